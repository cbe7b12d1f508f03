import pytest

from tidewire.operators import kernels


def _sides(spark):
    left = spark.range(400).selectExpr("id % 5 as window", "id % 3 as block", "id as node", "true as is_point")
    right = spark.range(15).selectExpr("id % 5 as window", "cast(id / 5 as bigint) as block", "-id as node", "false as is_point")
    return left, right


@pytest.mark.parametrize("partitions", [1, 4, 8, 64])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_halves_of_a_union_meet(spark, partitions, broadcast):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left, right = _sides(spark)
        sizes = left.groupBy("window").count()
        both = left.join(sizes, "window").drop("count").unionByName(right.join(sizes, "window").drop("count"))

        def count(key, table):
            points = table.column("is_point").to_numpy(zero_copy_only=False)
            return {"points": [int(points.sum())], "others": [int((~points).sum())]}

        frame = kernels.per_group(both, ["window", "block"], count, "window bigint, block bigint, points bigint, others bigint")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(window" in plan and "REPARTITION_BY_COL" in plan
        rows = frame.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 15 and all(r.others == 1 and r.points in (26, 27) for r in rows)
