import json

import pytest

from tidewire.sources import readers, writers


def test_csv_and_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x",\nnew', 1.5), (2, None, None)], "a int, b string, c double")
    writers.save_data(df, str(tmp_path / "c"), "csv")
    writers.save_data(df, str(tmp_path / "c"), "csv")
    got = readers.get_data(spark, str(tmp_path / "c"), "csv", "a int, b string, c double")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert [tuple(r) for r in readers.get_data(spark, str(tmp_path / "t.tsv"), "tsv", "a int, b string").collect()] == [(1, "x")]


def test_json_layouts(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"meta": {"n": 2}, "rows": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}))
    got = readers.get_data(spark, str(tmp_path / "w.json"), "json", "a int, b string", records="rows")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]
    (tmp_path / "col.json").write_text(json.dumps({"date": {"0": 60000, "1": 120000}, "open": {"0": 1.5, "1": None}}))
    got = readers.get_data(spark, str(tmp_path / "col.json"), "columns_json", "date timestamp, open double")
    assert [(r["row"], r["date"].minute, r["open"]) for r in got.orderBy("row").collect()] == [(0, 1, 1.5), (1, 2, None)]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    writers.save_data(df, str(tmp_path / "j"), "json")
    assert [tuple(r) for r in spark.read.schema("a int, b string").json(str(tmp_path / "j")).collect()] == [(1, "x")]


def test_bad_formats(spark, tmp_path):
    df = spark.range(1)
    for call in (lambda: readers.get_data(spark, "x", "xls"), lambda: writers.save_data(df, "x", "xls"),
                 lambda: writers.save_lines(spark, ["a"], "x", "doc"), lambda: readers.get_data(spark, "x", "csv")):
        with pytest.raises(ValueError):
            call()


def test_lines_and_partitions(spark, tmp_path):
    writers.save_lines(spark, ["a", 2], str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["2", "a"]
    df = spark.createDataFrame([(1, "Vader"), (2, "FinBert")], "a int, sent_model string")
    writers.save_model_output(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).filter("sent_model = 'Vader'")
    assert "PartitionFilters: [isnotnull(sent_model" in back._jdf.queryExecution().toString()
    assert [r["a"] for r in back.collect()] == [1]
    ids = readers.with_row_ids(df.select("a")).select("idx_news").collect()
    assert len({r[0] for r in ids}) == 2
