import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import feed, language, market
from tidewire.operators.ordering import chrono_split, contiguous_folds, last_marked, number_rows, previous_row, running_total
from tidewire.plans import news_feed

RAW = "idx_news long, date string, url string, author string, title string, subtitle string"


def test_clean_feed(spark):
    rows = [
        (0, "2024-01-01 00:00:02", "u", "Wire desk by A B", "Big ", "<p> News </p>"),
        (1, "2024-01-01 00:00:01", "u", None, "big", "news!"),
        (2, "2024-01-01 00:00:01", "u", "C", "Other", "x"),
        (3, "2024-01-01 00:00:01", "u", "C", "Third", "x"),
        (4, "2024-01-01 00:00:03", "u", "C", None, "x"),
    ]
    out = news_feed.clean(
        spark.createDataFrame(rows, RAW), source="Wire desk", author_prefixes=["Wire desk by"]).orderBy("idx_news").collect()
    # Row 1 is the text of row 0 but for the space; rows 2 and 3 share its time.
    assert [(r["idx_news"], r["title_desc"], r["author"]) for r in out] == [
        (0, "big news", " A B"), (1, "bignews", None), (4, "", "C")]
    assert {r["source"] for r in out} == {"Wire desk"}
    with pytest.raises(TypeError):
        feed.clean_feed(spark.range(1), 3)


def test_dedupe_keeps_the_first_row(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "")], "idx_news long, title_desc string")
    assert sorted(r[0] for r in feed.dedupe_text(df).collect()) == [1, 2, 5]


def test_contract_and_merge(spark, at):
    cols = "idx_news long, date timestamp, url string, author string, title string, subtitle string, source string, title_desc string"
    rows = [(1, at("2024-01-02 00:00:00"), "u", None, "t", "s", "c", "x"), (2, at("2024-01-01 00:00:00"), "u", "a", "t", "s", "c", "x")]
    a = spark.createDataFrame(rows, cols)
    b = a.withColumn("author", F.when(F.col("idx_news") == 2, "z").otherwise(F.col("author")))
    found = {r["check"]: r["violations"] for r in feed.feed_contract(a, b).collect() if r["violations"]}
    assert found == {"sent_date_sorted": 1, "emb_date_sorted": 1, "sent_text_unique": 1, "emb_text_unique": 1, "feed_author": 1}
    with pytest.raises(ValueError):
        feed.assert_contract(a, b)
    sent = a.withColumns({"clean_sent_title_desc": F.lit("s"), "feat_sent_score": F.lit(0.5)})
    emb = b.withColumns({"clean_emb_title_desc": F.lit("e"), "feat_emb_x_1": F.lit(1.0)})
    merged = feed.merge_features(sent, emb).collect()
    assert [r["idx_news"] for r in merged] == [1] and merged[0]["feat_emb_x_1"] == 1.0
    assert feed.without_prefix(emb, "feat_emb").columns[-1] == "clean_emb_title_desc"


def test_forward_return(spark, at):
    bars = spark.createDataFrame(
        [(at("2024-01-01 00:01:00"), 2.0), (at("2024-01-01 00:06:00"), 3.0), (at("2024-01-01 00:02:00"), 0.0),
         (at("2024-01-01 00:07:00"), 5.0), (at("2024-01-01 00:06:00"), 9.0)], "date timestamp, open double")
    news = spark.createDataFrame(
        [(1, at("2024-01-01 00:01:00")), (2, at("2024-01-01 00:00:00.000001")), (3, at("2024-01-01 00:01:00.5")),
         (4, at("2024-01-01 00:05:30"))], "idx_news long, date timestamp")
    out = market.add_forward_return(news, bars, 5)
    assert {r["idx_news"]: r["feat_ret_5min"] for r in out.collect()} == {1: 0.5, 2: 0.5, 3: None, 4: None}
    assert market.add_forward_return(news, bars, [5, 6], "target").columns[-2:] == ["target_5min", "target_6min"]
    with pytest.raises(TypeError):
        market.add_forward_return(news, bars, "5")


def test_order_helpers(spark):
    rng = np.random.default_rng(0)
    values = rng.permutation(101).tolist()
    df = spark.createDataFrame([(v, v % 7 == 0) for v in values], "v long, m boolean").repartition(5)
    assert [r["rn"] for r in number_rows(df, ["v"]).orderBy("v").collect()] == list(range(1, 102))
    prior = previous_row(df, ["v"], {"p": F.col("v")}).orderBy("v").collect()
    assert [r["p"] for r in prior] == [None] + list(range(100))
    marked = last_marked(df, ["v"], F.col("m"), F.col("v"), "last").orderBy("v").collect()
    assert [r["last"] for r in marked] == [v // 7 * 7 for v in range(101)]
    total = running_total(df, ["v"], F.col("v"), "s").orderBy("v").collect()
    assert [r["s"] for r in total] == [v * (v + 1) // 2 for v in range(101)]


@pytest.mark.parametrize("n, sizes", [(10, (6, 2, 2)), (11, (6, 2, 3))])
def test_splits(spark, n, sizes):
    df = spark.createDataFrame([(i, 100 - i) for i in range(n)], "idx_news long, date long")
    out = chrono_split(df, ["date", "idx_news"], "idx_news").orderBy("date").collect()
    assert tuple(sum(r["split"] == s for r in out) for s in ("train", "val", "test")) == sizes
    assert [r["rn"] for r in out] == list(range(1, n + 1))


def test_folds(spark):
    df = spark.createDataFrame([(i, i) for i in range(13)], "idx_news long, date long")
    out = contiguous_folds(df, ["date"], "idx_news").orderBy("idx_news").collect()
    assert [r["fold"] for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_language(spark):
    train = spark.createDataFrame(
        [("en", "the cat and the dog of the house"), ("fr", "le chat et le chien de la maison"),
         ("en", "this is the weather"), ("fr", "voici la météo du jour")], "lang string, text string")
    model = language.train_languages(train, "text")
    df = spark.createDataFrame([(1, "the dog"), (2, "la maison"), (3, "")], "idx_news long, title_desc string")
    found = {r[0]: r[1] for r in language.detect_language(df, model, "idx_news", "title_desc").collect()}
    assert found == {1: "en", 2: "fr"}
    assert [r[0] for r in language.keep_language(df, "en", model=model).collect()] == [1]
