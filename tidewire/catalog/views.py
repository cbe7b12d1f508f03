"""News, bars and vectors derived from the given tables, in Spark and in SQL.

Every document is an article. The events, in time order, are dealt out to the
documents in equal runs: a run gives its document the publication time (its first
event) and the sentiment shares (by event type). All rows of both tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.catalog.registry import table

AUTHOR_PREFIX = "Wire desk by"
SOURCE = "Wire desk"


def clock_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    run = -(-events.count() // docs.count())
    kind = F.col("event_type")
    return events.groupBy(F.floor(F.col("event_id") / run).alias("doc_id")).agg(
        F.min("ts").alias("date"),
        F.min_by("user_id", "event_id").alias("user_id"),
        F.avg((kind == "error").cast("double")).alias("feat_sent_negative"),
        F.avg(kind.isin("click", "view").cast("double")).alias("feat_sent_neutral"),
        F.avg(kind.isin("purchase", "signup").cast("double")).alias("feat_sent_positive"),
    )


SENT = ["feat_sent_negative", "feat_sent_neutral", "feat_sent_positive"]


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.join(clock_runs(spark, sf_dir), "doc_id").select(
        F.col("doc_id").alias("idx_news"),
        "date",
        F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("url"),
        F.concat(F.lit(f"{AUTHOR_PREFIX} user "), "user_id").alias("author"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substr(text, length(substring_index(text, '\n', 1)) + 1)").alias("subtitle"),
        F.lit(SOURCE).alias("source"),
        F.col("text").alias("title_desc"),
        "lang",
        *SENT,
    )


def article_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx_news, date): what the window operators need, and no text."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    runs = clock_runs(spark, sf_dir)
    return docs.join(runs, "doc_id").withColumnRenamed("doc_id", "idx_news")


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a vector and a given label; the vectors are dealt out in turn.
    Label 0 plays the noise."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    label = F.when(F.col("label") == 0, -1).otherwise(F.col("label"))
    return (
        article_clock(spark, sf_dir)
        .withColumn("vec_id", F.pmod("idx_news", F.lit(n)))
        .join(vectors.withColumn("label", label), "vec_id")
        .withColumn("embedding", F.col("embedding").cast("array<double>"))
        .drop("vec_id")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("minute", "ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.sum("value").alias("volume"),
    )


RUNS_SQL = """runs AS MATERIALIZED (
  SELECT event_id // (SELECT CAST(ceil((SELECT count(*) FROM events) / CAST((SELECT count(*) FROM documents) AS DOUBLE)) AS BIGINT)) AS doc_id,
         min(ts) AS date, arg_min(user_id, event_id) AS user_id,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS feat_sent_negative,
         avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END) AS feat_sent_neutral,
         avg(CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 ELSE 0.0 END) AS feat_sent_positive
  FROM events GROUP BY 1)"""
NEWS_SQL = f"""{RUNS_SQL},
news AS (
  SELECT d.doc_id AS idx_news, r.date, 'doc://' || d.source || '/' || d.doc_id AS url,
         '{AUTHOR_PREFIX} user ' || r.user_id AS author,
         split_part(d.text, chr(10), 1) AS title,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 1) AS subtitle,
         '{SOURCE}' AS source, d.text AS title_desc, d.lang,
         r.feat_sent_negative, r.feat_sent_neutral, r.feat_sent_positive
  FROM documents d JOIN runs r USING (doc_id))"""
VECTORS_SQL = """vectors AS MATERIALIZED (
  SELECT n.idx_news, n.date, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v,
         CASE WHEN e.label = 0 THEN -1 ELSE e.label END AS label,
         n.feat_sent_negative, n.feat_sent_neutral, n.feat_sent_positive
  FROM news n JOIN embeddings e ON e.vec_id = n.idx_news % (SELECT count(*) FROM embeddings))"""
BARS_SQL = """bars AS (
  SELECT date_trunc('minute', ts) AS date, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume
  FROM events GROUP BY 1)"""
