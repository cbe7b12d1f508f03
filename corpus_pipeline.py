"""A training-data pipeline over ``documents``: each stage applies one operator.

Every stage takes (spark, docs, sf_dir), works on all rows it gets and returns the
columns of documents; the last returns the packed pieces. ``run`` applies them in order,
storing each stage's rows in the shared checkpoint folder.

Null texts have no words and go in the first stage; an empty table stays empty; columns
other than those of documents are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import ngram_join, packing, pii, quality, suffix_dedup
from tidewire.llm.common import read, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, COLUMNS).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-grams the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS), 75, 5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 200 that start twice go; the documents stay."""
    return _documents(suffix_dedup.dedup(docs.select(*COLUMNS), text=True))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = pii.find(docs, COLUMNS)
    return _documents(found.withColumn("text", pii.redact(F.col("text"), F.col("spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    packed = packing.pack_documents(docs, VOCABULARY, 1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("personal data", redact),
    ("best-fit packing", pack),
]

#: Learned rules, a trained span classifier and the packing have no SQL; the tests compare
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
