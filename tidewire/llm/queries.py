"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import chat, filter_audit, lm_scoring, lz_dedup, ngram_join, packing, pieces, pii, quality, sharding, suffix_dedup, vector_codes, vectors
from tidewire.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query
def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_dedup.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["rank"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), 0.98).select("vec_id", "n_links", "component_id", "kept")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), 75, 5).select("doc_id", "n_shingles", "component_id")


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

FILTERS = "ABCDE"


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = filter_audit.text_masks(read(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.with_labels(masked, read(spark, sf_dir, "labels")), FILTERS)


SQL["op13_filter_audit"] = r"""WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
seen AS MATERIALIZED (
  SELECT words.doc_id, part, CAST(len(w) < 100 AS INT) AS fa,
         CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) AS fb,
         CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT) AS fc,
         CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS fd,
         CAST(coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text), false) AS INT) AS fe,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM words LEFT JOIN (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
                        FROM labels GROUP BY doc_id) l ON l.doc_id = words.doc_id),
masks AS MATERIALIZED (
  SELECT part, [fa, fb, fc, fd, fe] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM seen GROUP BY 1, 2),
f AS (SELECT unnest(range(1, 6)) AS i),
orders AS MATERIALIZED (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS MATERIALIZED (
  SELECT o, s.i AS step, o[s.i] AS own, list_slice(o, 1, s.i - 1) AS earlier,
         array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order FROM orders, f s),
counted AS MATERIALIZED (
  SELECT part, filter_order, step, any_value(own) AS own,
         sum(CASE WHEN fails[own] = 0 AND list_sum(list_transform(earlier, lambda x: fails[x])) IS NOT DISTINCT FROM (CASE WHEN step > 1 THEN 0 END) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails[own] = 1 AND coalesce(list_sum(list_transform(earlier, lambda x: fails[x])), 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails[own] = 1 AND list_sum(list_transform(earlier, lambda x: fails[x])) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[own] = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails[own] = 1 AND coalesce(list_sum(list_transform(earlier, lambda x: fails[x])), 0) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails[own] = 1 AND coalesce(list_sum(list_transform(earlier, lambda x: fails[x])), 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    rows = vector_codes.with_label_errors(coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS m
  FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)"""
        )
        if r < rounds:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(any_value(n.c), any_value(b.c)) AS c FROM b{r} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, m.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
      FROM a{r} JOIN parts USING (vec_id, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL)
    GROUP BY p, e) n ON n.p = b.p AND n.e = b.e GROUP BY b.p, b.e)"""
            )
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM kept, (SELECT unnest(range(0, 8)) AS p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INT)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


SQL["op12_vector_codes"] = _codes_sql()


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null doc_id counts as an empty text: its checksum is 0.
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    scored = lm_scoring.score(read(spark, sf_dir, "documents"), ~held_out, lower=True)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
