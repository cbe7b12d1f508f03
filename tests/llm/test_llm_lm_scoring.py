"""PPM scores against a plain model with one dictionary per order."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import lm_scoring
from tidewire.llm.queries import QUERIES

DOCS = "doc_id long, text string, train boolean, block long, key int, n int"
ORDER = 4


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Plain:
    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            for context, symbol in self.steps(text):
                for k in range(ORDER + 1):
                    self.counts[context[ORDER - k :]][symbol] += 1

    @staticmethod
    def steps(text):
        line = [256] * ORDER + list(text.encode()) + [256]
        for i in range(ORDER, len(line)):
            yield tuple(line[i - ORDER : i]), line[i]

    def chance(self, context, symbol):
        out, gone = 1.0, set()
        for k in range(ORDER, -1, -1):
            seen = self.counts.get(context[ORDER - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in gone}
            total, kinds = sum(left.values()), len(left) if len(seen) < 257 else 0
            if symbol in left:
                return out * left[symbol] / (total + kinds)
            if kinds:
                out *= kinds / (total + kinds)
            gone |= set(seen)
        return out / (257 - len(gone))

    def log10(self, text):
        return sum(math.log10(self.chance(*step)) for step in self.steps(text))


def check(spark, rows, got):
    train = [lowered(r[1]) for r in rows if r[2]]
    model = Plain(train)
    tokens = Counter()
    for text in train:
        tokens.update([*re.findall(r"[^\x20\x09-\x0D]+", text), None])
    n, kinds = sum(tokens.values()), len(tokens)
    want = []
    for doc_id, text, is_train, *_ in rows:
        own = [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), None]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in own)
        want.append((doc_id, bool(is_train), len(own), sum(tokens[w] > 0 for w in own), n, base, len(lowered(text).encode()) + 1, model.log10(lowered(text))))
    key = lambda r: tuple(str(x) for x in (*r[:5], r[6], round(r[5], 6)))
    got = [tuple(r) for r in got]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[6] == w[6]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[7] == pytest.approx(w[7], rel=1e-9)


def texts(seed, n):
    rng = random.Random(seed)
    odd = [None, "", " \n ", "\x00\x00", "É世界 é", "One TWO two", "a" * 40]
    out = []
    for i in range(n):
        text = rng.choice(odd) if rng.random() < 0.3 else " ".join(rng.choice(["the", "cat", "Sat", "on", "mat", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))
        out.append((rng.choice([i, i, 5, None]), text, rng.choice([True, True, False, None]), 1, 2, 3))
    return out + out[:4]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_match_a_plain_model(spark, seed, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 300)
    rows = texts(seed, 60)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    check(spark, rows, lm_scoring.score(frame, F.col("train")).collect())


def test_long_texts_small_pieces_and_small_trie_tasks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", f"x{rng.randrange(500)}"]) for _ in range(1500)), i % 3 != 0, 1, 2, 3) for i in range(4)]
    assert lm_scoring.ORDER == ORDER
    frame = spark.createDataFrame(rows, DOCS).repartition(2)
    monkeypatch.setattr(lm_scoring, "CHUNK", 700)
    monkeypatch.setattr(lm_scoring, "LEAVES", 50)
    check(spark, rows, lm_scoring.score(frame, F.col("train")).collect())


def test_without_training_rows_and_without_rows(spark):
    rows = [(1, "ab c", False, 1, 2, 3), (2, None, None, 1, 2, 3)]
    got = lm_scoring.score(spark.createDataFrame(rows, DOCS), F.col("train")).collect()
    check(spark, rows, got)
    assert lm_scoring.score(spark.createDataFrame([], DOCS), F.col("train")).count() == 0


def test_chances_of_all_symbols_sum_to_one():
    rng = np.random.default_rng(1)
    key = np.unique(np.array([int(sum(int(rng.integers(0, 4)) << 9 * i for i in range(5))) for _ in range(300)], dtype=np.int64))
    n = rng.integers(0, 4, size=len(key))
    pairs = np.zeros((257, 257), dtype=np.int64)
    np.add.at(pairs, ((key >> 9) & 511, key & 511), n)
    trie = lm_scoring.Trie(key, n, pairs)
    for context in np.unique(key >> 9)[:40]:
        every = (int(context) << 9) + np.arange(257)
        assert (10.0 ** trie.log10(every)).sum() == pytest.approx(1.0)


def test_query_marks_held_out_documents_and_prefers_known_text(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_lm_scoring"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    bits = {h: sum(r.score for r in got if r.held_out == h) / sum(len(docs[r.doc_id].encode()) for r in got if r.held_out == h) for h in (True, False)}
    assert math.log10(1 / 257) < bits[True] < bits[False] < 0
