"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tidewire.llm import vector_codes
from tidewire.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int, code int, far string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]) for r in kept]
    width = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(books[p]))

    def assign():
        return [[nearest(r[1][p * width : (p + 1) * width], p) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            members = defaultdict(list)
            for r, g in zip(kept, got):
                members[g[p][1]].append(r[1][p * width : (p + 1) * width])
            for e, own in members.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, label = [], defaultdict(int)
    for r, g in zip(kept, assign()):
        out.append((r[0], "".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g), r[2]))
        label[r[2]] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, label[k]) for i, c, e, k in out), key=str), sha


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    coded, books = vector_codes.compress(frame, **options)
    got = vector_codes.with_label_errors(coded).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str), books


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    out = []
    for i in range(n):
        v = (base[rng.integers(0, 12)] + rng.normal(scale=rng.choice([0, 0.2]), size=16)).tolist()
        odd = rng.random()
        if odd < 0.05:
            v = None
        elif odd < 0.1:
            v[3] = None
        elif odd < 0.15:
            v[0] = [float("nan"), float("inf"), float("-inf")][rng.integers(0, 3)]
        elif odd < 0.2:
            v = [0.0] * 16
        out.append((int(rng.integers(0, 2 * n)) if odd > 0.3 else None, v, None if rng.random() < 0.4 else int(rng.integers(0, 3)), 1, "x"))
    return out + out[:10]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_match_plain_rounds(spark, seed):
    rows = rows_of(seed, 150)
    got, books = run(spark, rows)
    want, sha = plain(rows)
    assert got == want
    assert books.sha256() == sha
    assert len(books.compared) == 7


def test_salted_totals_without_a_broadcast(spark, monkeypatch):
    rows = rows_of(3, 60)
    monkeypatch.setattr(vector_codes, "small", lambda df: df)
    assert run(spark, rows)[0] == plain(rows)[0]


def test_active_scan_is_the_full_scan_with_fewer_distances():
    rng = np.random.default_rng(4)
    for _ in range(300):
        part = rng.integers(-3, 4, size=(40, 2))  # many ties
        before = rng.integers(-3, 4, size=(8, 2))
        after = before.copy()
        change = rng.random(8) < 0.3
        after[change] = rng.integers(-3, 4, size=(int(change.sum()), 2))
        moved = (after != before).any(axis=1)
        code, far = vector_codes.full_scan(part, before)
        code, far, taken = vector_codes.active_scan(part, after, moved, code, far)
        want, near = vector_codes.full_scan(part, after)
        assert (code == want).all() and (far == near).all()
        assert taken <= 40 * 8 and (moved.any() or taken == 0)


def test_settled_codebooks_cost_nothing(spark):
    rows = [(i, [float(i % 4)] * 8, 0, 1, "x") for i in range(64)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, ROWS), entries=4)
    assert coded.where("error != 0").count() == 0
    assert books.compared[0] == 64 * 8 * 4 and books.compared[-1] == 0


def test_few_rows_odd_lengths_and_nothing(spark):
    rows = [(1, [0.5] * 10, 1, 1, "x"), (2, [1.0] * 3, None, 1, "x"), (3, [], 1, 1, "x"), (4, [1e30], 1, 1, "x"), (5, None, 1, 1, "x")]
    got, books = run(spark, rows)
    assert [g[:3] for g in got] == [(1, "00" * 8, 0), (2, "01" * 5 + "00" * 3, 0), (3, "0202" + "01" * 3 + "00" * 3, 0)]
    assert books.entries.shape == (8, 3, 2)
    for nothing in ([], [(1, None, 1, 1, "x")]):
        assert run(spark, nothing)[0] == []


def test_query_keeps_every_finite_vector(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_vector_codes"](spark, sf)
    assert got.count() == vector_codes.finite(spark.read.parquet(f"{sf}/embeddings.parquet")).count()
    assert got.select("codebooks_sha256").distinct().count() == 1
