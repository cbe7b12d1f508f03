"""The filter audit against a plain walk through every order."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewire.llm import filter_audit
from tidewire.llm.queries import FILTERS, QUERIES

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, good int"
LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def failing(rows):
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copied = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows)
        yield [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copied,
        ]


def plain(rows, labels):
    out = defaultdict(lambda: [0] * 7)
    docs = []
    for row, fails in zip(rows, failing(rows)):
        own = [x for x in labels if row[0] is not None and x[0] == row[0]]
        docs.append((row[2] or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    shapley = defaultdict(int)
    for part, fails, good, toxic in docs:
        for order in itertools.permutations(range(5)):
            gone = False
            for step, f in enumerate(order, 1):
                now = out[part, "".join(FILTERS[x] for x in order), step]
                now[0] += not gone and not fails[f]
                now[1] += fails[f] and not gone
                now[2] += fails[f] and gone
                now[3] += fails[f] and sum(fails) == 1
                now[4] += fails[f] and not gone and good
                now[5] += fails[f] and not gone and toxic
                shapley[part, f] += fails[f] and not gone
                gone = gone or fails[f]
    for (part, order, step), now in out.items():
        now[6] = shapley[part, FILTERS.index(order[step - 1])]
    return dict(out)


def rows_of(rng, n):
    langs = ["en", "fr", "", None]
    texts = [None, "", " \t\n", "#", "AB CD", "é" * 50, " ".join(["same"] * 200), " ".join(f"w{i}" for i in range(150)) + " |",
             " ".join(f"W{i}" for i in range(100)), "x y " * 120, " ".join(f"w{i % 80}" for i in range(100)), "word " * 30000]
    return [
        (None if rng.random() < 0.1 else int(rng.integers(0, 60)), texts[rng.integers(0, len(texts))], langs[rng.integers(0, 4)], "s", 7, "p", 1)
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [0, 1])
def test_audit_matches_a_walk_through_every_order(spark, seed):
    rng = np.random.default_rng(seed)
    rows = rows_of(rng, 160)
    rows += rows[:5]
    labels = [(None if rng.random() < 0.1 else int(rng.integers(0, 70)), *[[0, 1, None][rng.integers(0, 3)] for _ in range(2)], "x", 3) for _ in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    masked = filter_audit.with_labels(filter_audit.text_masks(docs), spark.createDataFrame(labels, LABELS))
    got = {
        (r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
        for r in filter_audit.audit(masked, FILTERS).collect()
    }
    assert got == plain(rows, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    masked = filter_audit.with_labels(filter_audit.text_masks(docs), labels)
    assert filter_audit.audit(masked, FILTERS).count() == 0


def test_many_parts_and_large_counts_do_not_run_over(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOLD", 3)
    most = 2**40 - 1
    rows = [(f"p{i % 20}", i % 4, True, i % 3 == 0, most) for i in range(200)]
    frame = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long").repartition(6)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(frame, "XY").collect()}
    assert len(got) == 20 * 4
    for (part, order, step), r in got.items():
        own = [x for x in rows if x[0] == part]
        f = "XY".index(order[step - 1])
        before = [x for x in own if step == 1 or not x[1] >> (1 - f) & 1]
        assert r.removed == sum(x[4] for x in before if x[1] >> f & 1)
        assert r.kept == sum(x[4] for x in before if not x[1] >> f & 1)
        assert r.toxic_lost == sum(x[4] for x in before if x[1] >> f & 1 and x[3])
        assert r.unique_fails == sum(x[4] for x in own if x[1] == 1 << f)


def test_query_has_all_steps(spark):
    got = QUERIES["op13_filter_audit"](spark, "/root/testdata/sf0.001")
    assert got.groupBy("part").count().where("count != 600").count() == 0
