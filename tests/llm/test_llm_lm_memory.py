"""LM scoring: what a block holds follows its distinct grams, not its length."""

import tracemalloc

import numpy as np

from tidewire.llm import lm_scoring as lm


def test_a_block_holds_its_distinct_keys(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 100)
    rng, tally, want, most = np.random.default_rng(0), lm.Tally(), {}, 0
    for _ in range(200):
        keys, train = rng.integers(0, 150, size=90), rng.random(90) < 0.5
        for k, t in zip(keys.tolist(), train.tolist()):
            want[k] = want.get(k, 0) + t
        tally.add(keys, train)
        most = max(most, sum(map(len, tally.keys)))
    # The pieces of 200 additions have over 15,000 keys.
    assert most <= 500
    key, n = tally.taken()
    assert dict(zip(key.tolist(), n.tolist())) == want and (np.diff(key) > 0).all()
    assert not len(tally.taken()[0])


def test_a_task_of_the_trie_holds_few_leaves():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 45, size=lm.LEAVES) & ~np.int64(0x100804020100))
    n = rng.integers(0, 3, size=len(key))
    pairs = np.zeros((lm.ALPHABET, lm.ALPHABET), dtype=np.int64)
    np.add.at(pairs, ((key >> lm.BITS) & lm.LOW, key & lm.LOW), n)
    tracemalloc.start()
    value = lm.Trie(key, n, pairs).log10(key)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(value).all() and most < 60e6
