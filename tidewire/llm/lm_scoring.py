"""LM scoring: prediction by partial matching over bytes, with a trie learned from the corpus.

A text is bytes between edge symbols; each symbol is predicted from the ``ORDER`` before it. So
all that a text needs of the trie are its distinct (ORDER + 1)-grams, and a block of texts has few
of them for its length. Blocks post their grams with the counts from training texts; the sums
are the trie's leaves. Leaves under one pair of last context symbols lie in one task, which
has all longer contexts of these leaves, and works out each gram's probability once. The answers go back to the
blocks, which add them up. Word counts for the base score travel the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import symbols as sym
from tidewire.llm.common import discard, partitions, store, store_buckets
from tidewire.session import small

ORDER = 4
#: Symbols: 256 bytes and the edge of a text. Nine bits each, so a gram fits 45 bits.
EDGE, ALPHABET, BITS = 256, 257, 9
#: Bytes of text in a block (one longer text is a block), symbols looked at in one go.
BLOCK, CHUNK = 16 << 20, 1 << 18
#: Distinct grams per task of the trie: about 40 MB of tables in its worker.
LEAVES = 200_000
GRAM, WORD = 0, 1
LOW = (1 << BITS) - 1


def blocks(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, text, train, block: runs of rows of a partition with about ``BLOCK`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes = np.diff(sym.text_bytes(batch.column(1))[1]).tolist()
            own = []
            for n in sizes:
                if held and held + n > BLOCK:
                    now, held = now + 1, 0
                held += n
                own.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["doc_id", "text", "train", "block"])

    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, train boolean, block long")


def _lowered(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = sym.text_bytes(column)
    return (sym._LOWER[raw] if lower else raw), offsets


def _parts(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs [a, b) of texts with about ``CHUNK`` bytes, their bytes and offsets."""
    for a, b in sym.parts(sym.text_bytes(column)[1], CHUNK):
        yield a, b, *_lowered(column.slice(a, b - a), lower)


def grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (gram, number of its text) over all predicted symbols: each text's bytes and its end."""
    sizes = np.diff(offsets)
    stream = np.full(len(raw) + (ORDER + 1) * len(sizes), EDGE, dtype=np.uint16)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    stream[np.arange(len(raw)) + (ORDER + 1) * text + ORDER] = raw
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + ORDER + 1)
    place = np.arange(len(stream)) - np.repeat(np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1), sizes + ORDER + 1)
    for a in range(ORDER, len(stream), CHUNK):
        b = min(a + CHUNK, len(stream))
        part = stream[a - ORDER : b].astype(np.int64)
        gram = part[: b - a].copy()
        for i in range(1, ORDER + 1):
            gram <<= BITS
            gram |= part[i : i + b - a]
        real = place[a:b] >= ORDER
        yield gram[real], text[a:b][real]


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not sum(map(len, keys)):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys with their counts in training texts; keys of the others count nothing."""
    seen, n = np.unique(keys[train], return_counts=True)
    other = np.unique(keys[~train])
    return [seen, other], [n, np.zeros(len(other), dtype=np.int64)]


class Tally:
    """A block's distinct keys and their counts in training texts, piece by piece.

    Equal keys of the pieces fall together as soon as those added outgrow the distinct ones.
    """

    def __init__(self) -> None:
        self.keys, self.counts = [], []

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        fresh = _distinct(keys, train)
        self.keys += fresh[0]
        self.counts += fresh[1]
        if sum(map(len, self.keys[1:])) > max(len(self.keys[0]), CHUNK):
            key, n = _tally(self.keys, self.counts)
            self.keys, self.counts = [key], [n]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys, ascending, and their counts; the tally is empty then."""
        out = _tally(self.keys, self.counts)
        self.keys, self.counts = [], []
        return out


def posted(rows: DataFrame, lower: bool) -> DataFrame:
    """kind, key, block, n: each block's distinct grams and words and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {GRAM: Tally(), WORD: Tally()}

        def emit() -> Iterator[pa.RecordBatch]:
            for kind, tally in held.items():
                key, n = tally.taken()
                for a in range(0, len(key), CHUNK):
                    m = len(key[a : a + CHUNK])
                    columns = [pa.array(np.full(m, kind, dtype=np.int8)), pa.array(key[a : a + CHUNK]), pa.array(np.full(m, now)), pa.array(n[a : a + CHUNK])]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "key", "block", "n"])

        for batch in batches:
            block = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and block[a] != now:
                    yield from emit()
                now = int(block[a])
                train = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                for x, y, raw, offsets in _parts(batch.column(0).slice(a, b - a), lower):
                    own = train[x:y]
                    for gram, text in grams(raw, offsets):
                        held[GRAM].add(gram, own[text])
                    hashes, first = sym.word_hashes(raw, offsets)
                    held[WORD].add(hashes.view(np.int64), np.repeat(own, np.diff(first)))
        if now is not None:
            yield from emit()

    return rows.select("text", "train", "block").mapInArrow(run, "kind byte, key long, block long, n long")


class Trie:
    """Contexts of every order above the given leaves, with escape estimates and exclusion.

    A context with ``total`` symbols, ``kinds`` of them distinct, predicts a seen symbol with
    count / (total + kinds) and escapes to the next shorter context with kinds / (total +
    kinds). There all symbols of the longer context are excluded: they leave both sums. A
    context that was never seen is passed over. Below the empty context the symbols not yet
    excluded are equally likely. A context with all symbols never escapes.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> None:
        """``key``, ``n``: distinct leaves and training counts; ``pairs``: counts by last symbol and next one."""
        seen = n > 0
        self.levels = {}
        for k in range(ORDER, -1, -1):
            if k > 1:
                link, count = _tally([key[seen] & self.mask(k)], [n[seen]])
            else:
                table = pairs if k else pairs.sum(axis=0, keepdims=True)
                before, after = np.nonzero(table)
                link, count = before << BITS | after, table[before, after]
            context = link >> BITS
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(link) else np.zeros(0, dtype=np.int64)
            kinds = np.diff(np.r_[first, len(link)])
            total = np.add.reduceat(count, first) if len(first) else count
            self.levels[k] = (link, count.astype(float), context[first], total.astype(float), kinds.astype(float), first)
        self.shadow = {}
        for k in range(ORDER, 0, -1):
            link, first = self.levels[k][0], self.levels[k][5]
            below, count = self.levels[k - 1][:2]
            # A symbol after a context was seen after every shorter one.
            at = np.searchsorted(below, link & self.mask(k - 1))
            self.shadow[k] = np.add.reduceat(count[at], first) if len(first) else np.zeros(0)

    @staticmethod
    def mask(k: int) -> int:
        """The last ``k`` symbols of the context and the next symbol."""
        return (1 << BITS * (k + 1)) - 1

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of each gram's last symbol's probability after the symbols before it."""
        out, hidden, gone = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key))
        todo = np.arange(len(key))
        for k in range(ORDER, -1, -1):
            link, count, context, total, kinds, _ = self.levels[k]
            if not len(context) or not len(todo):
                continue
            want = key[todo] & self.mask(k)
            at = np.minimum(np.searchsorted(context, want >> BITS), len(context) - 1)
            known = context[at] == want >> BITS
            place = np.minimum(np.searchsorted(link, want), len(link) - 1)
            hit = link[place] == want
            left, fresh = total[at] - hidden[todo], kinds[at] - gone[todo]
            fresh = np.where(kinds[at] == ALPHABET, 0.0, fresh)
            now = todo[hit]
            out[now] += np.log10(count[place[hit]] / (left[hit] + fresh[hit]))
            miss = known & ~hit & (fresh > 0)
            out[todo[miss]] += np.log10(fresh[miss] / (left[miss] + fresh[miss]))
            down = known & ~hit
            if k:
                hidden[todo[down]] = self.shadow[k][at[down]]
            gone[todo[down]] = kinds[at[down]]
            todo = todo[~hit]
        out[todo] -= np.log10(ALPHABET - gone[todo])
        return out


def _leaf_values(leaves: DataFrame, tasks: int) -> DataFrame:
    """key, value: log10 probability of every posted gram. ``leaves``: key, n."""
    known = leaves.where("n > 0").groupBy(F.expr(f"key & {(1 << 2 * BITS) - 1}").alias("pair")).agg(F.sum("n").alias("n"))
    pairs = np.zeros((ALPHABET, ALPHABET), dtype=np.int64)
    # At most 257 * 257 rows.
    for pair, n in known.collect():
        pairs[pair >> BITS, pair & LOW] = n

    def answer(table: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        trie = Trie(key, n, pairs)
        value = np.concatenate([trie.log10(key[a : a + CHUNK]) for a in range(0, len(key), CHUNK)])
        del table, trie
        pa.default_memory_pool().release_unused()
        return pa.table({"key": key, "value": value})

    # The two symbols before the predicted one decide the task: their leaves have all longer contexts.
    last = F.expr(f"shiftright(key, {BITS}) & {(1 << 2 * BITS) - 1}")
    dealt = leaves.withColumn("task", F.pmod(F.xxhash64(last), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(lambda t: answer(t), "key long, value double")


def _add_up(texts: pa.Table, known: pa.Table, lower: bool, ends: int, total: int, below: float) -> pa.Table:
    """The scores of one block's texts from the answers for its grams and words."""
    table = {}
    for kind in (GRAM, WORD):
        own = known.select(["key", "value"]).filter(pc.equal(known.column("kind"), kind))
        key, value = own.column("key").to_numpy(), own.column("value").to_numpy()
        # A block posts each key once.
        order = np.argsort(key)
        table[kind] = key[order], value[order]
    del known, own, key, value, order
    pa.default_memory_pool().release_unused()
    column = texts.column("text").combine_chunks()
    m = len(column)
    model, plain = np.zeros(m), np.full(m, math.log10((ends + 0.5) / below))
    symbols, tokens, seen = np.zeros(m, dtype=np.int64), np.ones(m, dtype=np.int64), np.full(m, int(ends > 0))
    for a, b, raw, offsets in _parts(column, lower):
        key, value = table[GRAM]
        for gram, text in grams(raw, offsets):
            if not len(gram):
                continue
            # One sort brings equal grams of a text together; a text's number fits 19 bits.
            base = int(text[0])
            both = np.sort(gram.astype(np.uint64) << np.uint64(19) | (text - base).astype(np.uint64))
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            times, both = np.diff(np.r_[first, len(both)]), both[first]
            own, whose = (both >> np.uint64(19)).astype(np.int64), (both & np.uint64((1 << 19) - 1)).astype(np.int64) + base
            change = np.r_[True, own[1:] != own[:-1]]
            found = value[np.searchsorted(key, own[change])][np.cumsum(change) - 1]
            model[a:b] += np.bincount(whose, weights=times * found, minlength=b - a)
            symbols[a:b] += np.bincount(whose, weights=times, minlength=b - a).astype(np.int64)
        hashes, first = sym.word_hashes(raw, offsets)
        key, value = table[WORD]
        kinds_, which = np.unique(hashes.view(np.int64), return_inverse=True)
        count = value[np.searchsorted(key, kinds_)][which] if len(hashes) else np.zeros(0)
        whose = np.repeat(np.arange(b - a), np.diff(first))
        plain[a:b] += np.bincount(whose, weights=np.log10((count + 0.5) / below), minlength=b - a)
        seen[a:b] += np.bincount(whose, weights=count > 0, minlength=b - a).astype(np.int64)
        tokens[a:b] += np.diff(first)
    return pa.table({
        "doc_id": texts.column("doc_id"), "train": texts.column("train"), "n_tokens": tokens,
        "n_known": seen, "train_tokens": np.full(m, total, dtype=np.int64), "base_score": plain, "n_symbols": symbols, "score": model,
    })


def score(docs: DataFrame, train: Column, lower: bool = True) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, n_symbols, score.

    The model and the word counts are learned from all rows where ``train`` holds (null: not).
    ``lower``: A-Z are lower-cased first. A null text is empty. ``score`` is the log10
    probability of the text's bytes and its end by prediction by partial matching. Tokens are
    the words and one end; ``base_score`` adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over them,
    c counting a token in the training texts, N all of those tokens (``train_tokens``), V the distinct ones;
    ``n_known`` has the tokens with c > 0. Without training rows all symbols are equally
    likely and N, V are 0. Every row counts and is scored, repeated ones and null ids too. Words
    are compared by 64-bit hashes. A text of one row must fit a task.
    """
    spark = docs.sparkSession
    # Bucketed by block, so that the texts need not move again when the answers come back.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = store_buckets(blocks(docs, train), "block", math.ceil(size / (2 * BLOCK)))
    posts = store(posted(rows, lower))
    counts = store(posts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    discard()
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    ends = rows.where("train").count()
    n, kinds = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n + ends, kinds + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    leaves = counts.where(F.col("kind") == GRAM).select("key", "n")
    tasks = max(partitions(spark), math.ceil(leaves.count() / LEAVES))
    # Distinct grams are few, but only their measured size decides whether they are broadcast.
    values = small(_leaf_values(leaves, tasks))
    asked = posts.select("kind", "key", "block")
    answers = asked.where(F.col("kind") == GRAM).join(values, "key").select("block", "kind", "key", "value").unionByName(
        asked.where(F.col("kind") == WORD).join(words, "key").select("block", "kind", "key", F.col("n").cast("double").alias("value"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, n_symbols long, score double"
    both = rows.groupBy("block").cogroup(answers.groupBy("block"))
    scored = store(both.applyInArrow(lambda texts, known: _add_up(texts, known, lower, ends, total, below), schema))
    discard(rows, posts, counts)
    return scored
