"""SentencePiece encoding and decoding by a lattice of vocabulary pieces.

The vocabulary at hand is of the BPE kind: its ids come from merges in order of score, and
the path with the best sum of scores is often another one. So the lattice keeps its shape
(bounded substrings, an equi-join to the piece table, edges grouped by word, one fold over
the positions), but the fold carries the last piece of each prefix and lets an edge follow
only where the merges could have left these two pieces side by side. Exactly one path is
left, the library's. Words are many and a join of all their occurrences would shuffle a
multiple of the corpus, so the relations are arrays over the distinct words of a batch.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm import symbols as sym

U = np.uint64
LONGEST = 16
NEVER = np.iinfo(np.int64).max


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * U(0x9E3779B97F4A7C15)) >> U(44)


@dataclass
class Pieces:
    """The piece table: hashes of the pieces (spaces for their marks), merge ranks and splits."""

    text: list[bytes]
    rank: np.ndarray  # merges made earlier are smaller; -1: a single character
    left: np.ndarray
    right: np.ndarray
    hashes: np.ndarray  # sorted, of pieces that an edge may be
    token: np.ndarray  # their ids
    pairs: np.ndarray  # sorted left * n + right of all merges
    pair_rank: np.ndarray
    bytes_: np.ndarray  # ids of the 256 byte pieces

    def __post_init__(self) -> None:
        # One look at a bit tells most misses before the search.
        self._some = np.zeros(1 << 20, dtype=bool)
        self._some[_slot(self.hashes)] = True
        self._pair = np.zeros(1 << 20, dtype=bool)
        self._pair[_slot(self.pairs.astype(U))] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 if there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self._some[_slot(hashes)])
        asked = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == asked, self.token[at], -1)
        return out

    @property
    def raw(self) -> int:
        """Stands for a character without a piece."""
        return len(self.text)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file; all models of byte fallback with a leading mark will do."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i).replace("▁", " ") for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        number = {names[i]: i for i in plain}
        scores = sorted({-model.get_score(i) for i in plain})
        order = {s: k for k, s in enumerate(scores)}
        rank = np.full(n + 1, -1, dtype=np.int64)
        for i in plain:
            if len(names[i]) > 1:
                rank[i] = order[-model.get_score(i)]
        left, right = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        pairs = {}
        edges = []
        for name, i in number.items():
            for cut in range(1, len(name)):
                a, b = number.get(name[:cut]), number.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = rank[i]
        for name, i in number.items():
            if len(name) == 1:
                edges.append(i)
            elif name.strip(" ") or name == " ":
                made, splits = merged(name, number, rank)
                if made == [i]:
                    edges.append(i)
                    left[i], right[i] = splits[i]
        spelled = [names[i].encode() for i in edges]
        raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        ends = np.cumsum([len(s) for s in spelled])
        hashes = sym.Runs(raw, np.array([0, len(raw)])).hashes(np.r_[0, ends[:-1]], ends)
        by_hash = np.argsort(hashes)
        keys = np.array(sorted(pairs), dtype=np.int64)
        bytes_ = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        text = [n_.encode() for n_ in names]
        for b, i in enumerate(bytes_):
            text[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                text[i] = b""
        return cls(text, rank, left, right, hashes[by_hash], np.array(edges)[by_hash], keys, np.array([pairs[k] for k in keys], dtype=np.int64), bytes_)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces, NEVER if there is none."""
        key = a * (len(self.text) + 1) + b
        out = np.full(len(key), NEVER)
        maybe = np.flatnonzero(self._pair[_slot(key.astype(U))])
        asked = key[maybe]
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        out[maybe] = np.where(self.pairs[at] == asked, self.pair_rank[at], NEVER)
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave ``a`` next to ``b``.

        Both pieces' merges are undone from the last one back; at no time may the two that
        then touch have been the better merge. Of equal merges the left one came first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NEVER)
        open_ = np.arange(len(a))
        while len(open_):
            x, y, most = a[open_], b[open_], limit[open_]
            bad = self.joined(x, y) < most
            good[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit[open_] = np.where(undo_left, rx, ry + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[~bad & (np.maximum(rx, ry) >= 0)]
        return good


def merged(word: str, number: dict[str, int], rank: np.ndarray) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Pieces of one word by merging, best first, and the parts each merge was made of."""
    parts, splits = list(word), {}
    while len(parts) > 1:
        ranked = [(rank[number[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in number]
        if not ranked:
            break
        _, i = min(ranked)
        splits[number[parts[i] + parts[i + 1]]] = (number[parts[i]], number[parts[i + 1]])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [number.get(p, -1) for p in parts], splits


def _words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches that no piece crosses: spaces with what follows, line ends."""
    space, line = raw == 32, raw == 10
    start = np.zeros(len(raw), dtype=bool)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    start[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(start)


class Known:
    """Words of a task encoded before, by hash; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.length = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        begin = np.r_[0, ends[:-1]]
        order = np.argsort(every := np.concatenate([self.hashes, hashes]))
        self.hashes = every[order]
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])[order]
        self.length = np.concatenate([self.length, ends - begin])[order]
        self.ids = np.concatenate([self.ids, ids])


def encode_batch(column: pa.Array, pieces: Pieces, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a string column and where each text's begin."""
    known = Known() if known is None else known
    if len(known.hashes) > known.most:
        known.clear()
    texts = [(" " + t).replace("▁", " ").encode() if t else b"" for t in column.to_pylist()]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    start = _words(raw, offsets)
    stop = np.r_[start[1:], len(raw)]
    runs = sym.Runs(raw, offsets)
    distinct, one, which = np.unique(runs.hashes(start, stop), return_index=True, return_inverse=True)
    new = one[known.find(distinct) < 0]
    if len(new):
        known.add(runs.hashes(start[new], stop[new]), *_lattice(runs, raw, start[new], stop[new], pieces))
    word = known.find(distinct)[which]
    length = known.length[word]
    index = np.arange(length.sum()) + np.repeat(known.begin[word] - (np.cumsum(length) - length), length)
    first = np.r_[0, np.cumsum(length)][np.searchsorted(start, offsets)]
    return known.ids[index], first


def _lattice(runs: sym.Runs, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, end to end, and where each word's end."""
    # Nodes: the character borders of every word, one more than its characters.
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    a, b = np.searchsorted(lead, start), np.searchsorted(lead, stop)
    chars = b - a
    base = np.r_[0, np.cumsum(chars + 1)[:-1]]
    word = np.repeat(np.arange(len(start)), chars)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(chars) - chars, chars)
    border = np.r_[lead, len(raw)]
    at = a[word] + nth
    # Explode substrings of up to LONGEST characters; equi-join them to the piece table.
    edges = []
    for size in range(1, LONGEST + 1):
        fits = nth + size <= chars[word]
        w, i, c = word[fits], nth[fits], at[fits]
        if not len(w):
            break
        hashes = runs.hashes(border[c], border[c + size])
        token = pieces.find(hashes)
        hit = token >= 0
        token[~hit] = pieces.raw
        keep = hit | (size == 1)
        edges.append((i[keep] + size, base[w[keep]] + i[keep], np.full(keep.sum(), size), token[keep]))
    end, source, size, token = (np.concatenate(x) for x in zip(*edges))
    order = np.argsort(end, kind="stable")
    end, source, size, token = end[order], source[order], size[order], token[order]
    # Fold over the positions: the last piece of every prefix.
    last = np.full(base[-1] + chars[-1] + 1, -2, dtype=np.int64)
    came = np.full(len(last), -1, dtype=np.int64)
    last[base] = -1
    cuts = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
    for x, y in zip(cuts, np.r_[cuts[1:], len(end)]):
        before, t, s = last[source[x:y]], token[x:y], source[x:y]
        ok = before == -1
        check = np.flatnonzero(before >= 0)
        ok[check] = pieces.side_by_side(before[check], t[check])
        node = (s + size[x:y])[ok]
        last[node], came[node] = t[ok], s[ok]
    # Back along the only path.
    node = base + chars
    _spaces(pieces, raw, start, stop, last, came, base, lead)
    steps = []
    going = np.arange(len(start))
    while len(going):
        steps.append((going, last[node[going]], came[node[going]]))
        node[going] = came[node[going]]
        going = going[node[going] > base[going]]
    owner = np.concatenate([g for g, *_ in steps])[::-1]
    token = np.concatenate([t for _, t, _ in steps])[::-1]
    place = np.concatenate([c for *_, c in steps])[::-1]
    order = np.argsort(owner, kind="stable")
    owner, token, place = owner[order], token[order], place[order]
    # A character without a piece is its bytes.
    character = a[owner] + place - base[owner]
    width = np.where(token == pieces.raw, border[np.minimum(character + 1, len(border) - 1)] - border[character], 1)
    out = np.repeat(token, width)
    inside = np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
    single = out == pieces.raw
    out[single] = pieces.bytes_[raw[(np.repeat(border[character], width) + inside)[single]]]
    counts = np.bincount(np.repeat(owner, width), minlength=len(start))
    return out.astype(np.int32), np.cumsum(counts)


def _spaces(pieces, raw, start, stop, last, came, base, lead) -> None:
    """Words behind several spaces: runs of spaces merge by place, not by rank, so such words
    are merged one by one and their path is put into the lattice."""
    several = np.flatnonzero((stop - start > 1) & (raw[start] == 32) & (raw[np.minimum(start + 1, len(raw) - 1)] == 32))
    if not len(several):
        return
    number = _numbers(pieces)
    for w in several.tolist():
        text = raw[start[w] : stop[w]].tobytes().decode()
        parts, _ = merged_long(text, number, pieces.rank)
        node = int(base[w])
        for piece in parts:
            came[node + len(piece)], last[node + len(piece)] = node, number.get(piece, pieces.raw)
            node += len(piece)


def _numbers(pieces: Pieces) -> dict[str, int]:
    known = getattr(pieces, "_number", None)
    if known is None:
        specials = set(pieces.bytes_.tolist())
        known = {t.decode("utf-8", "replace"): i for i, t in enumerate(pieces.text) if t and i not in specials and i > 2}
        pieces._number = known
    return known


def merged_long(word: str, number: dict[str, int], rank: np.ndarray) -> tuple[list[str], None]:
    """As ``merged``, with a heap: for words of any length."""
    import heapq

    n = len(word)
    part, after, before = list(word), [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (both := part[i] + part[j]) in number:
            heapq.heappush(heap, (int(rank[number[both]]), i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j < 0 or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [p for p in part if p], None


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: marks are spaces, the first one was put there by the encoder."""
    text = b"".join([pieces.text[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    A null or empty text has no ids. The marks U+2581 in a text count as spaces; strings of
    control pieces are ordinary text; a character without a piece becomes its bytes' pieces.
    Repeated rows are encoded alike, other columns are ignored. ``model`` is read on the
    driver; its table (fixed size) goes to the tasks.
    """
    pieces = Pieces.load(model)

    def run(batches):
        known = Known()
        for batch in batches:
            for a, b in sym.parts(sym.text_bytes(batch.column(1))[1], 8 * sym.CHUNK):
                ids, first = encode_batch(batch.column(1).slice(a, b - a), pieces, known)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text."""
    pieces = Pieces.load(model)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(np.array(x, dtype=np.int64), pieces) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (little-endian 32-bit ids), decoded_sha256 of every row."""
    pieces = Pieces.load(model)

    def run(batches):
        known = Known()
        for batch in batches:
            for a, b in sym.parts(sym.text_bytes(batch.column(1))[1], 8 * sym.CHUNK):
                ids, first = encode_batch(batch.column(1).slice(a, b - a), pieces, known)
                own = [ids[x:y] for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(x) for x in own], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], pa.string()),
                        pa.array([hashlib.sha256(decode_ids(x, pieces).encode()).hexdigest() for x in own], pa.string()),
                    ],
                    names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string")
