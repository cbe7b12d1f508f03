"""Plain versions of the operators, one document at a time."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text, out = text or "", []
    for rank, (pattern, good) in enumerate((
        (EMAIL, lambda h: True),
        (IP, lambda h: all(int(p) <= 255 for p in h.split("."))),
        (CARD, lambda h: 14 <= len(d := re.sub("[ -]", "", h)) <= 19 and luhn(d)),
        (PHONE, lambda h: 10 <= len(re.sub("[^0-9]", "", h)) <= 15),
    )):
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if good(m.group())]
    names = ("email", "ip", "card", "phone")
    counts = [sum(r == k for _, r, _ in out) for k in range(4)]
    return counts, sha(",".join(f"{names[r]}:{s}:{e}" for s, r, e in sorted(out)))


def byte_dedup(docs, width=200):
    """{doc: (n_bytes, n_removed, n_spans, sha)}; docs: {id: text}."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    seen = {}
    for b in data.values():
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def word_dedup(docs, width=50):
    """{doc: (n_words, n_removed, sha)}; docs: {id: text}."""
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, n=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs, percent=75):
    """{doc: (n_shingles, component)}; docs: {id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(d for d in sets if sets[d])
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = components(docs, links)
    return {d: (len(sets[d]), comp[d]) for d in docs}
