"""Personal data: strict patterns, and weak labelers whose votes train a span classifier."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import let, store

# The four base patterns. The look-behind (or the end of the last match)
# only keeps the matcher from starting again inside a run that has already failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Leading zeros, then a number up to 255, or nothing if the zeros are the number.
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|(?<=0))"
#: Kinds in the order of ties; the last two come from the classifier.
KINDS = ("email", "ip", "card", "phone", "secret", "local_phone")
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"
LOCAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
#: Words that introduce such data (the gazetteer), matched in the characters before a span.
GAZETTEER = {
    "secret": ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth", "bearer", "credential"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telephone", "whatsapp", "contact"),
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
}
BEFORE = 24
LABELERS = ("pattern", "gazetteer", "context", "makeup", "length")


#: Values, and characters, of a piece: a row's work grows with its length times one piece.
STEP, PIECE = 256, 1024
MOST = 2**31 - 1


def _running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running sums, greatest or least values of an array of integers, itself included.

    An array that grows by one value at a time is copied each time, so pieces of ``STEP`` values are
    accumulated first, then the pieces' last values.
    """
    nothing = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("last"), nothing.alias("out"))

    def grow(acc: Column, last: Column, told: Column) -> Column:
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(told)).alias("out"))

    def pieces(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        return F.transform(every, lambda i: F.aggregate(
            F.slice(v, i * STEP + 1, F.lit(STEP)), start, lambda acc, x: grow(acc, op(acc["last"], x), op(acc["last"], x))))

    def together(parts: Column) -> Column:
        before = F.aggregate(parts, start, lambda acc, x: grow(acc, op(acc["last"], x["last"]), acc["last"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, before, lambda x, carried: F.transform(x["out"], lambda y: op(y, carried))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(pieces(v), together)).otherwise(nothing))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _cuts(text: Column) -> Column:
    """A text in pieces of ``PIECE`` characters: ``_part`` then never walks the text from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(cuts: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text cut by ``_cuts``."""
    first = F.floor(start / PIECE).cast("int")
    own = F.slice(cuts, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
    return F.when(end > start, F.array_join(own, "").substr(start - first * PIECE + 1, end - start)).otherwise("")


def _found(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches, left to right, in code points."""
    # Between two matches lies one piece: their lengths add up to the places.
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.filter(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda x: x["hit"].isNotNull())

    def placed(b: Column) -> Column:
        ends = _running(F.transform(b, lambda x: F.length(x["piece"]) + F.length(x["hit"])), _sum, 0)
        return F.zip_with(b, ends, lambda x, e: F.struct((e - F.length(x["hit"])).alias("start"), e.alias("end"), x["hit"].alias("hit")))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(none)


def _free(found: Column, base: Column) -> Column:
    """The matches that touch no base span.

    In order of their starts, a match touches a span that began before it and ends behind its
    start, or one that begins behind its start and before its end.
    """
    own = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("loose"), b["end"].alias("end"), F.lit("").alias("hit")))
    loose = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("loose"), x["end"].alias("end"), x["hit"].alias("hit")))

    def judged(line: Column) -> Column:
        ended = _running(F.transform(line, lambda x: F.when(x["loose"] == 0, x["end"]).otherwise(0)), F.greatest, 0)
        begins = F.transform(F.reverse(line), lambda x: F.when(x["loose"] == 0, x["start"]).otherwise(MOST))
        begun = F.reverse(_running(begins, F.least, MOST))
        every = F.arrays_zip(line.alias("x"), ended.alias("ended"), begun.alias("begun"))
        free = F.filter(every, lambda z: (z["x"]["loose"] == 1) & (z["ended"] <= z["x"]["start"]) & (z["begun"] >= z["x"]["end"]))
        return F.transform(free, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["hit"].alias("hit")))

    return F.when((F.size(found) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(own, loose)), judged)).otherwise(found)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""

    def value(i: Column, d: Column) -> Column:
        one = d.substr(F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * one).otherwise(one)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i, digits)) % 10 == 0


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _is_card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.when(_between(F.length(d), 14, 19), luhn(d)).otherwise(False))


VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": _is_card,
    "phone": lambda hit: _between(F.length(_digits(hit)), 10, 15),
}


def _spans(text: Column, kind: str) -> Column:
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    good = F.filter(_found(text, pattern), lambda x: VALID[kind](x["hit"]))
    return F.transform(good, lambda x: _span(x, kind))


def _span(x: Column, kind: str) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), x["hit"].alias("hit"))


def _votes(cuts: Column, span: Column, kind: str, base: bool) -> Column:
    """Each labeler says 1 (personal), -1 (not) or 0 (nothing to say)."""
    hit = span["hit"]
    before = F.lower(_part(cuts, F.greatest(span["start"] - BEFORE, F.lit(0)), span["start"]))
    names = "|".join(GAZETTEER[kind])
    if kind == "secret":
        mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
        pattern = F.when(hit.rlike("^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$") & mixed, 1).when(~mixed, -1).otherwise(0)
        makeup = F.when(~hit.rlike("[0-9]"), -1).when(F.length(_digits(hit)) * 5 >= F.length(hit), 1).otherwise(0)
        length = F.when(F.length(hit) >= 32, 1).when(F.length(hit) < 20, -1).otherwise(0)
        context = F.when(before.rlike("[=:]\\s*[\"']?$"), 1).otherwise(-1)
    else:
        pattern = F.lit(1 if base else 0)
        makeup = F.when(hit.rlike("[(@]"), 1).otherwise(0)
        length = F.when(_between(F.length(hit), 7, 40), 1).otherwise(-1)
        context = F.when(before.rlike("[:(<]\\s*$"), 1).otherwise(0)
    gazetteer = F.when(before.rlike(rf"(?:^|[^a-z])(?:{names})[^a-z]*$"), 1).otherwise(0 if kind != "secret" else -1)
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(LABELERS, (pattern, gazetteer, context, makeup, length))])


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with base spans and voted candidates of every row, texts left out."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("_text")).select(*keep, "_text", *[_spans(F.col("_text"), k).alias(k) for k in KINDS[:4]])
    t, own = F.col("_text"), F.col("_base")
    strict = base.withColumn("_base", F.array_sort(F.concat(*KINDS[:4]))).withColumns(
        {k: let(_found(t, p), lambda f: _free(f, own)) for k, p in (("secret", SECRET), ("local_phone", LOCAL_PHONE))})
    any_ = F.size("_base") + F.size("secret") + F.size("local_phone") > 0
    strict = strict.withColumn("_cuts", F.when(any_, _cuts(t)).otherwise(F.array().cast("array<string>")))
    cuts = F.col("_cuts")

    def loose(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(_span(x, kind).alias("span"), _votes(cuts, x, kind, False).alias("votes")))

    def sure(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x.alias("span"), _votes(cuts, x, kind, True).alias("votes")))

    slim = "array<struct<start:int,rank:int,end:int>>"
    pair = f"array<struct<span:struct<start:int,rank:int,end:int>,votes:struct<{','.join(f'{n}:int' for n in LABELERS)}>>>"

    def bare(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))

    every = F.concat(*map(sure, KINDS[:4]), loose("secret"), loose("local_phone"))
    return strict.select(
        *keep,
        F.transform(own, bare).cast(slim).alias("base"),
        F.transform(every, lambda c: F.struct(bare(c["span"]).alias("span"), c["votes"].alias("votes"))).cast(pair).alias("voted"),
    )


def fit(voted: DataFrame, rounds: int = 50) -> dict:
    """Labeler reliabilities by expectation maximisation, then a logistic span classifier.

    The corpus is counted into vote patterns (kinds x 3^labelers at most), so the driver
    iterates over a table that does not grow. Returns {"bias": ..., kind or (labeler,
    vote): weight}. Without candidates all weights are 0.
    """
    patterns = [
        (KINDS[r["rank"]], tuple(r[n] for n in LABELERS), r["n"])
        for r in voted.select(F.explode("voted").alias("c"))
        .groupBy(F.col("c.span.rank").alias("rank"), *[F.col(f"c.votes.{n}").alias(n) for n in LABELERS])
        .agg(F.count("*").alias("n")).collect()
    ]
    right = dict.fromkeys(LABELERS, 0.8)
    prior = {k: 0.5 for k in KINDS}
    belief: list[float] = []
    for _ in range(rounds):
        belief = []
        for kind, votes, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(v * math.log(right[name] / (1 - right[name])) for name, v in zip(LABELERS, votes))
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for i, name in enumerate(LABELERS):
            spoke = [(n, b if v[i] > 0 else 1 - b) for (_, v, n), b in zip(patterns, belief) if v[i]]
            right[name] = min(0.99, max(0.51, (4 + sum(n * b for n, b in spoke)) / (5 + sum(n for n, _ in spoke))))
        for kind in KINDS:
            own = [(n, b) for (k, _, n), b in zip(patterns, belief) if k == kind]
            prior[kind] = min(0.95, max(0.05, (1 + sum(n * b for n, b in own)) / (2 + sum(n for n, _ in own))))
    weights: dict = {"bias": 0.0, **dict.fromkeys(KINDS, 0.0), **{(n, v): 0.0 for n in LABELERS for v in (-1, 1)}}
    total = sum(n for *_, n in patterns)
    for _ in range(400):
        slope = dict.fromkeys(weights, 0.0)
        for (kind, votes, n), b in zip(patterns, belief):
            on = ["bias", kind, *[(name, v) for name, v in zip(LABELERS, votes) if v]]
            p = 1 / (1 + math.exp(-sum(weights[w] for w in on)))
            for w in on:
                slope[w] += math.sqrt(n / total) * (b - p)
        weights = {w: x + 0.2 * (slope[w] - 0.01 * x) for w, x in weights.items()}
    return weights


def score(candidate: Column, weights: dict) -> Column:
    """The classifier's log-odds for one voted candidate."""
    kind = F.element_at(F.array(*[F.lit(weights[k]) for k in KINDS]), candidate["span"]["rank"] + 1)
    total = F.lit(weights["bias"]) + kind
    for name in LABELERS:
        vote = candidate["votes"][name]
        total = total + F.when(vote > 0, weights[name, 1]).when(vote < 0, weights[name, -1]).otherwise(0.0)
    return total


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``base`` and ``spans``: arrays of (start, rank, end), rank into KINDS.

    Base spans always stay; the classifier adds the other candidates it believes. Places
    count code points, the end is exclusive. A null text has no spans. Every row is
    searched as a whole and on its own, repeated rows alike.
    """
    voted = store(candidates(docs, keep))
    weights = fit(voted)
    added = F.filter("voted", lambda c: (c["span"]["rank"] >= 4) & (score(c, weights) > 0))
    return voted.select(*keep, "base", F.array_sort(F.concat("base", F.transform(added, lambda c: c["span"]))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span put as its kind in brackets; of overlapping ones the first."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def put(cuts: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        at = _running(F.concat(F.array(F.lit(0)), ends), F.greatest, 0)  # one more than the spans

        def one(s: Column, done: Column) -> Column:
            word = F.concat(F.lit("["), F.upper(F.element_at(names, s["rank"] + 1)), F.lit("]"))
            return F.when(s["start"] < done, F.lit("")).otherwise(F.concat(_part(cuts, done, s["start"]), word))

        def joined(reached: Column) -> Column:
            before = F.slice(reached, F.lit(1), F.size(spans))
            last = F.element_at(reached, -1)
            rest = _part(cuts, last, F.length(text))
            return F.concat(F.array_join(F.zip_with(spans, before, one), ""), rest)

        return let(at, joined)

    return F.when(F.size(spans) > 0, let(_cuts(text), put)).otherwise(text)
