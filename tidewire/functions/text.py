"""Text expressions. Every function maps columns to a column.

Word and space classes are spelled out instead of ``\\w``, ``\\b`` and ``\\s``,
whose reach differs between regex engines and JVM versions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# An edge in front of a word character, and one behind it.
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"

# The patterns of the feed's cleaning rules.
TAG = r"<[^>]+>"
URL = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
EMAIL = rf"{EDGE}[\p{{L}}\p{{N}}_.\-]++@[\p{{L}}\p{{N}}_.\-]+\.{WORD}{{2,4}}{EDGE}"
SPECIAL_SIGN = r"[$%@#&*]"

# Phrases that mark a recurring column and not its content.
COLUMN_PHRASES = [
    "the latest in blockchain tech upgrades, funding announcements and deals. for the period of",
    "the protocol",
    "protocol village",
    "first mover americas",
    "latest price moves crypto markets context",
    "latest blockchain tech upgrades funding announcements deals period",
    "market analysis",
]
# Trend words, then time words, then price words.
TREND_TERMS = [
    "bullish", "bearish", "bull", "bear", "crypto", "cryptocurrency", "tumbles", "slumps",
    "drops", "rallies", "rising", "falling", "dropping", "slumping", "surges", "plunges",
    "soars", "plummets", "tumbles",
]
TIME_TERMS = ["latest", "latest price moves", "daily price moves"]
PRICE_TERMS = ["price", "price moves", "price action", "price movements", "crypto market context"]
MARKET_TERMS = [TREND_TERMS, TIME_TERMS, PRICE_TERMS]

# The seven date shapes, most specific first.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATE_SHAPES = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    rf"{_MONTH}{SPACE}+\d{{1,2}},?{SPACE}+\d{{4}}",
    rf"\d{{1,2}}{SPACE}+{_MONTH},?{SPACE}+\d{{4}}",
    rf"{_MONTH}{SPACE}+\d{{1,2}}",
    rf"\d{{1,2}}{SPACE}+{_MONTH}",
]

STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being but by can "
    "could did do does for from had has have he her here him his how i if in into is it its "
    "just me more most my no nor not of on or other our out over she so some such than that "
    "the their them then there these they this those to too under up very was we were what "
    "when where which while who why will with would you your"
).split()


def flatten_terms(terms: Iterable) -> list[str]:
    """Nested term lists as one list, order kept."""
    return [t for item in terms for t in ([item] if isinstance(item, str) else flatten_terms(item))]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def remove_terms(c: Column | str, terms: Iterable) -> Column:
    """Delete whole-word terms; the earlier term wins where two could match."""
    terms = flatten_terms(terms)
    if not terms:
        return _col(c)
    either = "|".join(map(re.escape, terms))
    if not all(t and _plain(t[0]) and _plain(t[-1]) for t in terms):
        return F.regexp_replace(_col(c), f"{EDGE}(?:{either}){EDGE}", "")
    # Most places fail at their first character, before anything is looked at around them.
    first = "".join(sorted({t[0] for t in terms}))
    return F.regexp_replace(_col(c), f"(?=[{first}]){START}(?:{either}){END}", "")


def _plain(sign: str) -> bool:
    """A letter, number or underscore that stands for itself in a pattern's class."""
    return ord(sign) < 0x10000 and (sign == "_" or unicodedata.category(sign)[0] in "LN")


def remove_dates(c: Column | str) -> Column:
    # Every shape starts with a digit or with a month's first letter.
    return F.regexp_replace(_col(c), f"(?i)(?=[0-9jfmasond]){START}(?:{'|'.join(DATE_SHAPES)}){EDGE}", "")


def _replace(c: Column, pattern: str, by: str, *signs: str) -> Column:
    """``regexp_replace`` of a pattern whose matches hold one of ``signs``: texts without them stay unread."""
    def body(t: Column) -> Column:
        held = reduce(or_, (t.contains(s) for s in signs))
        return F.when(held, F.regexp_replace(t, pattern, by)).otherwise(t)

    return F.get(F.transform(F.array(c), body), F.lit(0))


def clean_text(c: Column | str, terms: Iterable = ()) -> Column:
    """Lower-case words and digits, one space apart; NULL becomes ''.

    Tags, URLs and e-mails go first, in that order. Currency signs need no pass
    of their own: they fall to the final ``[^a-z0-9]`` step like any other sign.
    """
    text = remove_terms(F.lower(F.coalesce(_col(c), F.lit(""))), terms)
    for pattern, signs in ((TAG, ["<"]), (URL, ["http", "www."]), (EMAIL, ["@"])):
        text = _replace(text, pattern, " ", *signs)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def clean_sentiment(c: Column | str) -> Column:
    """Lower case, mentions and links masked, white space squeezed."""
    text = F.regexp_replace(F.lower(_col(c)), f"@{WORD}+", "@user")
    return squeeze(F.regexp_replace(text, f"http{NOT_SPACE}+", "http"))


def starts_with_any(c: Column | str, sequences: Iterable[str]) -> Column:
    head = F.lower(F.regexp_replace(_col(c), f"^{SPACE}+", ""))
    hit = F.lit(False)
    for seq in sequences:
        hit = hit | head.startswith(seq.lower())
    return F.coalesce(hit, F.lit(False))


def pattern_flags(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Four boolean columns per text column; NULL text gives false."""
    rules = {"html": TAG, "url": URL, "email": EMAIL, "special_sign": SPECIAL_SIGN}
    return df.withColumns(
        {
            f"{c}_has_{name}": F.coalesce(F.col(c).rlike(rule), F.lit(False))
            for c in columns
            for name, rule in rules.items()
        }
    )


def word_tokens(c: Column | str) -> Column:
    tokens = F.regexp_extract_all(_col(c), F.lit(f"({WORD}+)"), F.lit(1))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def vocabulary_tokens(c: Column | str) -> Column:
    """Lower-case words of two or more characters (the TF-IDF tokens)."""
    tokens = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def alphabetic_tokens(c: Column | str, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case digit-free words of bounded length (the word2vec tokens)."""
    runs = F.regexp_extract_all(
        F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"([\p{L}\p{Nl}\p{No}_]+)"), F.lit(1)
    )
    return F.filter(
        runs,
        lambda t: (F.length(t) >= shortest) & (F.length(t) <= longest) & ~t.startswith("_"),
    )


def split_sentences(c: Column | str) -> Column:
    """Pieces that end in '.', '!' or '?' followed by white space."""
    pieces = F.split(_col(c), f"(?<=[.!?]){SPACE}+")
    return F.filter(pieces, lambda s: F.length(s) > 0)


def unescape_html(c: Column | str) -> Column:
    """Named (HTML 4) and numeric character references to characters."""
    names = F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, chr(v))])

    def code_point(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def reference(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        dec = F.regexp_extract(piece, r"^#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        rest = F.regexp_replace(piece, r"^#?[0-9A-Za-z]+;", "")
        number = F.coalesce(
            F.when(dec != "", dec.cast("bigint")),
            F.when(hexa != "", F.conv(hexa, 16, 10).cast("bigint")),
        )
        char = F.when(number.between(1, 0x10FFFF), code_point(number)).otherwise(
            F.try_element_at(names, name)
        )
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(_col(c), "&")
    unescaped = F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), reference), ""),
    )
    return F.when(_col(c).contains("&"), unescaped).otherwise(_col(c))


def html_text(c: Column | str) -> Column:
    """Text nodes of a page, each trimmed, joined without a separator.

    Comments, declarations and the content of script, style, template and ruby
    annotation elements are not text. NULL stays NULL.
    """
    mark = "\u0001"
    hidden = r"(?is)<!--.*?-->|<(script|style|template|rt|rp)\b[^>]*>.*?</\1\s*>"
    body = F.regexp_replace(F.regexp_replace(_col(c), hidden, mark), r"<[!?/]?[A-Za-z][^>]*>", mark)
    nodes = F.transform(
        F.split(body, mark),
        lambda s: F.regexp_replace(unescape_html(s), f"^{SPACE}+|{SPACE}+$", ""),
    )
    return F.array_join(nodes, "")
