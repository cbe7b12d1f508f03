import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import lemmas


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr("x").alias("y")).first()["y"]


@pytest.mark.parametrize("body, want", [
    (None, ""),
    ("<b>Hello</b> WORLD https://a.b/c?d www.x.y mail me.now@site.org now", "hello world mail now"),
    ("Price: $5 €6", "price 5 6"),
    ("  a b\tc ", "a b c"),
    ("The Protocol: news", "news"),
])
def test_clean_text(spark, body, want):
    assert one(spark, body, lambda c: text.clean_text(c, text.COLUMN_PHRASES)) == want


def test_clean_text_is_idempotent(spark):
    body = "<p>Ünï</p> x@y.com — 12.5% of THE market analysis"
    once = one(spark, body, text.clean_text)
    assert one(spark, once, text.clean_text) == once


def test_terms_prefer_list_order_and_whole_words(spark):
    terms = text.flatten_terms(text.MARKET_TERMS)
    assert one(spark, "latest price moves", lambda c: text.remove_terms(c, terms)) == "  moves"
    assert one(spark, "bullish ébull bull", lambda c: text.remove_terms(c, ["bull"])) == "bullish ébull "
    assert one(spark, None, lambda c: text.remove_terms(c, ["x"])) is None
    assert one(spark, "same", lambda c: text.remove_terms(c, [])) == "same"


def _applied_patterns(spark, expr):
    """The plan's text: which patterns stand under a condition."""
    df = spark.createDataFrame([("x",)], "x string").select(expr("x").alias("y"))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_clean_text_reads_past_texts_without_signs(spark):
    plan = _applied_patterns(spark, text.clean_text)
    assert all(f", {sign})" in plan and "Contains(" in plan for sign in ("<", "http", "www.", "@"))
    # Terms and dates are tried only where one can start.
    assert "(?=[bt])" in _applied_patterns(spark, lambda c: text.remove_terms(c, ["the", "bull"]))
    assert "(?=[0-9jfmasond])" in _applied_patterns(spark, text.remove_dates)


@pytest.mark.parametrize("terms", [["the", "the end", "été"], ["c++", "a b"], [".net", "the"], ["", "x"], ["_a", "9"]])
def test_terms_are_cut_at_the_same_edges(spark, terms):
    bodies = ["the end of été", "c++ a b c+++", "x.net .net the.net", "xx x x", "_a 9 99 a_a", "thé the_ the-end", "été étés", ""]
    plain = f"{text.EDGE}(?:{'|'.join(map(re.escape, terms))}){text.EDGE}"
    df = spark.createDataFrame([(b,) for b in bodies], "x string")
    for r in df.select(text.remove_terms("x", terms).alias("got"), F.regexp_replace("x", plain, "").alias("want")).collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize("body", [
    "on 2022-06-01 end", "01/06/2022 end", "1-6-22 end", "June 1, 2022 end", "1 June 2022 end", "march 14 end",
    "14 Mar. end", "in 2022 nothing",
])
def test_dates(spark, body):
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
    shapes = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
              month + r"\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\s+" + month + r",?\s+\d{4}",
              month + r"\s+\d{1,2}", r"\d{1,2}\s+" + month]
    want = re.sub("|".join(rf"\b{s}\b" for s in shapes), "", body, flags=re.I)
    assert one(spark, body, text.remove_dates) == want


def test_flags_and_starts(spark):
    df = spark.createDataFrame([("see <i>x</i> at www.a.b & mail a.b@c.io",), ("plain",), (None,)], "x string")
    rows = text.pattern_flags(df, ["x"]).select("x_has_html", "x_has_url", "x_has_email", "x_has_special_sign").collect()
    assert [tuple(r) for r in rows] == [(True,) * 4, (False,) * 4, (False,) * 4]
    hits = df.select(text.starts_with_any(F.concat(F.lit(" \n"), "x"), ["SEE", "zz"]).alias("h")).collect()
    assert [r["h"] for r in hits] == [True, False, False]


def test_html(spark):
    page = ("<!DOCTYPE html><head><title> T </title><style>p{}</style><script>var a='</p>';</script></head>"
            "<!-- c --><p> one <b>two</b>&nbsp;</p>&eacute;&#8364;&#x41;&unknown; R&amp;D 1 < 2")
    assert one(spark, page, text.html_text) == "Tonetwoé€A&unknown; R&D 1 < 2"
    assert one(spark, None, text.html_text) is None


def test_sentiment_cleaning(spark):
    assert one(spark, "Hi @Bob_1  see HTTPS://x.y/z\n now", text.clean_sentiment) == "hi @user see http now"


def test_tokens(spark):
    assert one(spark, "L'été, x_1 42!", text.word_tokens) == ["L", "été", "x_1", "42"]
    assert one(spark, None, text.word_tokens) == []
    assert one(spark, "A bc d_e 12", text.vocabulary_tokens) == ["bc", "d_e", "12"]
    assert one(spark, "a ab _cd ef2g " + "x" * 16, text.alphabetic_tokens) == ["ab", "ef"]
    assert one(spark, "One. Two!  Three?", text.split_sentences) == ["One.", "Two!", "Three?"]


def test_lemmas_and_embedding_text(spark):
    df = spark.createDataFrame([(1, "The markets rallied on March 14"), (2, ""), (3, None)], "idx_news long, title_desc string")
    table = spark.createDataFrame([("markets", "market"), ("rallied", "rally")], "token string, lemma string")
    out = {r[0]: r[1] for r in lemmas.prepare_embedding_text(df, lemmas=table).select("idx_news", "clean_emb_title_desc").collect()}
    assert out == {1: "market rally ", 2: "", 3: ""}


def test_suffix_lemmas(spark):
    df = spark.createDataFrame([("walk walking walked thing talks",)], "x string")
    assert {tuple(r) for r in lemmas.suffix_lemmas(df, "x").collect()} == {("walking", "walk"), ("walked", "walk")}


def test_tokens_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "walked the walk"), (1, "b"), (None, "walked"), (2, None), (3, "")], "k int, x string")
    table = spark.createDataFrame([("walked", "walk")], "token string, lemma string")
    out = lemmas.lemmatize(df, table, "k", "x")
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # Texts are dealt out by key before their tokens are: no shuffle stands above the explode.
    assert plan.index("Generate") < plan.index("REPARTITION_BY_NUM") and "ENSURE_REQUIREMENTS" not in plan
    assert {tuple(r) for r in out.collect()} == {(1, "b walk walk"), (None, "walk"), (2, ""), (3, "")}
