"""Queries: text, time and language functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query, r6, s6, sstamp, stamp, table
from tidewire.catalog.views import NEWS_SQL, SENT, news
from tidewire.functions import clock, text
from tidewire.functions.vectors import softmax
from tidewire.operators import language, lemmas, sentiment

# SQL spellings. RE2 has no look-around, so words are first wrapped in \x01 marks:
# a term then matches exactly where whole words meet it, accents included.
MARK = "\x01"
W = r"[\p{L}\p{N}_]"
S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def sub(expr: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', '{flags}')"


def sql_remove_terms(expr: str, terms: list[str]) -> str:
    import re

    def wrapped(term: str) -> str:
        parts = re.split(r"(\w+)", term)
        return "".join(MARK + p + MARK if re.fullmatch(r"\w+", p) else re.escape(p) for p in parts if p)

    marked = sub(expr, f"({W}+)", f"{MARK}\\1{MARK}")
    return f"replace({sub(marked, '|'.join(map(wrapped, terms)))}, '{MARK}', '')"


def sql_clean(expr: str, terms: list[str] = ()) -> str:
    out = f"lower(coalesce({expr}, ''))"
    if terms:
        out = sql_remove_terms(out, list(terms))
    out = sub(out, "<[^>]+>", " ")
    out = sub(out, rf"https?://{NS}+|www\.{NS}+", " ")
    out = sub(out, rf"\b[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.{W}{{2,4}}\b", " ")
    return f"trim({sub(out, '[^a-z0-9]+', ' ')})"


def sql_dates(expr: str) -> str:
    m = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
    shapes = [
        r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
        rf"{m}{S}+\d{{1,2}},?{S}+\d{{4}}", rf"\d{{1,2}}{S}+{m},?{S}+\d{{4}}",
        rf"{m}{S}+\d{{1,2}}", rf"\d{{1,2}}{S}+{m}",
    ]
    return sub(expr, "|".join(rf"\b{s}\b" for s in shapes), "", "gi")


DATA_TERMS = text.flatten_terms([text.MARKET_TERMS, "of the", "and the", "the", "für", "été"])
TERMS_FOR_FEED = text.COLUMN_PHRASES + ["the of", "and the"]


@query("clean_text", f"""SELECT doc_id, {sql_clean('text')} AS clean,
  {sql_clean('text', TERMS_FOR_FEED)} AS clean_terms FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.clean_text("text").alias("clean"),
        text.clean_text("text", TERMS_FOR_FEED).alias("clean_terms"),
    )


@query("remove_terms", f"SELECT doc_id, {sql_remove_terms('lower(text)', DATA_TERMS)} AS cut FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.remove_terms(F.lower("text"), DATA_TERMS).alias("cut"))


# The event time is written into the text so that every document holds dates.
@query("remove_dates", f"""WITH {NEWS_SQL}
SELECT idx_news, {sql_dates("strftime(date, '%Y-%m-%d') || ' ' || title_desc || ' ' || strftime(date, '%-d %B %Y') || ' x ' || strftime(date, '%b %d')")} AS cut FROM news""")
def _(spark, d):
    body = F.concat_ws(
        " ", F.date_format("date", "yyyy-MM-dd"), "title_desc", F.date_format("date", "d MMMM yyyy"),
        F.lit("x"), F.date_format("date", "MMM dd"),
    )
    return news(spark, d).select("idx_news", text.remove_dates(body).alias("cut"))


def _flag_sql(c: str) -> str:
    rules = {
        "html": "<[^>]+>", "url": rf"https?://{NS}+|www\.{NS}+",
        "email": rf"\b[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.{W}{{2,4}}\b", "special_sign": "[$%@#&*]",
    }
    return ", ".join(f"coalesce(regexp_matches({c}, '{p}'), false) AS {c}_has_{n}" for n, p in rules.items())


@query("pattern_flags", f"""SELECT 'd' AS origin, doc_id AS id, {_flag_sql('text')} FROM documents
UNION ALL SELECT 'p', page_id, {_flag_sql('text')} FROM (SELECT page_id, html AS text FROM pages)
UNION ALL SELECT 'u', page_id, {_flag_sql('text')} FROM (SELECT page_id, url AS text FROM pages)""")
def _(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    rows = docs.select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), "text")
    rows = rows.union(pages.select(F.lit("p"), "page_id", "html")).union(pages.select(F.lit("u"), "page_id", "url"))
    return text.pattern_flags(rows, ["text"]).drop("text")


@query("starts_with_any", """SELECT doc_id, coalesce(starts_with(lower(ltrim(text)), 'the')
  OR starts_with(lower(ltrim(text)), 'en') OR starts_with(lower(ltrim(text)), 'in '), false) AS hit FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.starts_with_any("text", ["The", "En", "in "]).alias("hit"))


@query("clean_sentiment", f"""SELECT origin, id, trim({sub(sub(sub('lower(body)', f'@{W}+', '@user'), f'http{NS}+', 'http'), f'{S}+', ' ')}) AS clean
FROM (SELECT 'd' AS origin, doc_id AS id, text AS body FROM documents
      UNION ALL SELECT 'p', page_id, url || ' ' || html FROM pages)""")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = table(spark, d, "pages").select(F.lit("p"), "page_id", F.concat_ws(" ", "url", "html"))
    return rows.union(pages).select("origin", "id", text.clean_sentiment("body").alias("clean"))


@query("word_tokens", f"""SELECT conv_id, turn, len(t) AS n, array_to_string(t, '|') AS tokens
FROM (SELECT conv_id, turn, regexp_extract_all(text, '{W}+') AS t FROM conversations)""")
def _(spark, d):
    t = text.word_tokens("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(t).cast("bigint").alias("n"), F.array_join(t, "|").alias("tokens"))


@query("sentence_split", f"""SELECT conv_id, turn, i - 1 AS i, s AS sentence FROM (
  SELECT conv_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
    SELECT conv_id, turn, list_filter(string_split({sub('text', f'([.!?]){S}+', chr(92) + '1' + MARK)}, '{MARK}'), lambda x: length(x) > 0) AS p
    FROM conversations))""")
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(text.split_sentences("text")).alias("i", "sentence")
    ).withColumn("i", F.col("i").cast("bigint"))


# Only the references that occur in the pages are spelled out in the SQL.
@query("html_text", f"""SELECT page_id, array_to_string(list_transform(string_split(
  {sub(sub('html', r'<!--.*?-->|<script' + chr(92) + r'b[^>]*>.*?</script' + chr(92) + r's*>|<style' + chr(92) + r'b[^>]*>.*?</style' + chr(92) + 's*>', MARK, 'gis'), '<[!?/]?[A-Za-z][^>]*>', MARK)}, '{MARK}'),
  lambda x: {sub("replace(replace(replace(replace(x, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', chr(34)), '&amp;', '&')", f'^{S}+|{S}+$')}), '') AS body
FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text("html").alias("body"))


LEMMA_SQL = f"""cleaned AS (SELECT doc_id, {sql_clean('text')} AS c FROM documents),
toks AS (SELECT doc_id, unnest(string_split(c, ' ')) AS token, generate_subscripts(string_split(c, ' '), 1) AS i FROM cleaned),
vocab AS (SELECT DISTINCT token FROM toks WHERE token <> ''),
lem AS (SELECT token, lemma FROM (SELECT token, CASE
    WHEN token LIKE '%ing' AND length(token) >= 6 THEN left(token, length(token) - 3)
    WHEN token LIKE '%ed' AND length(token) >= 5 THEN left(token, length(token) - 2)
    WHEN token LIKE '%ly' AND length(token) >= 5 THEN left(token, length(token) - 2)
    WHEN token LIKE '%s' AND length(token) >= 4 THEN left(token, length(token) - 1) END AS lemma FROM vocab)
  WHERE lemma IN (SELECT token FROM vocab)),
lemmatized AS (SELECT c.doc_id, coalesce(t.lemmas, '') AS lemmas FROM cleaned c LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY i) AS lemmas
  FROM toks LEFT JOIN lem USING (token)
  WHERE token <> '' AND token NOT IN ({', '.join(f"'{w}'" for w in text.STOP_WORDS)}) GROUP BY doc_id) t USING (doc_id))"""


@query("lemmatize", f"WITH {LEMMA_SQL} SELECT * FROM lemmatized")
def _(spark, d):
    docs = table(spark, d, "documents")
    clean = docs.select("doc_id", text.clean_text("text").alias("c"))
    return lemmas.lemmatize(clean, lemmas.suffix_lemmas(docs, "text"), "doc_id", "c")


@query("clean_emb_text", f"""WITH {LEMMA_SQL}
SELECT doc_id, {sql_dates(sql_remove_terms('lemmas', text.flatten_terms(text.MARKET_TERMS)))} AS clean_emb_text FROM lemmatized""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = lemmas.prepare_embedding_text(docs, "text", lemmas=lemmas.suffix_lemmas(docs, "text"), key="doc_id")
    return out.select("doc_id", "clean_emb_text")


# Feed dates in four spellings, chosen by event type; 'view' is unreadable.
@query("parse_dates", f"""WITH raw AS (SELECT event_id, CASE event_type
    WHEN 'click' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') WHEN 'purchase' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0230')
    WHEN 'view' THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s FROM events),
cut AS (SELECT event_id, regexp_replace(s, '^[A-Za-z]{{3}}, ', '') AS s FROM raw)
SELECT event_id, {sstamp("coalesce(try_strptime(regexp_replace(s, ' [+-][0-9]{4}$', ''), '%d %b %Y %H:%M:%S') - CASE WHEN s LIKE '% +0230' THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END, try_strptime(s, '%Y-%m-%d %H:%M:%S'))")} AS parsed FROM cut""")
def _(spark, d):
    kind = F.col("event_type")
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    raw = (
        F.when(kind == "click", F.concat(rfc, F.lit(" +0000")))
        .when(kind == "purchase", F.concat(rfc, F.lit(" +0230")))
        .when(kind == "view", F.col("props"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return table(spark, d, "events").select("event_id", stamp(clock.parse_feed_date(raw)).alias("parsed"))


@query("to_datetime", f"""WITH raw AS (SELECT event_id, event_type, ts, epoch(ts) AS secs FROM events)
SELECT event_id,
  {sstamp("CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END")} AS mixed,
  {sstamp("date_trunc('hour', (CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END) - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR")} AS mixed_ceil,
  {sstamp("date_trunc('second', ts)")} AS epoch FROM raw""")
def _(spark, d):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = table(spark, d, "events").select(
        "event_id", raw.alias("mixed"), raw.alias("mixed_ceil"), F.unix_timestamp("ts").alias("epoch"))
    out = clock.to_datetime(rows, "mixed")
    out = clock.to_datetime(out, ["mixed_ceil"], timeframe="hour", round=True)
    out = clock.to_datetime(out, "epoch", date_format=False)
    return out.select("event_id", *[stamp(c).alias(c) for c in ("mixed", "mixed_ceil", "epoch")])


# The events of 2024-01 are spread over the year so that both clock changes occur.
PARIS_SQL = f"""WITH w AS (SELECT event_id, timestamp '2024-01-01' + to_microseconds(epoch_us(ts - timestamp '2024-01-01') * 12) AS wall FROM events)
SELECT event_id, {sstamp("wall")} AS wall, {sstamp('''CASE
  WHEN wall >= timestamp '2024-03-31 02:00:00' AND wall < timestamp '2024-03-31 03:00:00' THEN NULL
  WHEN wall >= timestamp '2024-10-27 02:00:00' AND wall < timestamp '2024-10-27 03:00:00' THEN NULL
  WHEN wall >= timestamp '2024-03-31 03:00:00' AND wall < timestamp '2024-10-27 02:00:00' THEN wall - INTERVAL 2 HOUR
  ELSE wall - INTERVAL 1 HOUR END''')} AS utc FROM w"""


@query("paris_to_utc", PARIS_SQL)
def _(spark, d):
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    wall = F.timestamp_micros(start + (F.unix_micros("ts") - start) * 12)
    rows = table(spark, d, "events").select("event_id", wall.alias("wall"))
    return rows.select("event_id", stamp("wall").alias("wall"), stamp(clock.paris_to_utc("wall")).alias("utc"))


@query("ceil_minute", f"SELECT event_id, {sstamp(chr(100) + 'ate_trunc(' + chr(39) + 'minute' + chr(39) + ', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 MINUTE')} AS t0 FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", stamp(clock.ceil_to("ts", "minute")).alias("t0"))


# --- language -------------------------------------------------------------------

@query("lang_filter", f"WITH {NEWS_SQL} SELECT idx_news, lang FROM news WHERE lang = 'en'")
def _(spark, d):
    return language.keep_language(news(spark, d), "en", lang="lang").select("idx_news", "lang")


@query("lang_detect", """WITH chars AS (SELECT doc_id, lang, string_split(lower(text), '') AS c FROM documents),
grams AS (SELECT doc_id, lang, unnest(c) AS gram FROM chars
  UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM chars
  UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM chars),
per_doc AS (SELECT doc_id, lang, gram, count(*) AS n FROM grams WHERE gram <> '' GROUP BY ALL),
counts AS (SELECT lang, gram, sum(n) AS n FROM per_doc GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1),
vocab AS (SELECT DISTINCT gram FROM counts),
model AS (SELECT v.gram, t.lang, ln((coalesce(c.n, 0) + 1) / CAST(t.total + (SELECT count(*) FROM vocab) AS DOUBLE)) AS logp
  FROM vocab v CROSS JOIN totals t LEFT JOIN counts c ON c.gram = v.gram AND c.lang = t.lang),
scores AS (SELECT p.doc_id, m.lang, sum(p.n * m.logp) AS s FROM per_doc p JOIN model m USING (gram) GROUP BY ALL)
SELECT doc_id, lang AS detected FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return language.detect_language(docs, language.train_languages(docs, "text"), "doc_id", "text")


# --- sentiment ------------------------------------------------------------------

@query("sentiment_scores", f"""WITH {NEWS_SQL}, p AS (SELECT idx_news, feat_sent_negative AS neg, feat_sent_neutral AS neu,
  feat_sent_positive AS pos, -(feat_sent_negative * ln(feat_sent_negative + 1e-12) + feat_sent_neutral * ln(feat_sent_neutral + 1e-12)
  + feat_sent_positive * ln(feat_sent_positive + 1e-12)) AS e FROM news)
SELECT idx_news, {s6('pos - neg')} AS feat_sent_score, {s6('(pos - neg) / (1 - neu + 1e-12)')} AS feat_sent_score_biased_center,
  {s6('(pos - neg) / (pos + neg + 1e-12)')} AS feat_sent_score_sigmoid_adj, {s6('e')} AS feat_sent_entropy,
  {s6('(pos - neg) * (1 - e)')} AS feat_sent_score_entropy_adj FROM p""")
def _(spark, d):
    scored = sentiment.score_algebra(news(spark, d).select("idx_news", *SENT))
    return scored.select("idx_news", *[r6(c).alias(c) for c in scored.columns if c.startswith(("feat_sent_score", "feat_sent_entropy"))])


@query("softmax", f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS l FROM embeddings),
e AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS w FROM x)
SELECT vec_id, i - 1 AS i, {s6('p')} AS p FROM (SELECT vec_id, unnest(list_transform(w, lambda v: v / list_sum(w))) AS p, generate_subscripts(w, 1) AS i FROM e)""")
def _(spark, d):
    probs = softmax(F.col("embedding").cast("array<double>"))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(probs).alias("i", "p"))
    return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), r6("p").alias("p"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _step_sql(v: str, p: str, k: str, fade: float) -> str:
    push = f"(CASE WHEN {p} IN {_in(sentiment.INTENSIFIERS)} THEN 0.293 WHEN {p} IN {_in(sentiment.DAMPENERS)} THEN -0.293 ELSE 0 END * {fade})"
    moved = f"({v} + CASE WHEN {v} < 0 THEN -{push} ELSE {push} END)"
    return (f"CASE WHEN {p} IS NULL OR {k} IS NOT NULL THEN {v} WHEN {p} IN {_in(sentiment.NEGATIONS)} "
            f"OR contains({p}, 'n''t') THEN {moved} * -0.74 ELSE {moved} END")


# The valences come from the labelled documents: mean quality per word.
LEXICON_SQL = rf"""base AS (SELECT avg(quality) AS b FROM labels JOIN documents USING (doc_id)),
lexicon AS (SELECT term, 4 * (avg(quality) - (SELECT b FROM base)) AS valence FROM (
    SELECT l.quality, unnest(list_distinct(regexp_extract_all(lower(d.text), '{W}{{2,}}'))) AS term
    FROM documents d JOIN labels l USING (doc_id)) GROUP BY term HAVING count(*) >= 5),
terms AS (SELECT * FROM lexicon WHERE term NOT IN {_in(sentiment.INTENSIFIERS + sentiment.DAMPENERS)}),
pieces AS (SELECT doc_id, list_filter(string_split(trim({sub("coalesce(lower(text), '')", f'{S}+', ' ')}), ' '), lambda x: x <> '') AS p,
   least(length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')), 4) * 0.292 AS shout,
   length(regexp_replace(coalesce(text, ''), '[^?]', '', 'g')) AS asks FROM documents),
words AS (SELECT doc_id, shout + CASE WHEN asks > 3 THEN 0.96 WHEN asks > 1 THEN asks * 0.18 ELSE 0 END AS mark,
   list_transform(p, lambda x: CASE WHEN length(regexp_replace(x, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g')) <= 2 THEN x
     ELSE regexp_replace(x, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g') END) AS w FROM pieces),
placed AS (SELECT doc_id, list_position(w, 'but') AS but_at, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM words),
around AS (SELECT *, lag(term, 1) OVER o AS p1, lag(term, 2) OVER o AS p2, lag(term, 3) OVER o AS p3 FROM placed
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT a.*, t.valence AS v0, k1.term AS k1, k2.term AS k2, k3.term AS k3 FROM around a JOIN terms t USING (term)
  LEFT JOIN terms k1 ON k1.term = a.p1 LEFT JOIN terms k2 ON k2.term = a.p2 LEFT JOIN terms k3 ON k3.term = a.p3),
h1 AS (SELECT *, {_step_sql('v0', 'p1', 'k1', 1.0)} AS v1 FROM hits),
h2 AS (SELECT *, {_step_sql('v1', 'p2', 'k2', 0.95)} AS v2 FROM h1),
h3 AS (SELECT *, {_step_sql('v2', 'p3', 'k3', 0.9)} AS v3 FROM h2),
vals AS (SELECT doc_id, v3 * CASE WHEN but_at > 0 AND i < but_at THEN 0.5 WHEN but_at > 0 AND i > but_at THEN 1.5 ELSE 1 END AS v FROM h3),
sums AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS up,
  sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS down, count(*) FILTER (v <> 0) AS charged FROM vals GROUP BY 1),
joined AS (SELECT w.doc_id, mark, len(w.w) - coalesce(charged, 0) AS flat, coalesce(s, 0) AS s, coalesce(up, 0) AS up, coalesce(down, 0) AS down
  FROM words w LEFT JOIN sums USING (doc_id)),
marked AS (SELECT doc_id, flat, CASE WHEN s > 0 THEN s + mark WHEN s < 0 THEN s - mark ELSE s END AS s,
  CASE WHEN up > down THEN up + mark ELSE up END AS up, CASE WHEN down > up THEN down + mark ELSE down END AS down FROM joined)"""


@query("lexicon_sentiment", f"""WITH {LEXICON_SQL}
SELECT doc_id, round(coalesce(down / nullif(up + down + flat, 0), 0), 3) AS feat_sent_negative,
  round(coalesce(flat / nullif(up + down + flat, 0), 0), 3) AS feat_sent_neutral,
  round(coalesce(up / nullif(up + down + flat, 0), 0), 3) AS feat_sent_positive,
  round(s / sqrt(s * s + 15), 4) + CAST(0.0 AS DOUBLE) AS feat_sent_compound FROM marked""")
def _(spark, d):
    docs = table(spark, d, "documents")
    lexicon = sentiment.lexicon_from_labels(docs, table(spark, d, "labels"), "quality")
    out = sentiment.lexicon_sentiment(docs, lexicon, "doc_id", "text")
    return out.withColumn("feat_sent_compound", F.col("feat_sent_compound") + F.lit(0.0))
