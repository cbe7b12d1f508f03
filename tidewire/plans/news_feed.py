"""From raw rows to cleaned, scored and embedded news."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tidewire.functions import text
from tidewire.operators import embed, feed, language, lemmas, sentiment


def clean(
    raw: DataFrame, lang: str | None = None, language_model: DataFrame | None = None,
    wanted: str = "en", terms: Iterable = text.COLUMN_PHRASES, *, source: str, author_prefixes: Iterable[str] = (),
) -> DataFrame:
    """Shape, keep one language, clean, drop repeats. ``raw`` carries ``idx_news``."""
    kept = ["idx_news", "date", "url", "author", "title", "subtitle", *([lang] if lang else [])]
    keep = None
    if lang or language_model is not None:
        keep = lambda df: language.keep_language(df, wanted, lang, language_model)
    return feed.clean_feed(feed.shape_feed(raw, kept, source=source, author_prefixes=author_prefixes), "title_desc", keep, terms)


def score(news: DataFrame, models: dict[str, Callable], col: str = "title_desc") -> DataFrame:
    return sentiment.score_feed(news, col, models)


def vectorize(
    news: DataFrame, methods: str | list[str], col: str = "title_desc", lemma_table: DataFrame | None = None,
    pca_k: int | None = 150, options: dict[str, dict] | None = None,
) -> DataFrame:
    """Embedding text, then one vector per article and method."""
    prepared = lemmas.prepare_embedding_text(news, col, lemmas=lemma_table)
    return embed.embed(prepared, f"clean_emb_{col}", methods, pca_k=pca_k, options=options)
