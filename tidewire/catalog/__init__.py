"""Registered queries on the given tables, each with its SQL where SQL can say it."""

from tidewire.catalog import features, feeds, models, texts, windows  # noqa: F401
from tidewire.catalog.registry import QUERIES, SQL  # noqa: F401
