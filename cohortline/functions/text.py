"""Text clean-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: str | Column, *sentinels: str) -> Column:
    """Empty text, and any listed placeholder, becomes NULL."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(~value.isin("", *sentinels), value)


def normalize_text(c: str | Column) -> Column:
    """Lower case, outer blanks removed: names and e-mail addresses."""
    return F.trim(F.lower(F.col(c) if isinstance(c, str) else c))


def fill_missing(df: DataFrame, cols: Iterable[str], label: str = "Missing") -> DataFrame:
    """NULL becomes ``label``; the columns turn into text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(label)) for c in cols})


def list_items(c: str | Column, n: int, item: str = "<li>([^<]+)</li>") -> list[Column]:
    """First ``n`` list entries of an HTML fragment, trimmed, blank to NULL.

    Entry k is only found when k entries follow each other directly.
    """
    value = F.col(c) if isinstance(c, str) else c
    return [blank_to_null(F.trim(F.regexp_extract(value, item * k, k))) for k in range(1, n + 1)]
