"""One row per key.

``row_number() = 1`` is planned as a per-partition limit before the exchange, so a
key with very many rows sends one row per input task, not all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.skew import as_list


def _keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_first(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], tie: str | Sequence[str] = ()) -> DataFrame:
    """Earliest row per key; ``tie`` columns (ascending) make the order total.

    Rows whose order value is NULL come last, so a dated row always wins.
    """
    cols = [F.col(c).asc_nulls_last() for c in as_list(order)]
    return _keep_one(df, as_list(keys), cols + [F.col(c).asc_nulls_last() for c in as_list(tie)])


def dedupe_last(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], tie: str | Sequence[str] = ()) -> DataFrame:
    """Latest or largest row per key; ``tie`` columns are descending too."""
    cols = [F.col(c).desc_nulls_last() for c in as_list(order)]
    return _keep_one(df, as_list(keys), cols + [F.col(c).desc_nulls_last() for c in as_list(tie)])


def latest_snapshot(df: DataFrame, date_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of the newest report date (optionally only ``cols``)."""
    newest = df.agg(F.max(date_col).alias(date_col))
    rows = df.join(F.broadcast(newest), date_col, "left_semi")  # one row
    return (rows.select(*cols) if cols else rows).distinct()
