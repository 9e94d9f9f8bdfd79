"""Rates, shares, frequency tables and crosstabs.

All are one group-by: partial aggregation runs before the exchange, so a group
holding most of the rows costs one row per input task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.skew import as_list


def ratio(hits: Column, n: Column, digits: int = 3) -> Column:
    """Rounded rate; NULL over an empty denominator."""
    return F.round(F.try_divide(hits.cast("double"), n.cast("double")), digits)


def cohort_rates(
    df: DataFrame, by: str | Sequence[str], hits: Mapping[str, str], dated: Mapping[str, str] | None = None, digits: int = 3
) -> DataFrame:
    """Per cohort: starts, then hits and rate per flag column; first and last date per ``dated``.

    ``hits`` maps an output name to a 0/1 column; ``dated`` an output name to a date column.
    """
    n = F.count(F.lit(1))
    out = [n.alias("starts")]
    for name, c in hits.items():
        total = F.sum(F.col(c).cast("bigint"))
        out += [total.alias(name), ratio(total, n, digits).alias(f"{name}_rate")]
    for name, c in (dated or {}).items():
        out += [F.min(c).alias(f"first_{name}"), F.max(c).alias(f"last_{name}")]
    return df.groupBy(*as_list(by)).agg(*out).orderBy(*as_list(by))


def share_by_group(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """Percent of each value inside its group (NULL values are left out of the total).

    Totals are joined back rather than windowed, so that a group with very many values
    is never gathered in one task; both sides share the exchange of the counts.
    """
    keys = as_list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    names = {k: f"_g{i}" for i, k in enumerate(keys)}
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total")).withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(g)) for k, g in names.items()])
    percent = (F.col("n") / F.col("_total") * 100).alias("percent")
    return counts.join(totals, same).select(*keys, value, "n", percent)


def value_counts(df: DataFrame, *cols: str, order: str | None = None) -> DataFrame:
    """Frequency of each combination of values; NULL is a value."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *cols) if order == "n" else counts.orderBy(*cols) if order else counts


def crosstab(df: DataFrame, period: str, segment: str, values: Sequence[str], other: str = "Missing", total: str = "total") -> DataFrame:
    """Period by segment counts, with a column for every other segment and a total.

    NULL segments count under ``other``, so the columns add up to the total.
    """
    seg = F.col(segment)
    listed = F.coalesce(seg.isin(*values), F.lit(False))
    return (
        df.groupBy(period)
        .agg(
            *[F.count_if(seg == v).alias(v) for v in values],
            F.count_if(~listed).alias(other),
            F.count(F.lit(1)).alias(total),
        )
        .orderBy(period)
    )


def ever_flag(df: DataFrame, key: str | Sequence[str], hit: Column, name: str = "ever", within: Column | None = None, invert: bool = False) -> DataFrame:
    """1 if ``hit`` held on any row of the key inside the window, else 0.

    With ``invert`` the flag says the hit never happened.  Keys without a row inside
    the window are absent.
    """
    rows = df if within is None else df.where(within)
    yes, no = (0, 1) if invert else (1, 0)
    return rows.groupBy(*as_list(key)).agg(F.max(F.when(hit, 1).otherwise(0)).alias("_m")).select(
        *as_list(key), F.when(F.col("_m") == 1, yes).otherwise(no).alias(name)
    )


def any_prefix_flag(df: DataFrame, key: str | Sequence[str], text: str, prefixes: Sequence[str], name: str) -> DataFrame:
    """1 if any row's text starts with one of the prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(text).startswith(p)
    return ever_flag(df, key, hit, name)
