"""Checks on results: unique ids, kept rows, reconciliation, mismatches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.skew import as_list


def _value_counts(df: DataFrame, ids: Sequence[str], *groups: Column) -> tuple[DataFrame, list[str], Column]:
    """Rows per group, id column (``_which``) and value, the columns that hold the values, and whether a value is there.

    Every row is unpivoted to one narrow row per id, which are combined before they shuffle.  Values keep
    their type, in one column per type, so that they are told apart exactly.
    """
    types = [df.select(c).schema[0].dataType for c in ids]
    kinds = list(dict.fromkeys(types))
    values = [f"_v{j}" for j in range(len(kinds))]
    cells = [
        F.struct(F.lit(i).alias("_which"), *[(F.col(c) if t == kind else F.lit(None).cast(kind)).alias(v) for v, kind in zip(values, kinds)])
        for i, (c, t) in enumerate(zip(ids, types))
    ]
    narrow = df.select(*groups, F.explode(F.array(*cells)).alias("_cell"))
    keys = narrow.columns[: len(groups)]
    counted = narrow.select(*keys, "_cell.*").groupBy(*keys, "_which", *values).agg(F.count(F.lit(1)).alias("_rows"))
    return counted, values, reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])


def _id_counts(ids: Sequence[str], rows: str, unique: str) -> list[Column]:
    """Three columns per id from the counts of its non-NULL rows and values."""
    out = []
    for i, c in enumerate(ids):
        n, u = (F.coalesce(F.sum(F.when(F.col("_which") == i, F.col(x))), F.lit(0)) for x in (rows, unique))
        out += [n.alias(f"{c}_n"), u.alias(f"{c}_unique"), (n - u).alias(f"{c}_diff")]
    return out


def audit_unique(df: DataFrame, *ids: str) -> DataFrame:
    """Count, distinct count and their difference per id column, one row."""
    counted, _, there = _value_counts(df, ids)
    marked = counted.select("_which", F.when(there, F.col("_rows")).alias("_n"), F.when(there, 1).alias("_u"))
    return marked.agg(*_id_counts(ids, "_n", "_u"))


def audit_unique_rollup(df: DataFrame, group: str, *ids: str) -> DataFrame:
    """The same per group with a total row; ``is_total`` tells it from a NULL group.

    The total is taken from the values of the groups, not from a second copy of the rows.
    """
    counted, values, there = _value_counts(df, ids, F.col(group).alias("_group"))
    n, u = F.sum(F.when(there, F.col("_rows"))).alias("_n"), F.count_if(there).alias("_u")
    each = counted.groupBy("_group", "_which").agg(n, u).withColumn("is_total", F.lit(0))
    over = counted.groupBy("_which", *values).agg(F.sum("_rows").alias("_rows")).groupBy("_which").agg(n, u)
    total = over.withColumn("_group", F.lit(None).cast(df.select(group).schema[0].dataType)).withColumn("is_total", F.lit(1))
    both = each.unionByName(total).groupBy("_group", "is_total").agg(*_id_counts(ids, "_n", "_u"))
    return both.withColumnRenamed("_group", group)


def audit_composite(df: DataFrame, *keys: str) -> DataFrame:
    """Count and distinct count of a composite key; keys with a NULL part do not count."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(complete).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*keys)).alias("unique_n")
    )


def audit_join(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Labelled row and id counts on both sides of a join."""

    def line(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("unique_n")).withColumn("label", F.lit(label))

    return line(before, "Before Join").unionByName(line(after, "After Join"))


def per_period(df: DataFrame, period: Column, value: Column | None = None) -> DataFrame:
    """``period`` and ``n``: row counts, or the given aggregate, per reporting period."""
    total = F.count(F.lit(1)) if value is None else value
    return df.groupBy(period.alias("period")).agg(total.cast("bigint").alias("n"))


# The three ways the reports express a difference: against the official figure to a
# tenth of a percent, in whole percent, and as a share of our own figure.
PERCENT = {
    "tenth": lambda diff, ours, official: F.round(F.try_divide(diff, official), 3) * 100,
    "whole": lambda diff, ours, official: F.round(F.try_divide(diff, official) * 100, 0),
    "share": lambda diff, ours, official: F.round(F.try_divide(diff, ours), 2),
}


def reconcile(ours: DataFrame, official: DataFrame, percent: str = "tenth", as_of: date | None = None) -> DataFrame:
    """Compare two ``(period, n)`` series: counts, difference and percent per period.

    Periods on one side only are left out; with ``as_of`` so are open ones.
    """
    a = ours.withColumnRenamed("n", "n_etl")
    b = official.withColumnRenamed("n", "n_official")
    if as_of is not None:
        a, b = (df.where(F.col("period") < F.lit(as_of)) for df in (a, b))
    diff = F.col("n_etl") - F.col("n_official")
    return (
        a.join(b, "period")
        .withColumn("diff", diff)
        .withColumn("percent_diff", PERCENT[percent](*[c.cast("double") for c in (diff, F.col("n_etl"), F.col("n_official"))]))
        .orderBy(F.desc("period"))
    )


def compare_full(a: DataFrame, b: DataFrame, on: str, left: str, right: str, digits: int = 2) -> DataFrame:
    """Full outer comparison of two small count tables with the proportional difference."""
    gap = F.col(right).cast("double") - F.col(left).cast("double")
    return a.join(b, on, "full").withColumn("prop_diff", F.round(F.try_divide(gap, F.col(left).cast("double")), digits))


def compare_series(df: DataFrame, period: Column, filters: Mapping[str, Column]) -> DataFrame:
    """Counts under several filters side by side per period, in one pass.

    The first filter decides which periods appear.  A later one that matches nothing in
    a period is NULL there, as in a left join of separate counts.
    """
    names = list(filters)
    counts = [F.count_if(cond).alias(name) for name, cond in filters.items()]
    out = df.groupBy(period.alias("period")).agg(*counts).where(F.col(names[0]) > 0)
    return out.withColumns({n: F.nullif(F.col(n), F.lit(0)) for n in names[1:]}).orderBy("period")


def mismatch_rows(df: DataFrame, a: str, b: str, show: Sequence[str] = ()) -> DataFrame:
    """Rows whose two dates disagree, with the absolute gap in days.  Sort where it is shown."""
    keep = [*show, a, b]
    return df.where(F.col(a) != F.col(b)).select(*keep, F.abs(F.date_diff(F.col(a), F.col(b))).alias("difference"))


def negative_intervals(df: DataFrame, start: str, end: str, show: Sequence[str] = ()) -> DataFrame:
    """Rows that end before they start."""
    return df.where(F.col(end) < F.col(start)).select(*show, start, end)


def disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often two flags differ, by their values (rows with a NULL flag are not compared)."""
    return df.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, key: str | Sequence[str], more_than: int, day: str) -> DataFrame:
    """Keys with more rows than expected: n, first and last day, days apart."""
    return (
        df.groupBy(*as_list(key))
        .agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        .where(F.col("n") > more_than)
        .withColumn("days", F.date_diff("last_day", "first_day"))
    )


def duplicates_rollup(dups: DataFrame, by: str, per_id: int) -> DataFrame:
    """Repeated rows per day (or group) with a total, turned into persons by ``per_id`` rows each."""
    return dups.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), (F.sum("n") / per_id).alias("ids"))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row counts by which of the columns are NULL."""
    marks = [F.when(F.col(c).isNull(), 1).otherwise(0).alias(f"missing_{c}") for c in cols]
    return df.groupBy(*marks).agg(F.count(F.lit(1)).alias("n"))


def screen_test_records(df: DataFrame, name: str | None = None, prefix: str = "test", reject: Mapping[str, str] | None = None, test_flag: str | None = None) -> DataFrame:
    """Drop test and rejected records; an unknown value is not a reason to drop a row."""
    keep = F.lit(True)
    for c, bad in (reject or {}).items():
        keep = keep & ~F.col(c).eqNullSafe(bad)
    if name:
        keep = keep & ~F.coalesce(F.lower(name).startswith(prefix), F.lit(False))
    if test_flag:
        keep = keep & ~F.coalesce(F.col(test_flag), F.lit(False))
    return df.where(keep)


def work_list(df: DataFrame, condition: Column, cols: Sequence[str]) -> DataFrame:
    """Open cases to follow up."""
    return df.where(condition).select(*cols)
