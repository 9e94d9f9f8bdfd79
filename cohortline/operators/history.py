"""Status histories, monthly snapshots and per-term figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.recode import flag
from cohortline.operators.asof import asof_backward_last
from cohortline.operators.ordered import _cell
from cohortline.operators.skew import as_list, salted_join
from cohortline.operators.stages import with_stage


def prefix_match(c: str | Column, prefixes: Sequence[str]) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return out


def status_asof_flag(
    base: DataFrame,
    history: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    ts: str,
    status: str,
    marks: Mapping[str, Sequence[str]],
    day: str | None = None,
    tie: str | Sequence[str] = (),
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """Flags from the latest status at/before the anchor, several in one lookup.

    ``marks`` maps a name to status prefixes; each gives ``<name>_flag`` and
    ``<name>_date``, the latter only where the flag is 1.  ``day`` is the date column to
    report (default ``ts``).
    """
    found = asof_backward_last(base, history, on, anchor, ts, tie=tie, heavy=heavy)
    cols = []
    for name, prefixes in marks.items():
        hit = prefix_match(status, prefixes)
        cols += [flag(hit).alias(f"{name}_flag"), F.when(hit, F.col(day or ts)).alias(f"{name}_date")]
    return found.select(*as_list(on), *cols)


def status_intervals(
    history: DataFrame,
    on: str | Sequence[str],
    ts: str,
    status: str,
    tie: str | Sequence[str] = (),
    heavy: Sequence[int] = (),
    cuts: Sequence[int] = (),
) -> DataFrame:
    """The history as intervals [valid_from, valid_to) that do not overlap, one per row: keys, both ends, ``status``.

    A status holds until the next row of its key by ``ts``, ``tie`` and status; the last one's end is NULL.  Rows of
    one time follow each other, so all but the last are empty intervals, which as-of reads skip and "ever" counts.
    Rows whose key or time is NULL are in no interval.  ``heavy`` are key hashes as ``heavy_keys`` finds them; with
    ``cuts`` of ``time_cells`` such a key is ordered cell by cell, and each cell ends where the next begins.
    """
    on, tie = as_list(on), as_list(tie)
    known = history.dropna(subset=[*on, ts])
    kind = history.schema[ts].dataType.simpleString()
    extra = [F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)]
    rows = known.select(*on, F.col(ts).alias("valid_from"), F.col(status).alias("status"), *extra)
    rows = rows.withColumn("_cell", _cell(on, F.col("valid_from"), kind, heavy, cuts))
    order = Window.partitionBy(*on, "_cell").orderBy("valid_from", *[f"_t{i}" for i in range(len(tie))], "status")
    rows = rows.withColumn("valid_to", F.lead("valid_from").over(order))
    if heavy and cuts:
        # where the next cell of a heavy key begins: one row per heavy key and cell
        begins = known.where(F.xxhash64(*on).isin(*heavy)).groupBy(*on, _cell(on, F.col(ts), kind, heavy, cuts).alias("_cell")).agg(F.min(ts).alias("_b"))
        begins = begins.select(*on, "_cell", F.lead("_b").over(Window.partitionBy(*on).orderBy("_cell")).alias("_next"))
        rows = rows.join(F.broadcast(begins), [*on, "_cell"], "left").withColumn("valid_to", F.coalesce("valid_to", "_next"))
    return rows.select(*on, "valid_from", "valid_to", "status")


def status_profile(
    base: DataFrame,
    intervals: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    marks: Mapping[str, Sequence[str]],
    days: Sequence[int] = (),
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """Per key of ``base`` what its intervals say about the anchor (the earliest of the key), in one pass over them.

    ``marks`` maps a name to status prefixes; each gives ``<name>_flag`` (held at the anchor), ``<name>_date`` (the begin of
    that interval, only where the flag is 1), ``<name>_ever`` (began at/before the anchor at any time, however
    short) and ``<name>_never`` (its opposite).  ``days`` adds ``status_<n>d``, the status held that many days after the anchor.
    Keys without history, and those whose anchor is NULL, have flags 0, never 1 and NULL elsewhere.
    """
    keys = as_list(on)
    anchors = base.groupBy(*keys).agg(F.min(anchor).alias("_anchor"))
    met = salted_join(intervals, anchors, keys, "inner", heavy, ["valid_from"])

    def held(at):
        return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))

    parts = []
    for name, prefixes in marks.items():
        hit = F.coalesce(prefix_match("status", prefixes), F.lit(False))
        parts += [
            F.max(F.when(hit & held(F.col("_anchor")), F.col("valid_from"))).alias(f"{name}_date"),
            F.max(F.when(hit & (F.col("valid_from") <= F.col("_anchor")), 1)).alias(f"{name}_ever"),
        ]
    parts += [F.max(F.when(held(F.col("_anchor") + F.make_interval(days=F.lit(n))), F.col("status"))).alias(f"status_{n}d") for n in days]
    found = anchors.join(met.groupBy(*keys).agg(*parts), keys, "left")
    out = []
    for name in marks:
        ever = F.coalesce(F.col(f"{name}_ever"), F.lit(0))
        out += [flag(F.col(f"{name}_date").isNotNull()).alias(f"{name}_flag"), f"{name}_date", ever.alias(f"{name}_ever"), (1 - ever).alias(f"{name}_never")]
    return found.select(*keys, *out, *[f"status_{n}d" for n in days])


def retention_at(
    base: DataFrame,
    snaps: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    ts: str,
    metrics: Mapping[str, str],
    anchors: DataFrame | None = None,
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """First known value of each metric in a snapshot after the anchor, attached wide.

    ``metrics`` maps a metric column to its short name; adds the metric and
    ``<name>_date``.  The snapshots are read once, however many metrics there are.  ``anchors`` is a narrow frame with the keys and the anchor, to look
    events up from where ``base`` is wide.
    """
    keys = as_list(on)
    # all metrics in one pass over the snapshots: per key the earliest (time, value) of each
    known = snaps.where(F.coalesce(*metrics).isNotNull() if len(metrics) > 1 else F.col(next(iter(metrics))).isNotNull())
    known = known.select(*keys, ts, *[F.col(m).cast("int").alias(m) for m in metrics])
    first_anchor = (base if anchors is None else anchors).where(F.col(anchor).isNotNull()).groupBy(*keys).agg(F.min(anchor).alias("_anchor"))
    later = salted_join(known, first_anchor, keys, "inner", heavy, [ts]).where(F.col(ts) > F.col("_anchor"))
    firsts = {m: F.min(F.when(F.col(m).isNotNull(), F.struct(ts, m))).alias(f"_{m}") for m in metrics}
    found = later.groupBy(*keys).agg(*firsts.values())
    parts = [c for m, n in metrics.items() for c in (F.col(f"_{m}")[ts].alias(f"{n}_date"), F.col(f"_{m}")[m].alias(m))]
    return with_stage(base, found.select(*keys, *parts), keys, heavy=heavy)


def retention_avg(df: DataFrame, metric: str, month: str, name: str, digits: int = 2) -> DataFrame:
    """Average of a retention metric and number of students per snapshot month."""
    return (
        df.where(F.col(month).isNotNull())
        .groupBy(F.col(month).alias("month"))
        .agg(F.round(F.avg(metric), digits).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    )


def term_metrics(
    df: DataFrame, keys: str | Sequence[str], term: str, metrics: Mapping[str, str], terms: Sequence[int] = (1, 2), pick=F.max
) -> DataFrame:
    """One column per metric and term: ``metrics`` maps a column to an output pattern with ``{t}``."""
    cells = [
        pick(F.when(F.col(term) == t, F.col(c))).alias(pattern.format(t=t)) for c, pattern in metrics.items() for t in terms
    ]
    return df.groupBy(*as_list(keys)).agg(*cells)


def running_units(df: DataFrame, key: str, period: str, sums: Mapping[str, Column]) -> DataFrame:
    """Totals per key and period and their running sum.

    Rows are summed per period before the window, so a window holds periods, not rows.
    """
    totals = df.groupBy(key, period).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    window = Window.partitionBy(key).orderBy(period)
    return totals.withColumns({f"cumulative_{name}": F.sum(name).over(window) for name in sums})
