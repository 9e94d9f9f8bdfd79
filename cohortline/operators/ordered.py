"""As-of lookups for every anchor of a key, by one ordered pass instead of a join.

Anchors and events of a key become one stream in time order, cut into cells: ordinary keys
are one cell, heavy keys are cut at quantiles of their event times.  Within a cell a window
carries the last (or next) event; across cells the carry is a second, small window over
one row per cell.  So no event meets an anchor, a key with a third of all rows is spread over
its cells, and what is copied between cells is one event each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.skew import as_list

CELLS = 64


def time_cells(events: DataFrame, on: str | Sequence[str], ts: str, heavy: Sequence[int], cells: int = CELLS) -> list:
    """Times that cut the events of the heavy keys into about equal parts, at most ``cells`` of them; one narrow job."""
    if not heavy:
        return []
    rows = events.where(F.xxhash64(*as_list(on)).isin(*heavy)).select(F.col(ts).alias("t"))
    shares = [(k + 1) / cells for k in range(cells - 1)]
    # an approximate cut is as good as an exact one: cells only steer where rows go
    kind = rows.schema["t"].dataType.simpleString()
    number = F.unix_date("t") if kind == "date" else F.unix_micros(F.col("t").cast("timestamp"))
    found = rows.agg(F.percentile_approx(number, shares, 10_000)).first()[0] or []
    return sorted(set(found))


def _cell(on: Sequence[str], ts: Column, kind: str, heavy: Sequence[int], cuts: Sequence[int]) -> Column:
    """The number of a row's cell: 0 for ordinary keys, the place of its time among the cuts for heavy ones."""
    if not heavy or not cuts:
        return F.lit(0)
    number = F.unix_date(ts) if kind == "date" else F.unix_micros(ts.cast("timestamp"))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < number))
    return F.when(F.xxhash64(*on).isin(*heavy), place).otherwise(0)


def asof_each(
    anchors: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    ts: str,
    forward: bool = False,
    strict: bool = False,
    tie: str | Sequence[str] = (),
    heavy: Sequence[int] = (),
    cuts: Sequence[int] = (),
) -> DataFrame:
    """For every distinct key and anchor time the last event at/before it, or with ``forward`` the first at/after it.

    Returns the key, the anchor and the event's other columns, NULL where no event qualifies;
    with ``strict`` an event at the anchor's own time does not.  Events of one key and time are
    one after combining: the smallest by ``tie`` forward, the largest backward (NULL first
    backward, last forward).  Anchors whose key or time is NULL find nothing.  ``anchor`` and ``ts`` have one type.
    ``heavy`` are key hashes as ``heavy_keys`` finds them, ``cuts`` come from ``time_cells``.
    """
    on, tie = as_list(on), as_list(tie)
    rest = [c for c in events.columns if c not in on]
    kind = events.schema[ts].dataType.simpleString()
    known = lambda c: [F.col(k).isNotNull() for k in (*on, c)]
    times = anchors.select(*on, F.col(anchor).alias("_t")).distinct()

    rows = events
    for test in known(ts):
        rows = rows.where(test)
    by = F.struct(*[c for t in tie for c in ((F.col(t).isNull() if forward else F.col(t).isNotNull()).alias(f"_n_{t}"), F.col(t))], F.lit(0).alias("_z"))
    pick = F.min_by if forward else F.max_by
    daily = rows.groupBy(*on, F.col(ts).alias("_t")).agg(pick(F.struct(*[F.col(c) for c in rest if c != ts], F.lit(1).alias("_is")), by).alias("_e"))

    # at one time: backward an event stands before the anchors, forward after them; strict turns it round
    first = 1 if strict else 0
    stream = (
        daily.select(*on, "_t", "_e", F.lit(first).alias("_o"))
        .unionByName(times.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*on, "_t"))).withColumn("_o", F.lit(1 - first)), allowMissingColumns=True)
        .withColumn("_found", F.when(F.col("_e").isNotNull(), F.struct(F.col("_t").alias("_at"), "_e")))
        .withColumn("_cell", _cell(on, F.col("_t"), kind, heavy, cuts))
    )
    order = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_o")]
    inside = Window.partitionBy(*on, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stream.withColumn("_last", F.last("_found", ignorenulls=True).over(inside)).where(F.col("_e").isNull())
    if cuts:
        # one row per key and cell that has events: the event it hands to the following cells
        far = (F.min_by if forward else F.max_by)("_found", "_t")
        given = stream.where(F.col("_e").isNotNull()).groupBy(*on, "_cell").agg(far.alias("_carry"))
        met = times.where(F.xxhash64(*on).isin(*heavy)).withColumn("_cell", _cell(on, F.col("_t"), kind, heavy, cuts)).select(*on, "_cell").distinct()
        ahead = Window.partitionBy(*on).orderBy(F.col("_cell").desc() if forward else F.col("_cell").asc()).rowsBetween(Window.unboundedPreceding, -1)
        both = given.unionByName(met.withColumn("_carry", F.lit(None).cast(given.schema["_carry"].dataType))).groupBy(*on, "_cell").agg(F.first("_carry", ignorenulls=True).alias("_carry"))
        carried = both.withColumn("_before", F.last("_carry", ignorenulls=True).over(ahead)).select(*on, "_cell", "_before").where(F.xxhash64(*on).isin(*heavy))
        seen = seen.join(carried, [*on, "_cell"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    fields = [F.col("_last")["_at"].alias(ts)] + [F.col("_last")["_e"][c].alias(c) for c in rest if c != ts]
    found = seen.select(*on, F.col("_t").alias(anchor), *fields)
    unknown = times.where(" OR ".join(f"`{c}` IS NULL" for c in (*on, "_t"))).withColumnRenamed("_t", anchor)
    return found.unionByName(unknown, allowMissingColumns=True)
