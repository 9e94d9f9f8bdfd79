"""As-of joins: the first event on or after a date, the last one on or before it.

The answer is one row per key.  When a key has several anchors, an event qualifies if
it qualifies for any of them, which is the same as testing it against the smallest
(forward) or largest (backward) anchor.  So anchors are first reduced to one row per
key: the join stays one-to-many and never pairs all events with all anchors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.skew import any_heavy, as_list, is_heavy, salted_join


def _qualifying(base, events, on, anchor, ts, pick, test, heavy, tie):
    """Events that pass the test against their key's smallest or largest anchor."""
    anchors = base.where(F.col(anchor).isNotNull()).groupBy(*on).agg(pick(anchor).alias("_anchor"))
    joined = salted_join(events, anchors, on, "inner", heavy, [ts, *tie])
    return joined.where(test(F.col(ts), F.col("_anchor"))).drop("_anchor")


def _best(rows, events, on, ts, tie, pick, nulls_last):
    """The first or last row per key: the payload at the extreme of time and ties.

    A sort-merge join hands its rows over ordered by key, so this aggregates as they
    stream by; ranking them would sort every pair once more.  Only time and ties are
    compared, so the payload may be of any type, maps included.
    """
    rest = [c for c in events.columns if c not in (*on, ts, *tie)]
    order = [F.col(ts)]
    for c in tie:
        order += [F.col(c).isNull().alias(f"_n_{c}"), F.col(c)] if nulls_last else [F.col(c)]
    by = F.struct(*order)
    payload = F.struct(*[F.col(c) for c in (ts, *tie, *rest)])
    best = rows.groupBy(*on).agg((F.min_by if pick is F.min else F.max_by)(payload, by).alias("_b"))
    return best.select(*[c if c in on else F.col("_b")[c].alias(c) for c in events.columns])


def asof_forward_first(
    base: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    ts: str,
    strict: bool = False,
    tie: str | Sequence[str] = (),
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """First event per key at/after the anchor (strictly after with ``strict``).

    Returns the event's columns; keys without such an event are absent.  When the events
    carry nothing but the key and the time, a plain minimum is enough.
    """
    on, tie = as_list(on), as_list(tie)
    test = (lambda t, a: t > a) if strict else (lambda t, a: t >= a)
    rows = _qualifying(base, events, on, anchor, ts, F.min, test, heavy, tie)
    if set(events.columns) == {*on, ts}:
        return rows.groupBy(*on).agg(F.min(ts).alias(ts))
    return _best(rows, events, on, ts, tie, F.min, nulls_last=True)


def asof_backward_last(
    base: DataFrame,
    events: DataFrame,
    on: str | Sequence[str],
    anchor: str,
    ts: str,
    strict: bool = False,
    tie: str | Sequence[str] = (),
    how: str = "inner",
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """Last event per key at/before the anchor (strictly before with ``strict``).

    ``how='left'`` keeps every key of ``base``, with NULLs where no event qualifies.
    """
    on, tie = as_list(on), as_list(tie)
    test = (lambda t, a: t < a) if strict else (lambda t, a: t <= a)
    rows = _qualifying(base, events, on, anchor, ts, F.max, test, heavy, tie)
    if set(events.columns) == {*on, ts}:
        found = rows.groupBy(*on).agg(F.max(ts).alias(ts))
    else:
        found = _best(rows, events, on, ts, tie, F.max, nulls_last=False)
    if how == "left":
        return base.select(*on).distinct().join(found, on, "left")
    return found


def attach_first(
    base: DataFrame, events: DataFrame, on: str | Sequence[str], anchor: str, ts: str, strict: bool = False, heavy: Sequence[int] | Column = ()
) -> DataFrame:
    """Add ``ts``: the first event time at/after the row's own anchor, NULL when there is none.

    For narrow frames with one row per key (ids and dates).  One left join and one
    group-by on the same partitioning: a chain of stages shuffles each event source
    once and never reads the base twice.
    """
    keys = as_list(on)
    cols = base.columns
    left, right, by = base, events.select(*keys, F.col(ts).alias("_t")), keys
    if any_heavy(heavy):
        salts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = is_heavy(keys, heavy)
        slots = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        slot = F.pmod(F.xxhash64("_t") + F.spark_partition_id(), F.lit(salts)).cast("int")
        left = base.withColumn("_salt", F.explode(slots))
        right = right.withColumn("_salt", F.when(hot, slot).otherwise(0))
        by = [*keys, "_salt"]
    right = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(by)})
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(by)])
    after = (F.col("_t") > F.col(anchor)) if strict else (F.col("_t") >= F.col(anchor))
    return left.join(right, match & after, "left").groupBy(*cols).agg(F.min("_t").alias(ts))
