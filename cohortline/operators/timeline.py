"""Everything dated about a key in one frame, and all picks from it in one group-by.

Sources become narrow rows (key, kind, day, fields); one read of a source may give rows of
several kinds.  Rows of one key, kind and day are combined before they shuffle by key, so
a key with very many rows sends one row per kind and day.  The first day of the anchor
kind is found by a window on the partitioning that the picks then use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.operators.skew import as_list


@dataclass(frozen=True)
class Mark:
    """Rows of one kind: which rows of the source, their day, and their fields by name."""

    where: Column
    day: str
    fields: Mapping[str, Column | str] = field(default_factory=dict)


def dated(df: DataFrame, on: str | Sequence[str], marks: Mapping[str, Mark], types: Mapping[str, str]) -> DataFrame:
    """Rows of all kinds from one read of ``df``.  ``types`` declares the fields of the whole timeline."""

    def cell(name, mark):
        cells = [mark.fields.get(f, F.lit(None)) for f in types]
        cells = [(F.col(c) if isinstance(c, str) else c).cast(t).alias(f) for c, (f, t) in zip(cells, types.items())]
        row = F.struct(F.lit(name).alias("kind"), F.col(mark.day).alias("day"), *cells)
        return F.when(mark.where & F.col(mark.day).isNotNull(), row)

    keys = as_list(on)
    rows = F.array_compact(F.array(*[cell(n, m) for n, m in marks.items()]))
    return df.select(*keys, F.explode(rows).alias("_e")).select(*keys, "_e.*")


@dataclass(frozen=True)
class Pick:
    """What to take of one kind: its first day, after the anchor or anywhere, with its fields.

    Of several rows of that day the fields come from the row that is smallest field by
    field, in the order in which the picks name them (NULL last); with ``most`` every field is its own maximum.
    """

    fields: Sequence[str] = ()
    after_anchor: bool = True
    most: bool = False


def firsts(rows: DataFrame, on: str | Sequence[str], anchor: str, picks: Mapping[str, Pick]) -> DataFrame:
    """One row per key that has the anchor kind: a struct (day, fields) per kind, NULL where nothing qualifies.

    A kind qualifies after the anchor's first day.  Keys with a NULL part have their
    anchor and nothing else, as in a join.
    """
    keys = as_list(on)
    kind, day = F.col("kind"), F.col("day")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    used = list(dict.fromkeys(f for p in picks.values() for f in p.fields))
    order = [c for f in used for c in (F.col(f).isNull().alias(f"_n_{f}"), F.col(f))]
    least = [F.min(F.struct(*order)).alias("_least")] if used else []
    daily = rows.where((kind == anchor) | whole).groupBy(*keys, "kind", "day").agg(*least, *[F.max(f).alias(f"_max_{f}") for f in used])
    first_day = F.min(F.when(kind == anchor, day)).over(Window.partitionBy(*keys))
    placed = daily.withColumn("_first", first_day).where(F.col("_first").isNotNull())

    def pick(name, p):
        ok = (kind == name) & ((day > F.col("_first")) if p.after_anchor else F.lit(True))
        fields = [(F.col(f"_max_{f}") if p.most else F.col("_least")[f]).alias(f) for f in p.fields]
        return F.min_by(F.when(ok, F.struct(day.alias("day"), *fields)), F.when(ok, day)).alias(name)

    return placed.groupBy(*keys).agg(*[pick(n, p) for n, p in picks.items()])
