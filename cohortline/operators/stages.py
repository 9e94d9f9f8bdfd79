"""Attaching funnel stages to a person-level frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.recode import flag
from cohortline.operators.skew import as_list, salted_join


def with_stage(
    base: DataFrame,
    stage: DataFrame,
    on: str | Sequence[str],
    stage_flag: str | None = None,
    zero: Sequence[str] = (),
    heavy: Sequence[int] | Column = (),
) -> DataFrame:
    """Left join one stage (one row per key).

    ``stage_flag`` becomes 1 where the stage exists and 0 elsewhere; columns listed in
    ``zero`` are 0 instead of NULL.  Dates stay NULL.  ``heavy`` matters only when
    ``base`` itself may hold many rows of one key.
    """
    on = as_list(on)
    right = stage.withColumn(stage_flag, F.lit(1)) if stage_flag else stage
    out = salted_join(base, right, on, "left", heavy, [c for c in base.columns if c not in on][:4])
    filled = ([stage_flag] if stage_flag else []) + [c for c in zero if c != stage_flag]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in filled}) if filled else out


def with_stages(base: DataFrame, stages: Mapping[str, DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left join several stages (one row per key each) by the same key; each name becomes the stage's 0/1 flag.

    Frames read from tables in equal buckets of the key (``overwrite_bucketed``) are joined where they lie.
    """
    for name, stage in stages.items():
        base = with_stage(base, stage, on, name)
    return base


def direct_vs_via(middle: str | Column, end: str | Column) -> dict[str, Column]:
    """Reached the end without, or by way of, the middle step (for ``withColumns``)."""
    mid = F.coalesce(F.col(middle) if isinstance(middle, str) else middle, F.lit(0)) == 1
    last = F.coalesce(F.col(end) if isinstance(end, str) else end, F.lit(0)) == 1
    return {"direct": flag(last & ~mid), "via": flag(last & mid)}


def funnel_flags(status: str, rules: Mapping[str, Sequence[str]], dates: Mapping[str, str]) -> dict[str, Column]:
    """0/1 columns from a status text and from dates being present (for ``withColumns``).

    ``rules`` maps a flag to the status values that raise it; ``dates`` maps a flag to
    the date column whose presence raises it.
    """
    out = {name: flag(F.col(status).isin(*values)) for name, values in rules.items()}
    out.update({name: flag(F.col(c).isNotNull()) for name, c in dates.items()})
    return out


def composite_label(
    status: str | Column, listed: Sequence[str], stage: str | Column, both: str, status_only: str, stage_only: str, other: str = "Missing"
) -> Column:
    """Four-way label from "status is one of ``listed``" and "stage is known".

    An unknown status is ``other``, whatever the stage.
    """
    s = F.col(status) if isinstance(status, str) else status
    known = (F.col(stage) if isinstance(stage, str) else stage).isNotNull()
    inside = s.isin(*listed)
    return (
        F.when(inside & known, both)
        .when(inside, status_only)
        .when(~inside & known, stage_only)
        .otherwise(other)
    )


def coalesce_segment(*codes: str | Column, default: str = "Missing") -> Column:
    """First known code of several systems."""
    return F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in codes], F.lit(default))


def cohort_funnel(df: DataFrame, period: str, counts: Mapping[str, Column]) -> DataFrame:
    """Per period, how many rows satisfy each condition; NULL conditions do not count."""
    return df.groupBy(period).agg(*[F.count_if(cond).alias(name) for name, cond in counts.items()]).orderBy(period)


def stamp_refresh(df: DataFrame, run_ts) -> DataFrame:
    """Load time, given by the caller."""
    return df.withColumn("last_refreshed", F.lit(run_ts))
