"""Dates: reporting periods, durations and duration bins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_ending(c: str | Column) -> Column:
    """Sunday that closes the Monday-to-Sunday week of ``c``."""
    day = F.to_date(_col(c))
    return F.date_add(day, 6 - F.weekday(day))


def week_start(c: str | Column) -> Column:
    """Monday that opens the week of ``c``."""
    day = F.to_date(_col(c))
    return F.date_add(day, -F.weekday(day))


def month_end(c: str | Column) -> Column:
    return F.last_day(F.to_date(_col(c)))


def period_keys(df: DataFrame, ts: str, prefix: str | None = None) -> DataFrame:
    """Add ``<prefix>_date``, ``<prefix>_week`` (ending Sunday) and ``<prefix>_month`` (month end)."""
    name = prefix or ts
    return df.withColumns(
        {
            f"{name}_date": F.to_date(F.col(ts)),
            f"{name}_week": week_ending(ts),
            f"{name}_month": month_end(ts),
        }
    )


def local_date(ts: str | Column, zone: str) -> Column:
    """Calendar date of a UTC instant in ``zone``."""
    return F.to_date(F.from_utc_timestamp(_col(ts), zone))


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end``; negative when ``end`` comes first."""
    return F.date_diff(_col(end), _col(start))


def bin_days(days: str | Column, edges: Sequence[int], labels: Sequence[str], negative: str | None = None) -> Column:
    """Label a day count.

    ``edges`` are inclusive upper bounds, so there is one more label than edges.  The
    first bin is open below: negative durations land in it unless ``negative`` gives
    them a label of their own.  NULL stays NULL.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("need exactly one label more than edges")
    value = _col(days)
    steps = list(zip(edges, labels))
    out = F.when(value < 0, negative) if negative is not None else None
    for edge, label in steps:
        out = (F if out is None else out).when(value <= edge, label)
    return out.when(value > edges[-1], labels[-1])


def closed_before(c: str | Column, as_of: date) -> Column:
    """True for periods already closed on the reporting date."""
    return _col(c) < F.lit(as_of)


def in_year(c: str | Column, year: int) -> Column:
    """Year test as a plain range, so that it can prune partitions and row groups."""
    return (_col(c) >= F.lit(date(year, 1, 1))) & (_col(c) < F.lit(date(year + 1, 1, 1)))
