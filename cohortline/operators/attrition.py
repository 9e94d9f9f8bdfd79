"""Early attrition: weekly facts plus reversed starts that the facts do not show."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.dedupe import dedupe_first, dedupe_last
from cohortline.operators.skew import salted_join, small_side

# The status of a reversed start, the statuses that do not settle a
# student's week 8, and the last week that counts.
REVERSED = "TSCA"
UNSETTLED = ["TSCA", "ACTIVE"]
LAST_WEEK = 8

COLUMNS = ["lead_id", "student_key", "term_start", "wk", "wk_end", "college", "program", "status", "flag"]


def attrition_events(fact: DataFrame, reversed_starts: DataFrame, starts: DataFrame, calendar: DataFrame, since: date, as_of: date) -> DataFrame:
    """Weekly fact rows, then reversed starts without a settled fact row in week 8.

    A reversed start is stamped with the end of week 8 of its term and counts once that
    day has passed.  Its lead comes from the degree start of the same student and day.
    ``reversed_starts`` has student_key, term_start, college, program, reverse_start;
    ``starts`` lead_id, student_key, start_date; ``calendar`` term_start, wk_end, wk.
    """
    status = F.upper("status")
    weekly = fact.where((F.col("term_start") >= F.lit(since)) & (F.col("wk") <= LAST_WEEK) & (status != REVERSED))

    settled = fact.where(~status.isin(*UNSETTLED) & (F.col("wk") == LAST_WEEK)).select("student_key", "term_start").distinct()
    term = ["student_key", "term_start"]
    reversals = dedupe_first(
        reversed_starts.where((F.col("reverse_start") == 1) & (F.col("term_start") >= F.lit(since))), term, ["college", "program"]
    ).join(settled, term, "left_anti")
    leads = dedupe_first(
        starts.select("lead_id", "student_key", F.col("start_date").alias("term_start")), term, "lead_id"
    )
    week = calendar.where((F.col("wk") == LAST_WEEK) & (F.col("wk_end") <= F.lit(as_of))).select("term_start", "wk_end", "wk").distinct()
    extra = (
        reversals.join(leads, term, "left")
        .join(small_side(week), "term_start")
        .withColumn("status", F.lit(REVERSED))
        .withColumn("flag", F.col("reverse_start"))
    )
    return weekly.select(*COLUMNS).unionByName(extra.select(*COLUMNS))


def attrition_unique(events: DataFrame) -> DataFrame:
    """Flagged rows, the latest week per lead, student and term."""
    flagged = events.where((F.col("flag") == 1) & F.col("lead_id").isNotNull())
    return dedupe_last(flagged, ["lead_id", "student_key", "term_start"], "wk_end", ["wk", "status"])


def attrition_attach(starts: DataFrame, unique: DataFrame, heavy: Sequence[int] = ()) -> DataFrame:
    """Flag and status for degree starts whose lead and first day match a flagged term.

    Reduced to one row per lead and term first, so that starts are never multiplied.
    """
    one = dedupe_last(unique, ["lead_id", "term_start"], "wk_end", "student_key").select(
        "lead_id", F.col("term_start").alias("start_date"), F.col("flag").alias("attrition_flag"), F.col("status").alias("attrition_status")
    )
    return salted_join(starts, one, ["lead_id", "start_date"], "left", heavy)
