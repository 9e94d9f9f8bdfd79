"""Degree starts with early attrition, and success after the start."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import flag, keep_listed, month_end
from cohortline.operators.attrition import attrition_attach, attrition_events, attrition_unique
from cohortline.operators.history import term_metrics
from cohortline.operators.stages import with_stage
from cohortline.operators.timeline import Mark, Pick, dated, firsts
from cohortline.plans.leads import program_groups

# Graduate programs start with this letter, but for one; on-ramp stage
# labels; income levels that are kept.
GRADUATE_PREFIX = "M"
UNDERGRADUATE_EXCEPTION = "MSITMUG"
FINISHED, NEVER = "Graduated", "Never at Academy"
INCOME_LEVELS = ["High", "Low"]


def new_starts(new_start: DataFrame, opportunity: DataFrame, student_demographics: DataFrame, program_grouping: DataFrame, since: date) -> DataFrame:
    """Degree starts with student key, level, program group and on-ramp history."""
    p, stage = F.col("program"), F.col("onramp_stage")
    rows = new_start.where(F.col("closed_ts") >= F.lit(since)).select(
        "lead_id",
        F.to_date("closed_ts").alias("start_date"),
        month_end("closed_ts").alias("start_month"),
        "college",
        F.when(p.startswith(GRADUATE_PREFIX) & (p != UNDERGRADUATE_EXCEPTION), "GR").when(p.isNotNull(), "UG").alias("level"),
        "program",
        "region",
        "ethnicity",
        "minority",
        keep_listed("income_level", INCOME_LEVELS).alias("income_level"),
        "onramp_stage",
        flag(stage == FINISHED).alias("onramp_completed_flag"),
        flag(stage != NEVER).alias("onramp_attended_flag"),
    )
    keys = opportunity.select("lead_id", F.col("student_key").try_cast("bigint").alias("student_key"))
    return (
        rows.join(keys, "lead_id", "left")
        .join(student_demographics, "student_key", "left")
        .join(program_groups(program_grouping), "program", "left")
    )


def start_ids(new_start: DataFrame, opportunity: DataFrame, since: date) -> DataFrame:
    """Lead, student key and day of the degree starts: all that finding attrition rows needs."""
    starts = new_start.where(F.col("closed_ts") >= F.lit(since)).select("lead_id", F.to_date("closed_ts").alias("start_date"))
    return starts.join(opportunity.select("lead_id", F.col("student_key").try_cast("bigint").alias("student_key")), "lead_id")


def build_attrition(attrition_45d: DataFrame, student_month: DataFrame, starts: DataFrame, term_week: DataFrame, since: date, as_of: date) -> DataFrame:
    """Weekly early-attrition rows of all students, reversed starts included."""
    return attrition_events(attrition_45d, student_month, starts, term_week, since, as_of)


def build_degree_start(
    new_start: DataFrame,
    opportunity: DataFrame,
    student_demographics: DataFrame,
    program_grouping: DataFrame,
    attrition_45d: DataFrame,
    student_month: DataFrame,
    term_week: DataFrame,
    since: date,
    as_of: date,
    heavy: Mapping[str, Sequence[int]] = MappingProxyType({}),
) -> DataFrame:
    """One row per degree start with its early-attrition flag.

    ``heavy`` may name heavy pairs of lead_id and start_date.
    """
    starts = new_starts(new_start, opportunity, student_demographics, program_grouping, since)
    events = build_attrition(attrition_45d, student_month, start_ids(new_start, opportunity, since), term_week, since, as_of)
    return attrition_attach(starts, attrition_unique(events), heavy.get("lead_id,start_date", ()))


def build_degree_success(
    student_month: DataFrame,
    student_drop: DataFrame,
    term_progress: DataFrame,
    since: date,
    level: str = "UG",
) -> DataFrame:
    """One row per student: graduation, first drop, retention and per-term figures.

    All that is dated about a student is one timeline: one read of the monthly rows, one
    of the drops.  Heavy
    students need no list: their rows are combined by kind and day before they shuffle.
    """
    keys = ["student_key", "student_id"]
    recent = F.coalesce(F.col("faa_date") >= F.lit(since), F.lit(False))
    types = {"s1": "string", "s2": "string", "n1": "int", "n2": "int"}
    monthly = dated(
        student_month,
        keys,
        {
            "start": Mark((F.col("level") == level) & recent & (F.col("new_start") == 1), "faa_date", {"s1": "college", "s2": "program"}),
            "grad": Mark(F.col("grad") == 1, "month_end"),
            "ret7": Mark(F.col("ret7").isNotNull(), "month_end", {"n1": "ret7"}),
            "ret13": Mark(F.col("ret13").isNotNull(), "month_end", {"n1": "ret13"}),
            "otp": Mark(
                recent & (F.col("faa_date") < F.col("month_end")), "faa_date", {f"n{t}": F.when(F.col("term_seq") == t, F.col("term_otp")) for t in (1, 2)}
            ),
        },
        types,
    )
    drop_fields = {"s1": "drop_type", "s2": "drop_sub_type", "n1": flag(F.col("term_seq") == 1), "n2": flag(F.col("term_seq") == 2)}
    drops = dated(student_drop, keys, {"drop": Mark(F.lit(True), "month_end", drop_fields)}, types)
    found = firsts(
        monthly.unionByName(drops),
        keys,
        "start",
        {
            "start": Pick(["s1", "s2"], after_anchor=False),
            "grad": Pick(),
            "drop": Pick(["s1", "s2", "n1", "n2"]),
            "ret7": Pick(["n1"]),
            "ret13": Pick(["n1"]),
            "otp": Pick(["n1", "n2"], after_anchor=False, most=True),
        },
    )
    of = lambda kind, name: F.col(kind)[name]
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = found.select(
        *keys,
        of("start", "day").alias("faa_date"),
        of("start", "s1").alias("college_faa"),
        F.lit(level).alias("level_faa"),
        of("start", "s2").alias("program_faa"),
        F.trunc(of("start", "day"), "month").cast("date").alias("faa_month"),
        of("grad", "day").alias("grad_date"),
        flag(F.col("grad").isNotNull()).alias("grad_flag"),
        of("drop", "day").alias("drop_date"),
        of("drop", "s1").alias("drop_type"),
        of("drop", "s2").alias("drop_sub_type"),
        zero(of("drop", "n1")).alias("drop_t1_flag"),
        zero(of("drop", "n2")).alias("drop_t2_flag"),
        flag(F.col("drop").isNotNull()).alias("drop_flag"),
        of("ret7", "day").alias("r7_date"),
        of("ret7", "n1").alias("ret7"),
        of("ret13", "day").alias("r13_date"),
        of("ret13", "n1").alias("ret13"),
        of("otp", "n1").alias("t1_otp"),
        of("otp", "n2").alias("t2_otp"),
    )

    in_term = student_month.where(F.col("term_seq").isin(1, 2) & recent).select("student_id", "term_seq").distinct()
    # one row per student and term first, so that the semi join meets no long runs of one key
    best = term_progress.groupBy("student_id", "term_seq").agg(F.max("limited_progress").alias("limited_progress"), F.max("earned_cus").alias("earned_cus"))
    progress = best.join(in_term, ["student_id", "term_seq"], "left_semi")
    units = term_metrics(progress, "student_id", "term_seq", {"limited_progress": "limit_prog_t{t}", "earned_cus": "earned_cus_t{t}"})
    return with_stage(out, units.withColumns({f"earned_cus_t{t}": F.col(f"earned_cus_t{t}").cast("int") for t in (1, 2)}), "student_id")
