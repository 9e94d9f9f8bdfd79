"""Cohort marts: everything known about a person, one wide row each.

Every later stage is looked up from narrow id-and-date frames and attached to the wide
frame once, so the plan grows with the number of stages and no wide row is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import bin_days, crosswalk, days_between, local_date
from cohortline.operators.asof import asof_forward_first
from cohortline.operators.history import status_asof_flag
from cohortline.operators.rates import any_prefix_flag
from cohortline.operators.skew import left_fan_out, salted_join
from cohortline.operators.stages import coalesce_segment, direct_vs_via, with_stage
from cohortline.plans.onramp import SCHOOL

# Bin bounds and labels of the account cohort, history field and status
# prefixes, prefixes of degree types that count as a degree.
FOUR_EDGES, FOUR_LABELS = [30, 60, 90], ["0-30 days", "31-60 days", "61-90 days", "90+ days"]
SIX_EDGES, SIX_LABELS = [7, 14, 30, 60, 90], ["0-7 days", "8-14 days", "14-30 days", "31-60 days", "61-90 days", "90+ days"]
STATUS_FIELD = "CareStatus__c"
STATUS_MARKS = {"nayt": ["NAYT", "NAMT", "PEND"], "intv": ["INTV"]}
DEGREES = ["Doctor", "Mast", "Bach", "Assoc"]

SUCCESS = [
    "faa_date", "grad_flag", "grad_date", "drop_flag", "drop_date", "drop_type", "drop_sub_type", "drop_t1_flag", "drop_t2_flag",
    "ret7", "ret13", "r7_date", "r13_date", "limit_prog_t1", "limit_prog_t2", "earned_cus_t1", "earned_cus_t2", "t1_otp", "t2_otp",
]
ONRAMP = [
    "onramp_start_date", "channel", "offering_type", "offering_subtype", "product_code", "product_name", "partnership", "program_tag",
    "complete_flag", "complete_date", "onramp_drop_flag", "onramp_drop_date", "drop_7d_flag", "drop_72h_flag",
]
RECOMMEND = [
    "rec_flag", "rec_date", "rec_ts", "product_category", "product_type", "reason", "products", "product1", "product2", "product3",
    "rec_stage", "submit_docs", "status_at_rec", "not_admitted_at_rec", "counselor_at_rec",
]


def build_cohort_account(
    account: DataFrame,
    app: DataFrame,
    recommend: DataFrame,
    degree_start: DataFrame,
    onramp: DataFrame,
    student_transcript: DataFrame,
    field_history: DataFrame,
    degree_success: DataFrame,
    transcript_summary: DataFrame | None = None,
    zone: str = "America/Denver",
    heavy: Mapping[str, Sequence[int]] = MappingProxyType({}),
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """Accounts followed through application, recommendation, on-ramp, degree and success.

    A lead with several applications since its account has one row for each; check with
    ``audit_unique``.  ``heavy`` may name heavy values of lead_id and student_key, as
    ``heavy_by_key`` finds them.  ``keep`` may write the narrow
    application and recommendation frames, which several lookups start from.
    """
    lead, by_student_key = "lead_id", heavy.get("student_key", ())
    heavy = heavy.get(lead, ())
    opened = account.select(lead, "account_date")
    applied = keep(_since(app.select(lead, "app_flag", "app_date", "app_ts"), opened, lead, "app_date", "account_date", heavy), "applied")
    advised = keep(_since(recommend.select(lead, *RECOMMEND), opened, lead, "rec_date", "account_date", heavy), "advised")

    out = left_fan_out(account, applied, lead, heavy, ["app_ts"])
    out = with_stage(out, advised, lead, heavy=heavy)

    started = asof_forward_first(
        applied, degree_start.select(lead, F.col("start_date").alias("degree_start_date")), lead, "app_date", "degree_start_date", heavy=heavy
    )
    out = with_stage(out, started, lead, "degree_start_flag", heavy=heavy)

    renamed = onramp.withColumnsRenamed({"start_date": "onramp_start_date", "drop_flag": "onramp_drop_flag", "drop_date": "onramp_drop_date"})
    entered = asof_forward_first(
        advised, renamed.select(lead, *ONRAMP, "subscription_id"), lead, "rec_date", "onramp_start_date", tie="subscription_id", heavy=heavy
    ).drop("subscription_id")
    out = with_stage(out, entered, lead, "onramp_start_flag", heavy=heavy)
    both = direct_vs_via("onramp_start_flag", "degree_start_flag")
    out = out.withColumns({"direct_degree_start_flag": both["direct"], "degree_start_with_onramp_flag": both["via"]})

    out = with_stage(out, any_prefix_flag(student_transcript, lead, "degree_type", DEGREES, "has_degree"), lead, heavy=heavy)
    if transcript_summary is not None:
        out = with_stage(out, transcript_summary, lead, heavy=heavy)

    history = field_history.where(F.col("field") == STATUS_FIELD).select(
        lead, local_date("created_ts", zone).alias("status_date"), "created_ts", "new_value"
    )
    marked = status_asof_flag(applied, history, lead, "app_date", "status_date", "new_value", STATUS_MARKS, tie=["created_ts", "new_value"], heavy=heavy)
    out = with_stage(out, marked, lead, heavy=heavy)

    # success is found by student and brought back to the lead on narrow rows: the wide
    # frame stays partitioned by lead and its many NULL student keys are never shuffled
    student = "student_key"
    students = account.where(F.col(student).isNotNull()).select(lead, student)
    success = asof_forward_first(
        students.join(applied.select(lead, "app_date"), lead),
        degree_success.select(student, "student_id", *SUCCESS),
        student,
        "app_date",
        "faa_date",
        tie="student_id",
        heavy=by_student_key,
    ).drop("student_id")
    per_lead = salted_join(students, success, student, "inner", by_student_key, [lead]).drop(student)
    out = with_stage(out, per_lead, lead, heavy=heavy)
    return with_durations(out)


def _since(events: DataFrame, opened: DataFrame, on: str, ts: str, anchor: str, heavy: Sequence[int]) -> DataFrame:
    """Rows of a stage dated on/after the account of the same lead."""
    return salted_join(events, opened, on, "inner", heavy, [ts]).where(F.col(ts) >= F.col(anchor)).drop(anchor)


def with_durations(df: DataFrame) -> DataFrame:
    """Days between the stages and their bins."""
    pairs = {
        "account_to_app": ("app_date", "account_date", None),
        "app_to_rec": ("rec_date", "app_date", 6),
        "app_to_degree_start": ("degree_start_date", "app_date", 4),
        "rec_to_onramp_start": ("onramp_start_date", "rec_date", 6),
        "onramp_start_to_complete": ("complete_date", "onramp_start_date", 4),
        "onramp_start_to_drop": ("onramp_drop_date", "onramp_start_date", 4),
        "onramp_complete_to_degree_start": ("degree_start_date", "complete_date", 6),
        "degree_start_to_complete": ("grad_date", "degree_start_date", 4),
        "degree_start_to_drop": ("drop_date", "degree_start_date", 4),
    }
    shapes = {4: (FOUR_EDGES, FOUR_LABELS), 6: (SIX_EDGES, SIX_LABELS)}
    days = {f"days_{name}": days_between(end, start) for name, (end, start, _) in pairs.items()}
    bins = {f"bins_{name}": bin_days(f"days_{name}", *shapes[n]) for name, (_, _, n) in pairs.items() if n}
    return df.withColumns(days).withColumns(bins)


def build_cohort_inquiry(
    inquiry: DataFrame, recommend: DataFrame, degree_start: DataFrame | None = None, heavy: Mapping[str, Sequence[int]] = MappingProxyType({})
) -> DataFrame:
    """Inquiries with their recommendation, the first known school and, on request, degree starts."""
    lead = "lead_id"
    heavy = heavy.get(lead, ())
    advice = recommend.select(
        lead,
        "rec_flag",
        "rec_date",
        "rec_ts",
        "product_category",
        F.col("product_type").alias("rec_product_type"),
        "reason",
        "products",
        "rec_stage",
        "status_at_rec",
        "not_admitted_at_rec",
        "latest_status",
        crosswalk("college", SCHOOL).alias("rec_school"),
        F.col("level").alias("rec_level"),
        F.col("program").alias("rec_program"),
    )
    out = with_stage(inquiry, advice, lead, zero=["rec_flag", "not_admitted_at_rec"], heavy=heavy).withColumns(
        {
            "rec_stage": F.coalesce("rec_stage", F.lit("Missing")),
            "interest_without_cert": F.when(F.col("interest_school") != "Certificates", F.col("interest_school")),
        }
    )
    out = out.withColumn("school", coalesce_segment("rec_school", "interest_without_cert"))
    if degree_start is None:
        return out
    joined = asof_forward_first(
        inquiry.select(lead, "received_date"),
        degree_start.select(
            lead,
            F.col("start_date").alias("join_start_date"),
            F.col("college").alias("start_college"),
            F.col("level").alias("start_level"),
            F.col("program").alias("start_program"),
        ),
        lead,
        "received_date",
        "join_start_date",
        tie="start_program",
        heavy=heavy,
    )
    return with_stage(out, joined, lead, "degree_start_flag", heavy=heavy).withColumn(
        "days_app_to_degree_start", days_between("join_start_date", "app_date")
    )
