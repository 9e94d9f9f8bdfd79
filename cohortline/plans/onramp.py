"""On-ramp starts with their outcomes, and on-ramp inquiries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import bin_days, blank_to_null, crosswalk, days_between, fill_missing, flag, in_year, month_end, one_hot, week_ending
from cohortline.operators.asof import asof_forward_first
from cohortline.operators.audit import screen_test_records
from cohortline.operators.dedupe import dedupe_first
from cohortline.operators.demographics import enrich_demographics
from cohortline.operators.matching import event_kinds, first_product, match_ids, outcomes
from cohortline.operators.skew import NULL_KEY
from cohortline.operators.stages import direct_vs_via, funnel_flags, stamp_refresh, with_stage
from cohortline.plans.leads import applications

# Fields of interest and college codes as school codes, status values
# behind the funnel flags, duration labels.
INTEREST = {
    "Business": "WSB",
    "Teaching": "WSE",
    "Health": "LSH",
    "Computer Science": "WST",
    "Technology": "WST",
    "Information Technology": "WST",
    "Certificates": "Certificates",
}
SCHOOL = {"BU": "WSB", "HE": "LSH", "IT": "WST", "TC": "WSE"}
SCHOOLS = ["WSB", "WSE", "LSH", "WST"]
ONRAMP_STATUS = {
    "active_onramp_ontime": ["Enrolled"],
    "active_onramp_monthly": ["Enrolled - Month to Month"],
    "paused_onramp": ["Paused"],
    "completed_onramp": ["Graduated"],
    "dropped_onramp": ["Cancelled", "Withdrawn", "Reverse Enrollment"],
    "dropped_onramp_7d": ["Reverse Enrollment"],
    "dropped_onramp_7d_over": ["Cancelled", "Withdrawn"],
}
DEGREE_STATUS = {"active_degree": ["AS"], "dropped_degree": ["DR", "WI"], "graduated_degree": ["GR"]}
ACTIVE_PREFIX = "Enrolled"
NO_STATUS = "Prospecting"
START_EDGES = [7, 14, 30, 60]
START_LABELS = ["7 or fewer days", "8-14 days", "15-30 days", "31-60 days", "61+ days"]


def build_onramp(
    onramp_student: DataFrame,
    onramp_contact: DataFrame,
    id_match: DataFrame,
    tag: str,
    grain: str = "subscription",
    heavy: Mapping[str, Sequence[int]] = MappingProxyType({}),
) -> DataFrame:
    """On-ramp starts with first completion and drop and the matched lead.

    ``tag`` marks contacts of the program.  ``grain='first'`` keeps one start per person
    and contact instead of one per subscription.  ``heavy`` may name heavy values of
    person_id and contact_id.
    """
    starts, completions, drops = event_kinds(onramp_student)
    if grain == "first":
        starts_out = dedupe_first(starts, ["person_id", "contact_id"], "start_date", "subscription_id")
    else:
        starts_out = starts
    out = outcomes(starts_out, completions, drops, heavy=heavy.get("person_id", ()))
    tagged = onramp_contact.select("contact_id", F.when(F.col("subclass").contains(tag), tag).alias("program_tag"))
    by_contact = heavy.get("contact_id", ())
    out = with_stage(out, tagged, "contact_id", heavy=by_contact)
    matches = id_match.withColumn("student_key", F.col("student_key").try_cast("bigint"))
    return match_ids(
        out, matches, "contact_id", "best_enroll", ["lead_id", "student_key", "faa_date", "degree_program", "degree_status"], "lead_id", "referral_lead",
        heavy=by_contact,
    )


def build_inquiry(
    onramp_contact: DataFrame,
    id_match: DataFrame,
    course_enrollment: DataFrame,
    course_completion: DataFrame,
    status_feed: DataFrame,
    lead_demographics: DataFrame,
    student_month: DataFrame,
    tag: str,
    since: date,
    orientation: str,
    start_year: int,
    heavy: Mapping[str, Sequence[int]] = MappingProxyType({}),
    run_ts: datetime | None = None,
) -> DataFrame:
    """One row per inquiry: matched ids, first product, demographics and funnel flags.

    ``heavy`` may name heavy values of person_id, lead_id and student_key, hashed in
    the types joined here.  NULL, for inquiries nothing matches, is always spread.  With
    ``run_ts`` the rows carry it as ``last_refreshed``.
    """
    heavy = {k: [*heavy.get(k, ()), NULL_KEY] for k in ("person_id", "lead_id", "student_key")}
    contacts = screen_test_records(
        onramp_contact.where(F.col("subclass").contains(tag) & (F.col("created_ts") >= F.lit(since))), test_flag="is_test"
    ).select(
        "contact_id",
        blank_to_null("person_id", "null").alias("person_id"),
        F.lit(1).alias("rec_received"),
        F.to_date("created_ts").alias("received_date"),
        week_ending("created_ts").alias("received_week"),
        month_end("created_ts").alias("received_month"),
        F.col("reason").alias("referral_reason"),
        F.lit(tag).alias("program_tag"),
        F.col("product_type").alias("offering_subtype"),
        F.when(F.col("product_type").isin("Single Course", "Course Bundle"), "On-Ramp")
        .otherwise(blank_to_null("product_type", "null"))
        .alias("offering_type"),
        crosswalk("interest", INTEREST).alias("interest_school"),
    )
    start = F.try_to_date("start_date")
    matches = id_match.withColumns(
        {
            "student_key": F.col("student_key").try_cast("bigint"),
            "onramp_start_date": start,
            "onramp_start_week": week_ending(start),
            "onramp_start_month": month_end(start),
            "onramp_status": F.coalesce("status", F.lit(NO_STATUS)),
        }
    )
    refer = ["lead_id", "student_key", "onramp_start_date", "onramp_start_week", "onramp_start_month", "onramp_status", "faa_date", "degree_program", "degree_status"]
    matched = match_ids(contacts, matches, "contact_id", "best_refer", refer, "lead_id", "referral_lead").withColumn(
        "onramp_status", F.coalesce("onramp_status", F.lit(NO_STATUS))
    )
    wanted = matches.select("contact_id", "best_degree", F.col("college_interest").alias("wanted_college"), F.col("degree_program").alias("wanted_program"))
    matched = match_ids(matched, wanted, "contact_id", "best_degree", ["wanted_college", "wanted_program"], "wanted_college")

    product = first_product(course_enrollment, course_completion, "person_id", "course_id", "start", "item", "course", orientation, "completed").select(
        "person_id",
        F.col("start").alias("product_start"),
        F.col("end").alias("product_end"),
        "product",
        "product_type",
        "product_subtype",
        "completed_course_flag",
        "completed_course_date",
    )
    with_product = with_stage(matched, product, "person_id", heavy=heavy.get("person_id", ()))

    first_app = dedupe_first(applications(status_feed), "lead_id", "app_ts", ["college", "level", "program"]).select(
        "lead_id", "app_date", F.col("college").alias("app_college"), F.col("level").alias("app_level"), "path"
    )
    people = enrich_demographics(first_app, lead_demographics, "app_date").drop("birth_date", "non_term")
    shown = ["path", "age_days", "age_years", "gender", "ethnicity", "minority_group", "income", "income_level", "marital_status", "region", "first_time_group", "dma", "state"]
    known = fill_missing(with_stage(with_product, people, "lead_id", heavy=heavy.get("lead_id", ())), shown)

    first_degree = asof_forward_first(
        known.select("student_key", "received_date"),
        student_month.where((F.col("new_start") == 1) & in_year("faa_date", start_year)).select(
            "student_key", F.col("faa_date").alias("degree_start_date"), crosswalk("college", SCHOOL).alias("start_school")
        ),
        "student_key",
        "received_date",
        "degree_start_date",
        strict=True,
        tie="start_school",
        heavy=heavy.get("student_key", ()),
    )
    out = with_stage(known, first_degree, "student_key", heavy=heavy.get("student_key", ()))
    days = days_between("onramp_start_date", "received_date")
    dates = {"started_onramp": "onramp_start_date", "started_degree": "degree_start_date"}
    out = out.withColumns(
        {
            "days_rec_to_onramp": days,
            "bins_rec_to_onramp": bin_days(days, START_EDGES, START_LABELS),
            **{f"start_{k.lower()}": v for k, v in one_hot("start_school", SCHOOLS).items()},
            **funnel_flags("onramp_status", ONRAMP_STATUS, dates),
            **funnel_flags("degree_status", DEGREE_STATUS, {}),
            "active_onramp_total": flag(F.col("onramp_status").startswith(ACTIVE_PREFIX)),
        }
    )
    both = direct_vs_via("started_onramp", "started_degree")
    out = out.withColumns({"started_direct_degree": both["direct"], "started_onramp_and_degree": both["via"]})
    return out if run_ts is None else stamp_refresh(out, run_ts)
