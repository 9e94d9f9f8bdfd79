"""The checks and summaries published beside each stage.

Each takes the stage (best read back from its table) and returns a small frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import closed_before, month_end
from cohortline.operators.audit import (
    audit_composite,
    audit_join,
    audit_unique,
    audit_unique_rollup,
    compare_full,
    compare_series,
    disagreement,
    duplicates,
    duplicates_rollup,
    mismatch_rows,
    negative_intervals,
    null_profile,
    per_period,
    reconcile,
    work_list,
)
from cohortline.operators.dedupe import dedupe_first
from cohortline.operators.history import retention_avg, running_units
from cohortline.operators.rates import cohort_rates, crosstab, ratio, share_by_group, value_counts
from cohortline.operators.stages import coalesce_segment, cohort_funnel
from cohortline.plans.onramp import SCHOOLS

# Rows per person in the skill survey, courses that do not earn units.
STATEMENTS = 4
NO_UNITS = ["ORA1", "ORA4"]


def monthly(df: DataFrame, day: str, key: str, where: Column | None = None) -> DataFrame:
    """Rows with a known ``key`` per month of ``day``."""
    rows = df if where is None else df.where(where)
    return per_period(rows, month_end(day), F.count(key))


def official_series(official: DataFrame, label: str = "Monthly") -> DataFrame:
    """The official figures of one period type."""
    return per_period(official.where(F.col("period") == label), F.to_date("end_date"), F.sum("value"))


def monthly_check(
    df: DataFrame, day: str, key: str, official: DataFrame, percent: str = "tenth", as_of: date | None = None, where: Column | None = None
) -> DataFrame:
    """A stage's monthly count against the official series."""
    return reconcile(monthly(df, day, key, where), official_series(official), percent, as_of)


def summed_check(df: DataFrame, day: str, flag: str, official: DataFrame, percent: str = "whole") -> DataFrame:
    """The same for a summed flag."""
    return reconcile(per_period(df, month_end(day), F.sum(flag)), official_series(official), percent)


def account_ids(account: DataFrame, as_of: date) -> DataFrame:
    return audit_unique(account.where(closed_before("account_date", as_of)), "lead_id")


def questions_seen(survey_answer: DataFrame, since: date) -> DataFrame:
    """Question wordings in use, most frequent first: where a new wording shows up."""
    return value_counts(survey_answer.where(F.col("created_ts") >= F.lit(since)), "question", order="n")


def response_ids(responses: DataFrame) -> DataFrame:
    return audit_unique(responses.select("person_id", "lead_id").distinct(), "person_id", "lead_id")


def expected_responses(answers: DataFrame, per_person: int = STATEMENTS) -> DataFrame:
    """Persons by row count next to distinct persons: equal when nobody answered twice."""
    return answers.agg((F.count("person_id") / per_person).alias("by_rows"), F.count_distinct("person_id").alias("persons"))


def repeated_responses(answers: DataFrame) -> DataFrame:
    return duplicates(answers, "person_id", STATEMENTS, "response_date")


def repeated_per_day(answers: DataFrame) -> DataFrame:
    return duplicates_rollup(repeated_responses(answers), "last_day", 2 * STATEMENTS)


def product_shares(skills: DataFrame) -> DataFrame:
    return share_by_group(skills, "program", "product1")


def recommended_products(recommend: DataFrame) -> DataFrame:
    return value_counts(recommend, "product_type", "product1", order="value")


def onramp_ids(onramp: DataFrame) -> DataFrame:
    return audit_unique_rollup(onramp, "program_tag", "person_id", "contact_id")


def first_onramp_ids(onramp: DataFrame, tag: str) -> DataFrame:
    """Ids among the first starts of matched leads in the program."""
    first = dedupe_first(onramp.where(F.col("program_tag") == tag), "lead_id", "start_date", "subscription_id")
    return audit_unique(first, "person_id", "contact_id", "lead_id")


def inquiry_ids(inquiry: DataFrame, started_only: bool = False) -> DataFrame:
    rows = inquiry.where(F.col("onramp_start_date").isNotNull()) if started_only else inquiry
    return audit_unique(rows, "person_id", "contact_id", "lead_id")


def unmatched_inquiries(inquiry: DataFrame) -> DataFrame:
    return null_profile(inquiry, ["contact_id", "lead_id"])


def product_known(inquiry: DataFrame) -> DataFrame:
    """Started inquiries with and without a product."""
    rows = inquiry.where(F.col("onramp_start_date").isNotNull()).withColumn("has_product", F.col("product").isNotNull().cast("int"))
    return rows.groupBy("has_product").agg(
        F.count("contact_id").alias("contacts"),
        F.count_distinct("contact_id").alias("unique_contacts"),
        F.count("lead_id").alias("leads"),
        F.count_distinct("lead_id").alias("unique_leads"),
    )


def product_dates(inquiry: DataFrame) -> DataFrame:
    return mismatch_rows(inquiry, "product_start", "onramp_start_date", ["person_id", "product"])


def started_before_applying(inquiry: DataFrame) -> DataFrame:
    return negative_intervals(inquiry, "app_date", "onramp_start_date", ["lead_id"])


def completion_disagreement(inquiry: DataFrame) -> DataFrame:
    return disagreement(inquiry, "completed_onramp", "completed_course_flag")


def school_counts(inquiry: DataFrame, since: date | None = None) -> DataFrame:
    """Matched inquiries per month and school of interest, from a first day on."""
    rows = inquiry.where(F.col("lead_id").isNotNull())
    if since is not None:
        rows = rows.where(F.col("received_date") >= F.lit(since))
    return crosstab(rows, "received_month", "interest_school", SCHOOLS)


def inquiry_monthly(inquiry: DataFrame, tag: str, official: DataFrame, as_of: date) -> DataFrame:
    """Inquiries of a program per closed month against the official series, as a share of our own count."""
    return monthly_check(inquiry, "received_date", "contact_id", official, "share", as_of, F.col("program_tag") == tag)


def attrition_ids(events: DataFrame) -> DataFrame:
    return audit_unique_rollup(events, "flag", "student_key", "lead_id")


def attrition_terms(events: DataFrame, key: str = "student_key") -> DataFrame:
    """Flagged rows and distinct terms of a student or lead."""
    return audit_composite(events.where(F.col("flag") == 1), key, "term_start")


def attrition_monthly(events: DataFrame, official: DataFrame) -> DataFrame:
    """Flagged rows per term month against the official series, with distinct leads."""
    flagged = events.where(F.col("flag") == 1)
    ours = flagged.groupBy(month_end("term_start").alias("period")).agg(F.count("lead_id").alias("n"), F.count_distinct("lead_id").alias("unique_n"))
    return reconcile(ours, official_series(official))


def attrition_agreement(ours: DataFrame, day: str, events: DataFrame) -> DataFrame:
    """Two derivations of one number: a table's rows per month and the distinct flagged leads."""
    unique = per_period(events.where(F.col("flag") == 1), month_end("term_start"), F.count_distinct("lead_id"))
    return reconcile(monthly(ours, day, "lead_id"), unique)


def starts_kept(starts: DataFrame, joined: DataFrame) -> DataFrame:
    return audit_join(starts, joined, "lead_id")


def graduation_rates(success: DataFrame) -> DataFrame:
    return cohort_rates(success, "faa_month", {"grads": "grad_flag"}, {"grad_date": "grad_date"})


def snapshot_rates(student_month: DataFrame, since: date, level: str = "UG") -> DataFrame:
    """Graduation rate per start month straight from the snapshots."""
    rows = student_month.where((F.col("faa_date") >= F.lit(since)) & (F.col("level") == level))
    starts, grads = F.sum(F.col("new_start").cast("bigint")), F.sum(F.col("grad").cast("bigint"))
    return rows.groupBy(month_end("faa_date").alias("start_month")).agg(
        starts.alias("starts"), grads.alias("grads"), ratio(grads, starts).alias("cohort_rate")
    ).orderBy("start_month")


def drop_rates(success: DataFrame) -> DataFrame:
    return cohort_rates(success, "faa_month", {"drops": "drop_flag", "t1_drops": "drop_t1_flag"})


def retention_table(success: DataFrame) -> DataFrame:
    """Average retention and students per snapshot month, both horizons."""
    seven, thirteen = retention_avg(success, "ret7", "r7_date", "r7"), retention_avg(success, "ret13", "r13_date", "r13")
    return seven.join(thirteen, "month", "left").orderBy(F.desc("month"))


def student_units(assessment: DataFrame, as_of: date) -> DataFrame:
    """Units completed and attempted per student and closed term, and so far."""
    done, tried = F.col("completed") == 1, F.col("assigned") == 1
    rows = assessment.where(closed_before("term_end", as_of) & ~F.col("course").isin(*NO_UNITS) & (done | tried))
    return running_units(
        rows,
        "student_id",
        "term_end",
        {"units_completed": F.when(done, F.col("credits")).otherwise(0.0), "units_attempted": F.when(tried, F.col("credits")).otherwise(0.0)},
    )


def inquiry_funnel(cohort: DataFrame) -> DataFrame:
    """Inquiries per month and how far they came."""
    steps = ["started_onramp", "started_degree", "degree_start_flag", "started_onramp_and_degree", "started_direct_degree"]
    counts = {"referrals": F.lit(True), "recommended": F.col("rec_flag") == 1, **{s: F.col(s) == 1 for s in steps if s in cohort.columns}}
    return cohort_funnel(cohort, "received_month", counts)


def school_sources(cohort: DataFrame) -> DataFrame:
    """Matched inquiries per school by field of interest and by the first known school."""
    rows = cohort.where(F.col("lead_id").isNotNull())
    interest = coalesce_segment("interest_without_cert")
    a = rows.groupBy(interest.alias("school")).agg(F.count(F.lit(1)).alias("by_interest"))
    b = rows.groupBy("school").agg(F.count(F.lit(1)).alias("by_first_known"))
    return compare_full(a, b, "school", "by_interest", "by_first_known")


def start_series(cohort: DataFrame, tag: str) -> DataFrame:
    """On-ramp starts per month: all, tagged, recommended."""
    started = cohort.where(F.col("onramp_start_date").isNotNull() & F.col("lead_id").isNotNull())
    return compare_series(
        started, month_end("onramp_start_date"), {"n_all": F.lit(True), "n_tagged": F.col("program_tag") == tag, "n_recommended": F.col("rec_flag") == 1}
    )


def follow_up(cohort: DataFrame, stage: str, path: str, since: date, as_of: date, cols: Sequence[str]) -> DataFrame:
    """Recommended leads at one stage and on one path, not followed up yet."""
    return work_list(
        cohort, (F.col("rec_stage") == stage) & (F.col("path") == path) & (F.col("rec_date") > F.lit(since)) & closed_before("rec_date", as_of), cols
    )


def recommended_without_app(cohort: DataFrame, path: str) -> DataFrame:
    return work_list(
        cohort,
        (F.col("rec_flag") == 1) & (F.col("path") == path) & F.col("app_date").isNull(),
        ["lead_id", "account_date", "rec_date", "status_at_rec", "rec_stage"],
    )
