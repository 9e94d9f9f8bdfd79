"""Accounts created and applications completed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import blank_to_null, month_end, normalize_text, week_ending
from cohortline.operators.audit import screen_test_records
from cohortline.operators.dedupe import dedupe_first, dedupe_last, latest_snapshot
from cohortline.operators.skew import small_side
from cohortline.operators.demographics import enrich_demographics

# Status codes of a created account, labels of the two application paths,
# values that mark a record to leave out.
ACCOUNT_CODES = ["APIN", "APNN"]
GUIDED, UNGUIDED = "SSE", "Legacy"
REJECT = {"bad_reason": "Test Lead", "lead_quality": "Bad Lead"}


def path_label(guided: str = "guided") -> Column:
    return F.when(F.col(guided) == 1, GUIDED).otherwise(UNGUIDED)


def program_groups(program_grouping: DataFrame) -> DataFrame:
    """Program to group in the newest report, one row per program; a checked small lookup."""
    newest = latest_snapshot(program_grouping, "report_date", ["program", "program_group"])
    return small_side(dedupe_first(newest, "program", "program_group"))


def crm_lead(opportunity: DataFrame, contact: DataFrame) -> DataFrame:
    """CRM lead with its person id; ids cleaned, the student key as a number."""
    people = contact.select("contact_id", blank_to_null("person_id").alias("person_id"))
    return (
        opportunity.withColumns(
            {
                "student_key": blank_to_null("student_key").try_cast("bigint"),
                "name": normalize_text("name"),
                "email": normalize_text("email"),
            }
        )
        .join(people, "contact_id", "left")
        .drop("contact_id")
    )


def build_account(
    status_feed: DataFrame,
    opportunity: DataFrame,
    contact: DataFrame,
    program_grouping: DataFrame,
    lead_demographics: DataFrame,
    since: date,
    codes: Sequence[str] = ACCOUNT_CODES,
) -> DataFrame:
    """One row per lead whose account was created since ``since``: the highest lead count.

    The newest row is picked before any join, so the joins see one row per lead.
    """
    feed = status_feed.where((F.col("status_date") >= F.lit(since)) & F.col("status_code").isin(*codes)).select(
        "lead_id",
        F.to_date("status_ts").alias("account_date"),
        F.col("status_ts").alias("account_ts"),
        week_ending("status_ts").alias("account_week"),
        month_end("status_ts").alias("account_month"),
        "college",
        "level",
        "program",
        path_label().alias("path"),
        F.col("lead_count").try_cast("int").alias("lead_count"),
    )
    lead = crm_lead(opportunity, contact).select(
        "lead_id",
        "student_key",
        "person_id",
        "lead_quality",
        F.left("status", F.lit(4)).alias("status_latest"),
        "evals_outstanding",
        "eval_status",
        "eval_first_sent",
        "eval_app_complete",
        "evals_completed",
        "name",
        "email",
    )
    tie = ["account_ts", "college", "level", "program", "path"]
    out = (
        dedupe_last(feed, "lead_id", "lead_count", tie)
        .join(lead, "lead_id", "left")
        .join(program_groups(program_grouping), "program", "left")
    )
    return enrich_demographics(out, lead_demographics, "account_date")


def applications(status_feed: DataFrame) -> DataFrame:
    """Completed applications, distinct."""
    return (
        status_feed.where(F.col("app_complete") == 1)
        .select(
            "lead_id",
            F.to_date("status_ts").alias("app_date"),
            F.col("status_ts").alias("app_ts"),
            "college",
            "level",
            "program",
            "counselor",
            path_label().alias("path"),
        )
        .distinct()
    )


def build_app(
    status_feed: DataFrame,
    opportunity: DataFrame,
    contact: DataFrame,
    program_grouping: DataFrame,
    lead_demographics: DataFrame,
    good_only: bool = True,
) -> DataFrame:
    """Completed applications of known leads, without test and bad leads unless asked for.

    A lead may have several; ``audit_unique`` shows how many.
    """
    lead = crm_lead(opportunity, contact).select(
        "lead_id", "student_key", "person_id", F.col("status").alias("status_latest"), "lead_quality", "bad_reason", "name", "email"
    )
    if good_only:
        lead = screen_test_records(lead, name="name", reject=REJECT)
    out = (
        applications(status_feed)
        .join(lead, "lead_id")
        .join(program_groups(program_grouping), "program", "left")
        .withColumn("app_flag", F.lit(1))
    )
    return enrich_demographics(out, lead_demographics, "app_date")
