"""Cross-system ids, on-ramp events and products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.recode import any_of, crosswalk, flag, rule_group
from cohortline.functions.text import blank_to_null
from cohortline.operators.asof import asof_forward_first
from cohortline.operators.dedupe import dedupe_first
from cohortline.operators.skew import salted_join
from cohortline.operators.stages import with_stage

# Catalogue names of on-ramp offerings and the labels reports use.
OFFERING_TYPE = {"Single Courses": "On-Ramp", "Course Bundles": "On-Ramp", "Microcredentials": "Certificate"}
OFFERING_SUBTYPE = {"Single Courses": "Single Course", "Course Bundles": "Course Bundle", "Microcredentials": "Certificate"}
UNMATCHED = "Unmatched Opportunity"


def match_ids(df: DataFrame, matches: DataFrame, on: str, best: str, cols: Sequence[str], matched: str, label_as: str | None = None, label: str = UNMATCHED, heavy: Sequence[int] = ()) -> DataFrame:
    """Attach another system's ids from the best match only; every row of ``df`` stays.

    With ``label_as`` a column repeats the id, with ``label`` where there is none.
    """
    chosen = dedupe_first(matches.where(F.col(best)), on, matched).select(on, *cols)
    out = salted_join(df, chosen, on, "left", heavy, [c for c in df.columns if c != on][:4])
    return out.withColumn(label_as, F.coalesce(F.col(matched), F.lit(label))) if label_as else out


def event_kinds(students: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split subscription rows into starts, completions and drops.

    The stage date is the date of each event, the month end its reporting period.
    """
    starts = students.where(F.col("new_start") == 1).select(
        "person_id",
        "contact_id",
        "subscription_id",
        F.col("new_start").alias("start_flag"),
        F.col("stage_date").alias("start_date"),
        F.col("month_end").alias("start_month"),
        F.col("expires").alias("expiration_date"),
        "channel",
        crosswalk("offering_type", OFFERING_TYPE).alias("offering_type"),
        crosswalk("offering_type", OFFERING_SUBTYPE, default="Missing").alias("offering_subtype"),
        F.coalesce("offering_name", F.lit("Missing")).alias("product_code"),
        F.col("title").alias("product_name"),
        F.coalesce(blank_to_null("client", "null"), F.lit("None")).alias("partnership"),
    )
    shared = [
        "channel",
        F.coalesce("offering_type", F.lit("Unavailable")).alias("offering_type"),
        F.coalesce("offering_name", F.lit("Unavailable")).alias("offering_name"),
        F.col("title").alias("product"),
    ]
    ids = ["person_id", "contact_id", "subscription_id"]
    completions = students.where(F.col("complete") == 1).select(
        *ids, F.col("complete").alias("complete_flag"), F.col("stage_date").alias("complete_date"), F.col("month_end").alias("complete_month"), *shared
    )
    early7, early72 = F.col("cancel_7d") == 1, F.col("cancel_72h") == 1
    drops = students.where(any_of(F.col("drops") == 1, early7, early72)).select(
        *ids,
        F.lit(1).alias("drop_flag"),
        flag(early7).alias("drop_7d_flag"),
        flag(early72).alias("drop_72h_flag"),
        F.col("stage_date").alias("drop_date"),
        F.col("month_end").alias("drop_month"),
        *shared,
        F.coalesce(blank_to_null("client", "null"), F.lit("None")).alias("partnership"),
    )
    return starts, completions, drops


def outcomes(starts: DataFrame, completions: DataFrame, drops: DataFrame, on: str = "person_id", heavy: Sequence[int] = ()) -> DataFrame:
    """First completion and first drop on/after any start of the person; flags 0 when none."""
    done = asof_forward_first(
        starts, completions.select(on, "complete_flag", "complete_date"), on, "start_date", "complete_date", tie="complete_flag", heavy=heavy
    )
    kinds = ["drop_flag", "drop_7d_flag", "drop_72h_flag"]
    left = asof_forward_first(starts, drops.select(on, *kinds, "drop_date"), on, "start_date", "drop_date", tie=kinds, heavy=heavy)
    out = with_stage(starts, done, on, zero=["complete_flag"], heavy=heavy)
    return with_stage(out, left, on, zero=kinds, heavy=heavy)


def product_labels(item: str, course: str) -> dict[str, Column]:
    """Product, subtype and type of an enrolment from its item name (for ``withColumns``)."""
    name = F.col(item)
    single = name == "Single Course"
    bundle = any_of(name.startswith("Bundle"), name.startswith("Guaranteed"))
    return {
        "product": F.when(single, F.concat(F.lit("Single Course: "), F.col(course))).otherwise(name),
        "product_subtype": rule_group([(single, "Single Course"), (bundle, "Course Bundle")], "Certificate"),
        "product_type": rule_group([(single | bundle, "On-Ramp")], "Certificate"),
    }


def first_product(enrollments: DataFrame, completions: DataFrame, person: str, course_id: str, start: str, item: str, course: str, orientation: str, completed: str) -> DataFrame:
    """First enrolment per person (orientation aside), labelled, with its completion.

    Completion is looked up on person and course; the earliest one counts.
    """
    real = enrollments.where(~F.col(course).eqNullSafe(orientation))
    first = dedupe_first(real, person, start, [course_id, item]).withColumns(product_labels(item, course))
    done = (
        completions.where(F.col(completed).isNotNull())
        .groupBy(person, course_id)
        .agg(F.min(completed).alias("completed_course_date"))
    )
    return with_stage(first, done, [person, course_id], "completed_course_flag")
