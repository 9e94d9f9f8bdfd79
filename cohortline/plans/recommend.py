"""Recommendations received, one row per lead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import blank_to_null, flag, list_items
from cohortline.operators.asof import asof_backward_last
from cohortline.operators.stages import composite_label, with_stage

# Statuses of applicants not admitted yet, pathways without a product,
# pathways that belong to the on-ramp.
NOT_ADMITTED = ["NAMT", "NAYT", "PEND"]
NO_PRODUCT = "6 Month Term"
ON_RAMP_PRODUCTS = ["Single Course", "Course Bundle"]
EARLY_STAGE = "Pre-Transcript"


def build_recommend(
    recommend_feed: DataFrame, opportunity: DataFrame, counselor_history: DataFrame, heavy: Mapping[str, Sequence[int]] = MappingProxyType({})
) -> DataFrame:
    """Recommendation with its products, stage label and the counselor at that time.

    ``heavy`` may name heavy values of lead_id.
    """
    one, two, three = list_items("products_html", 3)
    lead = opportunity.select(
        "lead_id",
        blank_to_null("products_html").alias("products"),
        one.alias("product1"),
        two.alias("product2"),
        three.alias("product3"),
        blank_to_null("rec_stage").alias("crm_stage"),
        F.col("submit_docs").cast("int").alias("submit_docs"),
    )
    kind = blank_to_null("pathway", NO_PRODUCT)
    status = F.left("status_at_rec", F.lit(4))
    feed = recommend_feed.select(
        "lead_id",
        F.lit(1).alias("rec_flag"),
        F.to_date("rec_ts").alias("rec_date"),
        "rec_ts",
        F.when(kind.isin(ON_RAMP_PRODUCTS), "On-Ramp").otherwise(kind).alias("product_category"),
        kind.alias("product_type"),
        blank_to_null("reason").alias("reason"),
        status.alias("status_at_rec"),
        flag(status.isin(NOT_ADMITTED)).alias("not_admitted_at_rec"),
        F.left("latest_status", F.lit(4)).alias("latest_status"),
        "college",
        "level",
        "program",
    )
    counselor = asof_backward_last(
        feed.select("lead_id", "rec_date"),
        counselor_history.select("lead_id", "status_date", F.col("counselor").alias("counselor_at_rec")),
        "lead_id",
        "rec_date",
        "status_date",
        tie="counselor_at_rec",
        heavy=heavy.get("lead_id", ()),
    ).drop("status_date")
    return (
        with_stage(feed.join(lead, "lead_id", "left"), counselor, "lead_id", heavy=heavy.get("lead_id", ()))
        .withColumns(
            {
                "pre_transcript_flag": flag(F.col("crm_stage").startswith(EARLY_STAGE)),
                "rec_stage": composite_label(
                    "status_at_rec", NOT_ADMITTED, "crm_stage", f"{EARLY_STAGE} + NAYT", "NAYT", EARLY_STAGE
                ),
            }
        )
        .drop("crm_stage")
    )


def with_questions(recommend: DataFrame, background: DataFrame, skills: DataFrame) -> DataFrame:
    """Recommendations widened by both surveys."""
    answers = [c for c in background.columns if c.startswith("pbq_")]
    skill_cols = ["recommend_code", "math", "writing", "resilience", "career", "sc1", "sc2", "sc3", "sc4"]
    products = [F.col(f"product{i}").alias(f"rule_product{i}") for i in (1, 2, 3)]
    return recommend.join(background.select("lead_id", *answers), "lead_id", "left").join(
        skills.select("lead_id", *skill_cols, *products), "lead_id", "left"
    )
