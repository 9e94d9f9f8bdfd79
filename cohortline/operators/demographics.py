"""Demographic enrichment with the recodes the reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.recode import crosswalk, keep_listed, missing_if

# Placeholders that mean "not given", marital codes that are kept, and
# the labels of the two yes/no attributes.
INCOME_PLACEHOLDERS = ["Unknown", "Not reported", "iWouldRatherNotRespond"]
INCOME_LEVEL_PLACEHOLDERS = ["Declined", "Not reported"]
MARITAL = ["Single", "Married", "Divorced", "Separated", "Widowed"]
MINORITY = {"Y": "BHI2+", "N": "Not BHI2+"}
FIRST_TIME = {"Y": "FTFT", "N": "Not FTFT"}


def enrich_demographics(df: DataFrame, demographics: DataFrame, date_col: str) -> DataFrame:
    """Left join on lead_id: age in days and years at ``date_col``, recoded attributes."""
    born = F.to_date(F.try_to_timestamp("dob"))
    recoded = demographics.select(
        "lead_id",
        "gender",
        born.alias("birth_date"),
        crosswalk("minority", MINORITY).alias("minority_group"),
        "ethnicity",
        "region",
        "dma",
        "state",
        missing_if("income", INCOME_PLACEHOLDERS).alias("income"),
        missing_if("income_level", INCOME_LEVEL_PLACEHOLDERS).alias("income_level"),
        crosswalk("first_time", FIRST_TIME).alias("first_time_group"),
        keep_listed("marital", MARITAL).alias("marital_status"),
        F.col("non_term").try_cast("int").alias("non_term"),
    )
    out = df.join(recoded, "lead_id", "left")
    return out.withColumns(
        {
            "age_days": F.date_diff(F.col(date_col), F.col("birth_date")),
            "age_years": F.floor(F.months_between(F.col(date_col), F.col("birth_date")) / 12).cast("int"),
            # a lead without a demographic row is 'Missing' too
            "income": F.coalesce("income", F.lit("Missing")),
            "income_level": F.coalesce("income_level", F.lit("Missing")),
            "marital_status": F.coalesce("marital_status", F.lit("Missing")),
        }
    )
