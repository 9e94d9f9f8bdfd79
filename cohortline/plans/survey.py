"""The two applicant surveys, one row per lead."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import answer_is_yes, crosswalk, disagree_flag, likert_code, local_date, rule_group
from cohortline.operators.dedupe import dedupe_first
from cohortline.operators.survey import apply_rules, attach_responses, earliest_answers, normalize_labels, one_space, pivot_answers, widen_rules
from cohortline.plans import values as V

RULE_KEYS = ["program", "sc1", "sc2", "sc3", "sc4"]


def build_background_long(survey_answer: DataFrame, app: DataFrame, school: str, since: date, skill_survey: str = V.SKILL_SURVEY) -> DataFrame:
    """First answer per person and question, with question id and the person's first application.

    Persons without a completed application are left out.
    """
    rows = survey_answer.where(~F.col("survey").eqNullSafe(skill_survey) & (F.col("created_ts") >= F.lit(since)))
    answers = earliest_answers(rows, "person_id", "question", "created_ts", "answer").select(
        "person_id", "question", answer_is_yes("answer").alias("answer_code"), "created_ts"
    )
    first_app = dedupe_first(app, "person_id", "app_date", ["app_ts", "lead_id", "program", "college", "path"]).select(
        "person_id", "lead_id", "college", "level", "program", "path", "app_date"
    )
    return normalize_labels(answers, "question", V.background_questions(school), "question_id").join(first_app, "person_id")


def build_background(survey_answer: DataFrame, app: DataFrame, school: str, since: date) -> DataFrame:
    """Background answers per lead: first and last response time and one column per listed question."""
    long = build_background_long(survey_answer, app, school, since)
    return pivot_answers(
        long,
        ["lead_id", "person_id"],
        "question_id",
        "answer_code",
        {q: f"pbq_{q}" for q in V.BACKGROUND_COLUMNS},
        [F.min("created_ts").alias("response_first"), F.max("created_ts").alias("response_last")],
    )


def recommend_group(college: str = "college", program: str = "program") -> Column:
    """Program group used for recommendations; the first rule that fits decides."""
    p = F.col(program)
    return rule_group(
        [
            (F.col(college) == V.BUSINESS_COLLEGE, "Business"),
            (p.isin(V.HEALTH_PROFESSIONS), "Health Professions"),
            (p.isin(V.PSYCHOLOGY), "Psychology"),
            (p.isin(V.HEALTH_SCIENCE), "Health Science"),
            (p.isin(V.ELEMENTARY_SPECIAL_ED), "Elementary-Special Ed"),
            (p.isin(V.MATH_SCIENCE_ED), "Math-Science Ed"),
            (p.isin(V.CYBERSECURITY), "BSCIA"),
            (p.isin(V.COMPUTER_SCIENCE), "BSCS"),
            (p.isin(V.DATA_ANALYTICS), "BSDA"),
            (p.startswith(V.CLOUD_PREFIX) | p.isin(V.CLOUD_IT), "Cloud-IT"),
            (p.startswith(V.NETWORK_PREFIX), "BSNES"),
            (p.startswith(V.SOFTWARE_PREFIX), "BSSWE"),
        ]
    )


def skill_answers(survey_answer: DataFrame, zone: str, skill_survey: str = V.SKILL_SURVEY) -> DataFrame:
    """Long skill answers: statement code, answer code, local response day."""
    return survey_answer.where(F.col("survey") == skill_survey).select(
        "person_id",
        crosswalk(one_space("question"), V.SKILL_STATEMENTS).alias("question_code"),
        likert_code("answer").alias("answer_code"),
        "answer",
        local_date("created_ts", zone).alias("response_date"),
        "created_ts",
    )


def build_skill_conf(survey_answer: DataFrame, app: DataFrame, rules: DataFrame, since: date, zone: str = "America/Denver") -> DataFrame:
    """Skill answers per lead with disagree flags and up to three recommended products."""
    answers = skill_answers(survey_answer, zone).where(F.col("question_code").isNotNull())
    apps = app.where(F.col("app_date") >= F.lit(since)).select(
        "person_id", "lead_id", "app_date", "app_ts", "college", F.trim("program").alias("program"), "path"
    )
    rows = attach_responses(answers, apps, "person_id", "question_code", "created_ts", "app_date", ["app_ts", "lead_id", "program", "college", "path"], ["answer_code"])
    statements = list(V.SKILL_STATEMENTS.values())
    wide = pivot_answers(
        rows,
        ["person_id", "lead_id", "college", "program", "app_date", "path"],
        "question_code",
        "answer_code",
        {s: s.lower() for s in statements},
    ).withColumn("recommend_code", recommend_group())
    flagged = wide.withColumns({f"sc{i}": disagree_flag(s.lower()) for i, s in enumerate(statements, 1)})
    trimmed = rules.withColumn("program", F.trim("program"))
    return apply_rules(flagged, widen_rules(trimmed, RULE_KEYS, "seq", "product", 3), RULE_KEYS)
