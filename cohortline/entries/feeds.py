"""Stage tables and marts built from inputs derived from the driver's tables.

Each input is one query that Spark and DuckDB both understand: customers act as leads,
orders as their dated records.  The stage logic is written twice, once with the
builders and once in SQL.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from cohortline import plans
from cohortline.functions import blank_to_null
from cohortline.operators.audit import audit_unique
from cohortline.operators.matching import event_kinds
from cohortline.operators.skew import heavy_by_key, merge_heavy
from cohortline.operators.survey import rule_coverage, widen_rules
from cohortline.plans import reports as R
from cohortline.plans.degree import start_ids
from cohortline.plans.recommend import with_questions
from cohortline.plans.survey import RULE_KEYS, skill_answers
from cohortline.session import configure, keep, new_folder
from cohortline.sources import StageStore, table_from

SINCE = date(1996, 1, 1)
AS_OF = date(2001, 1, 1)
RUN_TS = datetime(2001, 1, 2)
ZONE = "America/Denver"
TAG = "Alpha"

LEAD = "'L' || CAST(o_custkey AS STRING)"
PROGRAM = """CASE o_orderkey % 9 WHEN 0 THEN 'BSIT' WHEN 1 THEN 'MSITMUG' WHEN 2 THEN 'BSCC1' WHEN 3 THEN 'MBA' WHEN 4 THEN 'BSPSY'
  WHEN 5 THEN 'BSNES2' WHEN 6 THEN 'BASPEE' WHEN 7 THEN 'BSSWE' ELSE 'XYZ' END"""
COLLEGE = "CASE o_orderstatus WHEN 'F' THEN 'BU' WHEN 'O' THEN 'HE' ELSE 'IT' END"

INPUTS = {
    "status_feed": f"""SELECT {LEAD} AS lead_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'APIN' WHEN '2-HIGH' THEN 'APNN' ELSE 'OTHR' END AS status_code,
        o_orderdate AS status_ts, CAST(o_orderdate AS DATE) AS status_date, {COLLEGE} AS college,
        CASE WHEN o_orderpriority < '3' THEN 'UG' ELSE 'GR' END AS level, {PROGRAM} AS program,
        CAST(floor(o_totalprice / 1000) AS INT) AS lead_count, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS guided,
        CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS app_complete, o_orderpriority AS counselor FROM {{orders}}""",
    "opportunity": """SELECT 'L' || CAST(c_custkey AS STRING) AS lead_id,
        CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS student_key, 'C' || CAST(c_custkey AS STRING) AS contact_id,
        CASE WHEN c_nationkey = 4 THEN ' Test ' ELSE ' ' END || c_name AS name, c_name || '@Mail.X ' AS email,
        CASE WHEN c_nationkey < 12 THEN 'NAYT - waiting' ELSE 'INTV' END AS status,
        CASE WHEN c_nationkey = 3 THEN 'Bad Lead' WHEN c_nationkey < 20 THEN 'Good Lead' END AS lead_quality,
        CASE WHEN c_nationkey = 5 THEN 'Test Lead' END AS bad_reason,
        CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN '<ul><li> One</li></ul>' WHEN c_nationkey < 20
          THEN '<ul><li>One</li><li>Two </li><li>Three</li></ul>' END AS products_html,
        CASE WHEN c_nationkey < 8 THEN 'Pre-Transcript A' WHEN c_nationkey < 16 THEN '' END AS rec_stage, c_nationkey > 10 AS submit_docs,
        CAST(c_nationkey AS STRING) AS evals_outstanding, 'open' AS eval_status, 'no' AS eval_first_sent, 'no' AS eval_app_complete,
        c_mktsegment AS evals_completed FROM {customer}""",
    "contact": """SELECT 'C' || CAST(c_custkey AS STRING) AS contact_id,
        CASE WHEN c_nationkey = 7 THEN '' ELSE 'U' || CAST(c_custkey AS STRING) END AS person_id FROM {customer}""",
    "program_grouping": f"""SELECT DISTINCT CAST('2000-01-31' AS DATE) AS report_date, 'Old' AS program_group, {PROGRAM.replace('o_orderkey', 'p_partkey')} AS program FROM {{part}}
        UNION ALL SELECT DISTINCT CAST('2000-02-29' AS DATE), CASE WHEN p_partkey % 9 < 4 THEN 'Tech' ELSE 'Arts' END, {PROGRAM.replace('o_orderkey', 'p_partkey')}
        FROM {{part}} WHERE p_partkey % 9 <> 8""",
    "lead_demographics": """SELECT 'L' || CAST(c_custkey AS STRING) AS lead_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CASE WHEN c_nationkey = 2 THEN 'unknown' ELSE CAST(1950 + c_nationkey AS STRING) || '-03-10' END AS dob,
        CASE WHEN c_nationkey < 5 THEN 'Y' WHEN c_nationkey < 20 THEN 'N' ELSE '?' END AS minority, c_mktsegment AS ethnicity,
        CASE WHEN c_nationkey < 20 THEN 'R' || CAST(c_nationkey AS STRING) END AS region, 'D1' AS dma, 'S' AS state,
        CASE c_nationkey WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Not reported' WHEN 3 THEN 'iWouldRatherNotRespond' ELSE 'Some' END AS income,
        CASE c_nationkey WHEN 1 THEN 'Declined' WHEN 2 THEN 'Not reported' ELSE 'High' END AS income_level,
        CASE WHEN c_nationkey < 9 THEN 'Y' ELSE 'N' END AS first_time, CASE WHEN c_nationkey < 12 THEN 'Single' ELSE 'Other' END AS marital,
        CASE WHEN c_nationkey = 6 THEN 'x' ELSE '1' END AS non_term FROM {customer} WHERE c_nationkey <> 11""",
    "survey_answer": """SELECT 'U' || CAST(o_custkey AS STRING) AS person_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Skillset Confidence' WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'Background' END AS survey,
        CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'I''m comfortable with advanced math concepts.'
            WHEN 1 THEN 'It is easy for me to combine information from different places and write clear arguments.'
            WHEN 2 THEN 'I was successful in achieving my goals with my most recent educational experience.'
            WHEN 3 THEN 'My long term career goals are clearly defined.' ELSE 'Something else' END
          ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Do you have a high school diploma or equivalent?' WHEN 1 THEN 'Did you earn a Bachelor''s Degree?'
            WHEN 2 THEN 'Did you earn a Bachelor''s degree?' WHEN 3 THEN 'Was your cumulative GPA 2.5 or higher?' ELSE 'Unlisted question?' END END AS question,
        CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'strongly_disagree' WHEN '2-HIGH' THEN 'somewhat_disagree'
            WHEN '3-MEDIUM' THEN 'somewhat_agree' WHEN '4-NOT SPECIFIED' THEN 'strongly_agree' ELSE 'odd' END
          ELSE CASE WHEN o_orderstatus = 'F' THEN 'no' WHEN o_orderstatus = 'O' THEN 'yes' END END AS answer,
        o_orderdate AS created_ts FROM {orders}""",
    "recommend_rules": """SELECT DISTINCT program, CAST(a % 2 AS INT) AS sc1, CAST(a % 3 % 2 AS INT) AS sc2, CAST(a % 5 % 2 AS INT) AS sc3, CAST(a % 7 % 2 AS INT) AS sc4,
        CAST(a % 3 + 1 AS INT) AS seq, 'Course ' || CAST(a % 4 AS STRING) AS product FROM (SELECT p_partkey AS a,
        CASE p_partkey % 3 WHEN 0 THEN ' BSIT' WHEN 1 THEN 'MBA' ELSE 'BSPSY ' END AS program FROM {part})""",
    "recommend_feed": f"""SELECT {LEAD} AS lead_id, min(o_orderdate) AS rec_ts,
        min(CASE o_orderstatus WHEN 'F' THEN 'Single Course' WHEN 'O' THEN '6 Month Term' ELSE '' END) AS pathway,
        max(CASE WHEN o_totalprice > 300000 THEN 'High' ELSE '' END) AS reason,
        min(CASE o_orderstatus WHEN 'F' THEN 'PEND x' WHEN 'O' THEN 'INTV x' END) AS status_at_rec, max(o_orderpriority) AS latest_status,
        min({COLLEGE}) AS college, 'UG' AS level, max({PROGRAM}) AS program FROM {{orders}} WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey""",
    "counselor_history": f"SELECT {LEAD} AS lead_id, o_orderpriority AS counselor, CAST(o_orderdate AS DATE) AS status_date FROM {{orders}} WHERE o_orderstatus <> 'P'",
    "field_history": f"""SELECT {LEAD} AS lead_id, CASE WHEN o_orderstatus = 'P' THEN 'Other' ELSE 'CareStatus__c' END AS field,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'NAYT x' WHEN '2-HIGH' THEN 'INTV y' WHEN '3-MEDIUM' THEN 'PEND' ELSE 'APIN' END AS new_value,
        o_orderdate + INTERVAL '3' HOUR AS created_ts FROM {{orders}}""",
    "student_transcript": f"""SELECT {LEAD} AS lead_id, CASE o_orderkey % 4 WHEN 0 THEN 'Bachelor''s' WHEN 1 THEN 'No Degree Earned' WHEN 2 THEN 'Other' END AS degree_type
        FROM {{orders}} WHERE o_orderstatus = 'F'""",
    "transcript_summary": """SELECT 'L' || CAST(c_custkey AS STRING) AS lead_id, c_nationkey AS courses_failed, 1 AS courses_withdrawn, 2 AS courses_passed,
        3 AS courses_attempted, CAST(c_nationkey AS DOUBLE) AS transfer_credits, CAST(1 AS DOUBLE) AS not_transfer_credits, CAST(3 AS DOUBLE) AS gpa_all,
        CAST(2 AS DOUBLE) AS gpa_transfer, CAST(4 AS DOUBLE) AS gpa_hs FROM {customer} WHERE c_nationkey > 15""",
    "onramp_student": f"""SELECT 'U' || CAST(o_custkey AS STRING) AS person_id, 'C' || CAST(o_custkey AS STRING) AS contact_id,
        'S' || CAST(o_orderkey AS STRING) AS subscription_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS new_start,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS complete, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS drops,
        CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 300000 THEN 1 ELSE 0 END AS cancel_7d,
        CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN 1 END AS cancel_72h,
        last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(o_orderdate AS DATE) AS stage_date, CAST(o_orderdate AS DATE) + 180 AS expires,
        o_orderstatus AS channel, CASE o_orderstatus WHEN 'F' THEN 'Single Courses' WHEN 'O' THEN 'Course Bundles' ELSE 'Microcredentials' END AS offering_type,
        {PROGRAM} AS offering_name, 'T' || o_orderstatus AS title, CASE WHEN o_totalprice < 100000 THEN 'null' ELSE 'Partner' END AS client FROM {{orders}}""",
    "onramp_contact": """SELECT 'C' || CAST(c_custkey AS STRING) AS contact_id,
        CASE WHEN c_nationkey = 7 THEN 'null' ELSE 'U' || CAST(c_custkey AS STRING) END AS person_id,
        CASE c_nationkey % 3 WHEN 0 THEN 'Alpha;Beta' WHEN 1 THEN 'Alpha' ELSE 'Beta' END AS subclass,
        CAST(CAST('1995-06-01' AS DATE) + CAST(c_custkey % 900 AS INT) AS TIMESTAMP) AS created_ts, 'r' AS reason,
        CASE c_nationkey % 4 WHEN 0 THEN 'Single Course' WHEN 1 THEN 'null' WHEN 2 THEN 'Certificate' ELSE 'Course Bundle' END AS product_type,
        CASE c_nationkey % 5 WHEN 0 THEN 'Business' WHEN 1 THEN 'Technology' WHEN 2 THEN 'Certificates' WHEN 3 THEN 'Health' END AS interest,
        CASE WHEN c_nationkey = 8 THEN TRUE WHEN c_nationkey < 8 THEN FALSE END AS is_test FROM {customer}""",
    "id_match": """SELECT 'C' || CAST(c_custkey AS STRING) AS contact_id, 'L' || CAST(c_custkey AS STRING) AS lead_id,
        CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS student_key, c_nationkey < 20 AS best_refer, c_nationkey < 22 AS best_enroll,
        c_nationkey > 4 AS best_degree,
        CASE WHEN c_nationkey % 4 = 0 THEN 'null' ELSE CAST(CAST('1996-06-01' AS DATE) + CAST(c_custkey % 700 AS INT) AS STRING) END AS start_date,
        CASE c_nationkey % 6 WHEN 0 THEN 'Enrolled' WHEN 1 THEN 'Enrolled - Month to Month' WHEN 2 THEN 'Graduated' WHEN 3 THEN 'Withdrawn' WHEN 4 THEN 'Reverse Enrollment' END AS status,
        CASE c_nationkey % 3 WHEN 0 THEN 'AS' WHEN 1 THEN 'DR' ELSE 'GR' END AS degree_status, c_mktsegment AS degree_program,
        'Q' || c_mktsegment AS college_interest, CAST('1997-01-01' AS DATE) AS faa_date FROM {customer}
        UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), 'X', '', FALSE, FALSE, FALSE, 'null', 'Paused', 'WI', 'none', 'none', CAST('1997-01-01' AS DATE) FROM {customer}""",
    "course_enrollment": """SELECT 'U' || CAST(o_custkey AS STRING) AS person_id, 'K' || CAST(o_orderkey % 5 AS STRING) AS course_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Single Course' WHEN '2-HIGH' THEN 'Bundle A' WHEN '3-MEDIUM' THEN 'Guaranteed B' ELSE 'Micro' END AS item,
        CASE WHEN o_orderstatus = 'P' THEN 'Welcome' ELSE 'Course ' || o_orderstatus END AS course, CAST(o_orderdate AS DATE) AS start,
        CAST(o_orderdate AS DATE) + 90 AS "end" FROM {orders}""",
    "course_completion": """SELECT 'U' || CAST(o_custkey AS STRING) AS person_id, 'K' || CAST(o_orderkey % 5 AS STRING) AS course_id,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS completed FROM {orders}""",
    "new_start": f"""SELECT {LEAD} AS lead_id, o_orderdate AS closed_ts, {COLLEGE} AS college, CASE WHEN o_orderkey % 11 > 0 THEN {PROGRAM} END AS program,
        CASE WHEN o_totalprice > 300000 THEN 'Graduated' WHEN o_totalprice > 100000 THEN 'Never at Academy' END AS onramp_stage,
        CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Mid' END AS income_level, 'R' AS region, 'E' AS ethnicity, 'N' AS minority
        FROM {{orders}} WHERE o_orderpriority = '4-NOT SPECIFIED'""",
    "student_demographics": """SELECT c_custkey AS student_key, 'F' AS gender, c_mktsegment AS employment, 'Some' AS household_income
        FROM {customer} WHERE c_nationkey <> 1""",
    "student_month": f"""SELECT o_custkey AS student_key, o_custkey + 1000000 AS student_id, CAST(o_orderdate AS DATE) AS faa_date,
        last_day(CAST(o_orderdate AS DATE)) AS month_end, {COLLEGE} AS college, CASE WHEN o_totalprice > 50000 THEN 'UG' ELSE 'GR' END AS level,
        {PROGRAM} AS program, CASE WHEN o_orderpriority < '4' THEN 1 ELSE 0 END AS new_start, CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END AS grad,
        CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 0 END AS ret7, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS ret13,
        CAST(o_orderkey % 3 + 1 AS INT) AS term_seq, CAST(o_orderkey % 2 AS INT) AS term_otp, CAST(o_orderdate AS DATE) AS term_start,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS reverse_start FROM {{orders}}""",
    "student_drop": """SELECT o_custkey AS student_key, o_custkey + 1000000 AS student_id, last_day(CAST(o_orderdate AS DATE)) AS month_end,
        CAST(o_orderkey % 3 + 1 AS INT) AS term_seq, o_orderpriority AS drop_type, o_orderstatus AS drop_sub_type FROM {orders} WHERE o_totalprice > 250000""",
    "term_progress": """SELECT o_custkey + 1000000 AS student_id, CAST(o_orderkey % 3 + 1 AS INT) AS term_seq,
        CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS limited_progress, floor(o_totalprice / 10000) AS earned_cus FROM {orders} WHERE o_orderstatus <> 'P'""",
    "attrition_45d": f"""SELECT {LEAD} AS lead_id, o_custkey AS student_key, CAST(o_orderdate AS DATE) AS term_start, CAST(l_linenumber + 1 AS INT) AS wk,
        CAST(l_shipdate AS DATE) AS wk_end, CASE l_returnflag WHEN 'R' THEN 'Drop' WHEN 'A' THEN 'Active' ELSE 'tsca' END AS status,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, {COLLEGE} AS college, {PROGRAM} AS program FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "official_monthly": """SELECT 'Monthly' AS period, last_day(CAST(o_orderdate AS DATE)) AS end_date, count(*) AS value FROM {orders}
        WHERE o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 <> 0 GROUP BY last_day(CAST(o_orderdate AS DATE))
        UNION ALL SELECT 'Weekly', last_day(CAST(o_orderdate AS DATE)), count(*) FROM {orders} GROUP BY last_day(CAST(o_orderdate AS DATE))""",
    "assessment": """SELECT l_suppkey AS student_id, last_day(CAST(l_shipdate AS DATE)) AS term_end, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS completed,
        CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS assigned, l_quantity AS credits, CASE WHEN l_linenumber = 1 THEN 'ORA1' ELSE 'C' END AS course FROM {lineitem}""",
    "term_week": "SELECT CAST(o_orderdate AS DATE) AS term_start, CAST(o_orderdate AS DATE) + 56 AS wk_end, 8 AS wk FROM {orders}",
}


class Inputs:
    """The derived inputs of one folder, made when asked for."""

    def __init__(self, spark, folder):
        self.spark = configure(spark)
        self.tables = {t: table_from(spark, folder, t) for t in ("orders", "customer", "lineitem", "part")}
        self.stages, self.folder = {}, folder
        place = new_folder(spark, "stages")
        self.store = StageStore(spark, place) if place else None

    def __getattr__(self, name):
        text = INPUTS[name].replace('"end"', "`end`")
        return self.spark.sql(text, **{t: df for t, df in self.tables.items() if "{" + t + "}" in text})

    def take(self, *names):
        return [getattr(self, n) for n in names]

    def stage(self, *builds):
        """Stages as published tables of this run's store, for several readers; they are built side by side."""
        for build in builds:
            if build not in self.stages and self.store is None:
                self.stages[build] = build(self)
        new = {b.__name__: b for b in builds if b not in self.stages}
        if new:
            made = self.store.stages({name: (lambda b=b: b(self), {"tables": self.folder}) for name, b in new.items()})
            self.stages.update({b: made[name] for name, b in new.items()})
        found = [self.stages[b] for b in builds]
        return found[0] if len(found) == 1 else found

    def shared(self, build):
        """The published table where there is one, else the stage itself."""
        return self.stages[build] if build in self.stages else build(self)


CRM = ["status_feed", "opportunity", "contact", "program_grouping", "lead_demographics"]


def account(i):
    return plans.build_account(*i.take(*CRM), since=SINCE)


def app(i):
    return plans.build_app(*i.take(*CRM))


def background(i):
    return plans.build_background(i.survey_answer, i.shared(app), "ACME", SINCE)


def skills(i):
    return plans.build_skill_conf(i.survey_answer, i.shared(app), i.recommend_rules, SINCE, ZONE)


def recommend(i):
    return plans.build_recommend(i.recommend_feed, i.opportunity, i.counselor_history, heavy_by_key(i.counselor_history, "lead_id"))


def onramp(i):
    return plans.build_onramp(*i.take("onramp_student", "onramp_contact", "id_match"), tag=TAG, heavy=heavy_by_key(i.onramp_student, "person_id", "contact_id"))


def inquiry(i):
    names = ["onramp_contact", "id_match", "course_enrollment", "course_completion", "status_feed", "lead_demographics", "student_month"]
    # hashed as the builder joins them: cleaned and typed
    matches = i.id_match.select("lead_id", F.col("student_key").try_cast("bigint").alias("student_key"))
    people = i.onramp_contact.select(blank_to_null("person_id", "null").alias("person_id"))
    heavy = merge_heavy(heavy_by_key(matches, "lead_id", "student_key"), heavy_by_key(people, "person_id"))
    return plans.build_inquiry(*i.take(*names), tag=TAG, since=SINCE, orientation="Welcome", start_year=1998, heavy=heavy, run_ts=RUN_TS)


def degree_start(i):
    names = ["new_start", "opportunity", "student_demographics", "program_grouping", "attrition_45d", "student_month", "term_week"]
    return plans.build_degree_start(*i.take(*names), since=SINCE, as_of=AS_OF)


def degree_success(i):
    return plans.build_degree_success(*i.take("student_month", "student_drop", "term_progress"), since=SINCE)


def questions(i):
    i.stage(app)  # both surveys read the applications
    return with_questions(recommend(i), background(i), skills(i))


def cohort_account(i):
    """Every stage is published once, then read; the builder writes two narrow frames."""
    accounts, apps, advice, starts, entered, success = i.stage(account, app, recommend, degree_start, onramp, degree_success)
    return plans.build_cohort_account(
        accounts,
        apps,
        advice,
        starts,
        entered,
        i.student_transcript,
        i.field_history,
        success,
        i.transcript_summary,
        ZONE,
        heavy=merge_heavy(heavy_by_key(i.status_feed, "lead_id"), heavy_by_key(i.student_month, "student_key")),
        keep=keep,
    )


def cohort_inquiry(i):
    return plans.build_cohort_inquiry(*i.stage(inquiry, recommend, degree_start), heavy_by_key(i.id_match, "lead_id"))


def demo_sql(source: str, day: str) -> str:
    """Demographic enrichment of ``source`` in SQL."""
    born = "try_cast(d.dob AS DATE)"
    return f"""SELECT t.*, d.gender, {born} AS birth_date, CASE d.minority WHEN 'Y' THEN 'BHI2+' WHEN 'N' THEN 'Not BHI2+' END AS minority_group,
    d.ethnicity, d.region, d.dma, d.state,
    CASE WHEN d.income IN ('Unknown', 'Not reported', 'iWouldRatherNotRespond') OR d.income IS NULL THEN 'Missing' ELSE d.income END AS income,
    CASE WHEN d.income_level IN ('Declined', 'Not reported') OR d.income_level IS NULL THEN 'Missing' ELSE d.income_level END AS income_level,
    CASE d.first_time WHEN 'Y' THEN 'FTFT' WHEN 'N' THEN 'Not FTFT' END AS first_time_group,
    CASE WHEN d.marital IN ('Single', 'Married', 'Divorced', 'Separated', 'Widowed') THEN d.marital ELSE 'Missing' END AS marital_status,
    try_cast(d.non_term AS INTEGER) AS non_term, CAST(date_diff('day', {born}, t.{day}) AS INTEGER) AS age_days,
    CAST(date_sub('year', {born}, t.{day}) AS INTEGER) AS age_years
    FROM {source} t LEFT JOIN lead_demographics d ON d.lead_id = t.lead_id"""


def days(end: str, start: str) -> str:
    return f"CAST(date_diff('day', {start}, {end}) AS INTEGER)"


def bins(value: str, edges: list[int], labels: list[str]) -> str:
    steps = " ".join(f"WHEN {value} <= {e} THEN '{n}'" for e, n in zip(edges, labels))
    return f"CASE {steps} WHEN {value} > {edges[-1]} THEN '{labels[-1]}' END"


def school_sql(c: str) -> str:
    return f"CASE {c} WHEN 'BU' THEN 'WSB' WHEN 'HE' THEN 'LSH' WHEN 'IT' THEN 'WST' WHEN 'TC' THEN 'WSE' END"


PATH_SQL = "CASE WHEN guided = 1 THEN 'SSE' ELSE 'Legacy' END AS path"
KEY_SQL = "try_cast(nullif(student_key, '') AS BIGINT)"

# each stage in SQL, in dependency order
STAGES = {
    "groups": """SELECT program, min(program_group) AS program_group FROM program_grouping
        WHERE report_date = (SELECT max(report_date) FROM program_grouping) GROUP BY 1""",
    "crm": f"""SELECT lead_id, {KEY_SQL} AS student_key, nullif(person_id, '') AS person_id, status, lead_quality, bad_reason, evals_outstanding,
        eval_status, eval_first_sent, eval_app_complete, evals_completed, trim(lower(name)) AS name, trim(lower(email)) AS email
        FROM opportunity LEFT JOIN contact USING (contact_id)""",
    "acc0": f"""SELECT lead_id, CAST(status_ts AS DATE) AS account_date, status_ts AS account_ts, CAST(date_trunc('week', status_ts) AS DATE) + 6 AS account_week,
        last_day(CAST(status_ts AS DATE)) AS account_month, college, level, program, {PATH_SQL}, lead_count
        FROM status_feed WHERE status_date >= DATE '1996-01-01' AND status_code IN ('APIN', 'APNN')
        QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY lead_count DESC, status_ts DESC, college DESC, level DESC, program DESC, path DESC) = 1""",
    "acc1": """SELECT a.*, student_key, person_id, lead_quality, left(status, 4) AS status_latest, evals_outstanding, eval_status, eval_first_sent,
        eval_app_complete, evals_completed, name, email, program_group FROM acc0 a LEFT JOIN crm USING (lead_id) LEFT JOIN groups USING (program)""",
    "account": demo_sql("acc1", "account_date"),
    "applied0": f"""SELECT DISTINCT lead_id, CAST(status_ts AS DATE) AS app_date, status_ts AS app_ts, college, level, program, counselor, {PATH_SQL}
        FROM status_feed WHERE app_complete = 1""",
    "app0": """SELECT a.*, student_key, person_id, status AS status_latest, lead_quality, bad_reason, name, email, program_group, 1 AS app_flag
        FROM applied0 a JOIN crm USING (lead_id) LEFT JOIN groups USING (program)
        WHERE bad_reason IS DISTINCT FROM 'Test Lead' AND lead_quality IS DISTINCT FROM 'Bad Lead' AND NOT coalesce(lower(name) LIKE 'test%', FALSE)""",
    "app": demo_sql("app0", "app_date"),
    "background": """SELECT b.lead_id, b.person_id,
        max(code) FILTER (question_id = 'hs_diploma') AS pbq_hs_diploma, max(code) FILTER (question_id = 'assoc_degree_plus') AS pbq_assoc_degree_plus,
        max(code) FILTER (question_id = 'bachelor_degree') AS pbq_bachelor_degree, max(code) FILTER (question_id = 'bachelor_degree_plus') AS pbq_bachelor_degree_plus,
        max(code) FILTER (question_id = 'college_gpa20_plus') AS pbq_college_gpa20_plus, max(code) FILTER (question_id = 'college_gpa25_plus') AS pbq_college_gpa25_plus,
        max(code) FILTER (question_id = 'gpa25_plus') AS pbq_gpa25_plus, max(code) FILTER (question_id = 'hsgpa25_plus') AS pbq_hsgpa25_plus,
        min(created_ts) AS response_first, max(created_ts) AS response_last
        FROM (SELECT person_id, created_ts, CASE WHEN answer = 'no' THEN 0 WHEN answer IS NOT NULL THEN 1 END AS code,
            CASE question WHEN 'Do you have a high school diploma or equivalent?' THEN 'hs_diploma' WHEN 'Did you earn a Bachelor''s Degree?' THEN 'bachelor_degree'
              WHEN 'Did you earn a Bachelor''s degree?' THEN 'bachelor_degree' WHEN 'Was your cumulative GPA 2.5 or higher?' THEN 'gpa25_plus' ELSE question END AS question_id
          FROM survey_answer WHERE survey IS DISTINCT FROM 'Skillset Confidence' AND created_ts >= DATE '1996-01-01'
          QUALIFY row_number() OVER (PARTITION BY person_id, question ORDER BY created_ts, answer NULLS LAST) = 1) r
        JOIN (SELECT person_id, lead_id FROM app QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY app_date, app_ts, lead_id) = 1) b USING (person_id)
        GROUP BY 1, 2""",
    "skill_answers": """SELECT person_id, created_ts,
        CASE question WHEN 'I''m comfortable with advanced math concepts.' THEN 'Math'
          WHEN 'It is easy for me to combine information from different places and write clear arguments.' THEN 'Writing'
          WHEN 'I was successful in achieving my goals with my most recent educational experience.' THEN 'Resilience'
          WHEN 'My long term career goals are clearly defined.' THEN 'Career' END AS qc,
        CASE answer WHEN 'strongly_disagree' THEN 1 WHEN 'somewhat_disagree' THEN 2 WHEN 'somewhat_agree' THEN 3 WHEN 'strongly_agree' THEN 4 END AS code
        FROM survey_answer WHERE survey = 'Skillset Confidence'
        QUALIFY qc IS NOT NULL AND row_number() OVER (PARTITION BY person_id, qc ORDER BY created_ts DESC, code DESC NULLS LAST) = 1""",
    "skill_wide": """SELECT s.person_id, a.lead_id, a.college, trim(a.program) AS program, a.app_date, a.path, max(code) FILTER (qc = 'Math') AS math,
        max(code) FILTER (qc = 'Writing') AS writing, max(code) FILTER (qc = 'Resilience') AS resilience, max(code) FILTER (qc = 'Career') AS career
        FROM skill_answers s JOIN (SELECT * FROM app WHERE app_date >= DATE '1996-01-01'
          QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY app_date DESC, app_ts DESC, lead_id DESC, program DESC, college DESC, path DESC) = 1) a USING (person_id)
        GROUP BY 1, 2, 3, 4, 5, 6""",
    "skill_flags": """SELECT *, CASE WHEN math <= 2 THEN 1 ELSE 0 END AS sc1, CASE WHEN writing <= 2 THEN 1 ELSE 0 END AS sc2,
        CASE WHEN resilience <= 2 THEN 1 ELSE 0 END AS sc3, CASE WHEN career <= 2 THEN 1 ELSE 0 END AS sc4,
        CASE WHEN college = 'BU' THEN 'Business' WHEN program = 'BSPSY' THEN 'Psychology' WHEN program IN ('BASPEE') THEN 'Elementary-Special Ed'
          WHEN program LIKE 'BSCC%' OR program IN ('BSIT', 'MSITMUG') THEN 'Cloud-IT' WHEN program LIKE 'BSNES%' THEN 'BSNES'
          WHEN program LIKE 'BSSWE%' THEN 'BSSWE' ELSE 'Other' END AS recommend_code FROM skill_wide""",
    "skills": """SELECT f.*, product1, product2, product3 FROM skill_flags f LEFT JOIN (
          SELECT trim(program) AS program, sc1, sc2, sc3, sc4, min(product) FILTER (seq = 1) AS product1, min(product) FILTER (seq = 2) AS product2,
          min(product) FILTER (seq = 3) AS product3 FROM recommend_rules GROUP BY 1, 2, 3, 4, 5) r USING (program, sc1, sc2, sc3, sc4)""",
    "recommend": """SELECT r.lead_id, 1 AS rec_flag, CAST(rec_ts AS DATE) AS rec_date, rec_ts,
        CASE WHEN pathway IN ('Single Course', 'Course Bundle') THEN 'On-Ramp' WHEN pathway NOT IN ('', '6 Month Term') THEN pathway END AS product_category,
        CASE WHEN pathway NOT IN ('', '6 Month Term') THEN pathway END AS product_type, nullif(reason, '') AS reason, left(status_at_rec, 4) AS status_at_rec,
        CASE WHEN left(status_at_rec, 4) IN ('NAMT', 'NAYT', 'PEND') THEN 1 ELSE 0 END AS not_admitted_at_rec, left(latest_status, 4) AS latest_status,
        r.college, r.level, r.program, nullif(products_html, '') AS products,
        nullif(trim(regexp_extract(products_html, '<li>([^<]+)</li>', 1)), '') AS product1,
        nullif(trim(regexp_extract(products_html, '<li>([^<]+)</li><li>([^<]+)</li>', 2)), '') AS product2,
        nullif(trim(regexp_extract(products_html, '<li>([^<]+)</li><li>([^<]+)</li><li>([^<]+)</li>', 3)), '') AS product3,
        CAST(submit_docs AS INTEGER) AS submit_docs, counselor_at_rec, CASE WHEN rec_stage LIKE 'Pre-Transcript%' THEN 1 ELSE 0 END AS pre_transcript_flag,
        CASE WHEN left(status_at_rec, 4) IN ('NAMT', 'NAYT', 'PEND') THEN CASE WHEN nullif(rec_stage, '') IS NOT NULL THEN 'Pre-Transcript + NAYT' ELSE 'NAYT' END
          WHEN status_at_rec IS NOT NULL AND nullif(rec_stage, '') IS NOT NULL THEN 'Pre-Transcript' ELSE 'Missing' END AS rec_stage
        FROM recommend_feed r LEFT JOIN opportunity o ON o.lead_id = r.lead_id LEFT JOIN (
          SELECT h.lead_id, h.counselor AS counselor_at_rec FROM recommend_feed f JOIN counselor_history h ON h.lead_id = f.lead_id AND h.status_date <= CAST(f.rec_ts AS DATE)
          QUALIFY row_number() OVER (PARTITION BY h.lead_id ORDER BY h.status_date DESC, h.counselor DESC) = 1) c ON c.lead_id = r.lead_id""",
    "os": """SELECT person_id, contact_id, subscription_id, new_start AS start_flag, stage_date AS start_date, month_end AS start_month, expires AS expiration_date, channel,
        CASE WHEN offering_type IN ('Single Courses', 'Course Bundles') THEN 'On-Ramp' ELSE 'Certificate' END AS offering_type,
        CASE offering_type WHEN 'Single Courses' THEN 'Single Course' WHEN 'Course Bundles' THEN 'Course Bundle' ELSE 'Certificate' END AS offering_subtype,
        offering_name AS product_code, title AS product_name, CASE WHEN client = 'null' THEN 'None' ELSE client END AS partnership FROM onramp_student WHERE new_start = 1""",
    "oc": """SELECT person_id, min(stage_date) AS complete_date FROM onramp_student c WHERE complete = 1
        AND EXISTS (SELECT 1 FROM os WHERE os.person_id = c.person_id AND os.start_date <= c.stage_date) GROUP BY 1""",
    "od": """SELECT person_id, stage_date AS drop_date, coalesce(cancel_7d, 0) AS d7, coalesce(cancel_72h, 0) AS d72 FROM onramp_student c
        WHERE (drops = 1 OR cancel_7d = 1 OR cancel_72h = 1)
        AND EXISTS (SELECT 1 FROM os WHERE os.person_id = c.person_id AND os.start_date <= c.stage_date)
        QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY stage_date, d7, d72) = 1""",
    "onramp": f"""SELECT os.*, CASE WHEN oc.person_id IS NULL THEN 0 ELSE 1 END AS complete_flag, complete_date, CASE WHEN od.person_id IS NULL THEN 0 ELSE 1 END AS drop_flag,
        coalesce(d7, 0) AS drop_7d_flag, coalesce(d72, 0) AS drop_72h_flag, drop_date, CASE WHEN subclass LIKE '%Alpha%' THEN 'Alpha' END AS program_tag,
        m.lead_id, {KEY_SQL.replace('student_key', 'm.student_key')} AS student_key, m.faa_date, m.degree_program, m.degree_status,
        coalesce(m.lead_id, 'Unmatched Opportunity') AS referral_lead
        FROM os LEFT JOIN oc ON oc.person_id = os.person_id LEFT JOIN od ON od.person_id = os.person_id
        LEFT JOIN onramp_contact k ON k.contact_id = os.contact_id LEFT JOIN id_match m ON m.contact_id = os.contact_id AND m.best_enroll""",
    "inq0": f"""SELECT k.contact_id, CASE WHEN k.person_id NOT IN ('', 'null') THEN k.person_id END AS person_id, 1 AS rec_received, CAST(created_ts AS DATE) AS received_date,
        CAST(date_trunc('week', created_ts) AS DATE) + 6 AS received_week, last_day(CAST(created_ts AS DATE)) AS received_month, k.reason AS referral_reason,
        'Alpha' AS program_tag, product_type AS offering_subtype, CASE WHEN product_type IN ('Single Course', 'Course Bundle') THEN 'On-Ramp'
          WHEN product_type <> 'null' THEN product_type END AS offering_type,
        CASE interest WHEN 'Business' THEN 'WSB' WHEN 'Technology' THEN 'WST' WHEN 'Health' THEN 'LSH' WHEN 'Certificates' THEN 'Certificates' END AS interest_school,
        m.lead_id, {KEY_SQL.replace('student_key', 'm.student_key')} AS student_key, try_cast(m.start_date AS DATE) AS onramp_start_date,
        CAST(date_trunc('week', try_cast(m.start_date AS DATE)) AS DATE) + 6 AS onramp_start_week, last_day(try_cast(m.start_date AS DATE)) AS onramp_start_month,
        coalesce(m.status, 'Prospecting') AS onramp_status, m.faa_date, m.degree_program, m.degree_status,
        coalesce(m.lead_id, 'Unmatched Opportunity') AS referral_lead, w.college_interest AS wanted_college, w.degree_program AS wanted_program
        FROM onramp_contact k LEFT JOIN id_match m ON m.contact_id = k.contact_id AND m.best_refer LEFT JOIN id_match w ON w.contact_id = k.contact_id AND w.best_degree
        WHERE subclass LIKE '%Alpha%' AND created_ts >= DATE '1996-01-01' AND NOT coalesce(is_test, FALSE)""",
    "enrolled": """SELECT person_id, course_id, start AS product_start, "end" AS product_end, CASE WHEN item = 'Single Course' THEN 'Single Course: ' || course ELSE item END AS product,
        CASE WHEN item = 'Single Course' OR item LIKE 'Bundle%' OR item LIKE 'Guaranteed%' THEN 'On-Ramp' ELSE 'Certificate' END AS product_type,
        CASE WHEN item = 'Single Course' THEN item WHEN item LIKE 'Bundle%' OR item LIKE 'Guaranteed%' THEN 'Course Bundle' ELSE 'Certificate' END AS product_subtype
        FROM course_enrollment WHERE course <> 'Welcome' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY start, course_id, item) = 1""",
    "finished": "SELECT person_id, course_id, min(completed) AS completed_course_date FROM course_completion WHERE completed IS NOT NULL GROUP BY 1, 2",
    "first_app": """SELECT lead_id, app_date, college AS app_college, level AS app_level, path FROM applied0
        QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY app_ts, college, level, program) = 1""",
    "people": demo_sql("first_app", "app_date"),
    "inq1": """SELECT i.*, product_start, product_end, product, product_type, product_subtype,
        CASE WHEN e.person_id IS NOT NULL THEN CASE WHEN completed_course_date IS NULL THEN 0 ELSE 1 END END AS completed_course_flag, completed_course_date,
        app_date, app_college, app_level,
        """ + ", ".join(f"coalesce(CAST(p.{c} AS VARCHAR), 'Missing') AS {c}" for c in [
            "path", "age_days", "age_years", "gender", "ethnicity", "minority_group", "income", "income_level", "marital_status", "region", "first_time_group", "dma", "state"]) + """
        FROM inq0 i LEFT JOIN enrolled e ON e.person_id = i.person_id LEFT JOIN finished f ON f.person_id = e.person_id AND f.course_id = e.course_id
        LEFT JOIN people p ON p.lead_id = i.lead_id""",
    "inq_degree": f"""SELECT s.student_key, s.faa_date AS degree_start_date, {school_sql('s.college')} AS start_school
        FROM student_month s JOIN (SELECT student_key, min(received_date) AS a FROM inq1 GROUP BY 1) i ON i.student_key = s.student_key AND s.faa_date > i.a
        WHERE new_start = 1 AND year(s.faa_date) = 1998
        QUALIFY row_number() OVER (PARTITION BY s.student_key ORDER BY s.faa_date, start_school NULLS LAST) = 1""",
    "inquiry": f"""SELECT i.*, TIMESTAMP '2001-01-02 00:00:00' AS last_refreshed, degree_start_date, start_school, {days('onramp_start_date', 'received_date')} AS days_rec_to_onramp,
        {bins(days('onramp_start_date', 'received_date'), [7, 14, 30, 60], ['7 or fewer days', '8-14 days', '15-30 days', '31-60 days', '61+ days'])} AS bins_rec_to_onramp,
        CASE WHEN start_school = 'WSB' THEN 1 ELSE 0 END AS start_wsb, CASE WHEN start_school = 'WSE' THEN 1 ELSE 0 END AS start_wse,
        CASE WHEN start_school = 'LSH' THEN 1 ELSE 0 END AS start_lsh, CASE WHEN start_school = 'WST' THEN 1 ELSE 0 END AS start_wst,
        CASE WHEN onramp_start_date IS NOT NULL THEN 1 ELSE 0 END AS started_onramp, CASE WHEN onramp_status LIKE 'Enrolled%' THEN 1 ELSE 0 END AS active_onramp_total,
        CASE WHEN onramp_status = 'Enrolled' THEN 1 ELSE 0 END AS active_onramp_ontime, CASE WHEN onramp_status = 'Enrolled - Month to Month' THEN 1 ELSE 0 END AS active_onramp_monthly,
        CASE WHEN onramp_status = 'Paused' THEN 1 ELSE 0 END AS paused_onramp, CASE WHEN onramp_status = 'Graduated' THEN 1 ELSE 0 END AS completed_onramp,
        CASE WHEN onramp_status IN ('Cancelled', 'Withdrawn', 'Reverse Enrollment') THEN 1 ELSE 0 END AS dropped_onramp,
        CASE WHEN onramp_status = 'Reverse Enrollment' THEN 1 ELSE 0 END AS dropped_onramp_7d, CASE WHEN onramp_status IN ('Cancelled', 'Withdrawn') THEN 1 ELSE 0 END AS dropped_onramp_7d_over,
        CASE WHEN degree_start_date IS NOT NULL THEN 1 ELSE 0 END AS started_degree, CASE WHEN degree_status = 'AS' THEN 1 ELSE 0 END AS active_degree,
        CASE WHEN degree_status IN ('DR', 'WI') THEN 1 ELSE 0 END AS dropped_degree, CASE WHEN degree_status = 'GR' THEN 1 ELSE 0 END AS graduated_degree,
        CASE WHEN onramp_start_date IS NULL AND degree_start_date IS NOT NULL THEN 1 ELSE 0 END AS started_direct_degree,
        CASE WHEN onramp_start_date IS NOT NULL AND degree_start_date IS NOT NULL THEN 1 ELSE 0 END AS started_onramp_and_degree
        FROM inq1 i LEFT JOIN inq_degree d ON d.student_key = i.student_key""",
    "starts": f"""SELECT n.lead_id, CAST(closed_ts AS DATE) AS start_date, last_day(CAST(closed_ts AS DATE)) AS start_month, n.college,
        CASE WHEN n.program LIKE 'M%' AND n.program <> 'MSITMUG' THEN 'GR' WHEN n.program IS NOT NULL THEN 'UG' END AS level, n.program, n.region, n.ethnicity, n.minority,
        CASE WHEN n.income_level IN ('High', 'Low') THEN n.income_level ELSE 'Missing' END AS income_level, onramp_stage,
        CASE WHEN onramp_stage = 'Graduated' THEN 1 ELSE 0 END AS onramp_completed_flag, CASE WHEN onramp_stage <> 'Never at Academy' THEN 1 ELSE 0 END AS onramp_attended_flag,
        try_cast(o.student_key AS BIGINT) AS student_key, gender, employment, household_income, program_group
        FROM new_start n LEFT JOIN opportunity o ON o.lead_id = n.lead_id LEFT JOIN student_demographics s ON s.student_key = try_cast(o.student_key AS BIGINT)
        LEFT JOIN groups g ON g.program = n.program WHERE closed_ts >= DATE '1996-01-01'""",
    "att": """SELECT lead_id, student_key, term_start, wk, wk_end, status, flag FROM attrition_45d
        WHERE term_start >= DATE '1996-01-01' AND wk <= 8 AND upper(status) <> 'TSCA'
        UNION ALL SELECT l.lead_id, r.student_key, r.term_start, 8, w.wk_end, 'TSCA', 1
        FROM (SELECT DISTINCT student_key, term_start FROM student_month WHERE reverse_start = 1 AND term_start >= DATE '1996-01-01') r
        JOIN (SELECT DISTINCT term_start, wk_end FROM term_week WHERE wk = 8 AND wk_end <= DATE '2001-01-01') w USING (term_start)
        LEFT JOIN (SELECT student_key, start_date AS term_start, min(lead_id) AS lead_id FROM starts GROUP BY 1, 2) l ON l.student_key = r.student_key AND l.term_start = r.term_start
        WHERE NOT EXISTS (SELECT 1 FROM attrition_45d s WHERE upper(s.status) NOT IN ('TSCA', 'ACTIVE') AND s.wk = 8 AND s.student_key = r.student_key AND s.term_start = r.term_start)""",
    "att_one": """SELECT lead_id, term_start, flag, status FROM (SELECT * FROM att WHERE flag = 1 AND lead_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY lead_id, student_key, term_start ORDER BY wk_end DESC, wk DESC, status DESC) = 1)
        QUALIFY row_number() OVER (PARTITION BY lead_id, term_start ORDER BY wk_end DESC, student_key DESC) = 1""",
    "degree_start": """SELECT s.*, a.flag AS attrition_flag, a.status AS attrition_status FROM starts s
        LEFT JOIN att_one a ON a.lead_id = s.lead_id AND a.term_start = s.start_date""",
    "stu": """SELECT student_key, student_id, faa_date, college AS college_faa, level AS level_faa, program AS program_faa FROM student_month
        WHERE level = 'UG' AND faa_date >= DATE '1996-01-01' AND new_start = 1
        QUALIFY row_number() OVER (PARTITION BY student_key, student_id ORDER BY faa_date, college, program) = 1""",
    "stu_drop": """SELECT d.student_key, d.month_end AS drop_date, drop_type, drop_sub_type, CASE WHEN term_seq = 1 THEN 1 ELSE 0 END AS t1, CASE WHEN term_seq = 2 THEN 1 ELSE 0 END AS t2
        FROM stu s JOIN student_drop d ON d.student_key = s.student_key AND d.student_id = s.student_id AND d.month_end > s.faa_date
        QUALIFY row_number() OVER (PARTITION BY d.student_key ORDER BY d.month_end, drop_type, drop_sub_type, t1, t2) = 1""",
    "stu_r7": """SELECT m.student_key, m.ret7, m.month_end AS r7_date FROM stu s JOIN student_month m ON m.student_key = s.student_key AND m.month_end > s.faa_date
        WHERE m.ret7 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.student_key ORDER BY m.month_end, m.ret7) = 1""",
    "stu_r13": """SELECT m.student_key, m.ret13, m.month_end AS r13_date FROM stu s JOIN student_month m ON m.student_key = s.student_key AND m.month_end > s.faa_date
        WHERE m.ret13 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.student_key ORDER BY m.month_end, m.ret13) = 1""",
    "stu_units": """SELECT student_id, max(limited_progress) FILTER (term_seq = 1) AS limit_prog_t1, max(limited_progress) FILTER (term_seq = 2) AS limit_prog_t2,
        CAST(max(earned_cus) FILTER (term_seq = 1) AS INTEGER) AS earned_cus_t1, CAST(max(earned_cus) FILTER (term_seq = 2) AS INTEGER) AS earned_cus_t2 FROM term_progress p
        WHERE EXISTS (SELECT 1 FROM student_month m WHERE m.student_id = p.student_id AND m.term_seq = p.term_seq AND m.term_seq IN (1, 2) AND m.faa_date >= DATE '1996-01-01')
        GROUP BY 1""",
    "stu_otp": """SELECT student_key, max(term_otp) FILTER (term_seq = 1) AS t1_otp, max(term_otp) FILTER (term_seq = 2) AS t2_otp FROM student_month
        WHERE faa_date >= DATE '1996-01-01' AND faa_date < month_end GROUP BY student_key, student_id, faa_date
        QUALIFY row_number() OVER (PARTITION BY student_key ORDER BY faa_date) = 1""",
    "degree_success": """SELECT s.*, CAST(date_trunc('month', faa_date) AS DATE) AS faa_month, CASE WHEN grad_date IS NULL THEN 0 ELSE 1 END AS grad_flag, grad_date,
        CASE WHEN drop_date IS NULL THEN 0 ELSE 1 END AS drop_flag, drop_date, drop_type, drop_sub_type, coalesce(t1, 0) AS drop_t1_flag, coalesce(t2, 0) AS drop_t2_flag,
        ret7, r7_date, ret13, r13_date, limit_prog_t1, limit_prog_t2, earned_cus_t1, earned_cus_t2, t1_otp, t2_otp
        FROM stu s LEFT JOIN (SELECT g.student_key, min(g.month_end) AS grad_date FROM student_month g JOIN stu ON stu.student_key = g.student_key AND g.month_end > stu.faa_date
          WHERE grad = 1 GROUP BY 1) g USING (student_key) LEFT JOIN stu_drop USING (student_key) LEFT JOIN stu_r7 USING (student_key) LEFT JOIN stu_r13 USING (student_key)
        LEFT JOIN stu_units USING (student_id) LEFT JOIN stu_otp USING (student_key)""",
}

SIX = [7, 14, 30, 60, 90], ["0-7 days", "8-14 days", "14-30 days", "31-60 days", "61-90 days", "90+ days"]
FOUR = [30, 60, 90], ["0-30 days", "31-60 days", "61-90 days", "90+ days"]
DURATIONS = {
    "account_to_app": ("app_date", "account_date", None),
    "app_to_rec": ("rec_date", "app_date", SIX),
    "app_to_degree_start": ("degree_start_date", "app_date", FOUR),
    "rec_to_onramp_start": ("onramp_start_date", "rec_date", SIX),
    "onramp_start_to_complete": ("complete_date", "onramp_start_date", FOUR),
    "onramp_start_to_drop": ("onramp_drop_date", "onramp_start_date", FOUR),
    "onramp_complete_to_degree_start": ("degree_start_date", "complete_date", SIX),
    "degree_start_to_complete": ("grad_date", "degree_start_date", FOUR),
    "degree_start_to_drop": ("drop_date", "degree_start_date", FOUR),
}
RECOMMENDED = (
    "rec_flag, rec_date, rec_ts, product_category, product_type, reason, products, product1, product2, product3, rec_stage, submit_docs, "
    "status_at_rec, not_admitted_at_rec, counselor_at_rec"
)

MART_STAGES = {
    "m_app": "SELECT p.lead_id, app_flag, app_date, app_ts FROM app p JOIN account a ON a.lead_id = p.lead_id AND app_date >= account_date",
    "m_rec": f"SELECT r.lead_id, {RECOMMENDED} FROM recommend r JOIN account a ON a.lead_id = r.lead_id AND rec_date >= account_date",
    "m_deg": """SELECT d.lead_id, min(d.start_date) AS degree_start_date FROM degree_start d
        WHERE EXISTS (SELECT 1 FROM m_app p WHERE p.lead_id = d.lead_id AND d.start_date >= p.app_date) GROUP BY 1""",
    "m_on": """SELECT o.lead_id, start_date AS onramp_start_date, channel, offering_type, offering_subtype, product_code, product_name, partnership, program_tag, complete_flag,
        complete_date, drop_flag AS onramp_drop_flag, drop_date AS onramp_drop_date, drop_7d_flag, drop_72h_flag
        FROM onramp o JOIN m_rec r ON r.lead_id = o.lead_id AND o.start_date >= r.rec_date
        QUALIFY row_number() OVER (PARTITION BY o.lead_id ORDER BY start_date, subscription_id) = 1""",
    "m_tr": """SELECT lead_id, max(CASE WHEN degree_type LIKE 'Doctor%' OR degree_type LIKE 'Mast%' OR degree_type LIKE 'Bach%' OR degree_type LIKE 'Assoc%'
        THEN 1 ELSE 0 END) AS has_degree FROM student_transcript GROUP BY 1""",
    "hist": """SELECT lead_id, CAST(created_ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Denver' AS DATE) AS sd, created_ts, new_value
        FROM field_history WHERE field = 'CareStatus__c'""",
    "m_st": """SELECT h.lead_id, h.sd, new_value AS v FROM hist h JOIN (SELECT lead_id, max(app_date) AS a FROM m_app GROUP BY 1) p ON p.lead_id = h.lead_id AND h.sd <= p.a
        QUALIFY row_number() OVER (PARTITION BY h.lead_id ORDER BY sd DESC, created_ts DESC, new_value DESC) = 1""",
    "m_su": """SELECT s.student_key, s.faa_date, grad_flag, grad_date, drop_flag, drop_date, drop_type, drop_sub_type, drop_t1_flag, drop_t2_flag, ret7, ret13, r7_date, r13_date,
        limit_prog_t1, limit_prog_t2, earned_cus_t1, earned_cus_t2, t1_otp, t2_otp FROM degree_success s JOIN (SELECT student_key, min(app_date) AS a FROM account
          JOIN m_app USING (lead_id) GROUP BY 1) p ON p.student_key = s.student_key AND s.faa_date >= p.a
        QUALIFY row_number() OVER (PARTITION BY s.student_key ORDER BY s.faa_date, student_id) = 1""",
    "m_all": """SELECT a.*, m_app.* EXCLUDE (lead_id), m_rec.* EXCLUDE (lead_id), degree_start_date, CASE WHEN m_deg.lead_id IS NULL THEN 0 ELSE 1 END AS degree_start_flag,
        m_on.* EXCLUDE (lead_id), CASE WHEN m_on.lead_id IS NULL THEN 0 ELSE 1 END AS onramp_start_flag,
        CASE WHEN m_deg.lead_id IS NOT NULL AND m_on.lead_id IS NULL THEN 1 ELSE 0 END AS direct_degree_start_flag,
        CASE WHEN m_deg.lead_id IS NOT NULL AND m_on.lead_id IS NOT NULL THEN 1 ELSE 0 END AS degree_start_with_onramp_flag, has_degree, t.* EXCLUDE (lead_id),
        CASE WHEN m_st.lead_id IS NOT NULL THEN CASE WHEN v LIKE 'NAYT%' OR v LIKE 'NAMT%' OR v LIKE 'PEND%' THEN 1 ELSE 0 END END AS nayt_flag,
        CASE WHEN v LIKE 'NAYT%' OR v LIKE 'NAMT%' OR v LIKE 'PEND%' THEN sd END AS nayt_date,
        CASE WHEN m_st.lead_id IS NOT NULL THEN CASE WHEN v LIKE 'INTV%' THEN 1 ELSE 0 END END AS intv_flag, CASE WHEN v LIKE 'INTV%' THEN sd END AS intv_date,
        m_su.* EXCLUDE (student_key)
        FROM account a LEFT JOIN m_app ON m_app.lead_id = a.lead_id LEFT JOIN m_rec ON m_rec.lead_id = a.lead_id LEFT JOIN m_deg ON m_deg.lead_id = a.lead_id
        LEFT JOIN m_on ON m_on.lead_id = a.lead_id LEFT JOIN m_tr ON m_tr.lead_id = a.lead_id LEFT JOIN transcript_summary t ON t.lead_id = a.lead_id
        LEFT JOIN m_st ON m_st.lead_id = a.lead_id LEFT JOIN m_su ON m_su.student_key = a.student_key""",
    "cohort_account": "SELECT *, "
    + ", ".join(f"{days(e, s)} AS days_{n}" for n, (e, s, _) in DURATIONS.items())
    + ", "
    + ", ".join(f"{bins(days(e, s), *b)} AS bins_{n}" for n, (e, s, b) in DURATIONS.items() if b)
    + " FROM m_all",
    "i_deg": """SELECT d.lead_id, d.start_date AS join_start_date, d.college AS start_college, d.level AS start_level, d.program AS start_program
        FROM degree_start d JOIN (SELECT lead_id, min(received_date) AS a FROM inquiry GROUP BY 1) i ON i.lead_id = d.lead_id AND d.start_date >= i.a
        QUALIFY row_number() OVER (PARTITION BY d.lead_id ORDER BY d.start_date, d.program NULLS LAST) = 1""",
    "cohort_inquiry": f"""SELECT i.*, coalesce(rec_flag, 0) AS rec_flag, rec_date, rec_ts, product_category, r.product_type AS rec_product_type, reason, products,
        coalesce(rec_stage, 'Missing') AS rec_stage, status_at_rec, coalesce(not_admitted_at_rec, 0) AS not_admitted_at_rec, latest_status,
        {school_sql('r.college')} AS rec_school, r.level AS rec_level, r.program AS rec_program,
        CASE WHEN interest_school <> 'Certificates' THEN interest_school END AS interest_without_cert,
        coalesce({school_sql('r.college')}, CASE WHEN interest_school <> 'Certificates' THEN interest_school END, 'Missing') AS school,
        join_start_date, start_college, start_level, start_program, CASE WHEN d.lead_id IS NULL THEN 0 ELSE 1 END AS degree_start_flag,
        {days('join_start_date', 'app_date')} AS days_app_to_degree_start
        FROM inquiry i LEFT JOIN recommend r ON r.lead_id = i.lead_id LEFT JOIN i_deg d ON d.lead_id = i.lead_id""",
    "questions": """SELECT r.*, pbq_hs_diploma, pbq_assoc_degree_plus, pbq_bachelor_degree, pbq_bachelor_degree_plus, pbq_college_gpa20_plus, pbq_college_gpa25_plus,
        pbq_gpa25_plus, pbq_hsgpa25_plus, recommend_code, math, writing, resilience, career, sc1, sc2, sc3, sc4, s.product1 AS rule_product1,
        s.product2 AS rule_product2, s.product3 AS rule_product3
        FROM recommend r LEFT JOIN background b ON b.lead_id = r.lead_id LEFT JOIN skills s ON s.lead_id = r.lead_id""",
}


def stage_sql(query: str) -> str:
    """The query over the inputs and stages, as common tables in dependency order."""
    parts = []
    for key, text in {**INPUTS, **STAGES, **MART_STAGES}.items():
        for t in ("orders", "customer", "lineitem", "part"):
            text = text.replace("{" + t + "}", t)
        parts.append(f"{key} AS ({text})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM ({query}) AS answer"


BUILDERS = {
    "stage_account": (account, "account"),
    "stage_app": (app, "app"),
    "stage_background": (background, "background"),
    "stage_skill_conf": (skills, "skills"),
    "stage_recommend": (recommend, "recommend"),
    "stage_questions": (questions, "questions"),
    "stage_onramp": (onramp, "onramp"),
    "stage_inquiry": (inquiry, "inquiry"),
    "stage_degree_start": (degree_start, "degree_start"),
    "stage_degree_success": (degree_success, "degree_success"),
    "mart_cohort_account": (cohort_account, "cohort_account"),
    "mart_cohort_inquiry": (cohort_inquiry, "cohort_inquiry"),
}


def skill_rows(i):
    return skill_answers(i.survey_answer, ZONE)


def attrition(i):
    ids = start_ids(i.new_start, i.opportunity, SINCE)
    return plans.build_attrition(i.attrition_45d, i.student_month, ids, i.term_week, SINCE, AS_OF)


OFFICIAL_SQL = "(SELECT CAST(end_date AS DATE) AS period, CAST(sum(value) AS BIGINT) AS n_official FROM official_monthly WHERE period = 'Monthly' GROUP BY 1)"


def check_sql(table: str, day: str, n: str, percent: str, where: str = "TRUE", closed: bool = False) -> str:
    """A monthly reconciliation in SQL."""
    shown = {"tenth": "round(diff / n_official, 3) * 100", "whole": "round(diff / n_official * 100, 0)", "share": "round(diff / n_etl, 2)"}[percent]
    late = " AND period < DATE '2001-01-01'" if closed else ""
    return f"""SELECT *, {shown} AS percent_diff FROM (SELECT period, n_etl, n_official, n_etl - n_official AS diff FROM
        (SELECT last_day({day}) AS period, CAST({n} AS BIGINT) AS n_etl FROM {table} WHERE {where} GROUP BY 1) a JOIN {OFFICIAL_SQL} b USING (period)) WHERE TRUE{late}"""


def ids_sql(table: str, *ids: str) -> str:
    cols = ", ".join(f"count({c}) AS {c}_n, count(DISTINCT {c}) AS {c}_unique, count({c}) - count(DISTINCT {c}) AS {c}_diff" for c in ids)
    return f"SELECT {cols} FROM {table}"


FOLLOW = ["lead_id", "account_date", "rec_date", "rec_stage", "status_at_rec"]

# report: (function, SQL over the stages)
REPORTS = {
    "report_account_ids": (lambda i: R.account_ids(account(i), AS_OF), ids_sql("account WHERE account_date < DATE '2001-01-01'", "lead_id")),
    "report_app_ids": (lambda i: audit_unique(app(i), "lead_id"), ids_sql("app", "lead_id")),
    "report_app_monthly": (lambda i: R.monthly_check(app(i), "app_date", "lead_id", i.official_monthly, as_of=AS_OF), check_sql("app", "app_date", "count(lead_id)", "tenth", closed=True)),
    "report_questions_seen": (
        lambda i: R.questions_seen(i.survey_answer, SINCE),
        "SELECT question, count(*) AS n FROM survey_answer WHERE created_ts >= DATE '1996-01-01' GROUP BY 1",
    ),
    "report_expected_responses": (
        lambda i: R.expected_responses(skill_rows(i)),
        "SELECT CAST(count(person_id) AS DOUBLE) / 4 AS by_rows, count(DISTINCT person_id) AS persons FROM survey_answer WHERE survey = 'Skillset Confidence'",
    ),
    "report_repeated_responses": (
        lambda i: R.repeated_responses(skill_rows(i)),
        """SELECT person_id, count(*) AS n, min(d) AS first_day, max(d) AS last_day, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS days FROM (
        SELECT person_id, CAST(created_ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Denver' AS DATE) AS d FROM survey_answer WHERE survey = 'Skillset Confidence') GROUP BY 1 HAVING count(*) > 4""",
    ),
    "report_repeated_per_day": (
        lambda i: R.repeated_per_day(skill_rows(i)),
        """SELECT last_day, CAST(grouping(last_day) AS INTEGER) AS is_total, CAST(sum(n) AS DOUBLE) / 8 AS ids FROM (SELECT person_id, count(*) AS n, max(d) AS last_day FROM (
        SELECT person_id, CAST(created_ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Denver' AS DATE) AS d FROM survey_answer WHERE survey = 'Skillset Confidence')
        GROUP BY 1 HAVING count(*) > 4) GROUP BY ROLLUP (last_day)""",
    ),
    "report_product_shares": (
        lambda i: R.product_shares(skills(i)).withColumn("percent", F.round("percent", 6)),
        """SELECT program, product1, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY program) * 100, 6) AS percent FROM skills
        WHERE product1 IS NOT NULL GROUP BY 1, 2""",
    ),
    "report_rule_coverage": (
        lambda i: rule_coverage(skills(i), widen_rules(i.recommend_rules.withColumn("program", F.trim("program")), RULE_KEYS, "seq", "product", 3), RULE_KEYS),
        """SELECT program, sc1, sc2, sc3, sc4, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'right_only' WHEN k IS NULL THEN 'left_only' ELSE 'both' END AS found_in
        FROM (SELECT program, sc1, sc2, sc3, sc4, count(*) AS n FROM skill_flags GROUP BY ALL) FULL JOIN
        (SELECT DISTINCT trim(program) AS program, sc1, sc2, sc3, sc4, 1 AS k FROM recommend_rules) USING (program, sc1, sc2, sc3, sc4)""",
    ),
    "report_recommended_products": (lambda i: R.recommended_products(recommend(i)), "SELECT product_type, product1, count(*) AS n FROM recommend GROUP BY 1, 2"),
    "report_recommend_monthly": (
        lambda i: R.monthly_check(recommend(i), "rec_date", "lead_id", i.official_monthly, as_of=AS_OF, where=F.col("status_at_rec") == "PEND"),
        check_sql("recommend", "rec_date", "count(lead_id)", "tenth", "status_at_rec = 'PEND'", closed=True),
    ),
    "report_onramp_ids": (
        lambda i: R.onramp_ids(onramp(i)),
        """SELECT program_tag, CAST(grouping(program_tag) AS INTEGER) AS is_total, count(person_id) AS person_id_n, count(DISTINCT person_id) AS person_id_unique,
        count(person_id) - count(DISTINCT person_id) AS person_id_diff, count(contact_id) AS contact_id_n, count(DISTINCT contact_id) AS contact_id_unique,
        count(contact_id) - count(DISTINCT contact_id) AS contact_id_diff FROM onramp GROUP BY ROLLUP (program_tag)""",
    ),
    "report_first_onramp_ids": (
        lambda i: R.first_onramp_ids(onramp(i), TAG),
        ids_sql("(SELECT * FROM onramp WHERE program_tag = 'Alpha' QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY start_date, subscription_id) = 1)", "person_id", "contact_id", "lead_id"),
    ),
    "report_onramp_monthly": (lambda i: R.summed_check(onramp(i), "start_month", "start_flag", i.official_monthly), check_sql("onramp", "start_month", "sum(start_flag)", "whole")),
    "report_onramp_completions": (
        lambda i: R.summed_check(event_kinds(i.onramp_student)[1], "complete_date", "complete_flag", i.official_monthly),
        check_sql("onramp_student", "stage_date", "sum(complete)", "whole", "complete = 1"),
    ),
    "report_inquiry_ids": (lambda i: R.inquiry_ids(inquiry(i), True), ids_sql("inquiry WHERE onramp_start_date IS NOT NULL", "person_id", "contact_id", "lead_id")),
    "report_unmatched_inquiries": (
        lambda i: R.unmatched_inquiries(inquiry(i)),
        "SELECT CASE WHEN contact_id IS NULL THEN 1 ELSE 0 END AS missing_contact_id, CASE WHEN lead_id IS NULL THEN 1 ELSE 0 END AS missing_lead_id, count(*) AS n FROM inquiry GROUP BY 1, 2",
    ),
    "report_product_known": (
        lambda i: R.product_known(inquiry(i)),
        """SELECT CASE WHEN product IS NULL THEN 0 ELSE 1 END AS has_product, count(contact_id) AS contacts, count(DISTINCT contact_id) AS unique_contacts,
        count(lead_id) AS leads, count(DISTINCT lead_id) AS unique_leads FROM inquiry WHERE onramp_start_date IS NOT NULL GROUP BY 1""",
    ),
    "report_product_dates": (
        lambda i: R.product_dates(inquiry(i)),
        """SELECT person_id, product, product_start, onramp_start_date, CAST(abs(date_diff('day', product_start, onramp_start_date)) AS INTEGER) AS difference
        FROM inquiry WHERE product_start <> onramp_start_date""",
    ),
    "report_started_before_applying": (lambda i: R.started_before_applying(inquiry(i)), "SELECT lead_id, app_date, onramp_start_date FROM inquiry WHERE onramp_start_date < app_date"),
    "report_completion_disagreement": (
        lambda i: R.completion_disagreement(inquiry(i)),
        "SELECT completed_onramp, completed_course_flag, count(*) AS n FROM inquiry WHERE completed_onramp <> completed_course_flag GROUP BY 1, 2",
    ),
    "report_school_counts": (
        lambda i: R.school_counts(inquiry(i), date(1997, 1, 1)),
        """SELECT received_month, count(*) FILTER (interest_school = 'WSB') AS "WSB", count(*) FILTER (interest_school = 'WSE') AS "WSE", count(*) FILTER (interest_school = 'LSH') AS "LSH",
        count(*) FILTER (interest_school = 'WST') AS "WST", count(*) FILTER (interest_school IS NULL OR interest_school NOT IN ('WSB', 'WSE', 'LSH', 'WST')) AS "Missing", count(*) AS total
        FROM inquiry WHERE lead_id IS NOT NULL AND received_date >= DATE '1997-01-01' GROUP BY 1""",
    ),
    "report_inquiry_monthly": (
        lambda i: R.inquiry_monthly(inquiry(i), TAG, i.official_monthly, AS_OF),
        check_sql("inquiry", "received_date", "count(contact_id)", "share", f"program_tag = '{TAG}'", closed=True),
    ),
    "report_attrition_ids": (
        lambda i: R.attrition_ids(attrition(i)),
        """SELECT flag, CAST(grouping(flag) AS INTEGER) AS is_total, count(student_key) AS student_key_n, count(DISTINCT student_key) AS student_key_unique,
        count(student_key) - count(DISTINCT student_key) AS student_key_diff, count(lead_id) AS lead_id_n, count(DISTINCT lead_id) AS lead_id_unique,
        count(lead_id) - count(DISTINCT lead_id) AS lead_id_diff FROM att GROUP BY ROLLUP (flag)""",
    ),
    "report_attrition_terms": (
        lambda i: R.attrition_terms(attrition(i)),
        "SELECT count(*) AS n, count(DISTINCT (student_key, term_start)) AS unique_n FROM att WHERE flag = 1 AND student_key IS NOT NULL",
    ),
    "report_attrition_monthly": (
        lambda i: R.attrition_monthly(attrition(i), i.official_monthly),
        f"""SELECT period, n_etl, unique_n, n_official, n_etl - n_official AS diff, round((n_etl - n_official) / n_official, 3) * 100 AS percent_diff FROM
        (SELECT last_day(term_start) AS period, count(lead_id) AS n_etl, count(DISTINCT lead_id) AS unique_n FROM att WHERE flag = 1 GROUP BY 1) a JOIN {OFFICIAL_SQL} b USING (period)""",
    ),
    "report_attrition_agreement": (
        lambda i: R.attrition_agreement(degree_start(i).where("attrition_flag = 1"), "start_date", attrition(i)),
        """SELECT period, n_etl, n_official, n_etl - n_official AS diff, round((n_etl - n_official) / n_official, 3) * 100 AS percent_diff FROM
        (SELECT last_day(start_date) AS period, count(lead_id) AS n_etl FROM degree_start WHERE attrition_flag = 1 GROUP BY 1) a JOIN
        (SELECT last_day(term_start) AS period, count(DISTINCT lead_id) AS n_official FROM att WHERE flag = 1 GROUP BY 1) b USING (period)""",
    ),
    "report_starts_kept": (
        lambda i: R.starts_kept(i.new_start.where(F.col("closed_ts") >= F.lit(SINCE)), degree_start(i)),
        """SELECT 'Before Join' AS label, count(lead_id) AS n, count(DISTINCT lead_id) AS unique_n FROM new_start WHERE closed_ts >= DATE '1996-01-01'
        UNION ALL SELECT 'After Join', count(lead_id), count(DISTINCT lead_id) FROM degree_start""",
    ),
    "report_starts_monthly": (
        lambda i: R.monthly_check(degree_start(i), "start_date", "lead_id", i.official_monthly),
        check_sql("degree_start", "start_date", "count(lead_id)", "tenth"),
    ),
    "report_onramp_finishers": (
        lambda i: R.monthly_check(degree_start(i), "start_date", "lead_id", i.official_monthly, where=F.col("onramp_completed_flag") == 1),
        check_sql("degree_start", "start_date", "count(lead_id)", "tenth", "onramp_completed_flag = 1"),
    ),
    "report_graduation_rates": (
        lambda i: R.graduation_rates(degree_success(i)),
        """SELECT faa_month, count(*) AS starts, CAST(sum(grad_flag) AS BIGINT) AS grads, round(sum(grad_flag) / count(*), 3) AS grads_rate,
        min(grad_date) AS first_grad_date, max(grad_date) AS last_grad_date FROM degree_success GROUP BY 1""",
    ),
    "report_snapshot_rates": (
        lambda i: R.snapshot_rates(i.student_month, SINCE),
        """SELECT last_day(faa_date) AS start_month, CAST(sum(new_start) AS BIGINT) AS starts, CAST(sum(grad) AS BIGINT) AS grads,
        round(sum(grad) / nullif(sum(new_start), 0), 3) AS cohort_rate FROM student_month WHERE faa_date >= DATE '1996-01-01' AND level = 'UG' GROUP BY 1""",
    ),
    "report_drop_rates": (
        lambda i: R.drop_rates(degree_success(i)),
        """SELECT faa_month, count(*) AS starts, CAST(sum(drop_flag) AS BIGINT) AS drops, round(sum(drop_flag) / count(*), 3) AS drops_rate,
        CAST(sum(drop_t1_flag) AS BIGINT) AS t1_drops, round(sum(drop_t1_flag) / count(*), 3) AS t1_drops_rate FROM degree_success GROUP BY 1""",
    ),
    "report_retention": (
        lambda i: R.retention_table(degree_success(i)),
        """SELECT a.month, r7, n_r7, r13, n_r13 FROM (SELECT r7_date AS month, CAST(round(CAST(avg(ret7) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS r7, count(*) AS n_r7 FROM degree_success WHERE r7_date IS NOT NULL GROUP BY 1) a
        LEFT JOIN (SELECT r13_date AS month, CAST(round(CAST(avg(ret13) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS r13, count(*) AS n_r13 FROM degree_success WHERE r13_date IS NOT NULL GROUP BY 1) b ON b.month = a.month""",
    ),
    "report_student_units": (
        lambda i: R.student_units(i.assessment, AS_OF),
        """WITH t AS (SELECT student_id, term_end, sum(CASE WHEN completed = 1 THEN credits ELSE 0 END) AS units_completed,
          sum(CASE WHEN assigned = 1 THEN credits ELSE 0 END) AS units_attempted FROM assessment
          WHERE term_end < DATE '2001-01-01' AND course NOT IN ('ORA1', 'ORA4') AND (completed = 1 OR assigned = 1) GROUP BY 1, 2)
        SELECT *, sum(units_completed) OVER w AS cumulative_units_completed, sum(units_attempted) OVER w AS cumulative_units_attempted FROM t
        WINDOW w AS (PARTITION BY student_id ORDER BY term_end)""",
    ),
    "report_inquiry_funnel": (
        lambda i: R.inquiry_funnel(cohort_inquiry(i)),
        """SELECT received_month, count(*) AS referrals, count(*) FILTER (rec_flag = 1) AS recommended, CAST(sum(started_onramp) AS BIGINT) AS started_onramp,
        CAST(sum(started_degree) AS BIGINT) AS started_degree, CAST(sum(degree_start_flag) AS BIGINT) AS degree_start_flag,
        CAST(sum(started_onramp_and_degree) AS BIGINT) AS started_onramp_and_degree, CAST(sum(started_direct_degree) AS BIGINT) AS started_direct_degree FROM cohort_inquiry GROUP BY 1""",
    ),
    "report_school_sources": (
        lambda i: R.school_sources(cohort_inquiry(i)),
        """SELECT school, by_interest, by_first_known, round((by_first_known - by_interest) / by_interest, 2) AS prop_diff FROM
        (SELECT coalesce(interest_without_cert, 'Missing') AS school, count(*) AS by_interest FROM cohort_inquiry WHERE lead_id IS NOT NULL GROUP BY 1) a FULL JOIN
        (SELECT school, count(*) AS by_first_known FROM cohort_inquiry WHERE lead_id IS NOT NULL GROUP BY 1) b USING (school)""",
    ),
    "report_start_series": (
        lambda i: R.start_series(cohort_inquiry(i), TAG),
        """SELECT last_day(onramp_start_date) AS period, count(*) AS n_all, nullif(count(*) FILTER (program_tag = 'Alpha'), 0) AS n_tagged,
        nullif(count(*) FILTER (rec_flag = 1), 0) AS n_recommended FROM cohort_inquiry WHERE onramp_start_date IS NOT NULL AND lead_id IS NOT NULL GROUP BY 1""",
    ),
    "report_follow_up": (
        lambda i: R.follow_up(cohort_account(i), "Pre-Transcript + NAYT", "SSE", date(1997, 1, 1), AS_OF, FOLLOW),
        f"""SELECT {', '.join(FOLLOW)} FROM cohort_account WHERE rec_stage = 'Pre-Transcript + NAYT' AND path = 'SSE' AND rec_date > DATE '1997-01-01' AND rec_date < DATE '2001-01-01'""",
    ),
    "report_recommended_without_app": (
        lambda i: R.recommended_without_app(cohort_account(i), "SSE"),
        "SELECT lead_id, account_date, rec_date, status_at_rec, rec_stage FROM cohort_account WHERE rec_flag = 1 AND path = 'SSE' AND app_date IS NULL",
    ),
}


def _run(build):
    return lambda spark, folder: build(Inputs(spark, folder))


ENTRIES = {name: (_run(build), stage_sql(f"SELECT * FROM {table}")) for name, (build, table) in BUILDERS.items()}
ENTRIES |= {name: (_run(build), stage_sql(text)) for name, (build, text) in REPORTS.items()}
