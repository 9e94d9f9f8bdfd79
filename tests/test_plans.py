"""Stage tables and marts on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline import plans
from cohortline.operators import audit_join, audit_unique
from cohortline.plans import reports
from cohortline.plans.recommend import with_questions
from cohortline.plans.survey import build_background_long
from cohortline.plans.values import BACKGROUND_QUESTIONS, SKILL_STATEMENTS, background_questions
from cohortline.sources import schema_of

D, T = dt.date, dt.datetime
SINCE = D(2023, 7, 1)


def frame(spark, name, *records):
    """Rows of a declared input; columns not given are NULL."""
    schema = schema_of(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], schema)


def by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def crm(spark):
    lead = [
        dict(lead_id="L1", student_key="11", contact_id="C1", name=" Ann B ", email="A@X.org ", status="NAYT - x", lead_quality="Good", products_html="<li> P1 </li><li>P2</li>", rec_stage="Pre-Transcript 1", submit_docs=True),
        dict(lead_id="L2", student_key="", contact_id="C2", name="Test Person", status="INTV"),
        dict(lead_id="L3", student_key="abc", contact_id="C9", name="contest", bad_reason="Test Lead", rec_stage=""),
        dict(lead_id="L4", student_key="14", contact_id="C4", name="Dee", lead_quality="Bad Lead"),
        dict(lead_id="L5", student_key="15", contact_id="C5", name="Eve"),
    ]
    return {
        "opportunity": frame(spark, "opportunity", *lead),
        "contact": frame(spark, "contact", *[dict(contact_id=f"C{i}", person_id=p) for i, p in ((1, "U1"), (2, ""), (4, "U4"), (5, "U5"))]),
        "program_grouping": frame(
            spark,
            "program_grouping",
            dict(report_date=D(2024, 1, 31), program_group="Old", program="BSIT"),
            dict(report_date=D(2024, 1, 31), program_group="Gone", program="MBA"),
            dict(report_date=D(2024, 2, 29), program_group="New", program="BSIT"),
        ),
        "lead_demographics": frame(
            spark,
            "lead_demographics",
            dict(lead_id="L1", gender="F", dob="2000-02-29", minority="Y", income="Not reported", income_level="High", first_time="N", marital="Single", non_term="1"),
            dict(lead_id="L2", dob="bad", minority="?", income=None, income_level="Declined", first_time=None, marital="Unknown", non_term="x"),
        ),
    }


@pytest.fixture(scope="module")
def feed(spark):
    def row(lead, code, ts, count, app=0, program="BSIT", guided=1):
        return dict(lead_id=lead, status_code=code, status_ts=ts, status_date=ts.date(), college="IT", level="UG", program=program, lead_count=count, guided=guided, app_complete=app, counselor="Kim")

    return frame(
        spark,
        "status_feed",
        row("L1", "APIN", T(2024, 1, 1, 9), 1),
        row("L1", "APNN", T(2024, 1, 3, 9), 2, guided=0),
        row("L2", "APIN", T(2024, 1, 5), 1, program=None),
        row("L3", "APIN", T(2023, 6, 30), 1),  # before the cutoff
        row("L4", "APIN", T(2024, 1, 5), 3, program="MBA"),
        row("L4", "APIN", T(2024, 1, 6), 3, program="MBA"),  # equal count: the later one
        row("L5", "OTHR", T(2024, 1, 5), 1),
        row("L1", "SUBM", T(2024, 1, 10, 12), 2, app=1),
        row("L1", "SUBM", T(2024, 1, 10, 12), 9, app=1),  # same application
        row("L2", "SUBM", T(2024, 1, 11), 1, app=1),
        row("L3", "SUBM", T(2024, 1, 11), 1, app=1),
        row("L4", "SUBM", T(2024, 1, 11), 1, app=1),
        row("L5", "SUBM", T(2024, 1, 11), 1, app=1, program=None),
    )


def test_account(spark, crm, feed):
    out = plans.build_account(feed, **crm, since=SINCE)
    got = by(out, "lead_id")
    assert set(got) == {"L1", "L2", "L4"}
    one, two, four = got["L1"], got["L2"], got["L4"]
    assert (one.account_date, one.account_week, one.account_month) == (D(2024, 1, 3), D(2024, 1, 7), D(2024, 1, 31))
    assert (one.lead_count, one.path, one.program_group, one.person_id, one.student_key) == (2, "Legacy", "New", "U1", 11)
    assert (one.name, one.email, one.status_latest) == ("ann b", "a@x.org", "NAYT")
    assert (one.minority_group, one.income, one.income_level, one.first_time_group, one.marital_status, one.non_term) == ("BHI2+", "Missing", "High", "Not FTFT", "Single", 1)
    assert (one.age_days, one.age_years) == (8709, 23)
    assert (two.student_key, two.person_id, two.program_group, two.birth_date, two.age_days, two.non_term) == (None,) * 6
    assert (two.minority_group, two.income, two.income_level, two.first_time_group, two.marital_status) == (None, "Missing", "Missing", None, "Missing")
    assert four.account_date == D(2024, 1, 6) and four.program_group is None and four.income == "Missing"
    assert audit_unique(out, "lead_id").first()["lead_id_diff"] == 0
    assert reports.account_ids(out, D(2024, 1, 5)).first()["lead_id_n"] == 1


def test_app(spark, crm, feed):
    good = plans.build_app(feed, **crm)
    assert sorted(r.lead_id for r in good.collect()) == ["L1", "L5"]  # unknown quality is kept
    every = plans.build_app(feed, **crm, good_only=False)
    assert sorted(r.lead_id for r in every.collect()) == ["L1", "L2", "L3", "L4", "L5"]
    one = by(good, "lead_id")["L1"]
    assert (one.app_flag, one.app_date, one.app_ts, one.counselor, one.path) == (1, D(2024, 1, 10), T(2024, 1, 10, 12), "Kim", "SSE")


def test_reconciliation_of_a_stage(spark, crm, feed):
    official = frame(
        spark,
        "official_monthly",
        dict(period="Monthly", end_date=D(2024, 1, 31), value=3),
        dict(period="Monthly", end_date=D(2024, 1, 31), value=1),
        dict(period="Weekly", end_date=D(2024, 1, 31), value=99),
        dict(period="Monthly", end_date=D(2024, 2, 29), value=7),
    )
    got = reports.monthly_check(plans.build_app(feed, **crm), "app_date", "lead_id", official, as_of=D(2024, 2, 1)).collect()
    assert [tuple(r) for r in got] == [(D(2024, 1, 31), 2, 4, -2, -50.0)]


@pytest.fixture(scope="module")
def app_rows(spark):
    rows = [
        ("L1", "U1", D(2024, 8, 1), T(2024, 8, 1), "IT", "UG", " BSIT", "SSE"),
        ("L2", "U1", D(2024, 9, 1), T(2024, 9, 1), "BU", "UG", "MBA", "SSE"),
        ("L3", "U3", D(2024, 8, 1), T(2024, 8, 1), "IT", "UG", "BSPSY", "SSE"),
    ]
    return spark.createDataFrame(rows, "lead_id string, person_id string, app_date date, app_ts timestamp, college string, level string, program string, path string")


def test_background(spark, app_rows):
    q = "Do you have a high school diploma or equivalent?"
    q2 = "Did you have a high school diploma or an  equivalency? "  # odd spacing still maps
    long_q = next(t for t in BACKGROUND_QUESTIONS if "{school}" in t)
    rows = [
        dict(person_id="U1", survey="PB", question=q, answer="no", created_ts=T(2024, 8, 1, 1)),
        dict(person_id="U1", survey="PB", question=q, answer="yes", created_ts=T(2024, 8, 2)),  # repeated: not counted
        dict(person_id="U1", survey=None, question="Did you earn a Bachelor's Degree?", answer="maybe", created_ts=T(2024, 8, 3)),
        dict(person_id="U1", survey="PB", question="Never seen?", answer="yes", created_ts=T(2024, 8, 4)),
        dict(person_id="U1", survey="PB", question=long_q.replace("{school}", "ACME"), answer="yes", created_ts=T(2024, 8, 4)),
        dict(person_id="U1", survey="Skillset Confidence", question=q, answer="yes", created_ts=T(2024, 7, 30)),
        dict(person_id="U3", survey="PB", question=q2, answer=None, created_ts=T(2024, 8, 5)),
        dict(person_id="U9", survey="PB", question=q, answer="yes", created_ts=T(2024, 8, 5)),  # no application
        dict(person_id="U3", survey="PB", question=q, answer="yes", created_ts=T(2024, 1, 1)),  # before the launch
    ]
    answers = frame(spark, "survey_answer", *rows)
    got = by(plans.build_background(answers, app_rows, "ACME", D(2024, 7, 9)), "lead_id")
    assert set(got) == {"L1", "L3"}
    one = got["L1"]
    assert (one.pbq_hs_diploma, one.pbq_bachelor_degree, one.pbq_gpa25_plus) == (0, 1, None)
    assert (one.response_first, one.response_last) == (T(2024, 8, 1, 1), T(2024, 8, 4))
    assert got["L3"].pbq_hs_diploma is None
    long = build_background_long(answers, app_rows, "ACME", D(2024, 7, 9))
    ids = {r.question_id for r in long.where("lead_id = 'L1'").collect()}
    assert ids == {"hs_diploma", "bachelor_degree", "Never seen?", BACKGROUND_QUESTIONS[long_q]}


def test_question_values():
    q = background_questions("ACME")
    assert len(q) == len(BACKGROUND_QUESTIONS) and not any("{school}" in t for t in q)


def test_skill_conf(spark, app_rows):
    math, writing, resilience, career = SKILL_STATEMENTS
    rules = frame(
        spark,
        "recommend_rules",
        dict(program="BSIT ", sc1=1, sc2=0, sc3=0, sc4=0, seq=1, product="A"),
        dict(program="MBA", sc1=1, sc2=0, sc3=0, sc4=0, seq=1, product="B1"),
        dict(program="MBA", sc1=1, sc2=0, sc3=0, sc4=0, seq=2, product="B2"),
    )
    rows = [
        dict(person_id="U1", survey="Skillset Confidence", question=math, answer="strongly_agree", created_ts=T(2024, 8, 1)),
        dict(person_id="U1", survey="Skillset Confidence", question=math, answer="somewhat_disagree", created_ts=T(2024, 8, 2)),
        dict(person_id="U1", survey="Skillset Confidence", question=writing, answer="somewhat_agree", created_ts=T(2024, 8, 2)),
        dict(person_id="U1", survey="Skillset Confidence", question=resilience, answer="odd", created_ts=T(2024, 8, 2)),
        dict(person_id="U3", survey="Skillset Confidence", question=career, answer="strongly_disagree", created_ts=T(2024, 8, 2)),
        dict(person_id="U3", survey="PB", question=math, answer="strongly_disagree", created_ts=T(2024, 8, 2)),
    ]
    out = plans.build_skill_conf(frame(spark, "survey_answer", *rows), app_rows, rules, D(2024, 7, 9))
    got = by(out, "person_id")
    one = got["U1"]  # the latest application, one row
    assert (one.lead_id, one.recommend_code, one.math, one.writing, one.resilience, one.career) == ("L2", "Business", 2, 3, None, None)
    assert (one.sc1, one.sc2, one.sc3, one.sc4, one.product1, one.product2, one.product3) == (1, 0, 0, 0, "B1", "B2", None)
    assert (got["U3"].sc4, got["U3"].product1, got["U3"].recommend_code) == (1, None, "Psychology")
    assert out.count() == 2


def test_recommend_and_questions(spark, crm):
    def rec(lead, status, pathway="Single Course", reason=""):
        return dict(lead_id=lead, rec_ts=T(2024, 2, 1, 8), pathway=pathway, reason=reason, status_at_rec=status, latest_status="INTV x", college="IT", level="UG", program="BSIT")

    feed = frame(spark, "recommend_feed", rec("L1", "NAYT x", "Single Course", "why"), rec("L2", None, ""), rec("L3", "PEND", "6 Month Term"), rec("L4", "INTV", "Certificate"), rec("L7", "INTV"))
    crm_rows = crm["opportunity"].withColumn("rec_stage", F.when(F.col("lead_id").isin("L2", "L4"), "Pre-Transcript 2").otherwise(F.col("rec_stage")))
    hist = frame(
        spark,
        "counselor_history",
        dict(lead_id="L1", counselor="before", status_date=D(2024, 1, 1)),
        dict(lead_id="L1", counselor="on", status_date=D(2024, 2, 1)),
        dict(lead_id="L1", counselor="after", status_date=D(2024, 2, 2)),
        dict(lead_id="L2", counselor="after", status_date=D(2024, 2, 2)),
    )
    out = plans.build_recommend(feed, crm_rows, hist)
    got = by(out, "lead_id")
    assert {k: r.rec_stage for k, r in got.items()} == {"L1": "Pre-Transcript + NAYT", "L2": "Missing", "L3": "NAYT", "L4": "Pre-Transcript", "L7": "Missing"}
    assert {k: r.not_admitted_at_rec for k, r in got.items()} == {"L1": 1, "L2": 0, "L3": 1, "L4": 0, "L7": 0}
    one = got["L1"]
    assert (one.product1, one.product2, one.product3, one.product_category, one.product_type, one.reason, one.submit_docs) == ("P1", "P2", None, "On-Ramp", "Single Course", "why", 1)
    assert (one.counselor_at_rec, got["L2"].counselor_at_rec, one.pre_transcript_flag) == ("on", None, 1)
    assert (got["L3"].product_type, got["L4"].product_category, got["L2"].product_type, got["L2"].reason) == (None, "Certificate", None, None)
    background = spark.createDataFrame([("L1", "U1", 1)], "lead_id string, person_id string, pbq_hs_diploma int")
    skills = spark.createDataFrame([("L1", "x", 1, 2, 3, 4, 1, 1, 0, 0, "a", "b", None)], "lead_id string, recommend_code string, math int, writing int, resilience int, career int, sc1 int, sc2 int, sc3 int, sc4 int, product1 string, product2 string, product3 string")
    wide = with_questions(out, background, skills)
    assert wide.count() == out.count() and by(wide, "lead_id")["L1"].rule_product2 == "b"


@pytest.fixture(scope="module")
def matches(spark):
    def m(contact, lead, key, refer, enroll, degree, start="2024-03-01", status="Enrolled"):
        return dict(contact_id=contact, lead_id=lead, student_key=key, best_refer=refer, best_enroll=enroll, best_degree=degree, start_date=start, status=status, degree_status="AS", degree_program="BSIT", college_interest="IT", faa_date=D(2024, 5, 1))

    return frame(spark, "id_match", m("C1", "L1", "11", True, True, True), m("C1", "LX", "99", False, False, False), m("C2", "L2", "", True, True, False, "null", None), m("C3", "L3", "13", True, False, False, "2024-02-01", "Withdrawn"))


@pytest.fixture(scope="module")
def contacts(spark):
    def c(i, person, tags, test, created=T(2024, 2, 1), interest="Business", kind="Single Course"):
        return dict(contact_id=f"C{i}", person_id=person, subclass=tags, created_ts=created, reason="r", product_type=kind, interest=interest, is_test=test)

    return frame(
        spark,
        "onramp_contact",
        c(1, "U1", "Beta;Alpha", None),
        c(2, "null", "Alpha", False, interest="Certificates", kind="null"),
        c(3, "U3", "Alpha", False, interest="Other", kind="Certificate"),
        c(4, "U4", "Beta", False),
        c(5, "U5", "Alpha", True),
        c(6, "U6", "Alpha", False, created=T(2024, 1, 1)),
        c(7, "U7", "Alpha", False),
    )


def test_onramp(spark, contacts, matches):
    def s(sub, person, contact, **kw):
        return dict(person_id=person, contact_id=contact, subscription_id=sub, title="t", client="null", offering_type="Course Bundles", **kw)

    students = frame(
        spark,
        "onramp_student",
        s("s1", "U1", "C1", new_start=1, stage_date=D(2024, 3, 1), month_end=D(2024, 3, 31)),
        s("s2", "U1", "C1", new_start=1, stage_date=D(2024, 5, 1), month_end=D(2024, 5, 31), offering_name="n"),
        s("s3", "U3", "C3", new_start=1, stage_date=None, month_end=D(2024, 3, 31)),
        s("e1", "U1", "C1", complete=1, stage_date=D(2024, 2, 1), month_end=D(2024, 2, 29)),  # before the start
        s("e2", "U1", "C1", complete=1, stage_date=D(2024, 4, 1), month_end=D(2024, 4, 30)),
        s("d1", "U1", "C1", cancel_7d=1, stage_date=D(2024, 3, 1), month_end=D(2024, 3, 31)),
        s("d2", "U1", "C1", drops=1, stage_date=D(2024, 6, 1), month_end=D(2024, 6, 30)),
    )
    out = plans.build_onramp(students, contacts, matches, "Alpha")
    got = by(out, "subscription_id")
    assert set(got) == {"s1", "s2", "s3"}
    for key in ("s1", "s2"):
        r = got[key]
        assert (r.complete_flag, r.complete_date, r.drop_flag, r.drop_7d_flag, r.drop_72h_flag, r.drop_date) == (1, D(2024, 4, 1), 1, 1, 0, D(2024, 3, 1))
    assert (got["s1"].lead_id, got["s1"].student_key, got["s1"].program_tag, got["s1"].offering_type, got["s1"].offering_subtype) == ("L1", 11, "Alpha", "On-Ramp", "Course Bundle")
    assert (got["s1"].product_code, got["s2"].product_code, got["s1"].partnership) == ("Missing", "n", "None")
    assert (got["s3"].complete_flag, got["s3"].lead_id, got["s3"].referral_lead) == (0, None, "Unmatched Opportunity")
    first = plans.build_onramp(students, contacts, matches, "Alpha", grain="first")
    assert sorted(r.subscription_id for r in first.collect()) == ["s1", "s3"]


def test_inquiry_and_mart(spark, contacts, matches, feed, crm):
    enrolled = frame(
        spark,
        "course_enrollment",
        dict(person_id="U1", course_id="K0", item="Single Course", course="Welcome", start=D(2024, 2, 1)),
        dict(person_id="U1", course_id="K1", item="Single Course", course="Algebra", start=D(2024, 3, 2)),
        dict(person_id="U1", course_id="K2", item="Bundle", course="x", start=D(2024, 4, 2)),
        dict(person_id="U3", course_id="K3", item="Guaranteed Z", course=None, start=D(2024, 4, 2)),
    )
    completed = frame(spark, "course_completion", dict(person_id="U1", course_id="K1", completed=D(2024, 6, 1)), dict(person_id="U1", course_id="K1", completed=D(2024, 5, 1)), dict(person_id="U3", course_id="K3", completed=None))
    months = frame(
        spark,
        "student_month",
        dict(student_key=11, faa_date=D(2024, 2, 1), new_start=1, college="BU"),  # the day itself does not count
        dict(student_key=11, faa_date=D(2024, 7, 1), new_start=1, college="IT"),
        dict(student_key=11, faa_date=D(2024, 9, 1), new_start=1, college="TC"),
        dict(student_key=13, faa_date=D(2025, 1, 1), new_start=1, college="IT"),  # another year
    )
    out = plans.build_inquiry(contacts, matches, enrolled, completed, feed, crm["lead_demographics"], months, tag="Alpha", since=D(2024, 1, 22), orientation="Welcome", start_year=2024)
    got = by(out, "contact_id")
    assert set(got) == {"C1", "C2", "C3", "C7"}
    one, two, three, seven = (got[f"C{i}"] for i in (1, 2, 3, 7))
    assert (one.received_week, one.received_month, one.offering_type, one.interest_school) == (D(2024, 2, 4), D(2024, 2, 29), "On-Ramp", "WSB")
    assert (two.person_id, two.offering_type, two.interest_school, two.onramp_start_date, two.onramp_status) == (None, None, "Certificates", None, "Prospecting")
    assert (seven.lead_id, seven.referral_lead, seven.onramp_status) == (None, "Unmatched Opportunity", "Prospecting")
    assert (one.product, one.product_type, one.completed_course_flag, one.completed_course_date) == ("Single Course: Algebra", "On-Ramp", 1, D(2024, 5, 1))
    assert (three.product_subtype, three.completed_course_flag, seven.completed_course_flag) == ("Course Bundle", 0, None)
    assert (one.app_date, one.age_years, one.gender, seven.path) == (D(2024, 1, 10), "23", "F", "Missing")
    assert (one.degree_start_date, one.start_school, one.start_wst, one.start_wsb) == (D(2024, 7, 1), "WST", 1, 0)
    assert (one.days_rec_to_onramp, one.bins_rec_to_onramp, three.bins_rec_to_onramp) == (29, "15-30 days", "7 or fewer days")
    assert (one.started_onramp, one.active_onramp_total, one.started_onramp_and_degree, one.started_direct_degree) == (1, 1, 1, 0)
    assert (three.dropped_onramp, three.dropped_onramp_7d, three.dropped_onramp_7d_over, three.started_degree) == (1, 0, 1, 0)
    recommend = spark.createDataFrame(
        [("L1", 1, D(2024, 2, 1), T(2024, 2, 1), "c", "t", "r", "p", "NAYT", "NAYT", 1, "INTV", "IT", "UG", "BSIT")],
        "lead_id string, rec_flag int, rec_date date, rec_ts timestamp, product_category string, product_type string, reason string, products string, rec_stage string, status_at_rec string, not_admitted_at_rec int, latest_status string, college string, level string, program string",
    )
    starts = spark.createDataFrame([("L1", D(2024, 1, 31), "IT", "UG", "a"), ("L1", D(2024, 2, 1), "IT", "UG", "b")], "lead_id string, start_date date, college string, level string, program string")
    mart = plans.build_cohort_inquiry(out, recommend, starts)
    rows = by(mart, "contact_id")
    assert mart.count() == out.count()
    assert {k: r.school for k, r in rows.items()} == {"C1": "WST", "C2": "Missing", "C3": "Missing", "C7": "WSB"}
    assert (rows["C1"].rec_flag, rows["C2"].rec_flag, rows["C2"].rec_stage, rows["C1"].degree_start_flag, rows["C1"].start_program, rows["C1"].days_app_to_degree_start) == (1, 0, "Missing", 1, "b", 22)
    assert "degree_start_flag" not in plans.build_cohort_inquiry(out, recommend).columns
    assert sum(r.referrals for r in reports.inquiry_funnel(mart).collect()) == 4


def test_degree_start(spark, crm):
    def n(lead, program, stage, ts=T(2024, 3, 1)):
        return dict(lead_id=lead, closed_ts=ts, college="IT", program=program, onramp_stage=stage, income_level="Mid")

    new = frame(spark, "new_start", n("L1", "MBA", "Graduated"), n("L2", "MSITMUG", "Never at Academy"), n("L4", None, None), n("L5", "BSIT", "Active"), n("L9", "BSIT", None), n("L1", "BSIT", None, T(2020, 6, 30)))
    att = frame(
        spark,
        "attrition_45d",
        dict(lead_id="L1", student_key=11, term_start=D(2024, 3, 1), wk=7, wk_end=D(2024, 4, 14), status="Dropped", flag=1),
        dict(lead_id="L1", student_key=11, term_start=D(2024, 3, 1), wk=8, wk_end=D(2024, 4, 21), status="Dropped late", flag=1),
        dict(lead_id="L5", student_key=15, term_start=D(2024, 9, 1), wk=8, wk_end=D(2024, 10, 21), status="Dropped", flag=1),
    )
    months = frame(spark, "student_month", dict(student_key=14, term_start=D(2024, 3, 1), reverse_start=1, college="IT", program="x"))
    weeks = frame(spark, "term_week", dict(term_start=D(2024, 3, 1), wk_end=D(2024, 4, 21), wk=8), dict(term_start=D(2024, 3, 1), wk_end=D(2024, 4, 21), wk=8))
    demo = frame(spark, "student_demographics", dict(student_key=11, gender="F", employment="full", household_income="x"))
    out = plans.build_degree_start(new, crm["opportunity"], demo, crm["program_grouping"], att, months, weeks, D(2020, 7, 1), D(2024, 6, 1))
    got = by(out, "lead_id")
    assert out.count() == 5
    assert {k: r.level for k, r in got.items()} == {"L1": "GR", "L2": "UG", "L4": None, "L5": "UG", "L9": "UG"}
    assert {k: (r.onramp_completed_flag, r.onramp_attended_flag) for k, r in got.items()} == {"L1": (1, 1), "L2": (0, 0), "L4": (0, 0), "L5": (0, 1), "L9": (0, 0)}
    assert (got["L1"].attrition_flag, got["L1"].attrition_status, got["L4"].attrition_status, got["L5"].attrition_flag) == (1, "Dropped late", "TSCA", None)
    assert (got["L1"].gender, got["L1"].income_level, got["L2"].student_key, got["L1"].start_month) == ("F", "Missing", None, D(2024, 3, 31))
    kept = {r.label: r.n for r in audit_join(new.where("closed_ts >= '2020-07-01'"), out, "lead_id").collect()}
    assert kept == {"Before Join": 5, "After Join": 5}


def success_inputs(spark):
    def m(key, student, faa, end, **kw):
        return dict(student_key=key, student_id=student, faa_date=faa, month_end=end, level="UG", college="IT", program="BSIT", **kw)

    faa = D(2024, 1, 15)
    months = frame(
        spark,
        "student_month",
        m(11, 1, faa, D(2024, 1, 31), new_start=1, grad=0, term_seq=1, term_otp=1),
        m(11, 1, D(2024, 3, 1), D(2024, 3, 31), new_start=1, grad=0),  # a second start is ignored
        m(11, 1, faa, D(2024, 1, 15), new_start=0, grad=1),  # not after the start
        m(11, 1, faa, D(2024, 8, 31), new_start=0, grad=0, ret7=None, term_seq=2, term_otp=0),
        m(11, 1, faa, D(2024, 9, 30), new_start=0, grad=0, ret7=1, term_seq=2),
        m(11, 1, faa, D(2024, 10, 31), new_start=0, grad=1, ret7=0, ret13=0),
        m(11, 2, D(2023, 1, 1), D(2024, 1, 31), new_start=1),  # another id, too early
        m(12, 3, D(2024, 2, 1), D(2024, 2, 29), new_start=1, grad=0),
    )
    drops = frame(
        spark,
        "student_drop",
        dict(student_key=12, student_id=3, month_end=D(2024, 1, 31), term_seq=1, drop_type="early"),  # before the start
        dict(student_key=12, student_id=3, month_end=D(2024, 6, 30), term_seq=2, drop_type="D", drop_sub_type="S"),
        dict(student_key=12, student_id=3, month_end=D(2024, 9, 30), term_seq=3, drop_type="late"),
    )
    progress = frame(spark, "term_progress", dict(student_id=1, term_seq=1, limited_progress=1, earned_cus=9.5), dict(student_id=1, term_seq=2, limited_progress=0, earned_cus=12.0), dict(student_id=3, term_seq=1, limited_progress=1, earned_cus=5.0))
    return months, drops, progress


def test_degree_success(spark):
    out = plans.build_degree_success(*success_inputs(spark), since=SINCE)
    got = by(out, "student_id")
    assert set(got) == {1, 3}
    one, three = got[1], got[3]
    assert (one.faa_date, one.faa_month, one.grad_flag, one.grad_date, one.drop_flag) == (D(2024, 1, 15), D(2024, 1, 1), 1, D(2024, 10, 31), 0)
    assert (one.ret7, one.r7_date, one.ret13, one.r13_date) == (1, D(2024, 9, 30), 0, D(2024, 10, 31))
    assert (one.limit_prog_t1, one.limit_prog_t2, one.earned_cus_t1, one.earned_cus_t2, one.t1_otp, one.t2_otp) == (1, 0, 9, 12, 1, 0)
    assert (three.drop_flag, three.drop_date, three.drop_type, three.drop_t1_flag, three.drop_t2_flag) == (1, D(2024, 6, 30), "D", 0, 1)
    assert (three.grad_flag, three.ret7, three.limit_prog_t1) == (0, None, None)  # no snapshot in that term
    assert [(r.starts, r.grads, r.grads_rate) for r in reports.graduation_rates(out).collect()] == [(1, 1, 1.0), (1, 0, 0.0)]


@pytest.mark.parametrize("heavy", [False, True])
def test_cohort_account(spark, crm, feed, contacts, matches, heavy):
    account = plans.build_account(feed, **crm, since=SINCE)
    app = plans.build_app(feed, **crm, good_only=False)
    rec = frame(spark, "recommend_feed", dict(lead_id="L1", rec_ts=T(2024, 1, 20), pathway="Single Course", status_at_rec="NAYT"), dict(lead_id="L4", rec_ts=T(2024, 1, 1), pathway="Single Course", status_at_rec="INTV"))
    recommend = plans.build_recommend(rec, crm["opportunity"], frame(spark, "counselor_history"))
    students = frame(
        spark,
        "onramp_student",
        dict(person_id="U1", contact_id="C1", subscription_id="s0", new_start=1, stage_date=D(2024, 1, 19)),  # before the recommendation
        dict(person_id="U1", contact_id="C1", subscription_id="s1", new_start=1, stage_date=D(2024, 2, 3)),
        dict(person_id="U1", contact_id="C1", subscription_id="s1", complete=1, stage_date=D(2024, 3, 5)),
    )
    onramp = plans.build_onramp(students, contacts, matches, "Alpha")
    starts = spark.createDataFrame([("L1", D(2024, 1, 9)), ("L1", D(2024, 4, 1)), ("L2", D(2024, 1, 11))], "lead_id string, start_date date")
    success = plans.build_degree_success(*success_inputs(spark), since=SINCE)
    history = frame(
        spark,
        "field_history",
        dict(lead_id="L1", field="CareStatus__c", new_value="INTV", created_ts=T(2024, 1, 5)),
        dict(lead_id="L1", field="CareStatus__c", new_value="NAYT", created_ts=T(2024, 1, 11, 6, 30)),  # still the 10th, local time
        dict(lead_id="L1", field="CareStatus__c", new_value="INTV", created_ts=T(2024, 1, 11, 7, 30)),
        dict(lead_id="L1", field="Other", new_value="INTV", created_ts=T(2024, 1, 11, 6, 45)),
        dict(lead_id="L2", field="CareStatus__c", new_value="INTV x", created_ts=T(2024, 1, 6)),
    )
    transcript = frame(spark, "student_transcript", dict(lead_id="L1", degree_type=None), dict(lead_id="L1", degree_type="Master's"), dict(lead_id="L2", degree_type="Other"))
    keys = [r[0] for r in spark.sql("select xxhash64(x) from values 'L1', 'L2' t(x)").collect()] if heavy else ()
    nulls = [r[0] for r in spark.sql("select xxhash64(x) from values 11L, cast(null as bigint) t(x)").collect()] if heavy else ()
    mart = plans.build_cohort_account(account, app, recommend, starts, onramp, transcript, history, success, heavy={"lead_id": keys, "student_key": nulls})
    got = by(mart, "lead_id")
    assert mart.count() == 3 and set(got) == {"L1", "L2", "L4"}
    one, two, four = got["L1"], got["L2"], got["L4"]
    assert (one.days_account_to_app, one.days_app_to_rec, one.bins_app_to_rec) == (7, 10, "8-14 days")
    assert (one.degree_start_flag, one.degree_start_date, one.bins_app_to_degree_start) == (1, D(2024, 4, 1), "61-90 days")
    assert (one.onramp_start_flag, one.onramp_start_date, one.days_rec_to_onramp_start, one.bins_rec_to_onramp_start) == (1, D(2024, 2, 3), 14, "8-14 days")
    assert (one.bins_onramp_start_to_complete, one.days_onramp_complete_to_degree_start, one.bins_onramp_complete_to_degree_start) == ("31-60 days", 27, "14-30 days")
    assert (one.direct_degree_start_flag, one.degree_start_with_onramp_flag, two.direct_degree_start_flag, four.direct_degree_start_flag) == (0, 1, 1, 0)
    assert (one.nayt_flag, one.nayt_date, one.intv_flag, one.intv_date) == (1, D(2024, 1, 10), 0, None)
    assert (two.intv_flag, two.intv_date, four.nayt_flag) == (1, D(2024, 1, 5), None)
    assert (one.has_degree, two.has_degree, four.has_degree) == (1, 0, None)
    assert (one.faa_date, one.grad_flag, one.days_degree_start_to_complete, one.bins_degree_start_to_complete) == (D(2024, 1, 15), 1, 213, "90+ days")
    assert (four.rec_flag, four.app_date) == (None, D(2024, 1, 11))  # recommended before the account
    assert (two.faa_date, two.grad_flag) == (None, None)
