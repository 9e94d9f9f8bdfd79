"""Declared schemas of the inputs the stage builders read, as DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

INPUTS = {
    "status_feed": "lead_id string, status_code string, status_ts timestamp, status_date date, college string, level string, "
    "program string, lead_count int, guided int, app_complete int, counselor string",
    "opportunity": "lead_id string, student_key string, contact_id string, name string, email string, status string, "
    "lead_quality string, bad_reason string, products_html string, rec_stage string, submit_docs boolean, "
    "evals_outstanding string, eval_status string, eval_first_sent string, eval_app_complete string, evals_completed string",
    "contact": "contact_id string, person_id string",
    "program_grouping": "report_date date, program_group string, program string",
    "lead_demographics": "lead_id string, gender string, dob string, minority string, ethnicity string, region string, dma string, "
    "state string, income string, income_level string, first_time string, marital string, non_term string",
    "student_demographics": "student_key bigint, gender string, employment string, household_income string",
    "survey_answer": "person_id string, survey string, question string, answer string, created_ts timestamp",
    "recommend_rules": "program string, sc1 int, sc2 int, sc3 int, sc4 int, seq int, product string",
    "recommend_feed": "lead_id string, rec_ts timestamp, pathway string, reason string, status_at_rec string, latest_status string, "
    "college string, level string, program string",
    "counselor_history": "lead_id string, counselor string, status_date date",
    "field_history": "lead_id string, field string, new_value string, created_ts timestamp",
    "student_transcript": "lead_id string, degree_type string",
    "transcript_summary": "lead_id string, courses_failed int, courses_withdrawn int, courses_passed int, courses_attempted int, "
    "transfer_credits double, not_transfer_credits double, gpa_all double, gpa_transfer double, gpa_hs double",
    "onramp_student": "person_id string, contact_id string, subscription_id string, new_start int, complete int, drops int, "
    "cancel_7d int, cancel_72h int, month_end date, stage_date date, expires date, channel string, offering_type string, "
    "offering_name string, title string, client string",
    "onramp_contact": "contact_id string, person_id string, subclass string, created_ts timestamp, reason string, "
    "product_type string, interest string, is_test boolean",
    "id_match": "contact_id string, lead_id string, student_key string, best_refer boolean, best_enroll boolean, best_degree boolean, "
    "start_date string, status string, degree_status string, degree_program string, college_interest string, faa_date date",
    "course_enrollment": "person_id string, course_id string, item string, course string, start date, end date",
    "course_completion": "person_id string, course_id string, completed date",
    "new_start": "lead_id string, closed_ts timestamp, college string, program string, onramp_stage string, income_level string, "
    "region string, ethnicity string, minority string",
    "student_month": "student_key bigint, student_id bigint, faa_date date, month_end date, college string, level string, "
    "program string, new_start int, grad int, ret7 int, ret13 int, term_seq int, term_otp int, term_start date, reverse_start int",
    "student_drop": "student_key bigint, student_id bigint, month_end date, term_seq int, drop_type string, drop_sub_type string",
    "term_progress": "student_id bigint, term_seq int, limited_progress int, earned_cus double",
    "assessment": "student_id bigint, term_end date, completed int, assigned int, credits double, course string",
    "attrition_45d": "lead_id string, student_key bigint, term_start date, wk int, wk_end date, status string, flag int, "
    "college string, program string",
    "term_week": "term_start date, wk_end date, wk int",
    "official_monthly": "period string, end_date date, value bigint",
}

# Columns of the driver's tables; declared, so that opening one runs no job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(INPUTS.get(name) or TABLES[name])
