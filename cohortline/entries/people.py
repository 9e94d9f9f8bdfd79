"""Funnel, as-of and on-ramp operators on the events table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from cohortline.functions import flag, week_ending
from cohortline.operators import (
    asof_backward_last,
    asof_each,
    asof_forward_first,
    attach_first,
    cohort_funnel,
    composite_label,
    dedupe_last,
    direct_vs_via,
    event_kinds,
    funnel_flags,
    heavy_in_plan,
    heavy_keys,
    match_ids,
    outcomes,
    time_cells,
    value_counts,
    with_stage,
    work_list,
)
from cohortline.session import configure
from cohortline.sources import table_from

# first signup, then the first view >= 90, click >= 95, purchase >= 95, error >= 95
STEPS = {
    "app_ts": ("view", 90, "signup_ts"),
    "rec_ts": ("click", 95, "app_ts"),
    "start_ts": ("purchase", 95, "app_ts"),
    "drop_ts": ("error", 95, "start_ts"),
}


def events(spark, folder):
    return table_from(configure(spark), folder, "events")


def kind(ev, event_type, at_least=None):
    rows = ev.where(F.col("event_type") == event_type)
    return rows if at_least is None else rows.where(F.col("value") >= at_least)


def person_dates(spark, folder):
    """One row per user: time of each funnel step."""
    ev = events(spark, folder)
    joined = reduce(or_, [(F.col("event_type") == event_type) & (F.col("value") >= at_least) for event_type, at_least, _ in STEPS.values()])
    heavy = heavy_keys(ev.where(joined), "user_id")
    out = kind(ev, "signup").groupBy("user_id").agg(F.min("ts").alias("signup_ts"))
    for name, (event_type, at_least, anchor) in STEPS.items():
        out = attach_first(out, kind(ev, event_type, at_least).select("user_id", F.col("ts").alias(name)), "user_id", anchor, name, heavy=heavy)
    return out


PERSON_SQL = """
base AS (SELECT user_id, min(ts) AS signup_ts FROM events WHERE event_type = 'signup' GROUP BY 1),
a AS (SELECT b.user_id, min(e.ts) AS app_ts FROM base b JOIN events e ON e.user_id = b.user_id
      AND e.event_type = 'view' AND e.value >= 90 AND e.ts >= b.signup_ts GROUP BY 1),
r AS (SELECT b.user_id, min(e.ts) AS rec_ts FROM a b JOIN events e ON e.user_id = b.user_id
      AND e.event_type = 'click' AND e.value >= 95 AND e.ts >= b.app_ts GROUP BY 1),
s AS (SELECT b.user_id, min(e.ts) AS start_ts FROM a b JOIN events e ON e.user_id = b.user_id
      AND e.event_type = 'purchase' AND e.value >= 95 AND e.ts >= b.app_ts GROUP BY 1),
d AS (SELECT b.user_id, min(e.ts) AS drop_ts FROM s b JOIN events e ON e.user_id = b.user_id
      AND e.event_type = 'error' AND e.value >= 95 AND e.ts >= b.start_ts GROUP BY 1),
person AS (SELECT * FROM base LEFT JOIN a USING (user_id) LEFT JOIN r USING (user_id)
           LEFT JOIN s USING (user_id) LEFT JOIN d USING (user_id))
"""


def funnel_weekly_cohort(spark, folder):
    people = person_dates(spark, folder).withColumn("cohort_week", week_ending("signup_ts"))
    return cohort_funnel(
        people,
        "cohort_week",
        {
            "accounts": F.col("signup_ts").isNotNull(),
            "app": F.col("app_ts").isNotNull(),
            "rec": F.col("rec_ts").isNotNull(),
            "start": F.col("start_ts").isNotNull(),
            "drop": F.col("drop_ts").isNotNull(),
        },
    )


FUNNEL_SQL = f"""
WITH {PERSON_SQL}
SELECT CAST(date_trunc('week', signup_ts) AS DATE) + 6 AS cohort_week, count(*) AS accounts, count(app_ts) AS app,
       count(rec_ts) AS rec, count(start_ts) AS "start", count(drop_ts) AS "drop"
FROM person GROUP BY 1
"""


def anchors(ev):
    return kind(ev, "purchase", 95).groupBy("user_id").agg(F.min("ts").alias("anchor_ts"))


def asof_forward(spark, folder):
    ev = events(spark, folder)
    found = kind(ev, "error", 95).select("user_id", "ts", "event_id", "value")
    return asof_forward_first(anchors(ev), found, "user_id", "anchor_ts", "ts", tie="event_id", heavy=heavy_in_plan(found, "user_id"))


def asof_forward_strict(spark, folder):
    """Several anchors per key: the first event strictly after any purchase."""
    ev = events(spark, folder)
    base = kind(ev, "purchase").select("user_id", F.col("ts").alias("anchor_ts"))
    found = kind(ev, "error").select("user_id", F.to_date("ts").alias("error_date"), "event_id")
    return asof_forward_first(
        base.withColumn("anchor_date", F.to_date("anchor_ts")), found, "user_id", "anchor_date", "error_date",
        strict=True, tie="event_id", heavy=heavy_keys(found, "user_id"),
    )


def asof_backward(spark, folder):
    ev = events(spark, folder)
    found = kind(ev, "view", 90).select("user_id", "ts", "event_id", "value")
    return asof_backward_last(anchors(ev), found, "user_id", "anchor_ts", "ts", tie="event_id", how="left", heavy=heavy_in_plan(found, "user_id"))


def stage_flags(spark, folder):
    ev = events(spark, folder)
    heavy = heavy_keys(ev.where(F.col("event_type").isin("view", "purchase") & (F.col("value") >= 97)), "user_id")
    base = kind(ev, "signup").groupBy("user_id").agg(F.min("ts").alias("signup_ts"))
    out = base
    for name, event_type in {"view": "view", "buy": "purchase"}.items():
        found = kind(ev, event_type, 97).select("user_id", F.col("ts").alias(f"{name}_ts"), F.col("event_id").alias(f"{name}_id"))
        stage = asof_forward_first(base, found, "user_id", "signup_ts", f"{name}_ts", tie=f"{name}_id", heavy=heavy)
        out = with_stage(out, stage, "user_id", f"{name}_flag", zero=[f"{name}_id"])
    return out


def direct_or_via(spark, folder):
    people = person_dates(spark, folder)
    return people.withColumns(direct_vs_via(flag(F.col("rec_ts").isNotNull()), flag(F.col("start_ts").isNotNull()))).select(
        "user_id", "direct", "via"
    )


def last_status(spark, folder):
    ev = events(spark, folder)
    last = dedupe_last(ev.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return with_stage(person_dates(spark, folder), last.select("user_id", F.col("event_type").alias("status")), "user_id")


LAST_SQL = f"""
WITH {PERSON_SQL},
last AS (SELECT user_id, event_type AS status FROM events
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT * FROM person LEFT JOIN last USING (user_id))
"""


def composite(spark, folder):
    label = composite_label("status", ["error", "purchase"], "rec_ts", "both", "status only", "stage only")
    return last_status(spark, folder).select("user_id", label.alias("label"))


def flags(spark, folder):
    out = last_status(spark, folder)
    cols = funnel_flags("status", {"ended_error": ["error"], "browsing": ["view", "click"]}, {"started": "start_ts", "dropped": "drop_ts"})
    return out.withColumns(cols).select("user_id", *cols)


def subscriptions(spark, folder):
    """Events as subscription rows: signups start, strong purchases complete, strong errors drop."""
    ev = events(spark, folder)
    day = F.to_date("ts")
    error = F.col("event_type") == "error"
    kinds = {"signup": "Course Bundles", "purchase": "Microcredentials", "error": "Single Courses"}
    offering = F.when(F.col("value") < 10, None)
    for event_type, name in kinds.items():
        offering = offering.when(F.col("event_type") == event_type, name)
    return ev.select(
        F.col("user_id").alias("person_id"),
        F.col("user_id").alias("contact_id"),
        F.col("event_id").alias("subscription_id"),
        flag(F.col("event_type") == "signup").alias("new_start"),
        flag((F.col("event_type") == "purchase") & (F.col("value") >= 95)).alias("complete"),
        flag(error & (F.col("value") >= 97)).alias("drops"),
        flag(error & (F.col("value") < 2)).alias("cancel_7d"),
        flag(error & (F.col("value") < 1)).alias("cancel_72h"),
        F.last_day(day).alias("month_end"),
        day.alias("stage_date"),
        F.date_add(day, 180).alias("expires"),
        F.col("event_type").alias("channel"),
        offering.alias("offering_type"),
        F.when(F.col("value") >= 20, F.col("event_type")).alias("offering_name"),
        F.col("event_type").alias("title"),
        F.when(F.col("value") < 50, "null").otherwise("Partner").alias("client"),
    )


SUBSCRIPTIONS_SQL = """
subs AS (SELECT user_id AS person_id, user_id AS contact_id, event_id AS subscription_id,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS new_start,
  CASE WHEN event_type = 'purchase' AND value >= 95 THEN 1 ELSE 0 END AS complete,
  CASE WHEN event_type = 'error' AND value >= 97 THEN 1 ELSE 0 END AS drops,
  CASE WHEN event_type = 'error' AND value < 2 THEN 1 ELSE 0 END AS cancel_7d,
  CASE WHEN event_type = 'error' AND value < 1 THEN 1 ELSE 0 END AS cancel_72h,
  last_day(CAST(ts AS DATE)) AS month_end, CAST(ts AS DATE) AS stage_date, CAST(ts AS DATE) + 180 AS expires,
  event_type AS channel,
  CASE WHEN value < 10 THEN NULL WHEN event_type = 'signup' THEN 'Course Bundles'
       WHEN event_type = 'purchase' THEN 'Microcredentials' WHEN event_type = 'error' THEN 'Single Courses' END AS offering_type,
  CASE WHEN value >= 20 THEN event_type END AS offering_name, event_type AS title,
  CASE WHEN value < 50 THEN 'null' ELSE 'Partner' END AS client
  FROM events),
starts AS (SELECT person_id, contact_id, subscription_id, new_start AS start_flag, stage_date AS start_date, month_end AS start_month,
  expires AS expiration_date, channel,
  CASE WHEN offering_type IN ('Single Courses', 'Course Bundles') THEN 'On-Ramp' WHEN offering_type = 'Microcredentials' THEN 'Certificate' END AS offering_type,
  CASE offering_type WHEN 'Single Courses' THEN 'Single Course' WHEN 'Course Bundles' THEN 'Course Bundle'
       WHEN 'Microcredentials' THEN 'Certificate' ELSE 'Missing' END AS offering_subtype,
  coalesce(offering_name, 'Missing') AS product_code, title AS product_name,
  CASE WHEN client = 'null' THEN 'None' ELSE client END AS partnership
  FROM subs WHERE new_start = 1),
completions AS (SELECT person_id, contact_id, subscription_id, complete AS complete_flag, stage_date AS complete_date,
  month_end AS complete_month, channel, coalesce(offering_type, 'Unavailable') AS offering_type,
  coalesce(offering_name, 'Unavailable') AS offering_name, title AS product FROM subs WHERE complete = 1),
drops AS (SELECT person_id, contact_id, subscription_id, 1 AS drop_flag, cancel_7d AS drop_7d_flag, cancel_72h AS drop_72h_flag,
  stage_date AS drop_date, month_end AS drop_month, channel, coalesce(offering_type, 'Unavailable') AS offering_type,
  coalesce(offering_name, 'Unavailable') AS offering_name, title AS product,
  CASE WHEN client = 'null' THEN 'None' ELSE client END AS partnership
  FROM subs WHERE drops = 1 OR cancel_7d = 1 OR cancel_72h = 1),
done AS (SELECT c.person_id, min(c.complete_date) AS complete_date FROM completions c JOIN starts s USING (person_id)
  WHERE s.start_date <= c.complete_date GROUP BY 1),
gone AS (SELECT d.person_id, d.drop_date, d.drop_7d_flag, d.drop_72h_flag FROM drops d JOIN starts s USING (person_id)
  WHERE s.start_date <= d.drop_date
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY drop_date, drop_7d_flag, drop_72h_flag) = 1),
outcomes AS (SELECT s.*, CASE WHEN done.person_id IS NULL THEN 0 ELSE 1 END AS complete_flag, done.complete_date,
  CASE WHEN gone.person_id IS NULL THEN 0 ELSE 1 END AS drop_flag, coalesce(gone.drop_7d_flag, 0) AS drop_7d_flag,
  coalesce(gone.drop_72h_flag, 0) AS drop_72h_flag, gone.drop_date
  FROM starts s LEFT JOIN done ON done.person_id = s.person_id LEFT JOIN gone ON gone.person_id = s.person_id)
"""


def subscription_outcomes(spark, folder):
    return outcomes(*event_kinds(subscriptions(spark, folder)), heavy=heavy_keys(events(spark, folder), "user_id"))


def matched_ids(spark, folder):
    ev = events(spark, folder)
    customer = table_from(spark, folder, "customer").select("c_custkey", "c_name")
    candidates = kind(ev, "purchase").select(
        F.col("user_id").alias("c_custkey"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("match_id"), (F.col("value") >= 95).alias("best")
    )
    return match_ids(customer, candidates, "c_custkey", "best", ["match_id"], "match_id", "referral")


def high_errors(spark, folder):
    return work_list(
        events(spark, folder),
        (F.col("event_type") == "error") & F.col("value").between(95, 99) & (F.col("ts") < F.lit("2024-01-20").cast("date")),
        ["event_id", "user_id", "ts", "value"],
    )


def asof_each_purchase(spark, folder):
    """For every purchase time of a user the last view before it and the first error at or after it."""
    e = events(spark, folder)
    kind = lambda k, *cols: e.where(F.col("event_type") == k).select("user_id", *cols)
    bought = kind("purchase", F.col("ts").alias("bought"))
    views, errors = kind("view", "ts", "event_id", "value"), kind("error", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    heavy = heavy_keys(e, "user_id")
    back = asof_each(bought, views, "user_id", "bought", "ts", strict=True, tie="event_id", heavy=heavy, cuts=time_cells(views, "user_id", "ts", heavy))
    ahead = asof_each(bought, errors, "user_id", "bought", "error_ts", forward=True, tie="error_id", heavy=heavy, cuts=time_cells(errors, "user_id", "error_ts", heavy))
    return back.join(ahead, ["user_id", "bought"]).select("user_id", "bought", "ts", "event_id", "value", "error_ts", "error_id")


ENTRIES = {
    "asof_each_purchase": (
        asof_each_purchase,
        """WITH b AS (SELECT DISTINCT user_id, ts AS bought FROM events WHERE event_type = 'purchase'),
        v AS (SELECT b.user_id, b.bought, e.ts, e.event_id, e.value FROM b JOIN events e ON e.user_id = b.user_id AND e.ts < b.bought
        WHERE e.event_type = 'view' QUALIFY row_number() OVER (PARTITION BY b.user_id, b.bought ORDER BY e.ts DESC, e.event_id DESC) = 1),
        r AS (SELECT b.user_id, b.bought, e.ts AS error_ts, e.event_id AS error_id FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.bought
        WHERE e.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY b.user_id, b.bought ORDER BY e.ts, e.event_id) = 1)
        SELECT * FROM b LEFT JOIN v USING (user_id, bought) LEFT JOIN r USING (user_id, bought)""",
    ),
    "funnel_weekly_cohort": (funnel_weekly_cohort, FUNNEL_SQL),
    "asof_forward": (
        asof_forward,
        """WITH p AS (SELECT user_id, min(ts) AS anchor_ts FROM events WHERE event_type = 'purchase' AND value >= 95 GROUP BY 1)
        SELECT e.user_id, e.ts, e.event_id, e.value FROM p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.anchor_ts
        WHERE e.event_type = 'error' AND e.value >= 95
        QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1""",
    ),
    "asof_forward_strict": (
        asof_forward_strict,
        """WITH p AS (SELECT user_id, min(CAST(ts AS DATE)) AS a FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT e.user_id, CAST(e.ts AS DATE) AS error_date, e.event_id FROM p JOIN events e ON e.user_id = p.user_id
        WHERE e.event_type = 'error' AND CAST(e.ts AS DATE) > p.a
        QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY CAST(e.ts AS DATE), e.event_id) = 1""",
    ),
    "asof_backward": (
        asof_backward,
        """WITH p AS (SELECT user_id, min(ts) AS anchor_ts FROM events WHERE event_type = 'purchase' AND value >= 95 GROUP BY 1),
        f AS (SELECT e.user_id, e.ts, e.event_id, e.value FROM p JOIN events e ON e.user_id = p.user_id AND e.ts <= p.anchor_ts
        WHERE e.event_type = 'view' AND e.value >= 90
        QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) = 1)
        SELECT p.user_id, f.ts, f.event_id, f.value FROM p LEFT JOIN f ON f.user_id = p.user_id""",
    ),
    "stage_flags": (
        stage_flags,
        """WITH b AS (SELECT user_id, min(ts) AS signup_ts FROM events WHERE event_type = 'signup' GROUP BY 1),
        v AS (SELECT e.user_id, e.ts AS view_ts, e.event_id AS view_id FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.signup_ts
          WHERE e.event_type = 'view' AND e.value >= 97 QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1),
        p AS (SELECT e.user_id, e.ts AS buy_ts, e.event_id AS buy_id FROM b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.signup_ts
          WHERE e.event_type = 'purchase' AND e.value >= 97 QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1)
        SELECT b.user_id, signup_ts, view_ts, coalesce(view_id, 0) AS view_id, CASE WHEN v.user_id IS NULL THEN 0 ELSE 1 END AS view_flag,
          buy_ts, coalesce(buy_id, 0) AS buy_id, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS buy_flag
        FROM b LEFT JOIN v ON v.user_id = b.user_id LEFT JOIN p ON p.user_id = b.user_id""",
    ),
    "direct_vs_via": (
        direct_or_via,
        f"""WITH {PERSON_SQL} SELECT user_id,
        CASE WHEN start_ts IS NOT NULL AND rec_ts IS NULL THEN 1 ELSE 0 END AS direct,
        CASE WHEN start_ts IS NOT NULL AND rec_ts IS NOT NULL THEN 1 ELSE 0 END AS via FROM person""",
    ),
    "composite_label": (
        composite,
        f"""{LAST_SQL} SELECT user_id, CASE WHEN status IN ('error', 'purchase') AND rec_ts IS NOT NULL THEN 'both'
        WHEN status IN ('error', 'purchase') THEN 'status only' WHEN status NOT IN ('error', 'purchase') AND rec_ts IS NOT NULL THEN 'stage only'
        ELSE 'Missing' END AS label FROM p""",
    ),
    "funnel_flags": (
        flags,
        f"""{LAST_SQL} SELECT user_id, CASE WHEN status = 'error' THEN 1 ELSE 0 END AS ended_error,
        CASE WHEN status IN ('view', 'click') THEN 1 ELSE 0 END AS browsing, CASE WHEN start_ts IS NOT NULL THEN 1 ELSE 0 END AS started,
        CASE WHEN drop_ts IS NOT NULL THEN 1 ELSE 0 END AS dropped FROM p""",
    ),
    "event_kinds": (lambda s, d: event_kinds(subscriptions(s, d))[0], f"WITH {SUBSCRIPTIONS_SQL} SELECT * FROM starts"),
    "event_kinds_complete": (lambda s, d: event_kinds(subscriptions(s, d))[1], f"WITH {SUBSCRIPTIONS_SQL} SELECT * FROM completions"),
    "event_kinds_drop": (lambda s, d: event_kinds(subscriptions(s, d))[2], f"WITH {SUBSCRIPTIONS_SQL} SELECT * FROM drops"),
    "outcomes": (subscription_outcomes, f"WITH {SUBSCRIPTIONS_SQL} SELECT * FROM outcomes"),
    "match_ids": (
        matched_ids,
        """WITH m AS (SELECT user_id, min('E' || CAST(event_id AS VARCHAR)) AS match_id FROM events
          WHERE event_type = 'purchase' AND value >= 95 GROUP BY 1)
        SELECT c_custkey, c_name, match_id, coalesce(match_id, 'Unmatched Opportunity') AS referral
        FROM customer LEFT JOIN m ON user_id = c_custkey""",
    ),
    "value_counts": (
        lambda s, d: value_counts(events(s, d), "event_type", order="n"),
        "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    ),
    "work_list": (
        high_errors,
        """SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error' AND value BETWEEN 95 AND 99
        AND ts < DATE '2024-01-20'""",
    ),
}
