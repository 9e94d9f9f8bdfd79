"""Operators on customers, orders and order lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortline.functions import (
    bin_days,
    closed_before,
    crosswalk,
    days_between,
    disagree_flag,
    in_year,
    likert_code,
    month_end,
    normalize_text,
    one_hot,
    period_keys,
    week_start,
)
from cohortline.operators import (
    attrition_attach,
    attrition_events,
    attrition_unique,
    audit_composite,
    audit_join,
    audit_unique,
    audit_unique_rollup,
    cohort_rates,
    compare_full,
    compare_series,
    crosstab,
    dedupe_first,
    dedupe_last,
    duplicates,
    duplicates_rollup,
    ever_flag,
    first_product,
    heavy_in_plan,
    heavy_keys,
    latest_snapshot,
    left_fan_out,
    mismatch_rows,
    negative_intervals,
    per_period,
    reconcile,
    retention_at,
    retention_avg,
    running_units,
    salted_join,
    status_asof_flag,
    status_intervals,
    status_profile,
    term_metrics,
    time_cells,
)
from cohortline.session import configure
from cohortline.sources import table_from

AS_OF = date(2001, 1, 1)
SINCE = date(1996, 1, 1)


def orders(spark, folder):
    return table_from(configure(spark), folder, "orders")


def lineitem(spark, folder):
    return table_from(configure(spark), folder, "lineitem")


def customer(spark, folder):
    return table_from(configure(spark), folder, "customer")


ORDER_COLS = ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]


def two_orders(spark, folder):
    """Dates of each customer's first and second order and the days between."""
    window = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = orders(spark, folder).select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", F.row_number().over(window)).where("rn <= 2")
    pair = ranked.groupBy("o_custkey").agg(
        *[F.max(F.when(F.col("rn") == i, F.to_date("o_orderdate"))).alias(name) for i, name in ((1, "first_date"), (2, "second_date"))]
    )
    return pair.withColumn("days", days_between("second_date", "first_date"))


TWO_SQL = """
WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
p AS (SELECT o_custkey, max(CASE WHEN rn = 1 THEN d END) AS first_date, max(CASE WHEN rn = 2 THEN d END) AS second_date FROM r GROUP BY 1),
q AS (SELECT *, CAST(date_diff('day', first_date, second_date) AS INTEGER) AS days FROM p)
"""


def binned(edges, labels, negative=None):
    def run(spark, folder):
        out = two_orders(spark, folder).withColumn("bin", bin_days("days", edges, labels, negative))
        return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))

    return run


def reconciled(percent, as_of=None):
    def run(spark, folder):
        every = orders(spark, folder)
        # distinct first: the optional side of a semi join cannot be split if one order holds most lines
        shipped = every.join(lineitem(spark, folder).select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
        return reconcile(per_period(every, month_end("o_orderdate")), per_period(shipped, month_end("o_orderdate")), percent, as_of)

    return run


RECONCILE_SQL = """
WITH a AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS n_etl FROM orders GROUP BY 1),
b AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS n_official FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1),
j AS (SELECT period, n_etl, n_official, n_etl - n_official AS diff FROM a JOIN b USING (period))
"""


def join_audit(spark, folder):
    before, lines = orders(spark, folder).select("o_orderkey"), lineitem(spark, folder).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return audit_join(before, left_fan_out(before, lines, "o_orderkey", heavy_keys(lines, "o_orderkey"), ["l_linenumber"]), "o_orderkey")


def order_line_dates(spark, folder):
    o = orders(spark, folder).select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("order_date"))
    li = lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_date"))
    return li.join(o, "l_orderkey")


def attrition_inputs(spark, folder):
    """Order lines as weekly facts, orders as terms: see ATTRITION_SQL for the same mapping."""
    ships = F.to_date("l_shipdate")
    fact = lineitem(spark, folder).select(
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("lead_id"),
        F.col("l_suppkey").alias("student_key"),
        F.trunc(ships, "month").alias("term_start"),
        (F.col("l_linenumber") + 1).alias("wk"),
        ships.alias("wk_end"),
        crosswalk("l_returnflag", {"R": "Drop", "A": "Active", "N": "tsca"}).alias("status"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flag"),
        F.col("l_linestatus").alias("college"),
        F.col("l_returnflag").alias("program"),
    )
    term = F.trunc(F.to_date("o_orderdate"), "month")
    o = orders(spark, folder)
    reversed_starts = o.select(
        F.col("o_custkey").alias("student_key"),
        term.alias("term_start"),
        F.col("o_orderpriority").alias("college"),
        F.col("o_orderstatus").alias("program"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("reverse_start"),
    )
    starts = o.select(
        F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("lead_id"), F.col("o_custkey").alias("student_key"), term.alias("start_date")
    )
    calendar = o.select(term.alias("term_start"), F.date_add(term, 56).alias("wk_end"), F.lit(8).alias("wk"))
    return fact, reversed_starts, starts, calendar


ATTRITION_SQL = """
WITH fact AS (SELECT 'L' || CAST(l_orderkey AS VARCHAR) AS lead_id, l_suppkey AS student_key,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS term_start, CAST(l_linenumber + 1 AS INTEGER) AS wk, CAST(l_shipdate AS DATE) AS wk_end,
  CASE l_returnflag WHEN 'R' THEN 'Drop' WHEN 'A' THEN 'Active' ELSE 'tsca' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, l_linestatus AS college, l_returnflag AS program FROM lineitem),
o AS (SELECT 'L' || CAST(o_orderkey AS VARCHAR) AS lead_id, o_custkey AS student_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS term_start,
  o_orderpriority AS college, o_orderstatus AS program, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS reverse_start FROM orders),
rev AS (SELECT student_key, term_start, college, program, reverse_start FROM o WHERE reverse_start = 1 AND term_start >= DATE '1996-01-01'
  QUALIFY row_number() OVER (PARTITION BY student_key, term_start ORDER BY college, program) = 1),
settled AS (SELECT DISTINCT student_key, term_start FROM fact WHERE upper(status) NOT IN ('TSCA', 'ACTIVE') AND wk = 8),
lead AS (SELECT student_key, term_start, min(lead_id) AS lead_id FROM o GROUP BY 1, 2),
cal AS (SELECT DISTINCT term_start, term_start + 56 AS wk_end FROM o WHERE term_start + 56 <= DATE '2001-01-01'),
ev AS (
  SELECT lead_id, student_key, term_start, wk, wk_end, college, program, status, flag FROM fact
  WHERE term_start >= DATE '1996-01-01' AND wk <= 8 AND upper(status) <> 'TSCA'
  UNION ALL
  SELECT l.lead_id, r.student_key, r.term_start, 8, c.wk_end, r.college, r.program, 'TSCA', r.reverse_start
  FROM rev r JOIN cal c USING (term_start) LEFT JOIN lead l ON l.student_key = r.student_key AND l.term_start = r.term_start
  WHERE NOT EXISTS (SELECT 1 FROM settled s WHERE s.student_key = r.student_key AND s.term_start = r.term_start)),
uniq AS (SELECT * FROM ev WHERE flag = 1 AND lead_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lead_id, student_key, term_start ORDER BY wk_end DESC, wk DESC, status DESC) = 1),
one AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY lead_id, term_start ORDER BY wk_end DESC, student_key DESC) = 1)
"""


def attrition_union(spark, folder):
    return attrition_events(*attrition_inputs(spark, folder), since=SINCE, as_of=AS_OF)


def attrition_attached(spark, folder):
    inputs = attrition_inputs(spark, folder)
    return attrition_attach(inputs[2], attrition_unique(attrition_events(*inputs, since=SINCE, as_of=AS_OF)))


def day_counts(spark, folder):
    """Orders and shipments per day: the first days have orders alone, the last ones shipments alone."""
    ordered = orders(spark, folder).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("ordered"))
    shipped = table_from(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    return compare_full(ordered, shipped, "day", "ordered", "shipped")


def three_series(spark, folder):
    o = orders(spark, folder)
    return compare_series(
        o, month_end("o_orderdate"), {"n_all": F.lit(True), "n_final": F.col("o_orderstatus") == "F", "n_urgent": (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)}
    )


def status_asof(spark, folder):
    base = customer(spark, folder).select(F.col("c_custkey").alias("o_custkey"), F.lit(date(1998, 1, 1)).alias("anchor"))
    history = orders(spark, folder).select("o_custkey", F.to_date("o_orderdate").alias("status_date"), "o_orderkey", "o_orderstatus")
    return status_asof_flag(
        base, history, "o_custkey", "anchor", "status_date", "o_orderstatus", {"done": ["F"], "open": ["O", "P"]}, tie="o_orderkey",
        heavy=heavy_in_plan(history, "o_custkey"),
    )


def intervals(spark, folder):
    history = orders(spark, folder).select("o_custkey", F.to_date("o_orderdate").alias("status_date"), "o_orderkey", "o_orderstatus")
    heavy = heavy_keys(history, "o_custkey")
    found = status_intervals(history, "o_custkey", "status_date", "o_orderstatus", "o_orderkey", heavy, time_cells(history, "o_custkey", "status_date", heavy))
    return found, heavy


def profile(spark, folder):
    base = customer(spark, folder).select(F.col("c_custkey").alias("o_custkey"), F.lit(date(1997, 1, 1)).alias("anchor"))
    found, heavy = intervals(spark, folder)
    return status_profile(base, found, "o_custkey", "anchor", {"done": ["F"], "open": ["O", "P"]}, (30, 365), heavy)


def likert(spark, folder):
    scale = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
    code = likert_code("o_orderpriority", scale)
    return orders(spark, folder).select("o_orderkey", code.alias("code")).withColumn("flagged", disagree_flag("code"))


SEGMENTS = {"AUTOMOBILE": "AU", "BUILDING": "BU", "MACHINERY": "MA"}


def crosswalked(spark, folder):
    c = F.col("c_mktsegment")
    return customer(spark, folder).select(
        "c_custkey",
        crosswalk(c, SEGMENTS).alias("code"),
        crosswalk(c, SEGMENTS, default="Missing").alias("code_default"),
        crosswalk(c, SEGMENTS, keep_unmapped=True).alias("code_kept"),
        *[v.alias(f"is_{k.lower()}") for k, v in one_hot(c, ["BUILDING", "FURNITURE"]).items()],
    )


def keys_per_period(spark, folder):
    return period_keys(orders(spark, folder).select("o_orderkey", "o_orderdate"), "o_orderdate", "order").withColumn(
        "order_week_start", week_start("o_orderdate")
    ).drop("o_orderdate")


def order_crosstab(spark, folder):
    o, c = orders(spark, folder), customer(spark, folder)
    joined = o.select("o_custkey", month_end("o_orderdate").alias("month")).join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return crosstab(joined, "month", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"])


def order_rates(spark, folder):
    o = orders(spark, folder).select(
        month_end("o_orderdate").alias("month"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("final"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"),
        F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("final_date"),
    )
    return cohort_rates(o, "month", {"finals": "final", "urgents": "urgent"}, {"final_date": "final_date"})


def retained(spark, folder):
    """An order in the 8th or the 14th month after a customer's first order."""
    o = orders(spark, folder).select("o_custkey", F.to_date("o_orderdate").alias("d"))
    first = o.groupBy("o_custkey").agg(F.min("d").alias("first_date"))

    def within(n):
        since = F.col("d") >= F.add_months("first_date", n)
        return F.when(since & (F.col("d") < F.add_months("first_date", n + 1)), 1).when(since, 0)

    heavy = heavy_keys(o, "o_custkey")
    snaps = salted_join(o, first, "o_custkey", "inner", heavy, ["d"]).select("o_custkey", "d", within(7).alias("r7"), within(13).alias("r13"))
    return retention_at(first, snaps, "o_custkey", "first_date", "d", {"r7": "r7", "r13": "r13"}, heavy=heavy)


RETENTION_SQL = """
WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_date FROM orders GROUP BY 1),
s AS (SELECT o.o_custkey, CAST(o_orderdate AS DATE) AS d, f.first_date FROM orders o JOIN f USING (o_custkey)),
x AS (SELECT o_custkey, d,
  CASE WHEN d >= first_date + INTERVAL 7 MONTH THEN CASE WHEN d < first_date + INTERVAL 8 MONTH THEN 1 ELSE 0 END END AS r7,
  CASE WHEN d >= first_date + INTERVAL 13 MONTH THEN CASE WHEN d < first_date + INTERVAL 14 MONTH THEN 1 ELSE 0 END END AS r13,
  first_date FROM s),
a AS (SELECT o_custkey, r7, d AS r7_date FROM x WHERE r7 IS NOT NULL AND d > first_date
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d, r7) = 1),
b AS (SELECT o_custkey, r13, d AS r13_date FROM x WHERE r13 IS NOT NULL AND d > first_date
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d, r13) = 1),
ret AS (SELECT f.o_custkey, f.first_date, r7, r7_date, r13, r13_date FROM f LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey))
"""


def retention_per_month(spark, folder):
    r = retained(spark, folder).withColumns({"m7": F.last_day("r7_date"), "m13": F.last_day("r13_date")})
    return retention_avg(r, "r7", "m7", "r7").join(retention_avg(r, "r13", "m13", "r13"), "month", "left")


def line_terms(spark, folder):
    return term_metrics(
        lineitem(spark, folder), "l_orderkey", "l_linenumber", {"l_quantity": "quantity_t{t}", "l_discount": "discount_t{t}"}
    )


def supplier_units(spark, folder):
    li = lineitem(spark, folder).where(closed_before("l_shipdate", AS_OF)).select(
        "l_suppkey", month_end("l_shipdate").alias("ship_month"), "l_quantity", "l_returnflag"
    )
    return running_units(
        li, "l_suppkey", "ship_month",
        {"shipped": F.col("l_quantity"), "returned": F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)},
    )


def line_duplicates(spark, folder):
    li = lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("ship_date"))
    return duplicates(li, ["l_orderkey", "l_linenumber"], 1, "ship_date")


def line_duplicates_rollup(spark, folder):
    li = lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("ship_date"))
    return duplicates_rollup(duplicates(li, ["l_orderkey", "l_linenumber", "l_returnflag"], 1, "ship_date"), "l_returnflag", 2)


def first_products(spark, folder):
    """Orders as course enrolments, final orders as completions."""
    o = orders(spark, folder)
    item = {"1-URGENT": "Single Course", "2-HIGH": "Bundle A", "3-MEDIUM": "Guaranteed B"}
    enrolled = o.select(
        "o_custkey",
        F.col("o_orderkey").alias("course_id"),
        F.to_date("o_orderdate").alias("start"),
        crosswalk("o_orderpriority", item, keep_unmapped=True).alias("item"),
        F.col("o_orderstatus").alias("course"),
    )
    completed = o.select("o_custkey", F.col("o_orderkey").alias("course_id"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("completed"))
    return first_product(enrolled, completed, "o_custkey", "course_id", "start", "item", "course", "P", "completed")


def year_orders(spark, folder):
    o = orders(spark, folder).where(in_year("o_orderdate", 1997)).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    return o.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


ENTRIES = {
    "dedupe_first": (
        lambda s, d: dedupe_first(orders(s, d).select(*ORDER_COLS), "o_custkey", "o_orderdate", "o_orderkey"),
        """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
    ),
    "dedupe_last": (
        lambda s, d: dedupe_last(orders(s, d).select(*ORDER_COLS), "o_custkey", "o_orderdate", "o_orderkey"),
        """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "latest_snapshot": (
        lambda s, d: latest_snapshot(lineitem(s, d), "l_shipdate", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]),
        """SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem
        WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)""",
    ),
    "conversion_days": (two_orders, f"{TWO_SQL} SELECT * FROM q"),
    "bins_four": (
        binned([30, 60, 90], ["0-30 days", "31-60 days", "61-90 days", "90+ days"]),
        f"""{TWO_SQL} SELECT CASE WHEN days <= 30 THEN '0-30 days' WHEN days <= 60 THEN '31-60 days' WHEN days <= 90 THEN '61-90 days'
        WHEN days > 90 THEN '90+ days' END AS bin, count(*) AS n FROM q GROUP BY 1""",
    ),
    "bins_six": (
        binned([7, 14, 30, 60, 90], ["0-7 days", "8-14 days", "14-30 days", "31-60 days", "61-90 days", "90+ days"]),
        f"""{TWO_SQL} SELECT CASE WHEN days <= 7 THEN '0-7 days' WHEN days <= 14 THEN '8-14 days' WHEN days <= 30 THEN '14-30 days'
        WHEN days <= 60 THEN '31-60 days' WHEN days <= 90 THEN '61-90 days' WHEN days > 90 THEN '90+ days' END AS bin, count(*) AS n FROM q GROUP BY 1""",
    ),
    "bins_five": (
        binned([7, 14, 30, 60], ["7 or fewer days", "8-14 days", "15-30 days", "31-60 days", "61+ days"], negative="before"),
        f"""{TWO_SQL} SELECT CASE WHEN days < 0 THEN 'before' WHEN days <= 7 THEN '7 or fewer days' WHEN days <= 14 THEN '8-14 days'
        WHEN days <= 30 THEN '15-30 days' WHEN days <= 60 THEN '31-60 days' WHEN days > 60 THEN '61+ days' END AS bin, count(*) AS n FROM q GROUP BY 1""",
    ),
    "audit_unique": (
        lambda s, d: audit_unique(orders(s, d), "o_custkey", "o_orderkey"),
        """SELECT count(o_custkey) AS o_custkey_n, count(DISTINCT o_custkey) AS o_custkey_unique, count(o_custkey) - count(DISTINCT o_custkey) AS o_custkey_diff,
        count(o_orderkey) AS o_orderkey_n, count(DISTINCT o_orderkey) AS o_orderkey_unique, count(o_orderkey) - count(DISTINCT o_orderkey) AS o_orderkey_diff FROM orders""",
    ),
    "audit_unique_rollup": (
        lambda s, d: audit_unique_rollup(orders(s, d), "o_orderstatus", "o_custkey"),
        """SELECT o_orderstatus, CAST(grouping(o_orderstatus) AS INTEGER) AS is_total, count(o_custkey) AS o_custkey_n,
        count(DISTINCT o_custkey) AS o_custkey_unique, count(o_custkey) - count(DISTINCT o_custkey) AS o_custkey_diff
        FROM orders GROUP BY ROLLUP (o_orderstatus)""",
    ),
    "audit_composite": (
        lambda s, d: audit_composite(orders(s, d), "o_custkey", "o_orderdate"),
        "SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) AS unique_n FROM orders",
    ),
    "audit_join": (
        join_audit,
        """SELECT 'Before Join' AS label, count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS unique_n FROM orders UNION ALL
        SELECT 'After Join', count(o_orderkey), count(DISTINCT o_orderkey) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    ),
    "reconcile_monthly": (reconciled("tenth", AS_OF), f"{RECONCILE_SQL} SELECT *, round(diff / n_official, 3) * 100 AS percent_diff FROM j WHERE period < DATE '2001-01-01'"),
    "reconcile_whole_percent": (reconciled("whole"), f"{RECONCILE_SQL} SELECT *, round(diff / n_official * 100, 0) AS percent_diff FROM j"),
    "reconcile_share": (reconciled("share"), f"{RECONCILE_SQL} SELECT *, round(diff / n_etl, 2) AS percent_diff FROM j"),
    "attrition_union": (attrition_union, f"{ATTRITION_SQL} SELECT * FROM ev"),
    "attrition_unique": (lambda s, d: attrition_unique(attrition_union(s, d)).drop("college", "program"), f"{ATTRITION_SQL} SELECT * EXCLUDE (college, program) FROM uniq"),
    "attrition_attach": (
        attrition_attached,
        f"""{ATTRITION_SQL} SELECT o.lead_id, o.student_key, o.term_start AS start_date, one.flag AS attrition_flag, one.status AS attrition_status
        FROM o LEFT JOIN one ON one.lead_id = o.lead_id AND one.term_start = o.term_start""",
    ),
    "compare_full_outer": (
        day_counts,
        """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS ordered FROM orders GROUP BY 1),
        s AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1)
        SELECT day, ordered, shipped, round((shipped - ordered) / ordered, 2) AS prop_diff FROM o FULL JOIN s USING (day)""",
    ),
    "series_three_way": (
        three_series,
        """SELECT a.period, n_all, n_final, n_urgent FROM
        (SELECT last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS n_all FROM orders GROUP BY 1) a
        LEFT JOIN (SELECT last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS n_final FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.period = a.period
        LEFT JOIN (SELECT last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS n_urgent FROM orders
          WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1) c ON c.period = a.period""",
    ),
    "status_asof_flag": (
        status_asof,
        """WITH l AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS st FROM orders
          WHERE CAST(o_orderdate AS DATE) <= DATE '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer)
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1)
        SELECT o_custkey, CASE WHEN st LIKE 'F%' THEN 1 ELSE 0 END AS done_flag, CASE WHEN st LIKE 'F%' THEN d END AS done_date,
          CASE WHEN st LIKE 'O%' OR st LIKE 'P%' THEN 1 ELSE 0 END AS open_flag, CASE WHEN st LIKE 'O%' OR st LIKE 'P%' THEN d END AS open_date FROM l""",
    ),
    "status_intervals": (
        lambda s, d: intervals(s, d)[0],
        """SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, o_orderstatus AS status,
          lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey, o_orderstatus) AS valid_to
        FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL""",
    ),
    "status_profile": (
        profile,
        """WITH h AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, o_orderstatus AS st FROM orders),
        a AS (SELECT c_custkey, arg_max(st, (d, k)) FILTER (WHERE d <= DATE '1997-01-01') AS st, max(d) FILTER (WHERE d <= DATE '1997-01-01') AS since_day,
            CAST(count(*) FILTER (WHERE d <= DATE '1997-01-01' AND st LIKE 'F%') > 0 AS INTEGER) AS done_ever,
            CAST(count(*) FILTER (WHERE d <= DATE '1997-01-01' AND (st LIKE 'O%' OR st LIKE 'P%')) > 0 AS INTEGER) AS open_ever,
            arg_max(st, (d, k)) FILTER (WHERE d <= DATE '1997-01-31') AS status_30d, arg_max(st, (d, k)) FILTER (WHERE d <= DATE '1998-01-01') AS status_365d
          FROM customer LEFT JOIN h ON o_custkey = c_custkey GROUP BY 1)
        SELECT c_custkey AS o_custkey, CASE WHEN st LIKE 'F%' THEN 1 ELSE 0 END AS done_flag, CASE WHEN st LIKE 'F%' THEN since_day END AS done_date, done_ever,
          1 - done_ever AS done_never, CASE WHEN st LIKE 'O%' OR st LIKE 'P%' THEN 1 ELSE 0 END AS open_flag,
          CASE WHEN st LIKE 'O%' OR st LIKE 'P%' THEN since_day END AS open_date, open_ever, 1 - open_ever AS open_never, status_30d, status_365d FROM a""",
    ),
    "likert_code": (
        likert,
        """WITH c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
          WHEN '4-NOT SPECIFIED' THEN 4 END AS code FROM orders)
        SELECT o_orderkey, code, CASE WHEN code <= 2 THEN 1 ELSE 0 END AS flagged FROM c""",
    ),
    "crosswalk": (
        crosswalked,
        """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AU' WHEN 'BUILDING' THEN 'BU' WHEN 'MACHINERY' THEN 'MA' END AS code,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AU' WHEN 'BUILDING' THEN 'BU' WHEN 'MACHINERY' THEN 'MA' ELSE 'Missing' END AS code_default,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AU' WHEN 'BUILDING' THEN 'BU' WHEN 'MACHINERY' THEN 'MA' ELSE c_mktsegment END AS code_kept,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_building, CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS is_furniture FROM customer""",
    ),
    "period_keys": (
        keys_per_period,
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS order_week,
        last_day(CAST(o_orderdate AS DATE)) AS order_month, CAST(date_trunc('week', o_orderdate) AS DATE) AS order_week_start FROM orders""",
    ),
    "crosstab": (
        order_crosstab,
        """SELECT last_day(CAST(o_orderdate AS DATE)) AS month, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE",
        count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING", count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD",
        count(*) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')) AS "Missing", count(*) AS total
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    ),
    "cohort_rates": (
        order_rates,
        """SELECT last_day(CAST(o_orderdate AS DATE)) AS month, count(*) AS starts, count(*) FILTER (o_orderstatus = 'F') AS finals,
        round(count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS finals_rate, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgents,
        round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 3) AS urgents_rate,
        min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS first_final_date,
        max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS last_final_date FROM orders GROUP BY 1""",
    ),
    "retention": (retained, f"{RETENTION_SQL} SELECT * FROM ret"),
    "retention_avg": (
        retention_per_month,
        f"""{RETENTION_SQL},
        m7 AS (SELECT last_day(r7_date) AS month, CAST(round(CAST(avg(r7) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS r7, count(*) AS n_r7 FROM ret WHERE r7_date IS NOT NULL GROUP BY 1),
        m13 AS (SELECT last_day(r13_date) AS month, CAST(round(CAST(avg(r13) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS r13, count(*) AS n_r13 FROM ret WHERE r13_date IS NOT NULL GROUP BY 1)
        SELECT m7.month, r7, n_r7, r13, n_r13 FROM m7 LEFT JOIN m13 ON m13.month = m7.month""",
    ),
    "term_metrics": (
        line_terms,
        """SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS quantity_t1, max(l_quantity) FILTER (l_linenumber = 2) AS quantity_t2,
        max(l_discount) FILTER (l_linenumber = 1) AS discount_t1, max(l_discount) FILTER (l_linenumber = 2) AS discount_t2 FROM lineitem GROUP BY 1""",
    ),
    "running_units": (
        supplier_units,
        """WITH t AS (SELECT l_suppkey, last_day(CAST(l_shipdate AS DATE)) AS ship_month, sum(l_quantity) AS shipped,
          sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned FROM lineitem WHERE l_shipdate < DATE '2001-01-01' GROUP BY 1, 2)
        SELECT *, sum(shipped) OVER w AS cumulative_shipped, sum(returned) OVER w AS cumulative_returned FROM t
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY ship_month)""",
    ),
    "ever_flag": (
        lambda s, d: ever_flag(lineitem(s, d), "l_orderkey", F.col("l_returnflag") == "R", "returned", F.col("l_linenumber") <= 3),
        """SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1""",
    ),
    "never_flag": (
        lambda s, d: ever_flag(lineitem(s, d), "l_suppkey", F.col("l_quantity") > 49.5, "never_full", invert=True),
        """SELECT l_suppkey, 1 - max(CASE WHEN l_quantity > 49.5 THEN 1 ELSE 0 END) AS never_full FROM lineitem GROUP BY 1""",
    ),
    "duplicates": (
        line_duplicates,
        """SELECT l_orderkey, l_linenumber, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day,
        CAST(date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS INTEGER) AS days
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "duplicates_rollup": (
        line_duplicates_rollup,
        """WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1)
        SELECT l_returnflag, CAST(grouping(l_returnflag) AS INTEGER) AS is_total, CAST(sum(n) AS DOUBLE) / 2 AS ids FROM k GROUP BY ROLLUP (l_returnflag)""",
    ),
    "date_mismatch": (
        lambda s, d: mismatch_rows(order_line_dates(s, d), "ship_date", "order_date", ["l_orderkey", "l_linenumber", "l_partkey"]),
        """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS ship_date, CAST(o_orderdate AS DATE) AS order_date,
        CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER) AS difference
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) <> CAST(o_orderdate AS DATE)""",
    ),
    "negative_interval": (
        lambda s, d: negative_intervals(order_line_dates(s, d), "order_date", "ship_date", ["l_orderkey", "l_partkey"]),
        """SELECT l_orderkey, l_partkey, CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)""",
    ),
    "first_product": (
        first_products,
        """WITH e AS (SELECT o_custkey, o_orderkey AS course_id, CAST(o_orderdate AS DATE) AS "start", o_orderstatus AS course,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Single Course' WHEN '2-HIGH' THEN 'Bundle A' WHEN '3-MEDIUM' THEN 'Guaranteed B' ELSE o_orderpriority END AS item
          FROM orders WHERE o_orderstatus <> 'P'
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) = 1),
        c AS (SELECT o_custkey, o_orderkey AS course_id, CAST(o_orderdate AS DATE) AS completed_course_date FROM orders WHERE o_orderstatus = 'F')
        SELECT e.*, CASE WHEN item = 'Single Course' THEN 'Single Course: ' || course ELSE item END AS product,
          CASE WHEN item = 'Single Course' THEN item WHEN item LIKE 'Bundle%' OR item LIKE 'Guaranteed%' THEN 'Course Bundle' ELSE 'Certificate' END AS product_subtype,
          CASE WHEN item = 'Single Course' OR item LIKE 'Bundle%' OR item LIKE 'Guaranteed%' THEN 'On-Ramp' ELSE 'Certificate' END AS product_type,
          completed_course_date, CASE WHEN completed_course_date IS NULL THEN 0 ELSE 1 END AS completed_course_flag
        FROM e LEFT JOIN c ON c.o_custkey = e.o_custkey AND c.course_id = e.course_id""",
    ),
    "year_range": (
        year_orders,
        """SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders
        WHERE year(o_orderdate) = 1997 GROUP BY 1""",
    ),
    "normalize_text": (
        lambda s, d: customer(s, d).select("c_custkey", normalize_text(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"), normalize_text("c_mktsegment").alias("segment")),
        "SELECT c_custkey, trim(lower('  ' || c_name || ' ')) AS name, trim(lower(c_mktsegment)) AS segment FROM customer",
    ),
}
