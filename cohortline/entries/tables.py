"""Writers and readers on the driver's tables: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortline import sources as S
from cohortline.operators import with_stages
from cohortline.session import configure, keep, new_folder


def orders(spark, folder):
    o = S.table_from(configure(spark), folder, "orders")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), F.trunc("o_orderdate", "month").cast("date").alias("month"))


def place(spark, name):
    found = new_folder(spark, name)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return found


def fresh_name(name):
    return f"{name}_{uuid.uuid4().hex}"


def table_replace_merge(spark, folder):
    """A table is replaced by its dear orders; then a frame that lacks the price and adds a size replaces its rows, widened."""
    name, o = fresh_name("t_orders"), orders(spark, folder)
    S.overwrite_table(o.select("o_orderkey", "o_totalprice"), name)
    S.overwrite_table(o.where("o_totalprice > 200000").select("o_orderkey", (F.col("o_totalprice") > 300000).alias("very_dear")), name, "merge")
    return S.read_table(spark, name)


def table_month_refresh(spark, folder):
    """A table by month, of which the months of 1996 are replaced by their cheap orders."""
    name, o = fresh_name("t_months"), orders(spark, folder).select("o_orderkey", "o_totalprice", "month")
    S.overwrite_partitioned(o, name, place(spark, "months"), "month")
    S.refresh_partitions(o.where("year(month) = 1996 AND o_totalprice < 100000"), name, "month")
    return S.read_table(spark, name)


def path_round_trip(spark, folder):
    """Orders by way of ORC files."""
    path = place(spark, "orc")
    orders(spark, folder).write.orc(path)
    return S.read_path(spark, "orc", path)


def rules_csv_round_trip(spark, folder):
    """The rule file's columns by way of CSV with a header."""
    path, p = place(spark, "rules"), S.table_from(spark, folder, "part")
    code = F.concat(F.lit("P"), F.col("p_size").cast("string"))
    bits = [(F.shiftright("p_partkey", k) % 2).cast("int").alias(f"sc{k + 1}") for k in range(4)]
    p.select(code.alias("program"), *bits, (F.col("p_partkey") % 3 + 1).cast("int").alias("seq"), F.col("p_name").alias("product")).write.csv(path, header=True)
    return S.read_rules_csv(spark, path)


def audited_orders(spark, folder):
    """Row and NULL counts and a join's fan-out, observed while the joined rows are written."""
    o, c = orders(spark, folder), S.table_from(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    store = S.StageStore(spark, place(spark, "audited"))
    store.stage("orders", lambda: o.join(c, "o_custkey", "left"), {"orders": folder}, {"matched": F.count("c_acctbal"), "last_day": F.max("day").cast("string")})
    held = store.manifest("orders")
    figures = {"rows": held.rows, "unmatched": held.nulls["c_acctbal"], "matched": held.audits["matched"], "null_days": held.nulls["day"]}
    rows = store.read("orders").agg(F.count(F.lit(1)).alias("read_back"))
    return rows.select(*[F.lit(v).cast("long").alias(k) for k, v in figures.items()], F.lit(held.audits["last_day"]).alias("last_day"), "read_back")


KINDS = ["view", "click", "purchase", "error"]


def bucketed_stages(spark, folder):
    """Eight stages and their people, each stored in buckets of the person, attached without a shuffle."""
    ev = S.table_from(configure(spark), folder, "events").where("user_id IS NOT NULL")
    times = keep(ev.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last")), "times")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(kind, pick, column):
        name = fresh_name("t_stage")
        S.overwrite_bucketed(times.where(F.col("event_type") == kind).select("user_id", F.col(pick).alias(column)), name, "user_id", buckets)
        return S.read_table(spark, name)

    people = stored("signup", "first", "signup_ts")
    return with_stages(people, {f"{pick}_{kind}": stored(kind, pick, f"{pick}_{kind}_ts") for kind in KINDS for pick in ("first", "last")}, "user_id")


STAGES_SQL = ", ".join(
    f"""CASE WHEN count(*) FILTER (event_type = '{kind}') > 0 THEN 1 ELSE 0 END AS {pick}_{kind},
    {how}(ts) FILTER (event_type = '{kind}') AS {pick}_{kind}_ts"""
    for kind in KINDS
    for pick, how in (("first", "min"), ("last", "max"))
)

ORDERS_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)"""

ENTRIES = {
    "table_replace_merge": (
        table_replace_merge,
        f"{ORDERS_SQL} SELECT o_orderkey, CAST(NULL AS DOUBLE) AS o_totalprice, o_totalprice > 300000 AS very_dear FROM o WHERE o_totalprice > 200000",
    ),
    "table_month_refresh": (
        table_month_refresh,
        f"""{ORDERS_SQL} SELECT o_orderkey, o_totalprice, month FROM o WHERE year(month) <> 1996 OR o_totalprice < 100000
        OR month NOT IN (SELECT month FROM o WHERE o_totalprice < 100000)""",
    ),
    "path_round_trip": (path_round_trip, f"{ORDERS_SQL} SELECT * FROM o"),
    "rules_csv_round_trip": (
        rules_csv_round_trip,
        """SELECT 'P' || CAST(p_size AS VARCHAR) AS program, CAST(p_partkey % 2 AS INTEGER) AS sc1, CAST(p_partkey // 2 % 2 AS INTEGER) AS sc2,
        CAST(p_partkey // 4 % 2 AS INTEGER) AS sc3, CAST(p_partkey // 8 % 2 AS INTEGER) AS sc4, CAST(p_partkey % 3 + 1 AS INTEGER) AS seq, p_name AS product FROM part""",
    ),
    "bucketed_stages": (
        bucketed_stages,
        f"""SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup_ts, {STAGES_SQL} FROM events
        WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > 0""",
    ),
    "audited_orders": (
        audited_orders,
        f"""{ORDERS_SQL} SELECT count(*) AS "rows", count(*) - count(c_custkey) AS unmatched, count(c_custkey) AS matched, count(*) - count(day) AS null_days,
        CAST(max(day) AS VARCHAR) AS last_day, count(*) AS read_back FROM o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey""",
    ),
}
