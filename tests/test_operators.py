"""Operators on hand-made rows: NULL keys, ties, boundaries, unmatched rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline.functions import month_end

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def dated(spark):
    data = [("a", D(2024, 1, 2), 1), ("a", D(2024, 1, 2), 2), ("a", D(2024, 1, 5), 3), ("b", None, 4), ("b", D(2024, 1, 1), 5), (None, D(2024, 1, 1), 6)]
    return spark.createDataFrame(data, "k string, d date, id int")


def test_dedupe(dated):
    first = {r.k: r.id for r in O.dedupe_first(dated, "k", "d", "id").collect()}
    last = {r.k: r.id for r in O.dedupe_last(dated, "k", "d", "id").collect()}
    assert first == {"a": 1, "b": 5, None: 6}  # a dated row beats an undated one
    assert last == {"a": 3, "b": 5, None: 6}


def test_dedupe_limits_before_the_exchange(dated):
    plan = O.dedupe_first(dated, "k", "d", "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_snapshot(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), "old", "p"), (D(2024, 2, 29), "new", "p"), (D(2024, 2, 29), "new", "p")], "report_date date, g string, p string")
    assert rows(O.latest_snapshot(df, "report_date", ["p", "g"])) == [("p", "new")]


@pytest.fixture(scope="module")
def asof(spark):
    base = spark.createDataFrame([("a", D(2024, 1, 10)), ("b", None), ("c", D(2024, 1, 10)), ("m", D(2024, 1, 10)), ("m", D(2024, 1, 20)), (None, D(2024, 1, 1))], "k string, anchor date")
    events = spark.createDataFrame(
        [
            ("a", D(2024, 1, 9), 1), ("a", D(2024, 1, 10), 3), ("a", D(2024, 1, 10), 2), ("a", D(2024, 1, 11), 4), ("b", D(2024, 1, 1), 5),
            ("m", D(2024, 1, 15), 6), ("m", D(2024, 1, 19), 7), (None, D(2024, 1, 2), 8), ("z", D(2024, 1, 1), 9), ("c", None, 10),
        ],
        "k string, ts date, id int",
    )
    return base, events


def test_asof_forward(asof):
    base, events = asof
    assert rows(O.asof_forward_first(base, events, "k", "anchor", "ts", tie="id"), "k") == [("a", D(2024, 1, 10), 2), ("m", D(2024, 1, 15), 6)]
    assert rows(O.asof_forward_first(base, events, "k", "anchor", "ts", strict=True, tie="id"), "k") == [("a", D(2024, 1, 11), 4), ("m", D(2024, 1, 15), 6)]


def test_asof_backward(asof):
    base, events = asof
    assert rows(O.asof_backward_last(base, events, "k", "anchor", "ts", tie="id"), "k") == [("a", D(2024, 1, 10), 3), ("m", D(2024, 1, 19), 7)]
    left = O.asof_backward_last(base, events, "k", "anchor", "ts", strict=True, tie="id", how="left")
    assert {r.k: r.id for r in left.collect()} == {"a": 1, "b": None, "c": None, "m": 7, None: None}


def test_asof_dates_only(asof):
    base, events = asof
    dates = events.select("k", "ts")
    assert rows(O.asof_forward_first(base, dates, "k", "anchor", "ts"), "k") == [("a", D(2024, 1, 10)), ("m", D(2024, 1, 15))]
    assert rows(O.asof_backward_last(base, dates, "k", "anchor", "ts"), "k") == [("a", D(2024, 1, 10)), ("m", D(2024, 1, 19))]


def test_attach_first(asof):
    base, events = asof
    got = {(r.k, r.anchor): r.ts for r in O.attach_first(base, events, "k", "anchor", "ts").collect()}
    assert got == {
        ("a", D(2024, 1, 10)): D(2024, 1, 10), ("b", None): None, ("c", D(2024, 1, 10)): None,
        ("m", D(2024, 1, 10)): D(2024, 1, 15), ("m", D(2024, 1, 20)): None, (None, D(2024, 1, 1)): None,
    }


def test_with_stage(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    stage = spark.createDataFrame([("a", D(2024, 1, 1), 5)], "k string, d date, n int")
    got = {r.k: (r.d, r.n, r.hit) for r in O.with_stage(base, stage, "k", "hit", zero=["n"]).collect()}
    assert got == {"a": (D(2024, 1, 1), 5, 1), "b": (None, 0, 0), None: (None, 0, 0)}


def test_direct_and_composite(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (None, 1), (1, 0), (None, None)], "mid int, last int").withColumns(O.direct_vs_via("mid", "last"))
    assert [tuple(r)[2:] for r in df.collect()] == [(0, 1), (1, 0), (1, 0), (0, 0), (0, 0)]
    label = O.composite_label("s", ["X"], "t", "both", "status", "stage")
    df = spark.createDataFrame([("X", "t"), ("X", None), ("Y", "t"), ("Y", None), (None, "t")], "s string, t string").select(label)
    assert [r[0] for r in df.collect()] == ["both", "status", "stage", "Missing", "Missing"]


def test_reconcile_styles(spark):
    ours = spark.createDataFrame([(D(2024, 1, 31), 11), (D(2024, 2, 29), 5), (D(2024, 3, 31), 4), (D(2024, 5, 31), 1)], "period date, n bigint")
    official = spark.createDataFrame([(D(2024, 1, 31), 10), (D(2024, 2, 29), 0), (D(2024, 4, 30), 9), (D(2024, 5, 31), 2)], "period date, n bigint")
    got = rows(O.reconcile(ours, official, as_of=D(2024, 5, 1)))
    assert [r[0] for r in got] == [D(2024, 2, 29), D(2024, 1, 31)]  # one-sided and open months are absent
    assert got[0][4] is None and got[1][1:4] == (11, 10, 1) and got[1][4] == pytest.approx(10.0)
    assert rows(O.reconcile(ours, official, "whole"), "period")[0][4] == 10.0
    assert rows(O.reconcile(ours, official, "share"), "period")[0][4] == 0.09


def test_audits(spark):
    df = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", None), (None, "g")], "id string, g string")
    assert rows(O.audit_unique(df, "id")) == [(3, 2, 1)]
    got = {(r.g, r.is_total): (r.id_n, r.id_unique) for r in O.audit_unique_rollup(df, "g", "id").collect()}
    assert got == {("g", 0): (2, 1), (None, 0): (1, 1), (None, 1): (3, 2)}
    assert rows(O.audit_composite(df, "id", "g")) == [(2, 1)]
    assert {r.label: r.n for r in O.audit_join(df, df.union(df), "id").collect()} == {"Before Join": 3, "After Join": 6}
    assert {tuple(r) for r in O.null_profile(df, ["id", "g"]).collect()} == {(0, 0, 2), (0, 1, 1), (1, 0, 1)}


def test_unique_counts_take_one_narrow_pass(spark):
    long = F.when(F.col("id") % 7 != 0, F.col("id") % 50).cast("long")
    text = F.when(F.col("id") % 3 != 0, (F.col("id") % 11).cast("string"))
    number = F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(-0.0)).when(F.col("id") % 4 == 2, F.lit(0.0))
    df = spark.range(4000).select(
        long.alias("a"), text.alias("b"), (F.col("id") % 11).cast("string").alias("c"), number.alias("d"), F.lit(None).cast("date").alias("e"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 5).alias("g"), F.lit("x" * 500).alias("wide"),
    )
    ids = ["a", "b", "c", "d", "e"]
    plain = [x for c in ids for x in (F.count(c).alias(f"{c}_n"), F.count_distinct(c).alias(f"{c}_unique"), (F.count(c) - F.count_distinct(c)).alias(f"{c}_diff"))]
    one, many = O.audit_unique(df, *ids), O.audit_unique_rollup(df, "g", *ids)
    assert one.columns == df.agg(*plain).columns and rows(one) == rows(df.agg(*plain))
    wanted = df.rollup("g").agg(F.grouping("g").cast("int").alias("is_total"), *plain)
    assert many.dtypes == wanted.dtypes and {tuple(r) for r in many.collect()} == {tuple(r) for r in wanted.collect()}
    assert many.count() == wanted.count() == 6
    for out in (one, many):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "wide" not in plan
    assert rows(O.audit_unique(df.where("false"), "a", "b")) == [(0, 0, 0, 0, 0, 0)]
    assert O.audit_unique_rollup(df.where("false"), "g", "a").count() == 0
    only = df.select("g", F.lit(None).cast("int").alias("a")).distinct()  # groups whose ids are all NULL stay
    assert {(r.g, r.is_total, r.a_n) for r in O.audit_unique_rollup(only, "g", "a").collect()} == {(g, 0, 0) for g in (None, 1, 2, 3, 4)} | {(None, 1, 0)}


def test_compare(spark):
    a = spark.createDataFrame([("x", 4), ("y", 1)], "s string, a bigint")
    b = spark.createDataFrame([("x", 5), ("z", 2)], "s string, b bigint")
    assert {r.s: (r.a, r.b, r.prop_diff) for r in O.compare_full(a, b, "s", "a", "b").collect()} == {"x": (4, 5, 0.25), "y": (1, None, None), "z": (None, 2, None)}
    df = spark.createDataFrame([(D(2024, 1, 3), 1), (D(2024, 1, 9), 0), (D(2024, 2, 9), 0)], "d date, f int")
    got = rows(O.compare_series(df, month_end("d"), {"n": F.lit(True), "f": F.col("f") == 1}))
    assert got == [(D(2024, 1, 31), 2, 1), (D(2024, 2, 29), 1, None)]


def test_mismatch_and_screen(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 5), D(2024, 1, 1)), (2, D(2024, 1, 1), D(2024, 1, 1)), (3, None, D(2024, 1, 1))], "id int, a date, b date")
    assert rows(O.mismatch_rows(df, "a", "b", ["id"])) == [(1, D(2024, 1, 5), D(2024, 1, 1), 4)]
    assert O.negative_intervals(df, "a", "b", ["id"]).count() == 1
    leads = spark.createDataFrame(
        [("Test Person", "ok", None, None), ("x", "Bad Lead", None, None), ("x", None, "Test Lead", None), ("x", None, None, True), (None, None, None, None), ("contest", "ok", "x", False)],
        "name string, q string, r string, t boolean",
    )
    kept = O.screen_test_records(leads, "name", "test", {"q": "Bad Lead", "r": "Test Lead"}, "t")
    assert {r.name for r in kept.collect()} == {None, "contest"}


def test_duplicates(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 4)), ("b", D(2024, 1, 1))], "k string, d date")
    dups = O.duplicates(df, "k", 1, "d")
    assert rows(dups) == [("a", 2, D(2024, 1, 1), D(2024, 1, 4), 3)]
    assert {(r.last_day, r.is_total): r.ids for r in O.duplicates_rollup(dups, "last_day", 2).collect()} == {(D(2024, 1, 4), 0): 1.0, (None, 1): 1.0}


def test_rates(spark):
    df = spark.createDataFrame([("m", 1, D(2024, 1, 1)), ("m", 0, None), ("m", None, None), ("n", 0, None)], "c string, f int, d date")
    assert rows(O.cohort_rates(df, "c", {"hits": "f"}, {"hit": "d"})) == [("m", 3, 1, 0.333, D(2024, 1, 1), D(2024, 1, 1)), ("n", 1, 0, 0.0, None, None)]
    s = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("g", None), (None, "x")], "g string, v string")
    got = {(r.g, r.v): round(r.percent, 3) for r in O.share_by_group(s, "g", "v").collect()}
    assert got == {("g", "x"): 66.667, ("g", "y"): 33.333, (None, "x"): 100.0}
    tab = O.crosstab(s, "g", "v", ["x"], other="rest")
    assert {r.g: (r.x, r.rest, r.total) for r in tab.collect()} == {"g": (2, 2, 4), None: (1, 0, 1)}
    zero = spark.createDataFrame([(0, 0)], "h int, n int").select(O.ratio(F.col("h"), F.col("n")))
    assert zero.first()[0] is None


def test_ever_flags(spark):
    df = spark.createDataFrame([("a", 1, 8), ("a", 0, 9), ("b", 1, 9), ("b", None, 8), ("c", 1, 9)], "k string, f int, wk int")
    within = F.col("wk") <= 8
    assert {r.k: r.e for r in O.ever_flag(df, "k", F.col("f") == 1, "e", within).collect()} == {"a": 1, "b": 0}
    assert {r.k: r.e for r in O.ever_flag(df, "k", F.col("f") == 1, "e", within, invert=True).collect()} == {"a": 0, "b": 1}
    t = spark.createDataFrame([("a", "Bachelor's"), ("a", None), ("b", "Other"), ("c", None)], "k string, d string")
    assert {r.k: r.h for r in O.any_prefix_flag(t, "k", "d", ["Bach", "Mast"], "h").collect()} == {"a": 1, "b": 0, "c": 0}


def test_labels_and_pivot(spark):
    df = spark.createDataFrame([("p", "How  old?", 1), ("p", "How old?\n", 3), ("p", "New?", 2), ("q", None, 1)], "k string, t string, a int")
    named = O.normalize_labels(df, "t", {"How old?": "age"}, "q")
    assert sorted(str(r.q) for r in named.collect()) == ["New?", "None", "age", "age"]
    wide = O.pivot_answers(named, "k", "q", "a", {"age": "age", "gone": "gone"})
    assert {r.k: (r.age, r.gone) for r in wide.collect()} == {"p": (3, None), "q": (None, None)}
    with pytest.raises(ValueError):
        O.literal_lookup(spark, {"a b": "1", "a  b": "2"}, "k", "v")


def test_rules(spark):
    rules = spark.createDataFrame([("P", 1, 1, "x"), ("P", 1, 2, "y"), ("P", 1, 1, "w"), ("Q", 0, 1, "z")], "p string, f int, seq int, product string")
    wide = O.widen_rules(rules, ["p", "f"], "seq", "product", 3)
    df = spark.createDataFrame([(1, "P", 1), (2, "P", 0), (3, "P", 0)], "id int, p string, f int")
    assert {r.id: (r.product1, r.product2, r.product3) for r in O.apply_rules(df, wide, ["p", "f"]).collect()} == {1: ("w", "y", None), 2: (None,) * 3, 3: (None,) * 3}
    assert rows(O.duplicate_rules(rules, ["p", "f", "seq"])) == [("P", 1, 1, 2)]
    assert {r.id for r in O.unmatched(df, wide, ["p", "f"]).collect()} == {2, 3}
    assert {(r.p, r.f): (r.n, r.found_in) for r in O.rule_coverage(df, wide, ["p", "f"]).collect()} == {("P", 1): (1, "both"), ("P", 0): (2, "left_only"), ("Q", 0): (0, "right_only")}


def test_attach_responses_makes_no_pairs(spark):
    answers = spark.createDataFrame([("p", "q", 1, 10), ("p", "q", 2, 11), ("x", "q", 1, 12)], "person string, q string, at int, v int")
    apps = spark.createDataFrame([("p", "L1", 1), ("p", "L2", 5)], "person string, lead string, day int")
    got = O.attach_responses(answers, apps, "person", "q", "at", "day", "lead")
    assert [(r.person, r.v, r.lead) for r in got.collect()] == [("p", 11, "L2")]


def test_history(spark):
    base = spark.createDataFrame([("a", D(2024, 1, 10)), ("b", D(2024, 1, 10))], "k string, anchor date")
    hist = spark.createDataFrame([("a", D(2024, 1, 9), "NAYT x"), ("a", D(2024, 1, 10), "INTV"), ("b", D(2024, 1, 11), "NAYT")], "k string, d date, s string")
    got = O.status_asof_flag(base, hist, "k", "anchor", "d", "s", {"n": ["NAYT"], "i": ["INTV"]})
    assert rows(got) == [("a", 0, None, 1, D(2024, 1, 10))]
    snaps = spark.createDataFrame([("a", D(2024, 1, 10), 1), ("a", D(2024, 2, 1), None), ("a", D(2024, 3, 1), 0), ("a", D(2024, 4, 1), 1)], "k string, m date, r int")
    assert {r.k: (r.r, r.x_date) for r in O.retention_at(base, snaps, "k", "anchor", "m", {"r": "x"}).collect()} == {"a": (0, D(2024, 3, 1)), "b": (None, None)}


def test_running_units_and_terms(spark):
    df = spark.createDataFrame([("s", 1, 2.0), ("s", 1, 1.0), ("s", 2, 4.0), ("t", 2, 1.0)], "k string, term int, u double")
    assert rows(O.running_units(df, "k", "term", {"units": F.col("u")}), "k", "term") == [("s", 1, 3.0, 3.0), ("s", 2, 4.0, 7.0), ("t", 2, 1.0, 1.0)]
    assert rows(O.term_metrics(df, "k", "term", {"u": "u{t}"}), "k") == [("s", 2.0, 4.0), ("t", None, 1.0)]


def test_attrition(spark):
    cols = "lead_id string, student_key bigint, term_start date, wk int, wk_end date, status string, flag int, college string, program string"
    t, end = D(2024, 1, 1), D(2024, 2, 25)
    fact = spark.createDataFrame(
        [
            ("L1", 1, t, 7, D(2024, 2, 18), "Dropped", 1, "c", "p"),
            ("L1", 1, t, 8, end, "Dropped", 1, "c", "p"),  # settles student 1
            ("L2", 2, t, 8, end, "Active", 0, "c", "p"),  # does not settle student 2
            ("L3", 3, t, 8, end, "TSCA", 1, "c", "p"),  # left out, comes back as a reversal
            ("L4", 4, t, 9, D(2024, 3, 3), "Dropped", 1, "c", "p"),  # too late a week
            ("L5", 5, t, 8, end, None, 1, "c", "p"),  # unknown status is not compared
        ],
        cols,
    )
    rev = spark.createDataFrame([(k, t, "c", "p", 1) for k in (1, 2, 3, 6)] + [(2, t, "c", "p", 1)], "student_key bigint, term_start date, college string, program string, reverse_start int")
    starts = spark.createDataFrame([("L2", 2, t), ("L3", 3, t)], "lead_id string, student_key bigint, start_date date")
    cal = spark.createDataFrame([(t, end, 8), (t, end, 8), (t, D(2024, 2, 18), 7)], "term_start date, wk_end date, wk int")
    ev = O.attrition_events(fact, rev, starts, cal, D(2020, 1, 1), D(2024, 2, 25))
    got = sorted((r.lead_id or "-", r.student_key, r.wk, r.status) for r in ev.collect())
    assert got == [("-", 6, 8, "TSCA"), ("L1", 1, 7, "Dropped"), ("L1", 1, 8, "Dropped"), ("L2", 2, 8, "Active"), ("L2", 2, 8, "TSCA"), ("L3", 3, 8, "TSCA")]
    early = O.attrition_events(fact, rev, starts, cal, D(2020, 1, 1), D(2024, 2, 24))
    assert early.where("status = 'TSCA'").count() == 0  # week 8 has not passed
    unique = O.attrition_unique(ev)
    assert sorted((r.lead_id, r.wk_end) for r in unique.collect()) == [("L1", end), ("L2", end), ("L3", end)]
    out = O.attrition_attach(starts.union(starts.limit(0)), unique)
    assert {r.lead_id: r.attrition_status for r in out.collect()} == {"L2": "TSCA", "L3": "TSCA"}
    assert out.count() == starts.count()


def test_match_ids(spark):
    df = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "contact string")
    m = spark.createDataFrame([("c1", "x", False), ("c1", "y", True), ("c2", "z", False)], "contact string, lead string, best boolean")
    assert {r.contact: (r.lead, r.ref) for r in O.match_ids(df, m, "contact", "best", ["lead"], "lead", "ref").collect()} == {
        "c1": ("y", "y"), "c2": (None, "Unmatched Opportunity"), "c3": (None, "Unmatched Opportunity"),
    }


def test_outcomes_any_start_counts(spark):
    starts = spark.createDataFrame([("p", "s1", D(2024, 1, 1)), ("p", "s2", D(2024, 3, 1)), ("q", "s3", D(2024, 1, 1))], "person_id string, subscription_id string, start_date date")
    done = spark.createDataFrame([("p", 1, D(2023, 12, 1)), ("p", 1, D(2024, 2, 1)), ("p", 1, D(2024, 4, 1))], "person_id string, complete_flag int, complete_date date")
    gone = spark.createDataFrame([("q", 1, 1, 0, D(2024, 1, 1))], "person_id string, drop_flag int, drop_7d_flag int, drop_72h_flag int, drop_date date")
    got = {r.subscription_id: (r.complete_flag, r.complete_date, r.drop_flag, r.drop_7d_flag) for r in O.outcomes(starts, done, gone).collect()}
    assert got == {"s1": (1, D(2024, 2, 1), 0, 0), "s2": (1, D(2024, 2, 1), 0, 0), "s3": (0, None, 1, 1)}


def test_stamp(spark):
    now = dt.datetime(2024, 1, 1)
    assert O.stamp_refresh(spark.range(1), now).first()["last_refreshed"] == now
