"""Stages that are published, resumed and audited; the timeline of a key; partition refresh."""

import datetime as dt

import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline import sources as S
from cohortline.entries import feeds


def test_a_stage_is_built_once_for_its_inputs(spark, tmp_path):
    store, calls = S.StageStore(spark, f"file://{tmp_path}"), []

    def build(n):
        calls.append(n)
        return spark.range(n).select("id", F.when(F.col("id") > 2, 1).alias("x"))

    assert store.stage("a", lambda: build(5), {"t": "1"}).count() == 5
    assert store.stage("a", lambda: build(6), {"t": "1"}).count() == 5 and calls == [5]
    assert S.StageStore(spark, f"file://{tmp_path}").stage("a", lambda: build(7), {"t": "1"}).count() == 5
    old = store.manifest("a")
    assert store.stage("a", lambda: build(8), {"t": "2"}).count() == 8 and calls == [5, 8]
    assert old.rows == 5 and old.nulls == {"id": 0, "x": 3} and store.read("a").columns == ["id", "x"]
    store.prune("a")
    assert [p.name for p in (tmp_path / "a").glob("v-*")] == [store.manifest("a").version] and store.read("a").count() == 8
    with pytest.raises(LookupError):
        store.read("b")


def test_a_failed_build_leaves_the_published_stage(spark, tmp_path):
    store = S.StageStore(spark, f"file://{tmp_path}")
    store.stage("a", lambda: spark.range(3), {"t": "1"})
    with pytest.raises(Exception):
        store.stage("a", lambda: spark.range(3).select(F.raise_error(F.lit("broken"))), {"t": "2"})
    assert store.read("a").count() == 3 and store.manifest("a").inputs == {"t": "1"}


def test_audits_come_out_of_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, None), (2, "y", 4)], "k int, a string, b int")
    starts = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("audited", "one write")
    got = S.audited_write(df, f"file://{tmp_path}/w", {"matched": F.count("b"), "last": F.max("k")})
    jobs = len(starts.getJobIdsForGroup("audited"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and got == {"rows": 3, "nulls": {"k": 0, "a": 1, "b": 2}, "audits": {"matched": 1, "last": 2}}
    profile = O.audit_unique(spark.read.parquet(f"file://{tmp_path}/w"), "a", "b").first()
    assert (profile["a_n"], profile["b_n"]) == (got["rows"] - got["nulls"]["a"], got["rows"] - got["nulls"]["b"])


def test_marts_resume_after_an_interruption(spark, tmp_path, monkeypatch):
    i = feeds.Inputs(spark, TESTDATA)
    i.store = S.StageStore(spark, f"file://{tmp_path}")
    i.stage(feeds.account), i.stage(feeds.app), i.stage(feeds.recommend)
    monkeypatch.setattr(feeds.plans, "build_onramp", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("interrupted")))
    with pytest.raises(RuntimeError):
        feeds.cohort_account(i)
    monkeypatch.undo()
    again = feeds.Inputs(spark, TESTDATA)
    again.store = S.StageStore(spark, f"file://{tmp_path}")
    mart = feeds.cohort_account(again)
    assert not {"account", "app", "recommend"} & set(again.store.built) and "onramp" in again.store.built
    assert mart.count() > 0
    last = feeds.Inputs(spark, TESTDATA)
    last.store = S.StageStore(spark, f"file://{tmp_path}")
    feeds.cohort_inquiry(last)
    assert set(last.store.built) == {"inquiry"}  # advice and starts are those of the account mart


def test_refresh_replaces_only_the_months_given(spark, tmp_path):
    months = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("month"))
    S.overwrite_partitioned(months, "t_months", f"file://{tmp_path}/m", "month")
    files = lambda m: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "m" / f"month={m}").glob("part-*"))
    before = {m: files(m) for m in range(4)}
    S.refresh_partitions(spark.range(3).select(F.lit(2).alias("month"), "id"), "t_months", "month")
    assert all(files(m) == before[m] for m in (0, 1, 3)) and files(2) != before[2]
    assert spark.read.table("t_months").groupBy("month").count().collect().__len__() == 4
    assert spark.read.table("t_months").where("month = 2").count() == 3
    with pytest.raises(Exception):
        S.refresh_partitions(spark.range(3).select(F.lit(1).alias("month"), F.raise_error(F.lit("broken")).cast("bigint").alias("id")), "t_months", "month")
    assert files(1) == before[1] and spark.read.table("t_months").where("month = 1").count() == 10


def test_overwrite_never_leaves_the_name_empty(spark, monkeypatch):
    S.overwrite_table(spark.range(3), "t_swap")
    run = spark.sql

    def fails(text, *a, **k):
        if text == "ALTER TABLE t_swap__fresh RENAME TO t_swap":
            raise RuntimeError("lost")
        return run(text, *a, **k)

    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: fails(text, *a, **k))
    with pytest.raises(RuntimeError):
        S.overwrite_table(spark.range(9), "t_swap")
    monkeypatch.undo()
    assert spark.read.table("t_swap").count() == 3
    S.overwrite_table(spark.range(9), "t_swap")
    assert spark.read.table("t_swap").count() == 9 and not spark.catalog.tableExists("t_swap__old")


D = dt.date
TYPES = {"s": "string", "n": "int"}


def picks_of(spark, rows):
    df = spark.createDataFrame(rows, "k int, kind string, day date, s string, n int")
    marks = {name: O.Mark(F.col("kind") == name, "day", {"s": "s", "n": "n"}) for name in ("start", "drop", "term")}
    picks = {"start": O.Pick(["s"], after_anchor=False), "drop": O.Pick(["s", "n"]), "term": O.Pick(["n"], after_anchor=False, most=True)}
    return {r["k"]: r for r in O.firsts(O.dated(df, "k", marks, TYPES), "k", "start", picks).collect()}


def test_timeline_picks(spark):
    got = picks_of(spark, [
        (1, "start", D(2024, 1, 5), "b", 0), (1, "start", D(2024, 1, 5), "a", 0), (1, "start", D(2024, 3, 1), "0", 0),
        (1, "drop", D(2024, 1, 5), "on the day", 0), (1, "drop", D(2024, 2, 1), None, 1), (1, "drop", D(2024, 2, 1), "x", 3), (1, "drop", D(2024, 2, 1), "x", 2),
        (1, "term", D(2023, 1, 1), "t", 4), (1, "term", D(2023, 1, 1), "t", 9), (1, "term", D(2023, 1, 2), "t", 99),
        (2, "drop", D(2024, 1, 1), "no start", 0), (3, "start", D(2024, 1, 1), None, None), (3, "drop", None, "undated", 1),
        (None, "start", D(2024, 1, 1), "unknown", 1), (None, "drop", D(2024, 2, 1), "unknown", 1),
    ])
    assert set(got) == {1, 3, None}
    assert (got[1]["start"]["day"], got[1]["start"]["s"]) == (D(2024, 1, 5), "a")
    assert (got[1]["drop"]["day"], got[1]["drop"]["s"], got[1]["drop"]["n"]) == (D(2024, 2, 1), "x", 2)
    assert got[1]["term"]["n"] == 9 and got[3]["drop"] is None and got[3]["start"]["s"] is None
    assert got[None]["drop"] is None and got[None]["start"]["s"] == "unknown"


def test_degree_success_reads_the_months_twice(spark):
    i = feeds.Inputs(spark, TESTDATA)
    months = i.student_month.withColumn("marker_month", F.lit(1))
    out = feeds.plans.build_degree_success(months, i.student_drop, i.term_progress, since=feeds.SINCE)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderpriority") > 0 and plan.count("Relation [") <= 4  # months twice, drops, progress


def test_hot_students_send_one_row_per_kind_and_day(spark):
    df = spark.range(50_000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("int").alias("k"), F.lit("drop").alias("kind"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 30).cast("int")).alias("day"), F.lit("s").alias("s"), F.lit(1).alias("n"),
    )
    marks = {"drop": O.Mark(F.col("kind") == "drop", "day", {"s": "s"}), "start": O.Mark(F.col("k") == 1, "day")}
    out = O.firsts(O.dated(df, "k", marks, TYPES), "k", "start", {"drop": O.Pick(["s"])})
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.rindex("Exchange") < plan.rindex("partial_min(")  # top first
