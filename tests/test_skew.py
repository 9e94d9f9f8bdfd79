"""Heavy keys: found, spread out, and without effect on results."""

import datetime as dt

import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline.entries import ENTRIES
from cohortline.operators.skew import small_side


@pytest.fixture(scope="module")
def events(spark):
    """A third of 30,000 rows on key 0, another tenth NULL, thousands of exact copies among them."""
    n = spark.range(30000)
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 997)
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(F.col("id") % 6 == 0, 5).otherwise(F.col("id") % 50).cast("int"))
    return n.select(key.alias("k"), day.alias("ts"), (F.col("id") % 7).alias("v"))


@pytest.fixture(scope="module")
def base(spark):
    k = spark.range(1500)
    return k.select(F.when(F.col("id") == 1499, None).otherwise(F.col("id")).alias("k"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("anchor"))


@pytest.fixture(scope="module")
def heavy(events):
    return O.heavy_keys(events, "k", share=0.02, floor=1000)


def same(a, b):
    assert a.columns == b.columns or set(a.columns) == set(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_finds_heavy_keys(spark, events, heavy):
    want = {r[0] for r in spark.sql("select xxhash64(0L) union all select xxhash64(cast(null as bigint))").collect()}
    assert set(heavy) == want
    assert O.heavy_keys(events, "k") == []  # nothing reaches the default floor


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(events, base, heavy, how):
    same(O.salted_join(events, base, "k", how, heavy, ["ts"]), O.salted_join(events, base, "k", how))


def test_salted_join_spreads_rows(spark, events, base, heavy):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sizes = {}
        for name, h in (("plain", ()), ("salted", heavy)):
            j = O.salted_join(events, base, "k", "inner", h, ["ts", "v"])
            sizes[name] = max(r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect())
        assert sizes["plain"] > 10000 and sizes["salted"] < sizes["plain"] / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_asof_with_heavy_keys(events, base, heavy):
    for strict in (False, True):
        same(
            O.asof_forward_first(base, events, "k", "anchor", "ts", strict, tie="v", heavy=heavy),
            O.asof_forward_first(base, events, "k", "anchor", "ts", strict, tie="v"),
        )
        same(
            O.asof_backward_last(base, events, "k", "anchor", "ts", strict, tie="v", heavy=heavy),
            O.asof_backward_last(base, events, "k", "anchor", "ts", strict, tie="v"),
        )
    same(O.attach_first(base, events, "k", "anchor", "ts", heavy=heavy), O.attach_first(base, events, "k", "anchor", "ts"))


def test_stage_and_fan_out_with_heavy_keys(events, base, heavy):
    stage = base.withColumnRenamed("anchor", "d")
    same(O.with_stage(events, stage, "k", "hit", heavy=heavy), O.with_stage(events, stage, "k", "hit"))
    same(O.left_fan_out(base, events, "k", heavy, ["ts"]), O.left_fan_out(base, events, "k"))


def test_adaptive_split_of_a_skewed_join(spark, tmp_path):
    """Two plain tables joined and then grouped by the join key: the hot partition is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    many = spark.range(400000).repartition(16).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"))
    many.write.parquet(str(tmp_path / "many"))
    spark.range(400000).select(F.col("id").alias("k"), F.col("id").alias("w")).write.parquet(str(tmp_path / "one"))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out = spark.read.parquet(str(tmp_path / "many")).join(spark.read.parquet(str(tmp_path / "one")), "k").groupBy("k").agg(F.count("w").alias("n"), F.sum("v"))
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum(r.n for r in rows) == 400000 and "skew=true" in plan
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_small_side_checks_size(spark):
    big = spark.range(1000)
    assert "ResolvedHint" in small_side(big, 1000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(big, 999)._jdf.queryExecution().analyzed().toString()


def test_heavy_keys_inside_the_plan(spark, events, base, heavy):
    """The subquery names the keys the sketch names, changes no result, and building the plan starts no job."""
    inside = lambda: O.heavy_in_plan(events, "k", share=0.02, floor=1000)
    assert set(spark.range(1).select(inside().alias("h")).first()["h"]) == set(heavy)
    assert spark.range(1).select(O.heavy_in_plan(events, "k").alias("h")).first()["h"] == []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "building only")
    try:
        joined = [O.salted_join(events, base, "k", how, inside(), ["ts"]) for how in ("inner", "left")]
        fanned = O.left_fan_out(base, events, "k", inside(), ["ts", "v"])
        first = O.asof_forward_first(base, events, "k", "anchor", "ts", tie="v", heavy=inside())
        added = O.attach_first(base, events, "k", "anchor", "ts", heavy=inside())
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for got, how in zip(joined, ("inner", "left")):
        same(got, O.salted_join(events, base, "k", how))
    same(fanned, O.left_fan_out(base, events, "k"))
    same(first, O.asof_forward_first(base, events, "k", "anchor", "ts", tie="v"))
    same(added, O.attach_first(base, events, "k", "anchor", "ts"))


def test_heavy_keys_inside_the_plan_spread_rows(spark, events, base):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        j = O.salted_join(events, base, "k", "inner", O.heavy_in_plan(events, "k", share=0.02, floor=1000), ["ts", "v"])
        assert max(r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()) < 10000 / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_entries_find_heavy_keys_in_the_plan(spark):
    for name in ("asof_forward", "asof_backward", "status_asof_flag"):
        plan = ENTRIES[name][0](spark, TESTDATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "scalar-subquery" in plan and "approx_top_k" in plan
