"""Cases that later rounds added: lost rule steps, payloads of any type, horizons in one pass, safe reads and writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline.operators.skew import NULL_KEY, salted_join
from cohortline.sources import overwrite_table, table_from

D = dt.date


@pytest.mark.parametrize("seq", [4, 0, None])
def test_a_rule_step_without_a_column_fails(spark, seq):
    rules = spark.createDataFrame([("A", 1, "x"), ("A", seq, "y")], "p string, seq int, product string")
    with pytest.raises(Exception, match="rule step"):
        O.widen_rules(rules, ["p"], "seq", "product", 3).collect()
    wide = O.widen_rules(rules.where("seq = 1"), ["p"], "seq", "product", 3)
    assert [tuple(r) for r in wide.collect()] == [("A", "x", None, None)]


def test_asof_payload_may_be_a_map(spark):
    base = spark.createDataFrame([(1, D(2024, 1, 5))], "k int, at date")
    events = spark.createDataFrame([(1, D(2024, 1, 6), 1, {"a": 1}), (1, D(2024, 1, 7), 2, {"b": 2}), (1, D(2024, 1, 4), 3, {"c": 3})], "k int, ts date, n int, m map<string,int>")
    assert O.asof_forward_first(base, events, "k", "at", "ts", tie="n").first()["m"] == {"a": 1}
    assert O.asof_backward_last(base, events, "k", "at", "ts", tie="n").first()["m"] == {"c": 3}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_retention_reads_the_snapshots_once_for_any_number_of_horizons(spark, tmp_path):
    rows = [(1, D(2024, m, 28), *[1 if m >= k else None for k in (2, 3, 4, 5)]) for m in range(1, 7)]
    spark.createDataFrame(rows, "k int, ts date, r7 int, r13 int, r19 int, r24 int").write.parquet(str(tmp_path / "snaps"))
    spark.createDataFrame([(1, D(2024, 1, 28)), (2, D(2024, 1, 28))], "k int, at date").write.parquet(str(tmp_path / "base"))
    base, snaps = spark.read.parquet(str(tmp_path / "base")), spark.read.parquet(str(tmp_path / "snaps"))
    metrics = {"r7": "a", "r13": "b", "r19": "c", "r24": "d"}
    two = O.retention_at(base, snaps, "k", "at", "ts", dict(list(metrics.items())[:2]))
    four = O.retention_at(base, snaps, "k", "at", "ts", metrics)
    assert scans(two) == scans(four) == 3
    found = {r["k"]: r for r in four.collect()}
    assert [found[1][f"{n}_date"] for n in "abcd"] == [D(2024, 2, 28), D(2024, 3, 28), D(2024, 4, 28), D(2024, 5, 28)]
    assert found[1]["r24"] == 1 and found[2]["r7"] is None


def test_null_keys_of_a_left_join_are_spread(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    one = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.lit(1).alias("hit"))
    assert many.select(F.xxhash64(F.lit(None).cast("long"))).first()[0] == many.select(F.xxhash64(F.lit(None).cast("string"))).first()[0] == NULL_KEY
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = salted_join(many, one, "k", "left", [NULL_KEY], ["id"])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 3000 and max(sizes) < 700
        assert out.where("hit = 1").count() == many.where("k % 2 = 0").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_missing_column_is_an_error(spark, tmp_path):
    spark.createDataFrame([(1,)], "r_regionkey long").write.parquet(str(tmp_path / "region.parquet"))
    with pytest.raises(ValueError, match="no column"):
        table_from(spark, str(tmp_path), "region")


def test_a_failed_rewrite_keeps_the_old_table(spark):
    overwrite_table(spark.range(3), "swapped")
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        overwrite_table(bad, "swapped")
    assert spark.table("swapped").count() == 3
    overwrite_table(spark.range(5), "swapped")
    assert spark.table("swapped").count() == 5


def test_kept_tables_can_be_deleted(spark, tmp_path, monkeypatch):
    from cohortline import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert session.keep(spark.range(5), "five").count() == 5 and list(tmp_path.rglob("five-*"))
    session.forget(spark)
    assert not list(tmp_path.rglob("five-*"))
