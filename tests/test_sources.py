"""Readers and writers on files."""

import pytest
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline import sources as S
from cohortline.session import keep


def test_rules_csv(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("program_code,SC1,SC2,SC3,SC4,recommendation sequence,Product\n BSIT ,1,0,0,1,2,Math\n")
    df = S.read_rules_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("BSIT", 1, 0, 0, 1, 2, "Math")]
    path.write_text("program_code,SC1,SC2,SC3,SC4,seq,Product\nBSIT,x,0,0,1,2,Math\n")
    with pytest.raises(Exception):
        S.read_rules_csv(spark, str(path)).collect()


def test_read_path_and_table(spark, tmp_path):
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert S.read_path(spark, "orc", str(tmp_path / "o")).count() == 3
    S.overwrite_table(spark.range(4), "t_read")
    assert S.read_table(spark, "t_read").count() == 4


def test_overwrite_replace_and_merge(spark):
    S.overwrite_table(spark.createDataFrame([(1, "x")], "a int, b string"), "t_sink")
    S.overwrite_table(spark.createDataFrame([(2, 5.0)], "a int, c double"), "t_sink", "merge")
    df = spark.read.table("t_sink")
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.collect()] == [(2, None, 5.0)]
    with pytest.raises(TypeError):
        S.overwrite_table(spark.createDataFrame([("2",)], "a string"), "t_sink", "merge")
    S.overwrite_table(spark.createDataFrame([("z",)], "q string"), "t_sink", "replace")
    assert spark.read.table("t_sink").columns == ["q"]
    with pytest.raises(ValueError):
        S.overwrite_table(spark.range(1), "t_sink", "other")


def test_partitioned_table_is_partitioned(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("month"))
    S.overwrite_partitioned(df, "t_part", str(tmp_path / "p"), "month")
    S.overwrite_partitioned(df.where("month < 2"), "t_part", str(tmp_path / "p"), "month")
    back = spark.read.table("t_part")
    assert back.count() == 50 and sorted(p.name for p in (tmp_path / "p").glob("month=*")) == ["month=0", "month=1"]
    assert "PartitionFilters: [isnotnull(month" in back.where("month = 1")._jdf.queryExecution().executedPlan().toString()


def test_keep_round_trip(spark):
    df = spark.range(5).withColumn("d", F.lit("2024-01-01").cast("date"))
    kept = keep(df, "five")
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 5


def test_keep_stays_lazy_without_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr("cohortline.session.shared_folder", lambda s: None)
    df = spark.range(5)
    assert keep(df, "five") is df


def test_declared_schemas_parse():
    for name in S.INPUTS:
        assert len(S.schema_of(name)) > 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_table_from_reads_declared_columns(spark, sf):
    for name in S.TABLES:
        declared = S.table_from(spark, f"/root/testdata/sf{sf}", name)
        found = spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
        assert declared.schema.simpleString() == found.schema.simpleString()


def test_stored_stages_are_attached_without_a_shuffle(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = [f"t_bucketed_{i}" for i in range(9)]
    spark.conf.set(key, "-1")
    try:
        for i, name in enumerate(names):
            for step in (7, i + 1):  # written twice: the second replaces the first, buckets stay
                S.overwrite_bucketed(spark.range(0, 500, step).select(F.col("id").alias("k"), (F.col("id") * i).alias(f"v{i}")), name, "k", 4)
        base, *stages = [S.read_table(spark, name) for name in names]
        out = O.with_stages(base, {f"s{i + 1}": stage for i, stage in enumerate(stages)}, "k")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 8
        got = {r["k"]: r for r in out.collect()}
        assert set(got) == set(range(500)) and "Exchange" not in out.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        for k, r in got.items():
            for i in range(1, 9):
                there = k % (i + 1) == 0
                assert (r[f"s{i}"], r[f"v{i}"]) == ((1, k * i) if there else (0, None))
        empty = base.where("false")
        assert O.with_stages(empty, {"s": stages[0]}, "k").count() == 0 and O.with_stages(base, {}, "k").count() == 500
    finally:
        spark.conf.set(key, before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
