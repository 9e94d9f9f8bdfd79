"""Properties on random rows."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline.functions import bin_days

START = dt.date(2024, 1, 1)
days = st.integers(0, 40).map(lambda n: START + dt.timedelta(days=n))
keys = st.one_of(st.none(), st.sampled_from("abcd"))
rows = st.lists(st.tuples(keys, st.one_of(st.none(), days), st.integers(0, 99)), max_size=30)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "k string, d date, id int"


@FEW
@given(base=rows, events=rows, strict=st.booleans())
def test_asof_forward_equals_brute_force(spark, base, events, strict):
    want = {}
    for k, a, _ in base:
        for k2, t, i in events:
            if k is not None and k == k2 and a is not None and t is not None and (t > a if strict else t >= a):
                want[k] = min(want.get(k, (t, i)), (t, i))
    b = spark.createDataFrame(base, SCHEMA).select("k", F.col("d").alias("anchor"))
    got = O.asof_forward_first(b, spark.createDataFrame(events, SCHEMA), "k", "anchor", "d", strict, tie="id")
    assert {r.k: (r.d, r.id) for r in got.collect()} == want


@FEW
@given(base=rows, events=rows)
def test_asof_backward_equals_brute_force(spark, base, events):
    want = {}
    for k, a, _ in base:
        for k2, t, i in events:
            if k is not None and k == k2 and a is not None and t is not None and t <= a:
                want[k] = max(want.get(k, (t, i)), (t, i))
    b = spark.createDataFrame(base, SCHEMA).select("k", F.col("d").alias("anchor"))
    got = O.asof_backward_last(b, spark.createDataFrame(events, SCHEMA), "k", "anchor", "d", tie="id")
    assert {r.k: (r.d, r.id) for r in got.collect()} == want


@FEW
@given(data=rows)
def test_dedupe_equals_brute_force(spark, data):
    groups = defaultdict(list)
    for k, d, i in data:
        groups[k].append((d is None, d or START, i))
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.k: r.id for r in O.dedupe_first(df, "k", "d", "id").collect()} == {k: min(v)[2] for k, v in groups.items()}
    last = {k: max((not n, d, i) for n, d, i in v)[2] for k, v in groups.items()}
    assert {r.k: r.id for r in O.dedupe_last(df, "k", "d", "id").collect()} == last


@FEW
@given(data=rows, stage=st.dictionaries(st.sampled_from("abcd"), days))
def test_stage_keeps_rows_and_flags_are_binary(spark, data, stage):
    df = spark.createDataFrame(data, SCHEMA)
    s = spark.createDataFrame(list(stage.items()), "k string, sd date")
    out = O.with_stage(df, s, "k", "hit").collect()
    assert len(out) == len(data)
    assert all(r.hit == int(r.k in stage) for r in out)


@FEW
@given(values=st.lists(st.one_of(st.none(), st.integers(-50, 200)), min_size=1, max_size=40))
def test_bins_and_nulls_cover_all_rows(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n int").select("n", bin_days("n", [30, 60, 90], ["a", "b", "c", "d"]).alias("b"))
    assert all((r.n is None) == (r.b is None) for r in df.collect())


@FEW
@given(data=rows)
def test_rates_stay_between_zero_and_one(spark, data):
    df = spark.createDataFrame(data, SCHEMA).withColumn("hit", (F.col("id") % 2).cast("int"))
    assert all(0 <= r.hits_rate <= 1 and r.hits <= r.starts for r in O.cohort_rates(df, "k", {"hits": "hit"}).collect())
