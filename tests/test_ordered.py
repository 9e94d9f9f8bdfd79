"""As-of lookups of every anchor against loops, with and without cells."""

import collections
import datetime as dt
import random

import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from cohortline import operators as O
from cohortline.operators.ordered import asof_each, time_cells


def brute(anchors, events, forward, strict):
    out = set()
    for k, a in anchors:
        ok = [e for e in events if k is not None and a is not None and e[0] == k and e[1] is not None and ((e[1] > a) if forward else (e[1] < a) or False) or (not strict and k is not None and a is not None and e[0] == k and e[1] == a)]
        if not ok:
            out.add((k, a, None, None))
            continue
        rank = lambda e: (e[1], e[2] is None if forward else e[2] is not None, e[2] or 0)
        best = (min if forward else max)(ok, key=rank)
        out.add((k, a, best[1], best[2]))
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_every_anchor_against_loops(spark, forward, strict, hot):
    rng = random.Random(7)
    day = lambda: rng.choice([None, *[f"2024-0{rng.randint(1, 4)}-{rng.randint(10, 28)}"] * 20])
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3, 4])
    anchors, events = [(key(), day()) for _ in range(150)], [(key(), day(), rng.choice([None, 1, 2, 3])) for _ in range(200)]
    a = spark.createDataFrame(anchors, "k int, a string").withColumn("a", F.col("a").cast("date"))
    e = spark.createDataFrame(events, "k int, t string, v int").withColumn("t", F.col("t").cast("date"))
    heavy = [spark.range(1).select(F.xxhash64(F.lit(x).cast("int"))).first()[0] for x in (1, 4)] if hot else []
    cuts = time_cells(e, "k", "t", heavy, 5)
    assert bool(cuts) == hot
    got = asof_each(a, e, "k", "a", "t", forward=forward, strict=strict, tie="v", heavy=heavy, cuts=cuts).collect()
    text = lambda d: None if d is None else str(d)
    got = [(r["k"], text(r["a"]), text(r["t"]), r["v"]) for r in got]
    assert len(got) == len(set(got)) and set(got) == brute(anchors, events, forward, strict)


def test_agrees_with_the_reduced_as_of(spark):
    """Where every key has one anchor both ways of looking give the same rows."""
    e = spark.read.parquet(f"{TESTDATA}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    anchors = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("a"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    one = O.asof_forward_first(anchors, buys, "user_id", "a", "ts", tie="event_id").select("user_id", "ts", "event_id")
    each = asof_each(anchors, buys, "user_id", "a", "ts", forward=True, tie="event_id").where("ts IS NOT NULL").select("user_id", "ts", "event_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, each.collect()))


def test_a_hot_key_is_spread_over_its_cells(spark):
    e = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    heavy = O.heavy_keys(e, "k", floor=1000)
    cuts = time_cells(e, "k", "t", heavy, 16)
    from cohortline.operators.ordered import _cell

    sizes = [r["count"] for r in e.where("k = 7").groupBy(_cell(["k"], F.col("t"), "timestamp", heavy, cuts).alias("c")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


@pytest.mark.parametrize("hot", [False, True])
def test_status_intervals_against_loops(spark, hot):
    """Intervals, and what a profile reads from them, with a key of a third of the rows cut into cells or not."""
    rng = random.Random(11)
    base_day = dt.date(2024, 1, 1)
    day = lambda n: base_day + dt.timedelta(days=n)
    data = [(rng.choice([1, 2, 3, 7, 7, None]), day(rng.randrange(90)) if rng.random() > 0.05 else None, i, rng.choice(["F1", "O", "P", None])) for i in range(400)]
    history = spark.createDataFrame(data, "k int, d date, n int, s string").repartition(4)
    heavy = O.heavy_keys(history, "k", share=0.2, floor=50) if hot else []
    cuts = O.time_cells(history, "k", "d", heavy, 8)
    assert bool(heavy) == bool(cuts) == hot
    found = O.status_intervals(history, "k", "d", "s", "n", heavy, cuts)

    expected, runs = [], {}
    for key in (1, 2, 3, 7):
        own = sorted((d, n, s) for k, d, n, s in data if k == key and d is not None)
        runs[key] = [(d, own[i + 1][0] if i + 1 < len(own) else None, s) for i, (d, _, s) in enumerate(own)]
        expected += [(key, *r) for r in runs[key]]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(expected)

    anchors = [(1, day(40)), (1, day(60)), (2, day(-1)), (3, None), (7, day(45)), (9, day(5)), (None, day(5))]
    base = spark.createDataFrame(anchors, "k int, a date")
    got = {r["k"]: r for r in O.status_profile(base, found, "k", "a", {"done": ["F"], "open": ["O", "P"]}, (10,), heavy).collect()}
    assert set(got) == {1, 2, 3, 7, 9, None}

    def at(key, when):
        return next(((d, s) for d, e, s in runs.get(key, []) if d <= when and (e is None or e > when)), (None, None))

    for key, when in ((1, day(40)), (2, day(-1)), (3, None), (7, day(45)), (9, day(5)), (None, day(5))):
        for name, letters in (("done", "F"), ("open", "OP")):
            since, held = at(key, when) if when else (None, None)
            hit = held is not None and held[0] in letters
            ever = when is not None and any(d <= when and s and s[0] in letters for d, _, s in runs.get(key, []))
            r = got[key]
            assert (r[f"{name}_flag"], r[f"{name}_date"], r[f"{name}_ever"], r[f"{name}_never"]) == (int(hit), since if hit else None, int(ever), int(not ever)), (key, name)
        assert got[key]["status_10d"] == (at(key, when + dt.timedelta(days=10))[1] if when else None)


def test_a_profile_scans_its_history_once(spark):
    from cohortline.entries.orders import profile

    plan = profile(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len([line for line in scans if "o_orderstatus" in line]) == 1
    assert len(scans) == 3  # and the narrow keys of the people: to meet the history, and for those without any
