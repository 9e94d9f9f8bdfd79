"""Column functions on boundary values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline import functions as C

D = dt.date


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_bins_boundaries(spark):
    days = [-1, 0, 7, 8, 14, 15, 30, 31, 60, 61, 90, 91, None]
    six = C.bin_days("d", [7, 14, 30, 60, 90], ["a", "b", "c", "d", "e", "f"])
    got = [r[0] for r in one(spark, [(d,) for d in days], "d int", six)]
    assert got == ["a", "a", "a", "b", "b", "c", "c", "d", "d", "e", "e", "f", None]
    neg = C.bin_days("d", [7], ["in", "late"], negative="before")
    assert [r[0] for r in one(spark, [(-1,), (0,), (8,), (None,)], "d int", neg)] == ["before", "in", "late", None]
    with pytest.raises(ValueError):
        C.bin_days("d", [7], ["only"])


def test_weeks_and_months(spark):
    rows = [(D(2024, 10, 14),), (D(2024, 10, 20),), (D(2024, 2, 3),), (None,)]
    got = one(spark, rows, "d date", C.week_ending("d"), C.week_start("d"), C.month_end("d"))
    assert got[0] == (D(2024, 10, 20), D(2024, 10, 14), D(2024, 10, 31))
    assert got[1] == (D(2024, 10, 20), D(2024, 10, 14), D(2024, 10, 31))
    assert got[2][2] == D(2024, 2, 29)
    assert got[3] == (None, None, None)


def test_period_keys_and_duration(spark):
    df = C.period_keys(spark.createDataFrame([(dt.datetime(2024, 10, 14, 23),)], "ts timestamp"), "ts", "seen")
    assert df.columns == ["ts", "seen_date", "seen_week", "seen_month"]
    got = one(spark, [(D(2024, 1, 10), D(2024, 1, 1)), (D(2024, 1, 1), D(2024, 1, 10)), (None, D(2024, 1, 1))], "e date, s date", C.days_between("e", "s"))
    assert [r[0] for r in got] == [9, -9, None]


def test_local_date_crosses_midnight(spark):
    rows = [(dt.datetime(2024, 7, 10, 5, 59),), (dt.datetime(2024, 7, 10, 6, 0),)]
    assert [r[0] for r in one(spark, rows, "ts timestamp", C.local_date("ts", "America/Denver"))] == [D(2024, 7, 9), D(2024, 7, 10)]


def test_in_year_is_a_range(spark):
    df = spark.createDataFrame([(D(2023, 12, 31),), (D(2024, 1, 1),), (D(2024, 12, 31),), (D(2025, 1, 1),), (None,)], "d date")
    assert df.where(C.in_year("d", 2024)).count() == 2


def test_closed_before(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),), (None,)], "d date")
    assert df.where(C.closed_before("d", D(2024, 1, 2))).count() == 1


def test_blank_to_null(spark):
    got = one(spark, [("",), ("null",), ("x",), (" ",), (None,)], "s string", C.blank_to_null("s"), C.blank_to_null("s", "null"))
    assert got == [(None, None), ("null", None), ("x", "x"), (" ", " "), (None, None)]


def test_normalize_text(spark):
    assert one(spark, [("  Ab C ",), (None,)], "s string", C.normalize_text("s")) == [("ab c",), (None,)]


def test_fill_missing_turns_into_text(spark):
    df = C.fill_missing(spark.createDataFrame([(1, None), (None, "x")], "n int, s string"), ["n", "s"], "?")
    assert df.schema["n"].dataType.simpleString() == "string"
    assert [tuple(r) for r in df.collect()] == [("1", "?"), ("?", "x")]


def test_list_items_need_adjacent_entries(spark):
    rows = [
        ("<ul></ul>",),
        ("<li> One </li>",),
        ("<li>A</li><li>B</li>",),
        ("<li>A</li><li>B</li><li>C</li><li>D</li>",),
        ("<li>A</li>\n<li>B</li>",),
        (None,),
    ]
    got = one(spark, rows, "h string", *C.list_items("h", 3))
    assert got == [(None,) * 3, ("One", None, None), ("A", "B", None), ("A", "B", "C"), ("A", None, None), (None,) * 3]


def test_crosswalk(spark):
    rows = [("a",), ("z",), (None,)]
    codes = {"a": "1", "b": "2"}
    got = one(spark, rows, "s string", C.crosswalk("s", codes), C.crosswalk("s", codes, default="9"), C.crosswalk("s", codes, keep_unmapped=True))
    assert got == [("1", "1", "1"), (None, "9", "z"), (None, "9", None)]


def test_likert_and_flags(spark):
    rows = [("strongly_disagree",), ("somewhat_disagree",), ("somewhat_agree",), ("strongly_agree",), ("odd",), (None,)]
    df = spark.createDataFrame(rows, "a string").withColumn("c", C.likert_code("a")).withColumn("f", C.disagree_flag("c"))
    assert [(r.c, r.f) for r in df.collect()] == [(1, 1), (2, 1), (3, 0), (4, 0), (None, 0), (None, 0)]
    assert [r[0] for r in one(spark, [("no",), ("yes",), ("maybe",), (None,)], "a string", C.answer_is_yes("a"))] == [0, 1, 1, None]


def test_lists_and_rules(spark):
    rows = [("Single",), ("Odd",), (None,)]
    got = one(spark, rows, "s string", C.keep_listed("s", ["Single"]), C.missing_if("s", ["Odd"]))
    assert got == [("Single", "Single"), ("Missing", "Missing"), ("Missing", "Missing")]
    rule = C.rule_group([(F.col("s") == "Single", "one"), (F.col("s").isNotNull(), "some")])
    assert [r[0] for r in one(spark, rows, "s string", rule)] == ["one", "some", "Other"]
    df = spark.createDataFrame(rows, "s string").withColumns(C.one_hot("s", ["Single", "Odd"]))
    assert [tuple(r)[1:] for r in df.collect()] == [(1, 0), (0, 1), (0, 0)]


def test_any_of_ignores_unknown(spark):
    got = one(spark, [(1, None), (0, None), (None, None)], "a int, b int", C.any_of(F.col("a") == 1, F.col("b") == 1))
    assert [r[0] for r in got] == [True, False, False]
