"""Compare a Spark result with DuckDB's: names, types, rows (any order), values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
from pyspark.sql import types as T

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP",
    T.BooleanType: "BOOLEAN",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def differences(df, con, sql: str) -> list[str]:
    """Empty when both agree."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} vs {sorted(rel.columns)}"]
    out = []
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        want = KINDS.get(type(f.dataType))
        if types[f.name] not in (want, "TIMESTAMP_NS", '"NULL"'):
            out.append(f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    order = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(_cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    ours = sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
