"""Keys that hold a large share of all rows.

A join of many rows to one row per key is easy to split: give the rows of a heavy
key a salt and repeat the single partner row once per salt.  Which keys need it is
found in one pass with a bounded heavy-hitter sketch, so the list is small by
construction and ordinary keys pay nothing.  The list only steers where rows go;
results are the same whatever it contains.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_KEY = 42  # xxhash64 of NULL, whatever its type: rows without a partner that a left join should spread
SHARE = 0.005
FLOOR = 1_000_000


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def heavy_by_key(df: DataFrame, *keys: str | Sequence[str], share: float = SHARE, floor: int = FLOOR) -> dict[str, list[int]]:
    """Hashes of the values holding more than ``share`` of the rows and at least ``floor`` rows, per key.

    One narrow job for all keys.  At most ``1 / share`` values come back for each; NULL
    counts as a value.  The result is indexed by key, composite ones joined by commas.
    """
    limit = int(1 / share)
    hashes = df.select(*[F.xxhash64(*as_list(k)).alias(f"h{i}") for i, k in enumerate(keys)])
    tops = [F.expr(f"approx_top_k(h{i}, {limit}, {limit * 50})").alias(f"top{i}") for i in range(len(keys))]
    row = hashes.agg(F.count(F.lit(1)).alias("n"), *tops).first()
    cut = max(floor, share * row["n"])
    return {
        ",".join(as_list(k)): [item["item"] for item in row[f"top{i}"] or [] if item["count"] >= cut] for i, k in enumerate(keys)
    }


def heavy_keys(df: DataFrame, on: str | Sequence[str], share: float = SHARE, floor: int = FLOOR) -> list[int]:
    """The same for one key.  Call it once per source and hand the list to every join on that key."""
    return heavy_by_key(df, on, share=share, floor=floor)[",".join(as_list(on))]


def heavy_in_plan(df: DataFrame, on: str | Sequence[str], share: float = SHARE, floor: int = FLOOR) -> Column:
    """The same list as a scalar subquery of the plan that uses it: no job runs while the plan is built.

    ``df`` holds the rows that are joined, so the list always fits them; it is sketched when the query runs, once for all
    joins that share the subquery.  At most ``1 / share`` hashes.  ``salted_join``, ``left_fan_out``, ``attach_first``
    and the as-of joins take it in place of a list.
    """
    limit = int(1 / share)
    hashes = df.select(F.xxhash64(*as_list(on)).alias("h"))
    found = hashes.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {limit}, {limit * 50})").alias("top"))
    often = F.filter("top", lambda x: x["count"] >= F.greatest(F.lit(float(floor)), F.lit(share) * F.col("n")))
    return found.select(F.transform(often, lambda x: x["item"])).scalar()


def is_heavy(keys: Sequence[str], heavy: Sequence[int] | Column) -> Column:
    """Whether a row's key is among the heavy ones, given as a list or as ``heavy_in_plan``; never NULL."""
    value = F.xxhash64(*keys)
    return F.coalesce(F.array_contains(heavy, value), F.lit(False)) if isinstance(heavy, Column) else value.isin(*heavy)


def any_heavy(heavy: Sequence[int] | Column) -> bool:
    """Whether a join has to salt at all; a list that only the plan will know always may hold something."""
    return isinstance(heavy, Column) or bool(heavy)


def merge_heavy(*found: Mapping[str, Sequence[int]]) -> dict[str, list[int]]:
    """Heavy keys of several sources together."""
    out: dict[str, list[int]] = {}
    for one in found:
        for key, hashes in one.items():
            out[key] = sorted({*out.get(key, []), *hashes})
    return out


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    heavy: Sequence[int] | Column = (),
    spread: Sequence[str] = (),
) -> DataFrame:
    """Join ``many`` (any number of rows per key) to ``one`` (a single row per key).

    ``how`` is 'inner' or 'left'.  With ``heavy`` given, rows of those keys are spread
    over as many salts as the session has shuffle partitions, by the ``spread``
    columns and the input split, so that exact copies part as well.
    """
    keys = as_list(on)
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if not any_heavy(heavy):
        return many.join(one, keys, how)
    salts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = is_heavy(keys, heavy)
    slot = F.pmod(F.xxhash64(*(spread or keys)) + F.spark_partition_id(), F.lit(salts)).cast("int")
    left = many.withColumn("_salt", F.when(hot, slot).otherwise(0))
    right = one.withColumn(
        "_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def left_fan_out(one: DataFrame, many: DataFrame, on: str | Sequence[str], heavy: Sequence[int] | Column = (), spread: Sequence[str] = ()) -> DataFrame:
    """Left join that may return several rows per key of ``one`` (unique on ``on``).

    With ``heavy`` keys the matched rows come from a salted join and the keys without
    a match are added back, because an outer join cannot split its optional side.
    """
    keys = as_list(on)
    if not any_heavy(heavy):
        return one.join(many, keys, "left")
    matched = salted_join(many, one, keys, "inner", heavy, spread)
    alone = one.join(many.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark a lookup for broadcast after checking that it is small; otherwise leave it.

    Counts at most ``max_rows + 1`` rows.  Meant for tables with few distinct keys
    (programs, rules, calendars), where shuffling the large side would pile it up on
    those keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
