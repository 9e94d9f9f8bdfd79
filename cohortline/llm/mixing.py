"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every document has a size in words.  The mix is as large as all documents together; each
source gets a share by weight, at most ``epochs`` times its own size, and what that frees
goes to the other sources by weight.

The words of a source lie on one axis, in seeded order, cut into blocks of equal token counts and
laid in shards.  Sainte-Lague is used twice: it gives each source a whole number of blocks, the
seats going to the highest quotients share / (2 k + 1), and it deals what is left of that quota after
whole turns around the axis to the source's shards, by their numbers of blocks.  Every shard then
picks its quota: that many blocks in a row, from a seeded one on, around the shard; documents stand in
seeded order, so this is a random choice of them.  A block is at most a thousandth of the smallest
target, so every source gets seats and comes within two blocks of its quota; a block that runs on into
the next shard belongs to the shard in which it begins.  No document is taken more than ``epochs`` times.

Only the table of sources reaches the driver: the mixture's own configuration, one
row and one weight per source.  Texts are read once: documents are written and shuffled as (id, source,
size), never with their text.  The number of shards follows the number of documents; where each shard begins on
the axis comes from the sums of the shards before, at most 4,096 of a source, in one task per source.

Null text has size 0 and is never taken; a null source is a source of its own, last in
order; a null id and repeated rows are kept, each with what it contributes; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import free_names, keep

SEED = 20_240_601
BLOCKS = 1_000_000  # least blocks in the whole mix, unless they would be smaller than a word
LEAST_BLOCKS = 1000  # of any source, unless they would be smaller than a word
SHARD_DOCS = 50_000
SHARDS = (64, 4096)


def word_count(text):
    """Number of runs that hold no ASCII white space; null and blank text count 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def shares(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Shares of the whole by weight, none above ``epochs`` times its size; the excess is shared anew."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = total - sum(out)
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); equal quotients go to the earlier party.

    A lower bound of every party's seats is given at once; only the last few are drawn
    one by one.  ``most`` caps the seats of a party.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    got = np.zeros(len(votes), np.int64)
    if not len(votes) or votes.sum() <= 0:
        return got
    divisor = votes.sum() / max(seats - len(votes), 1) if seats > len(votes) else np.inf
    if np.isfinite(divisor):
        got = np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), most)
        while got.sum() > seats:
            last = np.where(got > 0, votes / (2 * got - 1), np.inf)
            got[len(last) - 1 - int(np.argmin(last[::-1]))] -= 1
    while got.sum() < seats:
        quotient = np.where((got < most) & (votes > 0), votes / (2 * got + 1), -1.0)
        best = int(np.argmax(quotient))
        if quotient[best] < 0:
            break
        got[best] += 1
    return got


def shard_quotas(block: int, seed: int):
    """Of one source: where each shard begins on the axis, and the stretches of it that its quota of blocks takes.

    The stretches are [a, b) and [c, d) of the shard's own blocks (two where the pick runs around the
    shard) and [e, f), the part of a block begun in an earlier shard that lies here and is picked there.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        size = frame["words"].to_numpy(np.int64)
        end = np.cumsum(size)
        start, whole = end - size, int(end[-1])
        first = -(-start // block)  # the blocks that begin in each shard
        count = -(-end // block) - first
        quota = sainte_lague(count, int(frame["extra"].iloc[0]), count)
        draw = np.random.default_rng([seed, zlib.crc32(str(frame["source"].iloc[0]).encode())])
        pick = draw.integers(0, np.maximum(count, 1))
        straight = np.minimum(pick + quota, count)
        place = lambda number: np.minimum((first + number) * block, whole)
        before = start // block  # the block that holds the shard's first word, and its owner
        owner = np.minimum(np.searchsorted(first + count, before, side="right"), len(size) - 1)
        turned = np.mod(before - first[owner] - pick[owner], np.maximum(count[owner], 1))
        lead = (start % block > 0) & (turned < quota[owner])
        return pd.DataFrame(
            {
                "of": frame["source"], "at": frame["shard"], "start": start, "quota": quota,
                "a": place(pick), "b": place(straight), "c": place(0 * pick), "d": place(pick + quota - straight),
                "e": start, "f": np.where(lead, np.minimum((before + 1) * block, whole), start),
            }
        )

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_cycle: tuple[float, ...] = (1, 2, 3),
    epochs: int = 3,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: size, its source's size and target, and the words the mix takes of it.

    The last column, ``doc_key``, tells rows with one id apart.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("doc_key"),
    )
    rows = keep(rows, "sizes")
    table = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    table.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["words"]) for r in table]
    weights = [weight_cycle[i % len(weight_cycle)] for i in range(len(table))]
    targets = shares(sizes, weights, epochs)
    least = min((t for t in targets if t > 0), default=0.0)
    block = max(1, min(sum(sizes) // blocks, int(least / LEAST_BLOCKS)))
    quotas = sainte_lague(np.array(targets), round(sum(sizes) / block), np.array([epochs * math.ceil(s / block) for s in sizes], np.int64))
    turns = [min(int(q) * block // max(s, 1), epochs) for q, s in zip(quotas, sizes, strict=True)]
    extra = [round((int(q) * block - t * s) / block) if t < epochs else 0 for q, t, s in zip(quotas, turns, sizes, strict=True)]
    shards = min(max(SHARDS[0], sum(r["n"] for r in table) // SHARD_DOCS), SHARDS[1])

    plan = spark.createDataFrame(
        [(r["source"], s, t, w, x) for r, s, t, w, x in zip(table, sizes, targets, turns, extra, strict=True)],
        "source string, source_size long, target double, turns long, extra long",
    )
    rows = rows.withColumn("shard", F.pmod("doc_key", F.lit(shards)))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])

    parts = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"))
    fields = "of string, at long, start long, quota long, a long, b long, c long, d long, e long, f long"
    parts = parts.groupBy("source").applyInPandas(shard_quotas(block, seed), fields)  # at most 4,096 rows of a source
    order = Window.partitionBy("source", "shard").orderBy("doc_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    axis = rows.withColumn("_here", F.sum("size").over(order))
    axis = axis.join(parts, axis["source"].eqNullSafe(parts["of"]) & (axis["shard"] == parts["at"]))
    axis = axis.withColumn("_end", F.col("start") + F.col("_here")).withColumn("_begin", F.col("_end") - F.col("size"))

    def overlap(low, high):
        """Words of the document in the stretch [low, high) of the axis."""
        return F.greatest(F.least("_end", high) - F.greatest("_begin", low), F.lit(0))

    taken = F.col("turns") * F.col("size") + overlap("a", "b") + overlap("c", "d") + overlap("e", "f")
    return axis.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "doc_key")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``mix_size``, ``mix_target`` and ``mix_taken``.

    Rows that agree in id and text lie next to each other on the axis; the words taken of
    them are shared out evenly, so each row of such a group carries the same count.
    A column of ``docs`` that has the name of one of the three is replaced by it.
    """
    mixed = mix(docs, id_col, text_col, source_col)
    out = ["mix_size", "mix_target", "mix_taken"]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in out])
    own, of = free_names(docs, "key", "source")
    found = mixed.groupBy(F.col("doc_key").alias(own), F.col("source").alias(of)).agg(
        F.first("size").alias("mix_size"), F.first("target").alias("mix_target"), F.floor(F.sum("taken") / F.count(F.lit(1))).alias("mix_taken")
    )
    key = F.xxhash64(F.lit(SEED), docs[id_col], docs[text_col])
    same = (key == F.col(own)) & docs[source_col].eqNullSafe(F.col(of))
    return docs.join(found.where("mix_taken > 0"), same).drop(own, of)
