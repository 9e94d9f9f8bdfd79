"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A document is contaminated by a benchmark item if a window of it, as long as the item,
has a weighted Jaccard similarity of at least ``SIMILARITY`` with the item: shingles of
five words (runs of letters and digits, lower case), weighted by how often they occur.
A document shorter than the item is one window.  Items of fewer than five words have one
shingle of all their words and match only documents of those words.

Everything is DataFrame expressions; no Python runs on the executors.

1. Shingles of all documents meet the shingles of the items.  Similarity s needs a
   shared weight of at least s / (1 + s) times both sizes, so a window without that many
   shared shingles can be left out without losing a match.  Among the rest, the best
   window begins at a shared shingle or is the last of its document.
2. Windows that are left get a 64-bit SimHash.  Fingerprints within ``RADIUS`` = 23 bits differ by at most
   2 in one of 8 blocks of 8 bits; the items' blocks are spread to all 37
   values within 2 bits and joined, so every fingerprint within the radius is found.  At a similarity of
   0.8 about 10 of 64 bits differ (deviation 3): more than 23 has odds near 1 in 100,000.
3. The exact similarity of each candidate decides.

The items are a given list, small beside the documents.  They are broadcast only up to
``MOST_KEYS`` counted rows; beyond that the same joins shuffle.  Null text reads as
empty and matches nothing; null ids and repeated rows are kept apart by a hash of the
text; an empty table on either side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import free_names, keep, small

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 23
BLOCKS, BITS, BLOCK_RADIUS = 8, 8, 2
MOST_KEYS = 500_000
MOST_DOCS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; of all words together where there are fewer; none without words."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
    )
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))
    return F.when(F.size(w) >= SHINGLE, each).otherwise(few)


def fingerprint(hashes: Column) -> list[Column]:
    """SimHash in blocks of 8 bits: bit b is set if most shingles, counted as often as they occur, have it."""
    half = F.size(hashes)

    def bit(b: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > half, F.lit(1 << (b % BITS))).otherwise(F.lit(0))

    blocks = []
    for k in range(BLOCKS):
        total = bit(k * BITS)
        for b in range(1, BITS):
            total = total + bit(k * BITS + b)
        blocks.append(total)
    return blocks


def overlap(a: Column, b: Column) -> Column:
    """Shared weight of two arrays of shingles: the smaller count of each."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, doc_hash, item_id, similarity): every contaminated document with each of its items, once."""
    share = similarity / (1 + similarity)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("doc_hash"), words(F.col(text_col)).alias("w"))
    source = source.select("doc_id", "doc_hash", shingles(F.col("w")).alias("s"))
    bench = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w"))
    bench = bench.select("item_id", shingles(F.col("w")).alias("t")).distinct()
    bench = keep(bench.select(F.monotonically_increasing_id().alias("item"), "item_id", "t"), "items").where(F.size("t") > 0)

    # 1. shared shingles, and the windows that hold enough of them
    parts = bench.select("item", F.size("t").alias("n"), F.explode(F.array_distinct("t")).alias("h"))
    n_parts = parts.count()
    # outer: the filter that an inner explode infers would be pushed below and split the text once per word
    spread = source.select("doc_id", "doc_hash", F.size("s").alias("m"), F.posexplode_outer("s").alias("at", "h"))
    hits = spread.join(small(parts, n_parts, MOST_KEYS), "h")
    spots = hits.groupBy("doc_id", "doc_hash", "m", "item", "n").agg(F.array_sort(F.collect_set("at")).alias("p"))
    need = F.ceil((F.col("n") + F.least("n", "m")) * F.lit(share) - 1e-9).cast("int")
    last = F.greatest(F.col("m") - F.col("n"), F.lit(0))
    spots = spots.withColumn("need", need).withColumn("last", last).where(F.size("p") >= F.col("need"))
    full = F.filter(
        F.col("p"),
        lambda x, i: (x <= F.col("last")) & (F.get(F.col("p"), i + F.col("need") - 1) < x + F.col("n")),
    )
    end = F.when(F.size(F.filter("p", lambda x: x >= F.col("last"))) >= F.col("need"), F.array("last")).otherwise(F.array().cast("array<int>"))
    starts = spots.select("doc_id", "doc_hash", "n", F.explode(F.array_union(full, end)).alias("start"))
    wanted = starts.groupBy("doc_id", "doc_hash").agg(F.collect_set(F.struct("n", "start")).alias("windows"))
    wanted = keep(wanted, "windows")

    # 2. fingerprints of those windows, searched in blocks
    texts = source.join(
        small(wanted.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "windows"), wanted.count(), MOST_DOCS),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_hash") == F.col("_hash")),
    )
    cut = texts.select("doc_id", "doc_hash", "s", F.explode("windows").alias("x"))
    cut = cut.select("doc_id", "doc_hash", F.col("x.n").alias("n"), F.slice("s", F.col("x.start") + 1, F.col("x.n")).alias("s"))
    cut = keep(cut.select("*", F.array(*fingerprint(F.col("s"))).alias("print")), "fingerprints")
    marked = bench.select("*", F.size("t").alias("n"), F.array(*fingerprint(F.col("t"))).alias("item_print"))
    masks = F.array(*[F.lit(x) for x in range(1 << BITS) if x.bit_count() <= BLOCK_RADIUS])
    keys = marked.select("*", F.posexplode("item_print").alias("block", "value"))
    keys = keys.withColumn("value", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("value")))))
    probes = cut.select("*", F.posexplode("print").alias("block", "value"))
    n_keys = bench.count() * BLOCKS * 37
    pairs = probes.join(small(keys, n_keys, MOST_KEYS), ["n", "block", "value"])
    apart = F.aggregate(
        F.zip_with("print", "item_print", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x
    )

    # 3. the exact similarity
    shared = overlap(F.col("s"), F.col("t"))
    sure = pairs.where(apart <= RADIUS).select("doc_id", "doc_hash", "item_id", F.size("s").alias("a"), F.size("t").alias("b"), shared.alias("o"))
    sure = sure.withColumn("similarity", F.col("o") / (F.col("a") + F.col("b") - F.col("o"))).where(F.col("similarity") >= similarity)
    return sure.groupBy("doc_id", "doc_hash", "item_id").agg(F.max("similarity").alias("similarity"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    key, text_hash = free_names(docs, "id", "hash")
    found = matches(docs, items, id_col, text_col).select(F.col("doc_id").alias(key), F.col("doc_hash").alias(text_hash)).distinct()
    found = keep(found, "contaminated")
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(text_hash))
    return docs.join(small(found, found.count(), MOST_DOCS), same, "left_anti")
