"""Line dedup: a line that an earlier document holds goes, whole corpus over.

A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Keys
of at least ``LEAST`` code points that two documents hold lose their lines everywhere but
in the document with the smallest id, which keeps all of its own.  Shorter keys stay.

1. Every task puts the keys of its texts, once for each text, into two Bloom filters:
   once seen, and twice seen (already in the first).  Four bits of one 64-bit word per key.
   Filters are merged word by word, in segments: what is set in two tasks' first filters is
   set in the second one.  A key that two texts hold is therefore always in it.
2. The twice-seen filter is broadcast: at most ``MOST_BITS`` bits (128 MB), less where there
   are fewer lines.  Beyond about ``MOST_BITS / FILTER_BITS`` lines it fills up, more keys are suspected
   and more rows shuffle; results stay the same.
3. Texts are read once more.  Lines whose keys are not suspected stay, a text without
   suspects is done.  The others give (SHA-256 of the key, id) rows, combined before they
   shuffle; a digest that two ids hold is confirmed and keeps its smallest id.
4. Confirmed digests join the suspects, and the line numbers found join the texts that lose lines.

Null or empty text is one empty line.  A null id is larger than every id; rows that share
an id are one document, whose rows never drop each other's lines; repeated rows are each
returned.  An empty table gives an empty result.  Texts of any length are handled whole.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import MOST_BITS, SEGMENT, filter_words, flat, held_by, keep, packed, pieces, places, segments, top_level, unpacked

LEAST = 10
MOST_OFTEN = 1 << 16  # rows of a broadcast: 48 bytes each
LAST = (1 << 63) - 1
GAP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """The keys of all lines of a text in UTF-8."""
    return [line.strip(GAP) for line in text.lower().split(b"\n")]  # of bytes, only A-Z have a lower case


def counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def text_keys(data: np.ndarray, offsets: np.ndarray, least: int):
    """For every text: its bytes, its number of lines, and (line number, key) of the lines that count."""
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = whole[a:b]
        keys = line_keys(text)
        yield text, len(keys), [(i, k) for i, k in enumerate(keys) if counts(k, least)]


def add(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """Put hashes, one for each text and key, into the filters."""
    distinct, n = np.unique(hashes, return_counts=True)
    at, bits = places(distinct, len(once))
    again = (n > 1) | ((once[at] & bits) == bits)
    np.bitwise_or.at(twice, at[again], bits[again])
    np.bitwise_or.at(once, at, bits)


FILTERS = "segment int, once binary, twice binary"


def filter_rows(words: int, least: int, text_col: str):
    def run(batches):
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in pieces(batches, text_col):
            hashes = []
            for _, _, keys in text_keys(*flat(batch.column(text_col)), least):
                hashes += {xxhash.xxh3_64_intdigest(k) for _, k in keys}
            if hashes:
                add(once, twice, np.array(hashes, np.uint64))
        for s, part in segments(once):
            row = [pa.array([s], pa.int32()), pa.array([packed(once[part])]), pa.array([packed(twice[part])])]
            yield pa.RecordBatch.from_arrays(row, ["segment", "once", "twice"])

    return run


def merged_rows(batches):
    """Segments in order: one twice-seen segment for all rows of each."""
    at, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(twice)])], ["segment", "twice"])

    for batch in batches:
        for r in batch.to_pylist():
            a, b = unpacked(r["once"]), unpacked(r["twice"])
            if r["segment"] != at:
                if at is not None and twice.any():
                    yield out()
                at, once, twice = r["segment"], a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None and twice.any():
        yield out()


def suspects(texts: DataFrame, text_col: str = "text", least: int = LEAST, most_bits: int = MOST_BITS) -> np.ndarray:
    """The twice-seen filter of all lines: no key that two rows hold is missing in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = texts.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    words = filter_words(int(n_lines), most_bits)
    parts = texts.select(text_col).mapInArrow(filter_rows(words, least, text_col), FILTERS)
    parts = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged_rows, "segment int, twice binary")
    found = np.zeros(words, np.uint64)
    for r in parts.toLocalIterator():  # at most MOST_BITS bits
        found[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = unpacked(r["twice"])
    return found


def probe_rows(shared, least: int):
    def run(batches):
        twice = shared.value
        for batch in pieces(batches, "text"):
            n, digests, open_texts, suspected = [], [], [], []
            for text, n_lines, keys in text_keys(*flat(batch.column("text")), least):
                hit = held_by(twice, np.array([xxhash.xxh3_64_intdigest(k) for _, k in keys], np.uint64))
                lines = {}
                for (line, key), suspect in zip(keys, hit.tolist()):
                    if suspect:
                        lines.setdefault(hashlib.sha256(key).digest(), []).append(line)
                n.append(n_lines)
                digests.append(hashlib.sha256(text).hexdigest())
                open_texts.append(text.decode() if lines else None)
                suspected.append([{"digest": d, "lines": x} for d, x in lines.items()])
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("lines", pa.list_(pa.int32()))]))
            new = [pa.array(n, pa.int64()), pa.array(digests), pa.array(open_texts, pa.string()), pa.array(suspected, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *new], ["row", "id", "n_lines", "whole", "text", "suspects"])

    return run


PROBED = "row long, id long, n_lines long, whole string, text string, suspects array<struct<digest: binary, lines: array<int>>>"


def cut_rows(batches):
    for batch in pieces(batches, "text"):
        kept = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            gone = set(gone)
            kept.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone))
        new = [pa.array([len(g) for g in batch.column("gone").to_pylist()], pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_lines"), *new], ["id", "n_lines", "n_dropped", "kept"])


def dropped_lines(probed: DataFrame, most_often: int = MOST_OFTEN) -> DataFrame:
    """(row, gone): the numbers of the lines that an earlier document holds, per row that loses any."""
    held = probed.where(F.size("suspects") > 0).select("row", "id", F.explode("suspects").alias("s")).select("row", "id", "s.digest", "s.lines")
    repeated = held.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.bool_or(F.col("id").isNull()).alias("unknown"), F.count(F.lit(1)).alias("rows"))
    repeated = keep(repeated.where("first != last OR (first IS NOT NULL AND unknown)").select("digest", "first", "rows"), "repeated-lines")
    # the lines that most texts hold, a bounded number, are broadcast; the others are in few texts each and join by sorting
    level = top_level(repeated, "rows", most_often)
    often = repeated.where(F.col("rows") >= (2**level if level is not None else LAST))
    seldom = repeated.where(F.col("rows") < (2**level if level is not None else LAST))
    late = held.join(F.broadcast(often), "digest").unionByName(held.join(seldom.hint("merge"), "digest")).where("id IS NULL OR id != first")
    return late.groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("gone"))  # at most the lines of one text


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most_bits: int = MOST_BITS, most_often: int = MOST_OFTEN) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` (the text that stays; null where nothing goes) and ``kept_sha256`` of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(suspects(docs, text_col, least, most_bits))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    probed = keep(rows.mapInArrow(probe_rows(shared, least), PROBED), "lines")
    gone = keep(dropped_lines(probed, most_often), "dropped-lines")
    texts = probed.where("text IS NOT NULL").select("row", "id", "n_lines", "text")
    cut = texts.join(gone.hint("merge"), "row").select("id", "n_lines", "text", "gone").mapInArrow(cut_rows, "id long, n_lines long, n_dropped long, kept string")
    cut = cut.select("id", "n_lines", "n_dropped", "kept", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    whole = probed.select("row", "id", "n_lines", "whole").join(gone.select("row").hint("merge"), "row", "left_anti")
    whole = whole.select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("kept"), F.col("whole").alias("kept_sha256"))
    return cut.unionAll(whole).withColumnRenamed("id", "doc_id")
