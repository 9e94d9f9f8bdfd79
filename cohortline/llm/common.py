"""Helpers shared by the operators: kept tables, text batches and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
GAP_REGEX = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); a temporary one only in a local session, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's part of the shared folder, which ``cohortline.session.forget`` deletes."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several steps read to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most ``rows`` documents at a time to Python, in this session: whole texts are long, and executors hold several batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like these that no column of the frame has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"_{name}" in taken:
            name = f"_{name}"
        taken.add(f"_{name}")
        out.append(f"_{name}")
    return out


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A frame marked for broadcast if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def top_level(counts: DataFrame, n_col: str, most: int) -> int | None:
    """The lowest power of two that at most ``most`` of the counts reach, as its exponent; None if none does."""
    histogram = counts.groupBy(F.floor(F.log2(n_col)).alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 63 rows at most
    level, held = None, 0
    for r in sorted(histogram, key=lambda r: -r["level"]):
        if held + r["rows"] > most:
            break
        held, level = held + r["rows"], int(r["level"])
    return level


# --- Bloom filters: four bits of one 64-bit word per key -------------------------------

FILTER_BITS = 12  # per key
MOST_BITS = 1 << 30  # of one filter: 128 MB
SEGMENT = 1 << 13  # words


def filter_words(n_keys: int, most_bits: int = MOST_BITS) -> int:
    """Words of a filter: a power of two, about ``FILTER_BITS`` bits a key, within the bound."""
    wanted = min(max(FILTER_BITS * n_keys, 64 * 64), most_bits)
    return 1 << ((wanted - 1).bit_length() - 6)


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter and the bits in it that belong to each hash."""
    at = (hashes >> np.uint64(24)) & np.uint64(words - 1)
    bits = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return at.astype(np.int64), bits


def held_by(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have been put into a filter: all that were, and few others."""
    at, bits = places(hashes, len(words))
    return (words[at] & bits) == bits


def packed(words: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(words.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64)


def segments(words: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The parts of a filter in which anything is set."""
    for s in range(max(1, len(words) // SEGMENT)):
        part = slice(s * SEGMENT, (s + 1) * SEGMENT)
        if words[part].any():
            yield s, part


def key_filter(keys: DataFrame, n_keys: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A filter of the longs in the one column of ``keys``; tasks send the parts that they set."""
    words = filter_words(n_keys, most_bits)
    column = keys.columns[0]

    def part_rows(batches):
        own = np.zeros(words, np.uint64)
        for batch in batches:
            at, bits = places(mix(batch.column(column).to_numpy().view(np.uint64)), words)
            np.bitwise_or.at(own, at, bits)
        for s, part in segments(own):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed(own[part])])], ["segment", "bits"])

    def merged_rows(batches):
        at, whole = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["segment"] != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(whole)])], ["segment", "bits"])
                    at, whole = r["segment"], np.zeros(SEGMENT, np.uint64)[: min(SEGMENT, words)]
                whole = whole | unpacked(r["bits"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(whole)])], ["segment", "bits"])

    parts = keys.mapInArrow(part_rows, "segment int, bits binary").repartition("segment").sortWithinPartitions("segment")
    found = np.zeros(words, np.uint64)
    for r in parts.mapInArrow(merged_rows, "segment int, bits binary").toLocalIterator():  # at most MOST_BITS bits
        found[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = unpacked(r["bits"])
    return found


def may_hold(spark: SparkSession, words: np.ndarray):
    """A column function for longs: whether a broadcast filter may hold them."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(held_by(shared.value, mix(keys.to_numpy(np.int64).view(np.uint64))))

    return test


# --- batches of text -------------------------------------------------------------------


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            upto = min(n, max(upto, at + 1))
            yield batch.slice(at, upto - at)
            at = upto


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null reads as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- words and their hashes ------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every run of bytes that are no ASCII white space."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = gap[:-1] | edge[1:n]
    first = ~gap
    first[1:] &= cut
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) of every element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of the spans [start, end) of 64-bit values: equal spans, equal hashes.

    A prefix sum of value times power gives every span in constant time.
    """
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(salt))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, computed in runs of about a megabyte."""
    out = np.zeros(len(start), np.uint64)
    table, at = byte_values(salt), 0
    while at < len(start):
        low = start[at]
        upto = max(at + 1, int(np.searchsorted(end, low + BATCH_BYTES, side="right")))
        out[at:upto] = window_hashes(table[data[low : end[upto - 1]]], start[at:upto] - low, end[at:upto] - low)
        at = upto
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
