"""Removal of repeated passages: words covered by a window that an earlier document also holds.

Words are runs without ASCII white space, unchanged.  A window is ``WINDOW`` consecutive
words of one document; it goes if its word sequence also starts in a document with a
smaller id.  Removed windows merge into maximal intervals.

1. Copies: of the documents with one text only the first is searched; a later copy loses
   every word that lies in a window, which is all of them or none.
2. Anchors: a window's anchor is the ``GRAM``-word run with the smallest hash in it.  Equal windows
   have equal anchors, so a window can be repeated only if two different texts hold its
   anchor.  One row per text and anchor is counted in Spark, about one per eighteen words.
3. Windows with a repeated anchor get a Rabin-Karp hash (64 bits and an independent 32); Spark takes the
   smallest document of every hash, and the windows join it.  No group is ever gathered:
   both counts combine before they shuffle, and the joined side has one row per hash,
   so a window that fills a third of all rows is split by adaptive execution.
4. The positions found, merged into intervals, join their texts and cut them.

Texts are shuffled only where they hold a repeated anchor (step 3), and where they lose words or
have copies (step 4): Bloom filters of their hashes, at most 128 MB each, choose them where
they are read.  A filter lets a percent of the others through, more if it is too small for the
corpus; the joins behind it are exact.

Null text has no words; a null id is treated as larger than every id; rows that share an
id never remove each other's words; repeated rows are each returned.  Texts of any
length are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import find_words, flat, keep, key_filter, may_hold, mix, pieces, signed, window_hashes, word_hashes

WINDOW = 50
GRAM = 16
LAST_ID = (1 << 63) - 1


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def windows_of(batch: pa.RecordBatch, window: int, gram: int):
    """Word hashes of a batch; first word, row and anchor of each of its windows; the row of every word."""
    data, offsets = flat(batch.column("text"))
    start, end, row = find_words(data, offsets)
    hashes = word_hashes(data, start, end)
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return hashes, none, none, np.zeros(0, np.uint64), row
    at = np.arange(len(hashes) - gram + 1)
    grams = window_hashes(hashes, at, at + gram)
    anchors = running_min(grams, window - gram + 1)
    first = np.arange(len(hashes) - window + 1)
    whole = row[first] == row[first + window - 1]
    first = first[whole]
    return hashes, first, row[first], anchors[first], row


def anchor_rows(window: int, gram: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            _, _, row, anchor, _ = windows_of(batch, window, gram)
            if not len(row):
                continue
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
            pair = np.unique(np.stack([row[new].astype(np.uint64), anchor[new]], 1), axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(pair[:, 0].astype(np.int64))), pa.array(signed(pair[:, 1].copy()))], ["key", "anchor"]
            )

    return run


def window_rows(window: int, gram: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            hashes, first, row, anchor, word_row = windows_of(batch, window, gram)
            lists = batch.column("anchors")
            flatted = np.asarray(lists.flatten(), np.int64)
            owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
            salted = lambda r, a: mix(a.view(np.uint64) + mix(r.astype(np.uint64) + np.uint64(1)))
            hit = np.isin(salted(row, signed(anchor)), salted(owner, flatted))
            first, row = first[hit], row[hit]
            if not len(first):
                continue
            other = mix(hashes + np.uint64(77))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("key").take(pa.array(row)),
                    pa.array((first - np.searchsorted(word_row, row)).astype(np.int32)),
                    pa.array(signed(window_hashes(hashes, first, first + window))),
                    pa.array((window_hashes(other, first, first + window) >> np.uint64(33)).astype(np.int32)),
                ],
                ["doc_id", "key", "at", "hash", "check"],
            )

    return run


def cut_rows(window: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            data, offsets = flat(batch.column("text"))
            start, end, row = find_words(data, offsets)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            copies = batch.column("copy").to_pylist()
            removed, hashes = [], []
            for i, spots in enumerate(batch.column("spots")):
                low, high = bounds[i], bounds[i + 1]
                n = high - low
                gone = np.zeros(n + 1, np.int64)
                if copies[i] and n >= window:
                    gone[:n] = 1
                elif spots.is_valid and len(spots):
                    at = np.asarray(spots.values)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    gone = np.cumsum(gone)
                keep_ = gone[:n] == 0
                removed.append(int(n - keep_.sum()))
                hashes.append(hashlib.sha256(joined(data, start[low:high][keep_], end[low:high][keep_])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words with one blank between them, as UTF-8."""
    if not len(start):
        return b""
    size = end - start
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size) - 1, 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + inside] = data[np.repeat(start, size) + inside]
    return out.tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the words that stay, joined by blanks."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, -10).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("order"),
        half(1).alias("key"),
        half(17).alias("key2"),
        text.alias("text"),
    )
    place = F.xxhash64("key", "order")  # of a text in a document; filters hold it
    texts = ["key", "key2", "order"]
    classes = keep(rows.groupBy("key", "key2").agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("rows")), "texts")

    anchors = keep(rows.select("key", "text").mapInArrow(anchor_rows(window, gram), "key long, anchor long"), "anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("anchor")
    lists = anchors.join(repeated, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    lists = keep(lists.join(classes, "key").select(*texts, "anchors"), "lists")

    # only texts that hold a repeated anchor are shuffled to meet their list; the filter lets few others through
    wanted = may_hold(spark, key_filter(lists.select(place.alias("h")), lists.count()))
    searched = rows.where(wanted(place)).join(lists, texts).select(F.col("order").alias("doc_id"), "key", "text", "anchors")
    windows = keep(searched.mapInArrow(window_rows(window, gram), "doc_id long, key long, at int, hash long, check int"), "windows")
    least = windows.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    found = windows.join(least, ["hash", "check"]).where("doc_id > least")
    spots = keep(found.groupBy("key", F.col("doc_id").alias("order")).agg(F.collect_set("at").alias("spots")), "spots")

    # texts with spots, and texts of which there are several copies, are shuffled to meet them; the rest is hashed where it is read
    copied = classes.where("rows > 1")
    touched = spots.select(place.alias("h")).unionAll(copied.select(F.xxhash64("key").alias("h")))
    touched = keep(touched, "touched")
    either = may_hold(spark, key_filter(touched, touched.count()))
    near = either(place) | either(F.xxhash64("key"))
    state = classes.join(spots, ["key", "order"], "left").select(*texts, "spots", F.lit(True).alias("is_first"))
    cut = rows.where(near).join(state, texts, "left").select("doc_id", "text", "spots", F.col("is_first").isNull().alias("copy"))
    alone = rows.where(~near).select("doc_id", "text", F.lit(None).cast("array<int>").alias("spots"), F.lit(False).alias("copy"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return cut.mapInArrow(cut_rows(window), out).unionAll(alone.mapInArrow(cut_rows(window), out))
