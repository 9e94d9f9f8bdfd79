"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other.

A text with a space before it is encoded by a byte-level BPE (A) and a piece BPE (B).  The
byte offsets at which a token of A and a token of B both end cut the tokens into groups;
every A-B pair of occurrences in one group is a link.  An id pair counts the documents
that hold it linked, corpus wide.

- Galloping intersection: for every end of the shorter list a search starts at the place in
  the longer one that its rank suggests, widens in doubling steps until the end is
  bracketed, and halves the bracket.  All ends of a text gallop at once.
- The common ends' ranks in both lists bound the groups; differences of ranks are the numbers
  of tokens in a group, and their products the numbers of links.
- A text's links are kept as distinct id pairs with their number, written once, in
  rows of at most ``CHUNK`` pairs.  Spark counts documents per pair (combined before the
  shuffle).  Pairs in many documents, at most ``frequent`` rows, are broadcast; the rest join.

Null or empty texts, and those whose tokens do not give back the text (as the piece model
replaces some characters), have no tokens: zeros and an empty string.  Strings of special
tokens in a text are text.  Rows are documents: repeated rows count one by one, and a null
id is an id like any other.  An empty table gives an empty result.  Texts of any length are
encoded whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import keep, pieces, top_level

FOLDER = "/opt/tokenizers"
BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how the byte-level tokenizer cuts a text before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 16
FREQUENT = 1 << 20  # rows of a broadcast: 17 bytes each
BLOCK = 1 << 20  # links expanded at a time
SHIFT = 1 << 32  # a pair is a * SHIFT + b
_loaded: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The byte of every letter of a byte-level vocabulary: printable Latin-1 stands for itself, the others for U+0100 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer: how it encodes, and the bytes of its tokens as one array with offsets."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode = encode
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.names = [str(i) for i in range(len(tokens))]

    def gives(self, ids: np.ndarray, text: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the tokens' bytes, joined, are these."""
        if len(text) != (ends[-1] if len(ends) else 0):
            return False
        sizes = self.sizes[ids]
        return bool(np.array_equal(self.data[np.arange(len(text)) + np.repeat(self.starts[ids] - (ends - sizes), sizes)], text))


def byte_side(path: str) -> Side:
    """The byte-level tokenizer of a file: its vocabulary and merges, run as ranks.

    Where merges stand in the order of the ids they make, which is checked, the merge of
    lowest rank is the one that makes the lowest id, and a table of ids is all there is to know.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocabulary = byte_letters(), model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    tokens = [t.encode() for t in sorted(vocabulary, key=vocabulary.get)]
    ranks = {}
    for i in {*made, *(vocabulary[c] for c in letters)}:
        tokens[i] = bytes(letters[c] for c in tokens[i].decode())
        ranks[tokens[i]] = i
    model = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [model.encode_ordinary(" " + t) for t in texts], tokens)


def piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Side(lambda texts: model.encode(texts, num_threads=1), [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())])


def load(folder: str) -> tuple[Side, Side]:
    """Both tokenizers, once for each Python worker."""
    if folder not in _loaded:
        _loaded[folder] = byte_side(os.path.join(folder, BYTE_MODEL)), piece_side(os.path.join(folder, PIECE_MODEL))
    return _loaded[folder]


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into two increasing lists at which they hold the same value."""
    n, m = len(short), len(long)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(n, dtype=np.int64) * m // n
    low, high = start - 1, start.copy()  # wanted: long[low] < value <= long[high]; -1 and m stand for the ends
    up = long[start] < short
    low[up], high[up] = start[up], start[up] + 1
    step, going = 1, np.arange(n)
    while len(going):  # widen
        right = up[going]
        probe = np.where(right, high[going], low[going])
        value = long[np.clip(probe, 0, m - 1)]
        more = np.where(right, (probe < m) & (value < short[going]), (probe >= 0) & (value >= short[going]))
        going, right, probe = going[more], right[more], probe[more]
        step *= 2
        low[going] = np.where(right, probe, np.maximum(probe - step, -1))
        high[going] = np.where(right, np.minimum(probe + step, m), probe)
    going = np.flatnonzero(high - low > 1)
    while len(going):  # halve
        middle = (low[going] + high[going]) // 2
        less = long[middle] < short[going]
        low[going[less]], high[going[~less]] = middle[less], middle[~less]
        going = going[high[going] - low[going] > 1]
    same = high < m
    same[same] = long[high[same]] == short[same]
    return np.flatnonzero(same), high[same]


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups as numbers of tokens of A and of B."""
    if len(ends_a) <= len(ends_b):
        a, b = gallop(ends_a, ends_b)
    else:
        b, a = gallop(ends_b, ends_a)
    return a + 1, b + 1


def group_string(ids_a, ids_b, upto_a, upto_b, names_a, names_b) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    words = np.empty(2 * (len(ids_a) + len(ids_b)), object)
    at_a = np.arange(len(ids_a)) + np.repeat(upto_b - size_b, size_a)  # every token is followed by its separator
    at_b = np.arange(len(ids_b)) + np.repeat(upto_a, size_b)
    words[2 * at_a], words[2 * at_b] = [names_a[i] for i in ids_a.tolist()], [names_b[i] for i in ids_b.tolist()]
    words[1::2] = ","
    words[2 * at_a[upto_a - 1] + 1], words[2 * at_b[upto_b - 1] + 1] = "|", ";"
    return "".join(words[:-1].tolist())


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def links(ids_a, ids_b, upto_a, upto_b) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs and their number of links, expanded a bounded number at a time."""
    from_a, from_b = np.append(0, upto_a[:-1]), np.append(0, upto_b[:-1])
    size_b = upto_b - from_b
    of_group = np.repeat(np.arange(len(upto_a)), upto_a - from_a)
    width = size_b[of_group]  # every token of A meets this many of B
    reach = np.cumsum(width)
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts_k, parts_n, held, at = [], [], 0, 0

    def fold():
        return summed(np.concatenate([keys, *parts_k]), np.concatenate([n, *parts_n]))

    while at < len(ids_a):
        before = reach[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(reach, before + BLOCK, side="right")))
        w = width[at:upto]
        place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(from_b[of_group[at:upto]], w)
        k, c = np.unique(np.repeat(ids_a[at:upto].astype(np.int64) * SHIFT, w) + ids_b[place], return_counts=True)
        parts_k.append(k), parts_n.append(c)
        held, at = held + len(k), upto
        if held > max(4 * BLOCK, len(keys)):
            keys, n = fold()
            parts_k, parts_n, held = [], [], 0
    return fold()


ENCODED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
NAMES = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def align(text: str, ids_a: list[int], ids_b: list[int], a: Side, b: Side):
    """(ids of A, ids of B, group ends in both) of one text; no tokens if either side does not give its bytes back."""
    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    whole = np.frombuffer((" " + text).encode(), np.uint8)
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    if not text or not (a.gives(ids_a, whole, ends_a) and b.gives(ids_b, whole, ends_b)):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return ids_a, ids_b, *groups(ends_a, ends_b)


def encoded_rows(folder: str):
    def run(batches):
        a, b = load(folder)
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            out = []
            for row, id_, text, x, y in zip(rows, ids, texts, a.encode(texts), b.encode(texts)):
                ids_a, ids_b, upto_a, upto_b = align(text, x, y, a, b)
                pairs, times = links(ids_a, ids_b, upto_a, upto_b)
                sha = hashlib.sha256(group_string(ids_a, ids_b, upto_a, upto_b, a.names, b.names).encode()).hexdigest() if len(upto_a) else ""
                stats = [id_, len(ids_a), len(ids_b), len(upto_a), int(times.sum()), sha]
                for at in range(0, max(len(pairs), 1), CHUNK):
                    out.append([row, *(stats if not at else [None] * 6), pairs[at : at + CHUNK], times[at : at + CHUNK]])
            yield record(out)

    return run


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def record(out: list[list]) -> pa.RecordBatch:
    columns = list(zip(*out))
    kinds = [pa.int64()] * 6 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [lists(columns[7]), lists(columns[8])], NAMES)


def summed_rows(shared):
    """Per row: sums over its pairs that are in the broadcast table, and the other pairs."""

    def run(batches):
        known, n_docs, best = shared.value
        for batch in batches:
            width = max(1, BLOCK // CHUNK)
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                pairs, times = part.column("pairs"), part.column("times")
                sizes = np.diff(pairs.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                keys, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
                spot = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[spot] == keys if len(known) else np.zeros(len(keys), bool)
                spot = spot[hit]
                total = np.zeros((2, part.num_rows), np.int64)
                np.add.at(total[0], row[hit], n[hit] * best[spot])
                np.add.at(total[1], row[hit], n[hit] * n_docs[spot])
                offsets = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=part.num_rows))).astype(np.int32)
                rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(keys[~hit]), pa.array(n[~hit])], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total[0]), pa.array(total[1]), rare], ["row", "n_best", "count_sum", "rare"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """One row per document with its counts, the digest of its groups and its linked pairs; more rows (null counts) for further pairs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return keep(rows.mapInArrow(encoded_rows(folder), ENCODED), "encoded")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``pair``, ``docs`` (documents that hold it linked) and ``best`` (no pair of its A id is in more)."""
    counts = keep(encoded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("docs").alias("most"))  # one row per id of the vocabulary at most
    return keep(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-counts")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row."""
    encoded = encode(docs, id_col, text_col, folder)
    counts = pair_counts(encoded)
    level = top_level(counts, "docs", frequent)
    table = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if level is not None:
        often = counts.where(F.col("docs") >= 2**level).toArrow()
        order = np.argsort(often["pair"].to_numpy())
        table = (often["pair"].to_numpy()[order], often["docs"].to_numpy()[order], often["best"].to_numpy(zero_copy_only=False).astype(np.int64)[order])
        counts = counts.where(F.col("docs") < 2**level)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    known = keep(encoded.select("row", "pairs", "times").mapInArrow(summed_rows(shared), "row long, n_best long, count_sum long, rare array<struct<pair: long, times: long>>"), "sums")
    rare = known.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    sums = known.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    stats = encoded.where("n_a IS NOT NULL").select("row", F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return stats.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
