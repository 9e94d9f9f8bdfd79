"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A token file is nothing but token ids of ``WIDTH`` bytes, little endian, with an end-of-document id
after each document.  The scan cuts every file into blocks, which tasks read on their own; in
a block one vectorised comparison finds the separators.  A document may begin in one block
and end in another: a prefix scan over the blocks of a file gives the number of separators before each
block, so every segment knows its document, and the segments at the edges of blocks are added up.

``write`` makes such files from documents: Spark's text writer with the separator's bytes as its
line separator, so the files are committed like any Spark output, on any store.  A document may carry a header of
``HEADER`` ids that hold its number (base 2**15, so none is the separator); counts leave it out.

Null and empty text are documents of no tokens; null ids keep a mark of their own in the header; repeated
rows are documents of their own; an empty table writes no documents.  A last document without
separator counts if it has a token.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline.llm.common import keep, pieces

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256  # the first id that the vocabulary leaves free
WIDTH = 2
HEADER = 5
BLOCK_BYTES = 4 << 20

_encodings: dict[str, object] = {}


def encoding(folder: str, vocabulary: str):
    """The tiktoken encoding of a vocabulary file; special tokens are ordinary text."""
    key = f"{folder}/{vocabulary}"
    if key not in _encodings:
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
        public = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public)
        with open(key, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def header(doc_id: int | None) -> list[int]:
    value = (doc_id or 0) & ((1 << 64) - 1)
    digits = [(value >> (15 * k)) & 0x7FFF for k in range(HEADER)]
    return digits[:-1] + [digits[-1] | (0x10 if doc_id is None else 0)]


def token_rows(folder: str, vocabulary: str, width: int, with_header: bool):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in pieces(batches, "text"):
            out = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "")
                out.append(np.array(header(i) + ids if with_header else ids, kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["tokens"])

    return run


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    separator: int = SEPARATOR,
    width: int = WIDTH,
    with_header: bool = True,
) -> None:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = rows.mapInArrow(token_rows(folder, vocabulary, width, with_header), "tokens binary")
    mark = separator.to_bytes(width, "little").decode("latin-1")
    tokens.select(F.col("tokens").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", mark).text(path)


def read_block(path: str, at: int, size: int) -> bytes:
    """Bytes of a file, from a local or shared folder or from any store pyarrow knows."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path), "rb") as source:
            source.seek(at)
            return source.read(size)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        return source.read_at(size, at)


def segment_rows(separator: int, width: int, n_header: int):
    def run(batches):
        for df in batches:
            for path, block, at, size in zip(df["path"], df["block"], df["at"], df["size"], strict=True):
                ids = np.frombuffer(read_block(path, int(at), int(size)), f"<u{width}")
                ends = np.append(np.flatnonzero(ids == separator), len(ids))
                begins = np.append(0, ends[:-1] + 1)
                heads = [ids[b : min(b + n_header, e)].tolist() for b, e in zip(begins, ends, strict=True)]
                yield pd.DataFrame({"path": path, "block": block, "segment": np.arange(len(ends)), "n": ends - begins, "head": heads, "last": np.arange(len(ends)) == len(ends) - 1})

    return run


def count(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, n_header: int = HEADER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, doc, n_tokens, head): every document of the files by its place, its tokens without header, and the header."""
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.posexplode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block_bytes))).alias("block", "at"))
    blocks = blocks.select("path", "block", "at", F.least(F.lit(block_bytes), F.col("length") - F.col("at")).alias("size"))
    schema = "path string, block int, segment long, n long, head array<int>, last boolean"
    segments = keep(blocks.repartition("path", "block").mapInPandas(segment_rows(separator, width, n_header), schema), "segments")

    # prefix scan over the blocks of a file: separators before each block
    per_block = segments.groupBy("path", "block").agg(F.max("segment").alias("separators"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select("path", "block", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("base"))
    placed = segments.join(base, ["path", "block"]).withColumn("doc", F.col("base") + F.col("segment"))
    inner = (F.col("segment") > 0) & ~F.col("last")
    whole = placed.where(inner).select("path", "doc", "n", "head", F.lit(True).alias("closed"))
    edges = placed.where(~inner).groupBy("path", "doc").agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("block", "head"))).alias("parts"),
        F.min("last").alias("open"),
    )
    head = F.slice(F.flatten(F.transform("parts", lambda x: x["head"])), 1, max(n_header, 1))
    edges = edges.select("path", "doc", "n", head.alias("head"), ~F.col("open")).toDF("path", "doc", "n", "head", "closed")
    out = whole.unionByName(edges).where("closed OR n > 0")
    return out.select("path", "doc", (F.col("n") - n_header).alias("n_tokens"), "head")


def document_id(head) -> object:
    """The document number that a header holds."""
    digit = lambda k: F.get(head, F.lit(k)).cast("long")
    value = digit(0)
    for k in range(1, HEADER - 1):
        value = value.bitwiseOR(F.shiftleft(digit(k), 15 * k))
    value = value.bitwiseOR(F.shiftleft(digit(HEADER - 1).bitwiseAND(F.lit(15)), 60))
    return F.when(digit(HEADER - 1) < 16, value)
