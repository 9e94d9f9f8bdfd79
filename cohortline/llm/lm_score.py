"""Language-model scores: the marginal probability of a text over all its segmentations into pieces.

The pieces are the existing vocabulary of a public subword tokenizer.  Each word, behind the mark of
a word's begin, is a lattice of pieces; the forward recursion in log space adds up all ways through
it, so a score is the log of a marginal probability and not of a best segmentation.

Piece scores: the public file ranks its pieces, and rank r gets the Zipf probability proportional to
1 / (r + 2.7); the 256 bytes, which stand for characters that are no piece, share ``BYTE_SHARE``.
Under these scores forward and backward sums weight all segmentations of every training word, and the
expected counts of the pieces, with ``PRIOR`` counts of the old scores, give the probabilities used.
The vocabulary itself is never changed.

Word model: P(w) = max(c - D, 0) / N + (D V / N) m(w), where m is the lattice's marginal, c the
word's training count, N and V the number of training tokens and of distinct ones, and D the usual discount
from the numbers of words seen once and twice.  The base score is the add-one unigram of the words.

Everything learned covers every training row:

- every task adds up its words and expected piece counts and sends one row per distinct word and task;
- the words above a count, at most ``FREQUENT`` of them, are broadcast with their counts
  (the bound is checked on a histogram of counts before they are fetched);
- all others meet their counts by a join, as rows of document and word hash, so no word is left out
  and no frequent word makes a large group.

The column ``lattice_score`` is the lattice alone: the log10 of the marginal probability of the whole text, its
end included, under the vocabulary's own scores, with nothing learned.  ``score`` is the word model's, which predicts
held-out text far better, because words seen in training are more likely than their pieces say.

Words are compared by a 64-bit hash.  Null text reads as empty: one token, the end.  A null
id counts as the empty string for the split; repeated rows are scored each.  Without training rows the
lattice alone scores.
"""

from __future__ import annotations

import copy
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import find_words, flat, keep, mix, pieces, signed, window_hashes, word_hashes

VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
FREQUENT = 1 << 20
BYTE_SHARE = 0.01
PRIOR = 10_000.0
END_HASH = 1  # stands for the end token
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARK = "▁"


class Lattice:
    """Piece scores by hash of their characters, and the forward recursion over many words at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, end = [], 0
        for i in range(model.vocab_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
                continue
            if model.get_score(i) > -1e8:  # pieces of blanks alone have no rank
                names.append((model.get_score(i), model.id_to_piece(i)))
        names.sort(key=lambda x: -x[0])
        weight = 1.0 / (np.arange(len(names) + 1) + 2.7)  # the first is the end of a text
        logs = np.log(weight / weight.sum() * (1 - BYTE_SHARE))
        self.end, self.byte = float(logs[0]), float(np.log(BYTE_SHARE / 256))
        self.names = [name for _, name in names]
        self.longest = max(len(x) for x in self.names)
        chars = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in self.names]
        ends = np.cumsum([len(x) for x in chars])
        keys = window_hashes(mix(np.concatenate(chars)), ends - [len(x) for x in chars], ends)
        self.bits = 22
        slot = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, logs[1:].copy()
        home = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.probes = 1
        for i, h in enumerate(home):
            step = 0
            while slot[(h + step) & (len(slot) - 1)] >= 0:
                step += 1
            slot[(h + step) & (len(slot) - 1)] = i
            self.probes = max(self.probes, step + 1)
        self.slot = slot

    def learned(self, expected: np.ndarray, ends: int) -> tuple[np.ndarray, float, float]:
        """New logs of the pieces, the end and a byte from expected counts (the last is that of bytes)."""
        total = expected.sum() + ends + PRIOR
        values = np.log((expected[:-1] + PRIOR * np.exp(self.values)) / total)
        byte = np.log((expected[-1] + PRIOR * BYTE_SHARE) / total / 256)
        return values, float(np.log((ends + PRIOR * np.exp(self.end)) / total)), float(byte)

    def using(self, values: np.ndarray, end: float, byte: float) -> Lattice:
        new = copy.copy(self)
        new.values, new.end, new.byte = values, end, byte
        return new

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slot[at[open_]]
            taken = found >= 0
            open_, found = open_[taken], found[taken]
            same = self.keys[found] == keys[open_]
            out[open_[same]] = found[same]
            open_ = open_[~same]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slot) - 1)
        return out

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray | None = None):
        """Natural log of the marginal probability of each word (UTF-8 bytes, without its mark).

        With counts of the words also the expected counts of the pieces; the last is that of bytes.
        """
        out, expected = np.zeros(len(start)), np.zeros(len(self.values) + 1)
        order = np.argsort(end - start, kind="stable")
        sizes = (end - start)[order]
        at = 0
        while at < len(order):  # words of like length together
            limit = max(int(sizes[at]) + 3, int(sizes[at] * 1.3))
            upto = min(int(np.searchsorted(sizes, limit, side="right")), at + max(1, 300_000 // (limit + 1)))
            upto = max(upto, at + 1)
            take = order[at:upto]
            joined = b" ".join(data[a:b].tobytes() for a, b in zip(start[take], end[take], strict=True))
            out[take] = self._block(joined, len(take), None if counts is None else counts[take], expected)
            at = upto
        return out if counts is None else (out, expected)

    def _block(self, joined: bytes, n: int, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        chars = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        stop = np.append(np.flatnonzero(chars == 32), len(chars))
        begin = np.append(0, stop[:-1] + 1)
        length = stop - begin + 1  # with the mark
        marked = np.full(len(chars) + 1, ord(MARK), np.uint32)  # each blank, and the begin, becomes the mark
        marked[1:] = np.where(chars == 32, ord(MARK), chars)
        hashed = mix(marked)
        width = int(length.max())
        n_bytes = np.where(marked < 0x80, 1, np.where(marked < 0x800, 2, np.where(marked < 0x10000, 3, 4)))
        # edge[k]: log probability of the piece of k + 1 characters that starts at a place
        reach = min(self.longest, width)
        piece = np.full((reach, len(marked)), -1, np.int32)
        owner = np.repeat(np.arange(n), length)
        off = np.arange(len(marked)) - begin[owner]
        room = length[owner] - off
        for k in range(reach):
            here = np.flatnonzero(room > k)
            piece[k, here] = self.look_up(window_hashes(hashed, here, here + k + 1))
        edge = np.where(piece >= 0, self.values[piece], -np.inf)
        alone = piece[0] < 0
        edge[0, alone] = self.byte * n_bytes[alone]

        def add_up(terms):
            top = terms.max(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where(np.isneginf(top), -np.inf, top + np.log(np.exp(terms - top[:, None]).sum(1)))

        forward = np.full((n, width + 1), -np.inf)
        forward[:, 0] = 0.0
        for j in range(1, width + 1):
            live = np.flatnonzero(length >= j)
            ks = np.arange(min(j, reach))
            origin = j - 1 - ks
            forward[live, j] = add_up(forward[live[:, None], origin[None, :]] + edge[ks[None, :], begin[live][:, None] + origin[None, :]])
        total = forward[np.arange(n), length]
        if counts is not None:
            backward = np.full((n, width + reach + 1), -np.inf)
            backward[np.arange(n), length] = 0.0
            ks = np.arange(reach)
            for j in range(width - 1, -1, -1):
                live = np.flatnonzero(length > j)
                backward[live, j] = add_up(backward[live, j + 1 : j + 1 + reach] + edge[:, begin[live] + j].T)
            k, spot = np.nonzero(edge > -np.inf)
            w = owner[spot]
            weight = np.exp(forward[w, off[spot]] + edge[k, spot] + backward[w, off[spot] + k + 1] - total[w]) * counts[w]
            ids = piece[k, spot]
            raw = ids < 0
            expected[:-1] += np.bincount(ids[~raw], weights=weight[~raw], minlength=len(expected) - 1)
            expected[-1] += float((weight[raw] * n_bytes[spot[raw]]).sum())
        return total


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def lowered(batch: pa.RecordBatch):
    data, offsets = flat(batch.column("text"))
    data = LOWER[data]
    start, end, row = find_words(data, offsets)
    return data, start, end, row, word_hashes(data, start, end)


def distinct(data, start, end, hashes):
    """The distinct words of a batch: hashes, counts, and their bytes as one Arrow array."""
    keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    low, high = start[first], end[first]
    size = high - low
    offsets = np.append(0, np.cumsum(size))
    inside = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size)
    packed = data[np.repeat(low, size) + inside]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)])
    return keys, counts.astype(np.int64), array


def merged(held):
    hashes, counts = np.concatenate([h for h, _, _ in held]), np.concatenate([c for _, c, _ in held])
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    words = pa.chunked_array([w for _, _, w in held]).combine_chunks()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return hashes[order][first], np.add.reduceat(counts[order], first), words.take(pa.array(order[first]))


def count_rows(path: str):
    """Of the training rows of one task: (0, word hash, count, 0) and (1, piece, 0, expected count)."""

    def out(kind, ids, n, x):
        for i in range(0, len(ids), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids[part]), kind, np.int32)), pa.array(ids[part]), pa.array(n[part]), pa.array(x[part])],
                ["kind", "id", "n", "x"],
            )

    def run(batches):
        model = lattice(path)
        held, size, ends = [], 0, 0
        expected = np.zeros(len(model.values) + 1)

        def flush():
            keys, counts, words = merged(held)
            _, offsets, data = words.buffers()
            offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
            data = np.frombuffer(data, np.uint8)
            for i in range(0, len(keys), 100_000):
                expected[:] += model.words(data, offsets[:-1][i : i + 100_000], offsets[1:][i : i + 100_000], counts[i : i + 100_000].astype(float))[1]
            yield from out(0, signed(keys), counts, np.zeros(len(keys)))

        for batch in pieces(batches, "text"):
            ends += batch.num_rows
            data, start, end, _, hashes = lowered(batch)
            if len(hashes):
                held.append(distinct(data, start, end, hashes))
                size += len(held[-1][0])
            if size > 1_500_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 800_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        if ends:
            yield from out(0, np.array([END_HASH]), np.array([ends]), np.zeros(1))
            spot = np.flatnonzero(expected)
            yield from out(1, spot, np.zeros(len(spot), np.int64), expected[spot])

    return run


def score_rows(path: str, shared, ends: int, total: int, discount: float, share: float):
    """Per document: tokens, sums over frequent words, and for the others hash and log10 of the marginal."""

    def run(batches):
        (known, n_known), learned = shared.value
        given = lattice(path)
        model = given.using(*learned)
        cache = (np.zeros(0, np.uint64), np.zeros((2, 0)))

        def model_log(c, marginal):
            if not total:
                return marginal / np.log(10)
            return np.log10(np.maximum(c - discount, 0) / total + share * np.exp(marginal))

        for batch in pieces(batches, "text"):
            data, start, end, row, hashes = lowered(batch)
            n = batch.num_rows
            words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            spot = np.minimum(np.searchsorted(cache[0], words), max(len(cache[0]) - 1, 0))
            old = cache[0][spot] == words if len(cache[0]) else np.zeros(len(words), bool)
            both = np.zeros((2, len(words)))  # under the learned and under the given scores
            both[:, old] = cache[1][:, spot[old]]
            new = ~old
            for k, used in enumerate((model, given)):
                both[k, new] = used.words(data, start[first[new]], end[first[new]])
            keys = np.concatenate([cache[0], words[new]])
            order = np.argsort(keys, kind="stable")
            cache = (keys[order], np.concatenate([cache[1], both[:, new]], axis=1)[:, order])
            if len(keys) > 1_000_000:
                cache = (np.zeros(0, np.uint64), np.zeros((2, 0)))
            marginal, plain = both

            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            hit = known[at] == words if len(known) else np.zeros(len(words), bool)
            c = np.where(hit, n_known[at], 0) if len(known) else np.zeros(len(words))
            base, value = np.log10(c + 1), np.where(hit, model_log(c, marginal), 0.0)
            often = hit[back]
            sums = lambda x: np.bincount(row, weights=x[back], minlength=n)  # noqa: E731, B023
            rare, sizes = hashes[~often], np.bincount(row[~often], minlength=n)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"),
                    batch.column("doc_id"),
                    pa.array(np.bincount(row, minlength=n) + 1),
                    pa.array(np.bincount(row[often], minlength=n) + int(ends > 0)),
                    pa.array(sums(base) + np.log10(ends + 1)),
                    pa.array(sums(value) + model_log(float(ends), np.array(model.end))),
                    pa.array((sums(plain) + given.end) / np.log(10)),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(signed(rare)), pa.array((marginal[back] / np.log(10))[~often])], ["word", "m"])),
                ],
                ["row_id", "doc_id", "n_tokens", "n_known", "base", "score", "lattice_score", "rare"],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: base and model log10 probabilities of its whole text."""
    spark = docs.sparkSession
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held_out = F.crc32(number) % 7 == 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))

    learned = rows.where(~F.col("held_out")).select("text").mapInArrow(count_rows(vocabulary), "kind int, id long, n long, x double")
    learned = keep(learned.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "learned")
    counts = learned.where("kind = 0").select(F.col("id").alias("word"), "n")
    seen = lambda k: F.count(F.when(F.col("n") == k, 1))
    whole = counts.agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"), F.max(F.when(F.col("word") == END_HASH, F.col("n"))).alias("ends"),
        seen(1).alias("once"), seen(2).alias("twice"),
    ).first()
    total, words, ends = int(whole["tokens"] or 0), int(whole["words"]), int(whole["ends"] or 0)
    discount = whole["once"] / (whole["once"] + 2 * whole["twice"]) if whole["once"] and whole["twice"] else 0.75
    share = discount * words / total if total else 1.0
    model = lattice(vocabulary)
    expected = np.zeros(len(model.values) + 1)
    for r in learned.where("kind = 1").select("id", "x").collect():  # one row per piece of the vocabulary at most
        expected[r["id"]] = r["x"]

    # the lowest power of two that at most ``frequent`` words reach
    histogram = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    level, held = None, 0
    for r in sorted(histogram, key=lambda r: -r["level"]):
        if held + r["words"] > frequent:
            break
        held, level = held + r["words"], int(r["level"])
    table = (np.zeros(0, np.uint64), np.zeros(0))
    if level is not None:
        often = counts.where((F.col("n") >= 2**level) & (F.col("word") != END_HASH)).toArrow()
        word, n = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy().astype(float)
        order = np.argsort(word)
        table = (word[order], n[order])
    shared = spark.sparkContext.broadcast((table, model.learned(expected, ends)))

    schema = "row_id long, doc_id long, n_tokens long, n_known long, base double, score double, lattice_score double, rare array<struct<word: long, m: double>>"
    keyed = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    scored = keep(keyed.mapInArrow(score_rows(vocabulary, shared, ends, total, discount, share), schema), "scores")
    rare = scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.m")
    n = F.col("n")
    log = F.when(n.isNull(), F.col("m") + F.log10(F.lit(share)))
    log = log.otherwise(F.log10((n - F.lit(discount)) / F.lit(float(max(total, 1))) + F.lit(share) * F.pow(F.lit(10.0), "m")))
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("row_id")
        .agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce(n, F.lit(0)) + 1)).alias("more_base"), F.sum(log).alias("more_score"))
    )
    out = scored.drop("rare").join(sums, "row_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * F.lit(float(np.log10(total + words + 1)))).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
        "lattice_score",
    )
