"""Near-duplicate documents by weighted MinHash (BagMinHash), bands, and an exact check.

A document is the multiset of its shingles of five words (runs of letters, digits and non-ASCII
characters, lower case; fewer than five words make one shingle).  Two documents are
linked if their weighted Jaccard similarity, sum of smaller over sum of larger counts,
is at least ``SIMILARITY``; a class is a connected set of links.

BagMinHash: every shingle carries Poisson processes over the discretised weights [0,1), [1,2),
[2,4), [4,8), ...; a point has a time, a register and a weight coordinate, whose binary digits
are the splits of the hierarchy, and counts if the coordinate lies below the shingle's
weight.  The earliest time in each of ``REGISTERS`` registers is the signature: two documents agree in a register with a
probability that is exactly their weighted Jaccard similarity.  Only points before a limit are made, about
log(registers) + 4 per register and document; the few documents with a register left
empty are run again with twice the limit.

1. Documents with one sequence of words are one node; only nodes go on.
2. ``BANDS`` bands of ``ROWS`` registers: a pair at the threshold misses every band with odds of 3 in a million.
3. Buckets of more than ``HOT`` members, from copies with many changes of one text, would make all pairs of a group
   candidates.  Their members are dealt by their rarest shingles instead (a prefix filter, which is exact): texts of sizes x and y
   that share at least o shingles have their first common one, in any one order of all shingles, within the first
   x - o + 1 of the one and y - o + 1 of the other.  The order is by how many of these members hold a shingle, so two copies with too many changes of their own
   to be linked meet only where they share a change; ``MOST_TOKENS`` bounds the counts kept, not the shingles ordered.
   The smaller text of a pair needs only its places up to a ninth of its size; a text met at a later place has only smaller partners
   of certain sizes, and is compared within cells of those sizes.
4. In each bucket the members are compared with its leader, first the one that shares most bands with others (the text the
   copies were made of), then in rounds with other leaders, skipping members that are already in one class: a group of n near copies costs about n
   checks.  When few open pairs are left, all pairs of members in different classes are checked,
   so no link between classes is lost to the choice of leaders.  Pairs whose signatures, kept as two bits per register, differ
   in more than ``MOST_APART`` registers (5 deviations from the threshold) are left out.
5. A check ships each text once per leader it is compared with; a leader with many members is
   repeated for every ``GROUP`` of them, so no task gathers a class.

Documents without words (null, empty, punctuation alone) are classes of their own row.  Null ids and
repeated rows are kept; the class id is the smallest id in the class (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import find_words, flat, free_names, keep, mix, pieces, short_batches, signed, small, top_level, window_hashes, word_hashes

SIMILARITY = 0.8
SHINGLE = 5
REGISTERS = 252
ROWS = 6
BANDS = REGISTERS // ROWS
MOST_APART = 66  # registers of 252 whose two-bit sketches differ: 38 at the threshold, deviation 5.7
HOT = 64  # members; larger buckets are dealt anew by rare shingles
MOST_TOKENS = 1 << 18  # counts of shingles that order the prefixes; rarer ones stand first, in the order of their hashes
SLACK = 1e-3  # shingles; for rounding
CELL = np.log(1.04)  # sizes of one cell differ by less than 4 percent
GROUP = 500
ROUNDS = 2
MOST_DOCS = 100_000  # removed documents that are broadcast; more are joined
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def shingle_rows(texts: pa.Array, size: int = SHINGLE):
    """(row, shingle, weight) of all texts, sorted by row and shingle, and a hash of each text's words (0 without words)."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    start, end, row = find_words(PLAIN[data], offsets)
    hashes = word_hashes(data, start, end)
    n = len(offsets) - 1
    low = np.searchsorted(row, np.arange(n + 1))
    whole = window_hashes(hashes, low[:-1], low[1:]) if len(hashes) else np.zeros(n, np.uint64)
    whole = np.where(np.diff(low) > 0, np.maximum(whole, 1), 0).astype(np.uint64)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
    first = np.arange(max(len(hashes) - size + 1, 0))
    first = first[row[first] == row[first + size - 1]]
    short = np.flatnonzero((np.diff(low) > 0) & (np.diff(low) < size))
    at = np.append(first, low[short])
    to = np.append(first + size, low[short + 1])
    rows, keys = row[at], window_hashes(hashes, at, to)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))
    spot = np.flatnonzero(new)
    return rows[new], keys[new], np.diff(np.append(spot, len(rows))), whole


def uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures, one row of ``m`` earliest times per document; infinite for documents without shingles."""
    out = np.full(n * m, np.inf)
    total = np.bincount(row, weights=weight, minlength=n)
    limit = (np.log(m) + 4) / np.maximum(total, 1)
    todo = np.unique(row)
    while len(todo):
        mine = np.isin(row, todo)
        r, k, w = row[mine], key[mine], weight[mine]
        out.reshape(n, m)[todo] = np.inf
        level = 0
        while len(r):
            lower, upper = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            _points(out, r, mix(k + np.uint64((level + 1) * int(STEP) & (1 << 64) - 1)), w, lower, upper, limit, m)
            more = w > upper
            r, k, w, level = r[more], k[more], w[more], level + 1
        limit[todo] *= 2
        todo = todo[np.isinf(out.reshape(n, m)[todo]).any(1)]
    return out.reshape(n, m)


def _points(out, row, seed, weight, lower: int, upper: int, limit, m: int) -> None:
    """Enter the points of one level's processes, each of rate m (upper - lower), up to each document's limit."""
    time, rate, done = np.zeros(len(row)), float(m * (upper - lower)), 0
    while len(row):
        block = int(min(64, max(1, 65536 // len(row))))
        steps = (np.arange(done, done + block, dtype=np.uint64) * np.uint64(3) + np.uint64(1)) * STEP
        base = seed[:, None] + steps[None, :]
        gaps = -np.log(uniform(base)) / rate
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        i, j = np.nonzero(times <= limit[row][:, None])
        spot = base[i, j]
        if upper - lower > 1:
            inside = lower + (upper - lower) * uniform(spot + STEP + STEP) < weight[i]
            i, j, spot = i[inside], j[inside], spot[inside]
        register = (mix(spot + STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(out, row[i] * m + register, times[i, j])
        alive = times[:, -1] <= limit[row]
        row, seed, weight, time = row[alive], seed[alive], weight[alive], times[alive, -1]
        done += block


SKETCH = [f"s{k}" for k in range(8)]


def apart(left: list[str], right: list[str]) -> Column:
    """In how many registers two sketches differ."""
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        x = F.col(a).bitwiseXOR(F.col(b))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def node_rows(batches):
    """Per document its node (hash of its words) and the hashes of its bands."""
    for batch in pieces(batches, "text"):
        row, key, weight, whole = shingle_rows(batch.column("text"))
        n = batch.num_rows
        times = signatures(row, key, weight, n)
        bits = times.view(np.uint64).reshape(n * BANDS, ROWS).astype(np.uint64)
        band = np.zeros(n * BANDS, np.uint64)
        for k in range(ROWS):
            band = mix(band + bits[:, k])
        band = mix(band.reshape(n, BANDS) + np.arange(BANDS, dtype=np.uint64)[None, :] * STEP)
        low = np.zeros((n, 256), np.uint64)
        low[:, :REGISTERS] = mix(times.view(np.uint64)) & np.uint64(3)
        sketch = (low.reshape(n, 8, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(2, dtype=np.uint64)
        size = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(signed(band).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("hash"), pa.array(signed(whole)), pa.array(size), lists, *[pa.array(signed(sketch[:, k])) for k in range(8)]],
            ["doc_id", "hash", "node", "size", "bands", *SKETCH],
        )


def tokens_of(texts: pa.Array):
    """(row, token) of all texts, sorted by row: one token for each repeat of a shingle, so that shared weights are shared tokens."""
    row, key, weight, _ = shingle_rows(texts)
    at = np.repeat(np.arange(len(row)), weight)
    repeat = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    return row[at], mix(key[at] + repeat.astype(np.uint64) * STEP)


def token_rows(batches):
    """(token, n, least) of the n texts of a batch that hold a token, the least of their sizes."""
    for batch in pieces(batches, "text"):
        row, token = tokens_of(batch.column("text"))
        size = np.bincount(row, minlength=batch.num_rows)[row]
        order = np.lexsort((size, token))
        token, first, n = np.unique(token[order], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(n.astype(np.int64)), pa.array(size[order][first].astype(np.int64))], ["token", "n", "least"])


def size_cell(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 0.5)) / CELL).astype(np.int64)


def prefix_rows(counted, similarity: float):
    """(node, bucket, place, kind) by the tokens that stand first in a text, rare ones before the ``counted`` ones.

    Places that the smaller text of a pair can have go to the token's bucket (kind 0) and to its bucket of their size (1),
    later places to the token's buckets of their partners' sizes (2).  Tokens of one text alone are left out if all others are counted.
    """
    share = similarity / (1 + similarity)

    def run(batches):
        known, counts, least, whole = counted.value
        for batch in pieces(batches, "text"):
            row, token = tokens_of(batch.column("text"))
            often, floor = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                often, floor = np.where(known[at] == token, counts[at], 0), np.where(known[at] == token, least[at], 0)
            order = np.lexsort((token, often, row))
            row, token, often, floor = row[order], token[order], often[order], floor[order]
            low = np.searchsorted(row, np.arange(batch.num_rows + 1))
            place, size = np.arange(len(row)) - low[row], np.diff(low)[row]
            meets = often > 0 if whole else np.ones(len(row), bool)
            first = place <= (1 - 2 * share) * size + SLACK
            smaller = np.flatnonzero(meets & first)
            most = (size - place + SLACK) / share - size  # the largest partner that leaves room for enough shared tokens
            lowest = np.maximum(similarity * size - SLACK, floor)  # the smallest partner
            later = np.flatnonzero(meets & ~first & (most + SLACK >= lowest))
            start = size_cell(lowest[later])
            cells = size_cell(most[later] + SLACK) - start + 1
            cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells) + np.repeat(start, cells)
            later = np.repeat(later, cells)
            sized = lambda at, cell: mix(token[at] ^ mix((cell + 64).astype(np.uint64)))  # noqa: E731, B023
            at = np.concatenate([smaller, smaller, later])
            bucket = np.concatenate([token[smaller], sized(smaller, size_cell(size[smaller])), sized(later, cell)])
            kind = np.repeat(np.arange(3, dtype=np.int32), [len(smaller), len(smaller), len(later)])
            nodes = np.asarray(batch.column("node"))[row[at]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(signed(bucket)), pa.array(place[at].astype(np.int64)), pa.array(kind)], ["node", "bucket", "place", "kind"])

    return run


def rare_buckets(texts: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node, place): the tokens by which texts that are similar enough are sure to meet."""
    dealt = texts.repartition("node")
    counts = dealt.mapInArrow(token_rows, "token long, n long, least long").groupBy("token").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n > 1")
    counts = keep(counts, "tokens")
    level = top_level(counts, "n", MOST_TOKENS)
    known = counts.where(F.col("n") >= (1 << (level if level is not None else 62))).toArrow()  # at most MOST_TOKENS rows
    token, n, least = known["token"].to_numpy().view(np.uint64), known["n"].to_numpy(), known["least"].to_numpy()
    order = np.argsort(token)
    counted = texts.sparkSession.sparkContext.broadcast((token[order], n[order], least[order], len(n) == counts.count()))
    rows = keep(dealt.mapInArrow(prefix_rows(counted, similarity), "node long, bucket long, place long, kind int"), "rare")
    # two texts of a token, or in a cell of sizes at least one of either kind
    some = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    some = some.where("n > 1 and (low = 0 or low < high)").select("bucket")
    return rows.join(some, "bucket").select("bucket", "node", "place")


def fits(similarity: float, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Whether two rows (size, place) of a bucket leave room for enough shared shingles from their places on."""
    need = F.lit(similarity / (1 + similarity)) * (F.col(a[0]) + F.col(b[0])) - SLACK
    return (F.col(a[0]) - F.col(a[1]) >= need) & (F.col(b[0]) - F.col(b[1]) >= need)


def check_rows(similarity: float):
    """Links among rows sorted by leader, group and leader first: each member against its leader."""

    def run(batches):
        leader, held = None, None
        for batch in pieces(batches, "text"):
            row, key, weight, _ = shingle_rows(batch.column("text"))
            low = np.searchsorted(row, np.arange(batch.num_rows + 1))
            heads, members = batch.column("leader").to_pylist(), batch.column("node").to_pylist()
            pairs = []
            for i, (a, b) in enumerate(zip(heads, members, strict=True)):
                k, w = key[low[i] : low[i + 1]], weight[low[i] : low[i + 1]]
                if a == b:
                    leader, held = a, (k, w, int(w.sum()))
                    continue
                if a != leader:
                    continue
                at = np.minimum(np.searchsorted(held[0], k), len(held[0]) - 1)
                shared = int(np.minimum(held[1][at], w)[held[0][at] == k].sum())
                if shared >= similarity * (held[2] + int(w.sum()) - shared):
                    pairs.append((a, b))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; a is the leader."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1))).cast("int").alias("salt"))
    heads = salted.groupBy("a").agg(F.collect_set("salt").alias("salts")).select(F.col("a").alias("node"), F.col("a").alias("leader"), "salts")
    tails = salted.select(F.col("b").alias("node"), F.col("a").alias("leader"), F.array("salt").alias("salts"))
    rows = texts.join(heads.unionByName(tails).hint("merge"), "node").select("leader", "node", F.explode("salts").alias("salt"), "text")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", (F.col("leader") != F.col("node")).cast("int"))
    return dealt.select("leader", "node", "text").mapInArrow(check_rows(similarity), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node is connected with, by rounds of large and small stars.

    Each round joins links with one smallest neighbour per node and never gathers a
    node's neighbours; links are written between rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = keep(edges, "links")
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = keep(new, "links")
        after = state(new)
        edges, same, before = new, after == before, after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def relabel(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace ``label`` by the label of its component where it has one."""
    to = labels.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return df.join(to, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, and ``first`` true for exactly one row of its class.

    ``hash`` (of the text) and ``copy`` (a number among rows of one id and text) tell the rows of one id apart.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = keep(rows.mapInArrow(node_rows, "doc_id long, hash long, node long, size long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)), "nodes")

    # buckets with at least two nodes
    nodes = seen.where("node != 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "hash"), F.struct("doc_id", "hash")).alias("who"), F.min("size").alias("size"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in SKETCH])
    nodes = keep(nodes, "distinct")
    spread = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keep(spread.join(sizes, "bucket").select("bucket", "node", "size", "n"), "shared")
    # the hints keep one plan at every size
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets"), F.max("n").alias("most"))
    sketches = keep(nodes.join(meets.hint("merge"), "node").select("node", "who", "size", "meets", "most", *SKETCH), "sketches")
    wanted = sketches.select("node", F.col("who.doc_id").alias("_id"), F.col("who.hash").alias("_hash"), F.col("most") > HOT)
    wanted = wanted.toDF("node", "_id", "_hash", "hot").hint("merge")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["hash"] == F.col("_hash"))).select("node", "hot", "text")
    texts = keep(texts.dropDuplicates(["node"]), "texts")
    rare = rare_buckets(texts.where("hot").select("node", "text"), similarity)
    members = shared.where(F.col("n") <= HOT).select("bucket", "node", F.lit(0).cast("long").alias("place")).unionByName(rare)
    members = keep(members.join(sketches.select("node", "size", "meets"), "node"), "members")

    labelled = members.select("bucket", "node", "place", "size", "meets", F.col("node").alias("label"))
    tried = None
    for turn in range(ROUNDS + 1):
        per_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = per_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        mixed = mixed.where("labels > 1")
        load = mixed.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs"), F.sum("n").alias("members")).first()
        if not load["members"]:
            break
        last = turn == ROUNDS or (turn > 0 and load["pairs"] <= 16 * load["members"])
        open_ = labelled.join(mixed.select("bucket"), "bucket")
        if last:
            # members bring their sketches, so that the join of a bucket gives only pairs worth checking
            open_ = open_.join(sketches.select("node", *SKETCH).hint("merge"), "node")
            side = lambda x: open_.select("bucket", F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("size").alias(f"s{x}"), F.col("place").alias(f"p{x}"), *[F.col(c).alias(f"{x}_{c}") for c in SKETCH])  # noqa: E731, B023
            near = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits(similarity, ("sa", "pa"), ("sb", "pb"))
            near = near & (apart([f"a_{c}" for c in SKETCH], [f"b_{c}" for c in SKETCH]) <= MOST_APART)
            pairs = side("a").join(side("b"), "bucket").where(near)
        else:
            rank = F.xxhash64("node", F.lit(turn)) if turn else -F.col("meets")
            order = F.struct(rank.alias("rank"), "node", "label", "size", "place")
            head = open_.groupBy("bucket").agg(F.min(order).alias("head"))
            pairs = open_.join(head, "bucket").where(F.col("label") != F.col("head.label"))
            pairs = pairs.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.size").alias("sa"), F.col("size").alias("sb"), F.col("head.place").alias("pa"), F.col("place").alias("pb"))
            pairs = pairs.where(fits(similarity, ("sa", "pa"), ("sb", "pb")))  # similar texts have similar sizes, too
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, [F.least(pairs["a"], pairs["b"]) == tried["x"], F.greatest(pairs["a"], pairs["b"]) == tried["y"]], "left_anti")
        if not last:
            for x in ("a", "b"):
                pairs = pairs.join(sketches.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in SKETCH]), x)
            pairs = pairs.where(apart([f"a_{c}" for c in SKETCH], [f"b_{c}" for c in SKETCH]) <= MOST_APART)
        pairs = keep(pairs.select("a", "b"), "pairs")
        counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        links = verify(pairs.join(counts, "a"), texts, similarity)
        done = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = done if tried is None else tried.unionByName(done)
        own = labelled.select("node", "label").distinct()
        named = links.join(own.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        named = named.join(own.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        labelled = keep(relabel(labelled, components(named)), "labels")
        if last:
            break
    label = labelled.select("node", "label").distinct()

    # the class of every document
    per_node = seen.where("node != 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    per_node = per_node.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_class = per_node.groupBy("label").agg(F.min("least").alias("class_id"))
    per_node = per_node.join(per_class, "label").select("node", "label", "class_id")
    copy = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("node"))
    out = seen.select("doc_id", "hash", "node", copy.alias("copy")).join(per_node, "node", "left")
    best = out.where("node != 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("best")).select(F.col("label").alias("_label"), "best")
    out = out.join(best, F.col("label") == F.col("_label"), "left")
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash")) & (F.col("copy") == 1)
    return out.select(
        "doc_id",
        F.when(F.col("node") != 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        ((F.col("node") == 0) | chosen).alias("first"),
        "hash",
        "copy",
    )


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near duplicates: one document of each class stays, with all its columns.

    Rows without words all stay.
    """
    found = keep(classes(docs, id_col, text_col).select("doc_id", "hash", "first"), "classes")
    key, text_hash, rows, stay, own, copy = free_names(docs, "id", "hash", "rows", "stay", "text_hash", "copy")
    pairs = found.groupBy(F.col("doc_id").alias(key), F.col("hash").alias(text_hash)).agg(F.count(F.lit(1)).alias(rows), F.count_if("first").alias(stay))
    pairs = keep(pairs.where(F.col(stay) < F.col(rows)), "gone")  # rows of one id and text: none stays, or one of several
    names = docs.columns
    out = docs.withColumn(own, F.xxhash64(text_col))
    same = out[id_col].eqNullSafe(F.col(key)) & (F.col(own) == F.col(text_hash))
    whole = pairs.where(F.col(stay) == 0)
    out = out.join(small(whole, whole.count(), MOST_DOCS), same, "left_anti")
    partly = pairs.where(F.col(stay) > 0)
    n = partly.count()
    if n:
        out = out.join(small(partly, n, MOST_DOCS), same, "left")
        # of rows that share id and text the smallest by all other columns stays; rows found once pass the window alone
        order = [F.col(f"`{c}`") for c in names if c not in (id_col, text_col)]
        order = [c.cast("string") if dict(docs.dtypes)[n_].startswith("map") else c for n_, c in zip([c for c in names if c not in (id_col, text_col)], order)]
        alone = out.where(F.col(rows).isNull())
        several = out.where(F.col(rows).isNotNull())
        several = several.withColumn(copy, F.row_number().over(Window.partitionBy(key, text_hash).orderBy(*order, F.lit(1))))
        out = alone.unionByName(several.where(F.col(copy) <= F.col(stay)).drop(copy))
    return out.select(*[f"`{c}`" for c in names])
