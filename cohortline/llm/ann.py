"""Approximate nearest neighbours by inner product: robust-pruned graphs, one or more per shard.

The distinct vectors are dealt to shards of about ``SHARD_ROWS`` by hash; one task builds one shard.  A shard is
cut into bands of similar norm (``RATIO``, at least ``LEAST`` points), longest first, and each band gets a graph over the
directions of its points, where a query is a direction like any other: a single graph over unequal norms leads a search for
the largest inner product astray.  Points are inserted in batches: a greedy beam search over the graph so far
proposes neighbours, and pruning keeps a neighbour only if no kept one is ``ALPHA`` times nearer to it than the
point is, so edges stay diverse; reverse edges are added and pruned alike.  A search starts from the nearest of many starts, half
of them far from each other and half drawn at random, so that groups of near copies, which have edges among themselves only, are
reached.  A query searches the bands of every shard with a beam of ``BEAM`` that follows the inner product, and the best of
all win, scored on the original vectors in double precision.  A band is left out only where the longest vector in it could not
reach the K-th best found so far, whatever its direction.

Identical vectors are one point with its smallest ``K + 1`` ids: as ties go to smaller ids, no
other can be among the K nearest, so a vector that many rows share costs one point.

Every valid row is indexed.  Null, empty and zero vectors and those with null or non-finite components take no part;
nor do rows without id.  Vectors of different length are never compared.  Directions are taken before single precision, so
components of any finite size are searched; a product beyond the range of a double is infinite or NaN (last).  Queries are dealt
to each shard in blocks of at most about ``QUERY_BLOCK``, so a task holds one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import keep

K = 20
SHARD_ROWS = 20_000
QUERY_BLOCK = 20_000
RATIO = 1.25
LEAST = 256
DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
BATCH = 256
EXPAND = 4


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms in double and unit vectors in single precision."""
    most = np.abs(x).max(1, keepdims=True)
    unit = x / most
    length = np.sqrt((unit**2).sum(1, keepdims=True))
    with np.errstate(over="ignore"):
        return np.minimum(most * length, np.finfo(float).max)[:, 0], (unit / length).astype(np.float32)


def bands(norms: np.ndarray) -> list[int]:
    """Where bands of falling norms begin, and the end of the last."""
    edges = [0]
    while edges[-1] < len(norms):
        begin = edges[-1]
        below = int(np.searchsorted(-norms, -norms[begin] / RATIO, side="right"))
        edges.append(min(len(norms), max(below, begin + LEAST)))
    return edges


def beam_search(points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int):
    """Ids and inner products of the best found per query (unordered, -1 where empty), and all expanded nodes."""
    n_q, every = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n_q, beam), -1, np.int64)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    seen = np.zeros((n_q, len(points) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    seen[:, starts] = True
    first = queries @ points[starts].T
    if len(starts) > beam:
        best = np.argpartition(-first, beam - 1, axis=1)[:, :beam]
        ids[:], sims[:] = starts[best], np.take_along_axis(first, best, 1)
    else:
        ids[:, : len(starts)], sims[:, : len(starts)] = starts, first
    done = ids < 0
    expanded = []
    while True:
        rank = np.where(done, -np.inf, sims)
        pick = np.argpartition(-rank, EXPAND - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.argmax(rank, 1)[:, None]
        live = np.isfinite(np.take_along_axis(rank, pick, 1))
        if not live.any():
            break
        nodes = np.where(live, np.take_along_axis(ids, pick, 1), -1)
        done[every, pick] = True
        expanded.append(nodes)
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(n_q, -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[every, near]] = -1
        seen[every, near] = True
        new = np.where(near >= 0, np.einsum("qd,qrd->qr", queries, points[near]), -np.inf).astype(np.float32)
        ids, sims = np.concatenate([ids, near], 1), np.concatenate([sims, new], 1)
        done = np.concatenate([done, near < 0], 1)
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, done = ids[every, best], sims[every, best], done[every, best]
    return ids, sims, np.concatenate(expanded, 1)


def prune(points: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse neighbours of the points ``of`` among the candidates found (-1 for none)."""
    n, every = len(of), np.arange(len(of))[:, None]
    found = np.where(found == of[:, None], -1, found)
    square = float((points[0].astype(np.float64) ** 2).sum())
    far = np.where(found >= 0, 2 * (square - np.einsum("pd,pcd->pc", points[of], points[found])), np.inf)
    order = np.argsort(far, 1, kind="stable")[:, : 4 * degree]
    found, far = found[every, order], far[every, order]
    near = points[found]
    apart = 2 * (square - near @ near.transpose(0, 2, 1))
    alive, out = np.isfinite(far), np.full((n, degree), -1, np.int64)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[np.arange(n), first]
        if not some.any():
            break
        out[some, k] = found[np.arange(n), first][some]
        alive &= alpha * alpha * apart[np.arange(n), first] > far
        alive[np.arange(n), first] = False
    return out


def n_starts(n: int) -> int:
    return min(n, 64 + 2 * (n // DEGREE))


def spread_order(points: np.ndarray, seed: int) -> np.ndarray:
    """All points at random, but half the starts first, each the farthest from those before it."""
    order = np.random.default_rng(seed).permutation(len(points))
    far, chosen = [int(order[0])], points @ points[order[0]]
    while len(far) < n_starts(len(points)) // 2:
        far.append(int(np.argmin(chosen)))
        chosen = np.maximum(chosen, points @ points[far[-1]])
    first = np.array(list(dict.fromkeys(far)))  # a set of near copies may give a point twice
    return np.concatenate([first, order[~np.isin(order, first)]])


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (-1 for none) of all points, and where searches start."""
    n = len(points)
    graph = np.full((n + 1, DEGREE), -1, np.int64)  # the last row serves the padding
    order = spread_order(points, seed)
    starts = order[: n_starts(n)]
    batch = max(16, min(BATCH, (1 << 14) // points.shape[1]))
    at = 1
    while at < n:
        mine = order[at : at + min(batch, max(1, at))]
        ids, _, expanded = beam_search(points, graph, starts[:at], points[mine], BUILD_BEAM)
        graph[mine] = prune(points, mine, np.concatenate([ids, expanded], 1))
        # reverse edges
        source, target = np.repeat(mine, DEGREE), graph[mine].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), BATCH):
            part = slice(low, low + BATCH)
            wide = np.full((len(nodes[part]), int(counts[part].max())), -1, np.int64)
            place = np.arange(counts[part].sum()) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
            begin = first[part][0]
            wide[np.repeat(np.arange(len(nodes[part])), counts[part]), place] = source[begin : begin + counts[part].sum()]
            merged = np.concatenate([graph[nodes[part]], wide], 1)
            merged = np.take_along_axis(merged, np.argsort(merged < 0, 1, kind="stable"), 1)
            full = (merged >= 0).sum(1) > DEGREE
            graph[nodes[part][~full]] = merged[~full, :DEGREE]
            if full.any():
                graph[nodes[part][full]] = prune(points, nodes[part][full], merged[full])
        at += len(mine)
    return graph, starts


def build(group: pd.DataFrame) -> pd.DataFrame:
    """One row: the graphs of one shard and its vectors, longest first."""
    vectors = np.array(group["vector"].tolist(), np.float64)
    order = np.argsort(-directions(vectors)[0], kind="stable")
    vectors, names = vectors[order], group["ids"].iloc[order]
    norms, points = directions(vectors)
    edges = bands(norms)
    built = [build_graph(points[low:high]) for low, high in zip(edges, edges[1:], strict=False)]
    row = [
        group["dim"].iloc[0],
        group["shard"].iloc[0],
        np.asarray(edges, np.int64).tobytes(),
        np.concatenate([s for _, s in built]).astype(np.int32).tobytes(),
        vectors.tobytes(),
        np.concatenate([g for g, _ in built]).astype(np.int32).tobytes(),
        np.concatenate([np.asarray(x, np.int64) for x in names]).tobytes(),
        names.map(len).to_numpy().astype(np.int32).tobytes(),
    ]
    return pd.DataFrame([row], columns=["dim", "shard", "bands", "starts", "vectors", "graph", "ids", "sizes"])


def graphs(row: pd.Series, norms: np.ndarray, points: np.ndarray):
    """First point, longest norm, points with their norms to that of the longest, graph and starts of each band."""
    edges = np.frombuffer(row["bands"], np.int64)
    graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
    starts, at = np.frombuffer(row["starts"], np.int32), 0
    for b, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        scaled = points[low:high] * (norms[low:high] / norms[low]).astype(np.float32)[:, None]
        mine = starts[at : at + n_starts(high - low)].astype(np.int64)
        at += len(mine)
        yield low, norms[low], scaled, graph[low + b : high + b + 1].astype(np.int64), mine  # one row of padding a graph


def search(index: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    """The k best of one shard for a block of queries."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(index) or not len(queries):
        return none
    row = index.iloc[0]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
    norms, points = directions(vectors)
    parts = list(graphs(row, norms, points))
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
    begin = np.cumsum(sizes) - sizes
    beam, batch = max(beam, k + 1), max(16, min(BATCH, (1 << 14) // vectors.shape[1]))
    out = []
    for at in range(0, len(queries), batch):
        block = queries.iloc[at : at + batch]
        exact = np.array(block["vector"].tolist(), np.float64)
        lengths, probe = directions(exact)
        spots = np.full((len(exact), k + 1), -1, np.int64)
        scores = np.full((len(exact), k + 1), -np.inf)
        for low, longest, scaled, graph, starts in parts:
            open_ = np.flatnonzero(~(lengths * longest * (1 + 1e-9) < scores[:, -1]))
            if not len(open_):
                break  # the bands that follow are shorter
            found, _, _ = beam_search(scaled, graph, starts, probe[open_], beam)
            found = np.where(found >= 0, found + low, -1)
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.where(found >= 0, (vectors[found] * exact[open_][:, None, :]).sum(2), -np.inf)
            found, score = np.concatenate([spots[open_], found], 1), np.concatenate([scores[open_], score], 1)
            first = ids[begin[found]]
            best = np.lexsort((first, -score))[:, : k + 1]  # ties to the smaller id
            spots[open_], scores[open_] = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
        for own, mine, score in zip(block["query_id"], spots, scores, strict=True):
            mine, score = mine[mine >= 0], score[mine >= 0]
            take = np.repeat(mine, sizes[mine])
            inside = np.arange(len(take)) - np.repeat(np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
            names, score = ids[begin[take] + inside], np.repeat(score, sizes[mine])
            other = names != own
            names, score = names[other], score[other]
            top = np.lexsort((names, -score))[:k]
            out.append((np.full(len(top), own), names[top], score[top]))
    return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(finite & F.exists("vector", lambda x: x != 0)).distinct()


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: graph, vectors and ids."""
    rows = valid(vectors, id_col, vec_col)
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    points = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))
    points = keep(points, "points")
    shards = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = points.join(F.broadcast(shards), "dim")  # one row per length of vector
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))
    schema = "dim int, shard long, bands binary, starts binary, vectors binary, graph binary, ids binary, sizes binary"
    return keep(dealt.select("dim", "shard", "vector", "ids").groupBy("dim", "shard").applyInPandas(build, schema), "index")


def nearest(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, its own row left out."""
    rows = valid(queries, id_col, vec_col).withColumnRenamed("vec_id", "query_id").withColumn("dim", F.size("vector"))
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(shards, F.col("dim") == F.col("_dim"))
    dealt = rows.select(F.col("dim").alias("q_dim"), F.col("_shard").alias("q_shard"), F.col("block").alias("q_block"), "query_id", "vector")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = (
        spread.groupBy("dim", "shard", "block")
        .cogroup(dealt.groupBy("q_dim", "q_shard", "q_block"))
        .applyInPandas(lambda a, b: search(a, b, k, beam), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
