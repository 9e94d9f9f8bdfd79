"""Chat windows read back exactly; graph search against brute force; plans of the native operators."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from cohortline.llm import ann, chat

SCHEMA = "conv_id long, turn long, role string, text string, kind string, offset string, cell string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)


def digest(rows):
    """What reading back must give for each conversation."""
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    loss = {c: "".join(t for r, t in v if r == "assistant") for c, v in out.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[c]), sha(loss[c])) for c, v in out.items()}


def rows():
    marks = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>[user]x</s>", "a]b[c\\", "", None, "é😀\n<s>"]
    out = [(1, i, "user" if i % 2 == 0 else "assistant", m) for i, m in enumerate(marks)]
    out += [(2, i, ["system", "user", "assistant"][min(i, 1 + (i % 2))], f"turn {i} " + "w" * (i % 90)) for i in range(700)]
    out += [(3, 0, "assistant", "z" * 9000), (3, 1, "user", "short"), (3, 2, "assistant", "y" * 9000)]
    out += [(4, 0, "we]ird\\[role", "t"), (5, None, None, None), (None, 1, "assistant", "nobody"), (6, 0, "user", "same"), (6, 0, "user", "same")]
    big = 2**53
    out += [(big, 0, "user", "even"), (big + 1, 0, "user", "odd"), (big, 1, "assistant", "a"), (big + 1, 1, "assistant", "b")]
    return out + [(7, None, "user", "no turn"), (7, big, "user", "first"), (7, big + 1, "assistant", "second")]


@pytest.mark.parametrize("cell", [chat.CELL, 2000])
def test_windows_read_back(spark, cell):
    windows = chat.format_windows(turns(spark, rows()), budget=600, history=150, cell=cell)
    kept = windows.collect()
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert found == digest(rows())
    system = chat.format_turn("system", "turn 0 ")[0]
    for r in kept:
        inside = chat.read_turns(r["formatted"])
        assert len(r["formatted"]) <= 600 or len(inside) - r["n_repeated"] == 1
        if r["conv_id"] == 2:
            assert r["formatted"].startswith(system)
    assert sum(r["n_repeated"] > 1 for r in kept) > 3  # history beside the system turn
    assert chat.read_back(chat.format_windows(turns(spark, []))).count() == 0


def test_conversations_go_over_many_batches(spark):
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_windows(turns(spark, rows()), budget=600, history=150)).collect()}
    finally:
        spark.conf.set(key, before)
    assert found == digest(rows())


def test_escapes_are_reversible():
    for text in ("", "\\", "<", "[", "\\<[", "</s>\\", "a\\\\<s>"):
        formatted, low, high = chat.format_turn("r]\\[", text)
        assert chat.read_turns(formatted * 2) == [("r]\\[", low, high), ("r]\\[", len(formatted) + low, len(formatted) + high)]
        assert chat.unescape(formatted[low:high]) == text


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string, shard string")


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))).astype(np.float32)
    x[100:400] = x[100]  # a third of the rows share one vector
    data = [(i, [float(v) for v in x[i]], "a", "b") for i in range(900)]
    odd = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [1.0, None] * 8), (2080, [float("nan")] * 16), (2100, [float("inf")] * 16), (None, [1.0] * 16)]
    data += [(i, v, None, None) for i, v in odd] + [(3000, [1.0, 2.0], None, None), (3020, [2.0, 1.0], None, None)] + [data[0]]
    table = vectors(spark, data)
    found = {}
    for r in ann.nearest(ann.build_index(table, shard_rows=250), table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 900, 20), 3000, 3020}
    assert [v for _, v, _ in found[3000]] == [3020] and [v for _, v, _ in found[3020]] == [3000]
    full, hits = x.astype(float), 0
    for q in range(0, 900, 20):
        score = full @ full[q]
        order = [i for i in np.lexsort((np.arange(900), -score.round(12))) if i != q][:20]
        assert [k for k, _, _ in found[q]] == list(range(1, 21))
        got = [v for _, v, _ in found[q]]
        hits += len(set(order) & set(got))
        assert all(abs(s - full[v] @ full[q]) < 1e-9 for _, v, s in found[q])
        pairs = [(-s, v) for _, v, s in found[q]]
        assert pairs == sorted(pairs)
    assert hits / (45 * 20) >= 0.97
    assert ann.nearest(ann.build_index(table.where("false")), table).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kinds(n, d):
    """Vectors of one length, of unequal lengths, with a tight third, and in many groups of near copies."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, d))
    tight = unit(base)
    tight[: n // 3] = unit(unit(rng.normal(size=(1, d))) + 0.02 * rng.normal(size=(n // 3, d)))
    copies = unit(np.repeat(unit(rng.normal(size=(n // 40, d))), 40, 0) + 0.01 * rng.normal(size=(n // 40 * 40, d)))
    return {
        "unit": unit(base),
        "gauss": base,
        "uniform": unit(base) * rng.uniform(0.5, 2, (n, 1)),
        "lognormal": unit(base) * rng.lognormal(0, 1, (n, 1)),
        "tight": tight,
        "copies": copies,
        "huge": unit(base) * 1e60,
    }


@pytest.mark.parametrize("kind", ["unit", "gauss", "uniform", "lognormal", "tight", "copies", "huge"])
def test_recall_on_a_large_shard(kind):
    x = kinds(4000, 64)[kind]
    index = ann.build(pd.DataFrame({"dim": 64, "shard": 0, "vector": list(x), "ids": [[i] for i in range(len(x))]}))
    own = np.random.default_rng(2).permutation(len(x))[:200]
    found = ann.search(index, pd.DataFrame({"query_id": own, "vector": list(x[own])}), ann.K, ann.BEAM)
    recall = []
    for q, mine in found.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(set(np.argpartition(-score, ann.K)[: ann.K]) & set(mine["vec_id"])) / ann.K)
    assert len(recall) == 200 and np.mean(recall) >= 0.98 and min(recall) >= 0.5


def test_bands_cover_all_points():
    norms = np.sort(np.random.default_rng(4).lognormal(0, 2, 3000))[::-1]
    edges = ann.bands(norms)
    assert edges[0] == 0 and edges[-1] == 3000 and edges == sorted(set(edges))
    for low, high in zip(edges, edges[1:], strict=False):
        assert high - low <= ann.LEAST or norms[low] <= norms[high - 1] * ann.RATIO
    assert ann.bands(np.ones(1)) == [0, 1] and ann.bands(np.full(5000, np.finfo(float).max)) == [0, 5000]


def test_pruning_keeps_diverse_neighbours():
    points = ann.directions(np.array([[1, 0, 0.5], [1, 0.05, 0.5], [1, 0.06, 0.5], [-1, 0.1, 0.5], [0, 1, 0.5]]))[1]
    kept = ann.prune(points, np.array([0]), np.array([[1, 2, 3, 4]]), degree=3)[0]
    assert kept[0] == 1 and 2 not in kept


def test_native_operators_run_no_python(spark):
    import __spark_entry__ as contract
    from compare import TESTDATA

    for name in ("op2_pii", "op3_decontamination"):
        plan = contract.queries()[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
