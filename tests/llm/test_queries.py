"""The registered queries on the given tables, and the pipeline stage by stage."""

import os
import sys

import pytest
from compare import TESTDATA, connect, differences
from llm_helpers import WORD, jaccard, shingles

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from cohortline.llm.entries import LLM_ENTRIES, LLM_SQL


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_matches_sql(spark, name):
    assert differences(LLM_ENTRIES[name](spark, TESTDATA), connect(TESTDATA), LLM_SQL[name]) == []


def test_nearest_recall(spark):
    import numpy as np

    rows = spark.read.parquet(f"{TESTDATA}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in LLM_ENTRIES["op7_nearest"](spark, TESTDATA).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        true = set(ids[np.lexsort((ids, -score))[:20]])
        hits, total = hits + len(true & got[ids[i]]), total + len(true)
    assert hits / total >= 0.95


def test_pipeline_stage_by_stage(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").where("doc_id < 400")
    names = docs.columns
    item = [set(shingles(r["text"])) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.keep(stage(spark, docs, TESTDATA), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[: len(names)] == names
        gone = set(before) - set(after)
        if name == "language":
            assert not gone
        if name == "near_duplicates":
            bags = {d: shingles(r["text"]) for d, r in before.items()}
            assert gone and all(any(jaccard(bags[d], bags[k]) >= 0.8 for k in after) for d in gone)
            kept = sorted(after)
            index = {}
            for d in kept:
                for s in bags[d]:
                    index.setdefault(s, []).append(d)
            for d in kept:
                near = {k for s in bags[d] for k in index[s] if k < d}
                assert all(jaccard(bags[d], bags[k]) < 0.8 for k in near)
        if name == "decontamination":
            leaks = {d for d, r in before.items() if any(len(i) and len(i & set(shingles(r["text"]))) == len(i) for i in item)}
            assert gone and leaks <= gone and all(any(len(i & set(shingles(before[d]["text"]))) >= 0.8 * len(i) for i in item) for d in gone)
        if name == "personal_data":
            assert not gone and any(after[d]["text"] != before[d]["text"] for d in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "mixture":
            assert all(r["mix_size"] == len(WORD.findall(r["text"])) and 0 < r["mix_taken"] <= 3 * r["mix_size"] for r in after.values())
