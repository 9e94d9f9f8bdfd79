"""Fill-in-middle, tokenizer alignment and line dedup against brute force on awkward documents."""

import bisect
import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from compare import TESTDATA
from llm_helpers import sentence, table, texts

from pyspark.sql import functions as F

from cohortline.llm import align, fim, line_dedup
from cohortline.llm.common import MOST_BITS, filter_words, held_by, key_filter, may_hold


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in middle --------------------------------------------------------------------


def middle_cut(i, t, seed=1, rate=90, spm=20):
    t = t or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_outputs_and_round_trip(spark):
    rng = random.Random(3)
    rows = texts() + [(100 + i, "".join(rng.choice("ab<>PSM é漢🙂\n") for _ in range(rng.choice([0, 1, 2, 9, 400])))) for i in range(300)]
    rows += [(500, "holds <M> itself"), (501, "<P"), (502, "S>"), (503, "漢" * 100_000)]
    got = fim.restore(fim.transform(table(spark, rows))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    got.sort(key=lambda r: key((r["doc_id"], r["text"])))
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for (i, t), r in zip(sorted(rows, key=key), got):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle_cut(i, t)
        assert r["restored"] == (t or "") and r["text"] == t and r["hash"] == "z"


def test_fim_replaces_columns_of_its_own_names_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", "x", 5)], "doc_id long, text string, FORM string, Output long")
    out = fim.transform(df, rate=100, spm=0)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first()["form"] == "psm"
    assert fim.restore(fim.transform(df.limit(0))).count() == 0


def test_fim_refuses_damaged_outputs(spark):
    df = spark.createDataFrame([("psm", "<P>a<S>b"), ("plain", "x")], "form string, output string")
    with pytest.raises(Exception, match="one of each mark"):
        fim.restore(df).collect()


# --- alignment -------------------------------------------------------------------------


def aligned(rows, folder=align.FOLDER):
    """Everything again by sets and loops, with the tokens' bytes found another way (offsets of single decoded tokens)."""
    a, b = align.load(folder)
    bytes_of = lambda side, i: side.data[side.starts[i] : side.starts[i + 1]].tobytes()
    docs = []
    for i, t in rows:
        x, y = (a.encode([t])[0], b.encode([t])[0]) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(bytes_of(a, k) for k in x) != whole or b"".join(bytes_of(b, k) for k in y) != whole:
            x, y = [], []
        ends = [[], []]
        for side, ids, e in ((a, x, ends[0]), (b, y, ends[1])):
            at = 0
            for k in ids:
                at += len(bytes_of(side, k))
                e.append(at)
        common = sorted(set(ends[0]) & set(ends[1]))
        parts = [([], []) for _ in common]
        for ids, e, k in ((x, ends[0], 0), (y, ends[1], 1)):
            for token, end in zip(ids, e):
                parts[bisect.bisect_left(common, end)][k].append(token)
        pairs = collections.Counter((p, q) for g in parts for p in g[0] for q in g[1])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in parts)
        docs.append((i, len(x), len(y), len(parts), pairs, sha(text) if parts else ""))
    held = collections.Counter(p for d in docs for p in d[4])
    best = collections.defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return [
        (i, n_a, n_b, g, sum(pairs.values()), sum(n for p, n in pairs.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in pairs.items()), digest)
        for i, n_a, n_b, g, pairs, digest in docs
    ]


AWKWARD = [
    (200, "</s> <s> <unk> <|endoftext|> <0x41> plain"),
    (201, "▁ a lower block"),
    (202, "zero\x00byte � and ​ no width"),
    (203, "漢字かな交じり文" * 30),
    (204, "🙂👩‍👩‍👧 emoji"),
    (205, "  two  spaces\n\n\ttabs \r\n"),
    (206, " "),
    (207, "ﬁ ligature ① Å"),
    (208, "qzxjkvbw" * 500),
]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_alignment_matches_brute_force(spark, frequent):
    rows = [r for r in texts() if len(r[1] or "") < 20_000] + AWKWARD
    got = align.link_counts(table(spark, rows), frequent=frequent).collect()
    order = lambda x: sorted(map(tuple, x), key=repr)
    assert order(got) == order(aligned(rows))
    assert sum(r["n_a"] for r in got) > 5000


def test_ids_are_those_of_the_vocabulary_files(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(f"{align.FOLDER}/{align.BYTE_MODEL}")
    model.encode_special_tokens = True
    held = [t for _, t in texts() + AWKWARD if t] + [r["text"] for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()]
    a, _ = align.load(align.FOLDER)
    assert a.encode(held) == [e.ids for e in model.encode_batch([" " + t for t in held], add_special_tokens=False)]
    entries = {i: t for t, i in model.get_vocab(with_added_tokens=False).items()}
    letters = align.byte_letters()
    for i in range(0, 50_256, 7):
        assert a.data[a.starts[i] : a.starts[i + 1]].tobytes() == bytes(letters[c] for c in entries[i])


def test_alignment_of_an_empty_table(spark):
    assert align.link_counts(table(spark).limit(0)).count() == 0


def test_gallop_finds_common_values():
    rng = np.random.default_rng(1)
    for n, m in [(0, 5), (5, 0), (1, 1), (3, 400), (400, 3), (300, 300), (1, 1000)]:
        for top in (max(n, m) + 1, 5 * (n + m)):
            x, y = (np.sort(rng.choice(top, k, replace=False)) for k in (n, m))
            i, j = align.gallop(x, y) if m else (np.zeros(0, int), np.zeros(0, int))
            assert np.array_equal(x[i], np.intersect1d(x, y)) and np.array_equal(y[j], np.intersect1d(x, y))


def test_links_are_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 30, 500), rng.integers(0, 30, 400)
    upto_a, upto_b = np.array([1, 200, 350, 500]), np.array([90, 91, 300, 400])
    whole = align.links(a, b, upto_a, upto_b)
    monkeypatch.setattr(align, "BLOCK", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, align.links(a, b, upto_a, upto_b)))
    assert whole[1].sum() == 1 * 90 + 199 * 1 + 150 * 209 + 150 * 100


def test_many_pairs_of_one_text_become_several_rows(spark, monkeypatch):
    rows = [(1, sentence(random.Random(4), 3000)), (2, "short text")]
    want = align.link_counts(table(spark, rows)).collect()
    run = align.encoded_rows(align.FOLDER)
    monkeypatch.setattr(align, "CHUNK", 100)
    batch = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "row long, id long, text string").toArrow().to_batches()
    parts = [r for b in run(batch) for r in b.to_pylist()]
    assert len(parts) > 10 and [r["n_links"] for r in parts if r["n_a"] is not None] == [r["n_links"] for r in sorted(want)]
    assert sum(sum(r["times"]) for r in parts) == sum(r["n_links"] for r in want)


# --- lines -----------------------------------------------------------------------------


def lines_dropped(rows, least=10):
    gap, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(gap).translate(lower)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def line_rows():
    rng = random.Random(8)
    common = ["All rights reserved.", "ÄÖÜ äöü ß", "ÄÖÜ äöü ßx", "short one", "ten chars!", " not stripped ", "k" * 5000]
    rows = texts() + [(None, "All rights reserved.\nunknown id line"), (None, "unknown id line\nall RIGHTS reserved."), (5, "one two three\nunknown id line")]
    for i in range(300):
        lines = [rng.choice(["", " \t", "\r", sentence(rng, rng.randint(1, 6)), *common]) for _ in range(rng.randint(0, 12))]
        lines = [rng.choice([x, f" \t{x}\r", x.upper() if x.isascii() else x]) for x in lines]
        rows.append((rng.choice([i, 7]), "\n".join(lines)))
    return rows + [(1000, "\n"), (1001, "\n\n\n"), (1002, "Straße zehn\n" * 3000), (-9, "straße zehn")]


@pytest.mark.parametrize("most_bits, most_often", [(line_dedup.MOST_BITS, line_dedup.MOST_OFTEN), (64, 0)])
def test_lines_match_brute_force(spark, most_bits, most_often):
    """Whole filters, and one word that suspects everything; lookups broadcast or joined."""
    rows = line_rows()
    got = line_dedup.drop_repeats(table(spark, rows), most_bits=most_bits, most_often=most_often).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == order(lines_dropped(rows))
    assert all(r["kept"] is None or sha(r["kept"]) == r["kept_sha256"] for r in got) and sum(r["n_dropped"] for r in got) > 500


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_repeats(table(spark).limit(0)).count() == 0


def test_filters_never_miss_a_repeat_and_suspect_few_others(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('line number ', id, '\\nshared line number ', id % 10000) AS text").repartition(7)
    twice = line_dedup.suspects(df)
    suspected = lambda keys: held_by(twice, np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64))
    assert suspected([f"shared line number {i}" for i in range(0, n // 3, 7)]).all()
    assert suspected([f"line number {i}" for i in range(0, n, 7)]).mean() < 0.05


def test_filter_size_is_bounded():
    assert filter_words(10**12) * 64 == MOST_BITS
    assert 12 * 10**6 <= filter_words(10**6) * 64 <= 24 * 10**6


def test_key_filter_holds_its_keys(spark):
    df = spark.range(0, 100_000, 5).select((F.col("id") * 7919).alias("h")).repartition(5)
    words = key_filter(df, df.count())
    test = may_hold(spark, words)
    all_ = spark.range(100_000).select((F.col("id") % 5 == 0).alias("put"), test(F.col("id") * 7919).alias("hit"))
    n = {(r["put"], r["hit"]): r["count"] for r in all_.groupBy("put", "hit").count().collect()}
    assert n[True, True] == 20_000 and (True, False) not in n and n.get((False, True), 0) < 2_000
