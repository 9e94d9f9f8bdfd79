"""Operators on documents: brute force on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from llm_helpers import SCHEMA, WORD, jaccard, sentence, shingles, table, texts
from pyspark.sql import functions as F

from cohortline.llm import decontaminate, language, lm_score, mixing, near_dup, pii, substrings, token_counts
from cohortline.llm.common import new_path


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [near_dup.HOT, 2])
def test_near_duplicates_match_brute_force(docs, monkeypatch, hot):
    """Also with long bands for nearly every bucket."""
    monkeypatch.setattr(near_dup, "HOT", hot)
    rows = texts()
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    bags = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    expected = collections.Counter((rows[i][0], least[find(i)]) for i in range(len(rows)))
    found = near_dup.classes(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in found) == expected
    wordless = sum(1 for b in bags if not b)
    assert sum(r["first"] for r in found) == len({find(i) for i in range(len(rows)) if bags[i]}) + wordless
    kept = near_dup.remove(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["first"] for r in found)


@pytest.mark.parametrize("most", [near_dup.MOST_TOKENS, 8, 0])
def test_rare_shingles_meet_every_similar_pair(spark, docs, monkeypatch, most):
    """Every pair at the threshold has a common bucket that leaves it room, however many shingles are counted; sizes and repeats differ."""
    monkeypatch.setattr(near_dup, "MOST_TOKENS", most)
    rng = random.Random(11)
    base = " ".join(rng.choices([f"w{k}" for k in range(40)], k=150)).split()
    kept = {0: " ".join(base), 1: "word " * 300, 2: "word " * 245, 3: "word " * 238}
    for i in range(4, 160):  # changed words, cut ends, repeated passages
        w = list(base[: rng.choice([150, 148, 140, 125])])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["changed", f"own{i}", "w1"])
        kept[i] = " ".join(w + rng.choice([[], w[:12], ["tail"] * 9]))
    kept = {i: t for t, i in {t: i for i, t in kept.items()}.items()}
    texts = spark.createDataFrame(list(kept.items()), "node long, text string")
    bags = {i: shingles(t) for i, t in kept.items()}
    buckets = collections.defaultdict(list)
    for r in near_dup.rare_buckets(texts, 0.8).collect():
        buckets[r["bucket"]].append((r["node"], sum(bags[r["node"]].values()), r["place"]))
    rows = [(*x, *y) for members in buckets.values() for x in members for y in members if x[0] < y[0]]
    rows = spark.createDataFrame(rows, "a long, sa long, pa long, b long, sb long, pb long")
    met = {(r["a"], r["b"]) for r in rows.where(near_dup.fits(0.8, ("sa", "pa"), ("sb", "pb"))).select("a", "b").distinct().collect()}
    similar = {(a, b) for a in kept for b in kept if a < b and jaccard(bags[a], bags[b]) >= 0.8}
    assert len(similar) > 500 and similar <= met


def test_checked_pairs_follow_the_size_of_a_group_of_unlinked_copies(spark, monkeypatch):
    """Copies of one text that are all just below the threshold: no all-pairs check, whatever their number."""
    rng = random.Random(12)
    base = sentence(rng, 150).split()
    counted = []

    def count(df, name):
        df = keep(df, name)
        if name == "pairs":
            counted[-1] += df.count()
        return df

    keep = near_dup.keep
    monkeypatch.setattr(near_dup, "keep", count)
    monkeypatch.setattr(near_dup, "HOT", 8)  # smaller buckets are compared whole
    for n in (150, 300):
        rows = [(0, " ".join(base))] + [(i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(14)] + base[74:])) for i in range(1, n)]
        assert 0.75 < jaccard(shingles(rows[1][1]), shingles(rows[2][1])) < 0.8 and 0.75 < jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8
        counted.append(0)
        found = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len({r["class_id"] for r in found}) == n
    assert counted[0] <= 2 * 150 and counted[1] <= 2 * 300, counted


def test_bag_min_hash_estimates_weighted_similarity():
    import numpy as np
    import pyarrow as pa

    a, b = "a b c d e f g h i j " * 3 + "k l m n o p q r s t", "a b c d e f g h i j " * 2 + "k l m n o p q r s t u v w x"
    row, key, weight, _ = near_dup.shingle_rows(pa.array([a, b, a]))
    same = [near_dup.signatures(row, key + np.uint64(s), weight, 3, 512) for s in range(3)]
    agree = np.mean([(x[0] == x[1]).mean() for x in same])
    assert abs(agree - jaccard(shingles(a), shingles(b))) < 0.05
    assert all((x[0] == x[2]).all() for x in same)


def test_repeated_passages_match_brute_force(docs):
    last = substrings.LAST_ID
    words = [(last if d is None else d, d, WORD.findall(t or "")) for d, t in texts()]
    first = {}
    for order, _, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, last), order)
    expected = collections.Counter()
    for order, doc, w in words:
        gone = [0] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order:
                gone[i : i + 50] = [1] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected[(doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in substrings.remove_repeats(docs).collect()) == expected
    assert sum(n for (_, _, n, _), k in expected.items()) > 0


def test_base_scores_and_a_lattice_that_counts_every_segmentation(docs):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(d, WORD.findall((t or "").translate(lower)) + [None]) for d, t in texts()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for limit in (1 << 20, 8):  # all words broadcast, and nearly all joined
        found = sorted(lm_score.score(docs, frequent=limit).collect(), key=lambda r: (r["n_tokens"], r["base_score"]))
        expected = sorted(
            ((d, held(d), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)) for d, w in tokens),
            key=lambda r: (r[2], r[5]),
        )
        assert collections.Counter(tuple(r)[:5] for r in found) == collections.Counter(r[:5] for r in expected)
        assert all(math.isclose(r["base_score"], e[5], rel_tol=1e-9) for r, e in zip(found, expected))
        assert all(r["score"] < 0 for r in found)
        scores = {r["n_tokens"]: r["score"] for r in found}
        if limit == 8:
            assert all(math.isclose(scores[k], v, rel_tol=1e-9) for k, v in before.items())
        before = scores

    model = lm_score.lattice(lm_score.VOCABULARY)
    table_ = dict(zip(model.names, model.values))

    def marginal(s):
        if not s:
            return 1.0
        if s[0] not in table_:
            out = math.exp(model.byte * len(s[0].encode())) * marginal(s[1:])
        else:
            out = 0.0
        return out + sum(math.exp(table_[s[:k]]) * marginal(s[k:]) for k in range(1, len(s) + 1) if s[:k] in table_)

    import numpy as np

    for word in ("the", "nation", "é", "x漢y", "…of"):
        data = np.frombuffer(word.encode(), np.uint8)
        log, expected = model.words(data, np.array([0]), np.array([len(data)]), np.array([2.0]))
        assert math.isclose(log[0], math.log(marginal("▁" + word)), rel_tol=1e-9)
        assert expected.sum() > 0


def test_scores_are_sums_over_all_segmentations(spark):
    """Whole short texts, known and unknown words: the lattice's own score and the word model, by brute force."""
    rows = [(i, t) for i, t in enumerate(["The cat sat", "a cat é x漢y", "cat cat of ab", "", None, "a dog", "of the…", "sat a a"] * 3)]
    found = {r["doc_id"]: r for r in lm_score.score(table(spark, rows)).collect()}
    model = lm_score.lattice(lm_score.VOCABULARY)
    given = dict(zip(model.names, model.values))

    def ways(s, piece, byte):
        """All segmentations of ``s``: (log probability, pieces used)."""
        if not s:
            return [(0.0, [])]
        steps = [(piece[s[:k]], s[:k]) for k in range(1, len(s) + 1) if s[:k] in piece]
        if s[0] not in piece:
            steps.append((byte * len(s[0].encode()), s[0]))
        return [(p + q, [x, *rest]) for p, x in steps for q, rest in ways(s[len(x) :], piece, byte)]

    def marginal(word, piece, byte):
        return sum(math.exp(p) for p, _ in ways("▁" + word, piece, byte))

    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = {d: WORD.findall((t or "").translate(lower)) for d, t in rows}
    counts = collections.Counter(w for d, ws in words.items() if not held(d) for w in ws)
    ends = sum(not held(d) for d in words)
    expected = collections.Counter()
    for w, c in counts.items():
        found_ways = ways("▁" + w, given, model.byte)
        whole = sum(math.exp(p) for p, _ in found_ways)
        for p, used in found_ways:
            for x in used:
                expected[x if x in given else ""] += c * math.exp(p) / whole * (1 if x in given else len(x.encode()))
    total = sum(expected.values()) + ends + lm_score.PRIOR
    learned = {x: math.log((expected[x] + lm_score.PRIOR * math.exp(v)) / total) for x, v in given.items()}
    byte = math.log((expected[""] + lm_score.PRIOR * lm_score.BYTE_SHARE) / total / 256)
    end = (ends + lm_score.PRIOR * math.exp(model.end)) / total
    tokens, kinds, seen = sum(counts.values()) + ends, len(counts) + 1, collections.Counter([*counts.values(), ends])
    discount = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else 0.75

    def log(c, m):
        return math.log10(max(c - discount, 0) / tokens + discount * kinds / tokens * m)

    for d, ws in words.items():
        plain = sum(math.log10(marginal(w, given, model.byte)) for w in ws) + model.end / math.log(10)
        score = sum(log(counts[w], marginal(w, learned, byte)) for w in ws) + log(ends, end)
        assert math.isclose(found[d]["lattice_score"], plain, rel_tol=1e-9), d
        assert math.isclose(found[d]["score"], score, rel_tol=1e-9), d


def test_lattice_scores_improve_on_the_training_rows_and_order_held_out_text(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the cat " * 3) for i in range(40)]
    rows += [(100 + i, "zqxv wqzk jjxq vvkz qqzx") for i in range(40) if zlib.crc32(str(100 + i).encode()) % 7 == 2]
    out = lm_score.score(table(spark, rows)).where("held_out").collect()
    per = lambda low: [r["score"] / r["n_tokens"] for r in out if (r["doc_id"] >= 100) == low]
    assert min(per(False)) > max(per(True))


def test_token_counts_through_flat_files(spark, docs):
    encode = token_counts.encoding(token_counts.TOKENIZERS, token_counts.VOCABULARY).encode_ordinary
    path = new_path(spark, "tokens")
    token_counts.write(docs, path)
    expected = collections.Counter((d, len(encode(t or ""))) for d, t in texts())
    for block in (64, 1 << 20):  # documents across many blocks, and within one
        found = token_counts.count(spark, path, block_bytes=block)
        rows = found.select(token_counts.document_id(F.col("head")).alias("d"), "n_tokens").collect()
        assert collections.Counter(tuple(r) for r in rows) == expected
    assert token_counts.header(-5)[0] == (-5) & 0x7FFF


def brute_pii(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in kinds]


PERSONAL = [
    "mail a.b@c.d_e@f.g and x@y.z.w.v, é😀 q%r@s-t.u",
    "ip 1.2.3.4.5.6.7.8 300.1.1.1 0000255.01.2.3 1.2.3.4444444444444444444444444444444444444444444",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111111 0000000000000",
    "phone +1 (988) 555-2485 +1 +12345678 +123456789 + 1 +1.4111111111111",
    "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 and GB82 WEST 1234 5698 7654 33",
    "my ssn 123-45-6789 but not 123-45-6789" + " far away" * 10 + " 987-65-4321",
    "a" * 20000 + "@" + ".a" * 5000,
    "1" * 20000 + " " + "1." * 5000,
    None,
    "",
]


def test_personal_data(spark):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(None, PERSONAL[0])]
    for r, (_, text) in zip(sorted(pii.find(table(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])), rows, strict=True):
        spans = brute_pii(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(s) for s in spans]
        base = [x for s in spans for x in s]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["spans"].split(",")[: len(base)] == (base or r["spans"].split(",")[:0])
    found = {r["doc_id"]: r["spans"] for r in pii.find(table(spark, rows)).collect()}
    assert found[4].count("iban:") == 2 and found[5].count("ssn:") == 2


CONTEXT = {
    "SSNs: 123-45-6789, 234-56-7890": "SSNs: [SSN], [SSN]",
    "Call 555-123-4567 or 555-765-4321": "Call [LOCALPHONE] or [LOCALPHONE]",
    "123-45-6789, 223-45-6789, 323-45-6789 (ssn)": "[SSN], [SSN], [SSN] (ssn)",
    "ssn" + "." * 37 + "123-45-6789": "ssn" + "." * 37 + "[SSN]",
    "ssn" + "." * 38 + "123-45-6789": "ssn" + "." * 38 + "123-45-6789",
    "ssn 000-00-00001, 223-45-6789": "ssn 000-00-00001, [SSN]",
    "ssn 123-45-6789223-45-6789": "ssn 123-45-6789223-45-6789",
    "call +49.30.12.34.567 now": "call [PHONE] now",
    "a@b.c, 1.2.3.4 é🙂 +123456789": "[EMAIL], [IP] é🙂 [PHONE]",
    "nothing": "nothing",
    "": "",
}


def test_context_reaches_over_other_matches_and_spans_are_cut_once(spark):
    rows = list(enumerate(CONTEXT))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, rows)).collect()}
    for i, text in rows:
        assert clean[i] == CONTEXT[text]
    odd = spark.createDataFrame([("mail a@b.c", "x", "y", "z")], "text string, _m0 string, `_SPANS` string, `__m0` string")
    out = pii.redact(odd)
    assert out.columns == odd.columns and tuple(out.first()) == ("mail [EMAIL]", "x", "y", "z")


def test_redaction_leaves_no_confirmed_span(spark):
    clean = pii.redact(table(spark, list(enumerate(PERSONAL))))
    assert clean.columns == table(spark, []).columns
    for r in clean.collect():
        assert not any(brute_pii(r["text"])), r["text"][:200]
    assert {r["doc_id"] for r in clean.where("text IS NULL").collect()} == {8}


def test_contamination_matches_brute_force(spark):
    rows = texts()
    base = dict((i, t) for i, t in rows if i is not None)
    part = base[10].split()
    items = [(1, " ".join(part[10:50])), (2, " ".join(part[60:80] + ["other"] + part[80:110])), (3, "one two three"), (4, None), (5, ""), (6, base[70][:900]), (7, " ".join(part[:20] + part[60:80]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(table(spark), bench).collect()}
    expected = {}
    for doc, text in rows:
        s = list(re.findall(r"[^\W_]+", (text or "").lower()))
        for item, t in items:
            w = re.findall(r"[^\W_]+", (t or "").lower())
            if not w or not s:
                continue
            size = len(w) if len(w) >= 5 else len(s)
            for at in range(max(len(s) - size, 0) + 1):
                sim = jaccard(shingles(" ".join(s[at : at + size])), shingles(" ".join(w)))
                if sim >= 0.8:
                    expected[doc, item] = max(sim, expected.get((doc, item), 0))
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], expected[k]) for k in found)
    left = decontaminate.remove(table(spark), bench)
    gone = {d for d, _ in expected}
    assert left.columns == table(spark).columns
    assert collections.Counter(r["doc_id"] for r in left.collect()) == collections.Counter(d for d, _ in rows if d not in gone) + collections.Counter({None: 1} if None in gone else {})


def test_mixture_meets_its_targets(spark, docs):
    out = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    total, open_, target = sum(sizes.values()), list(range(len(names))), {}
    while True:
        left = total - sum(target.values())
        want = {i: left * (i % 3 + 1) / sum(k % 3 + 1 for k in open_) for i in open_}
        over = [i for i in open_ if want[i] > 3 * sizes[names[i]]]
        target |= {i: 3 * sizes[names[i]] for i in over} if over else want
        if not over:
            break
        open_ = [i for i in open_ if i not in over]
    taken = collections.Counter()
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[names.index(r["source"])])
        taken[r["source"]] += r["taken"]
    assert len(out) == docs.count()
    assert all(abs(taken[s] - target[i]) <= 0.02 * target[i] + 3 for i, s in enumerate(names))
    again = mixing.mix(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    took = mixing.take(docs)
    assert took.columns[: len(docs.columns)] == docs.columns and took.where("mix_taken <= 0").count() == 0


def test_shards_pick_whole_blocks_by_quota():
    """Every block is taken whole or not at all, as many as the quota says, also where shards are smaller than a block."""
    import numpy as np
    import pandas as pd

    rng = random.Random(3)
    for block in (1, 7, 40):
        for extra in (0, 1, 9, 10**6):
            size = [rng.choice([0, 1, 5, 90, 300]) for _ in range(30)]
            whole = sum(size)
            extra = min(extra, -(-whole // block))
            frame = pd.DataFrame({"source": None, "shard": range(30), "words": size, "extra": extra}).sample(frac=1, random_state=1)
            out = mixing.shard_quotas(block, 5)(frame)
            taken, at = np.zeros(whole, int), 0
            for r, n in zip(out.to_dict("records"), size):
                assert r["start"] == at
                for low, high in ((r["a"], r["b"]), (r["c"], r["d"]), (r["e"], r["f"])):
                    taken[max(low, at) : max(min(high, at + n), max(low, at))] += 1
                at += n
            blocks = [set(taken[k : k + block]) for k in range(0, whole, block)]
            assert all(len(b) == 1 and b <= {0, 1} for b in blocks)
            assert sum(max(b) for b in blocks) == extra == out["quota"].sum()


def test_mixture_fills_small_sources(spark):
    """Also where a block of the whole mix is larger than a source's shards, or than the source."""
    counts = {"a": (4, 25), "b": (400, 500), "c": (300, 400), "d": (1, 3)}
    rows = [(f"{s}{i}", "w " * n, s) for s, (k, n) in counts.items() for i in range(k)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string"), blocks=50).collect()
    target, taken = {r["source"]: r["target"] for r in out}, collections.Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and target["a"] == 300 and target["d"] == 9
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in counts), (taken, target)


def test_sainte_lague():
    assert list(mixing.sainte_lague([53, 24, 23], 7)) == [3, 2, 2]
    assert list(mixing.sainte_lague([1, 1, 1], 2)) == [1, 1, 0]
    assert list(mixing.sainte_lague([10, 1], 10, [4, 9])) == [4, 6]
    assert list(mixing.sainte_lague([], 3)) == [] and list(mixing.sainte_lague([0, 0], 3)) == [0, 0]


def test_language_of_documents_and_pages(spark):
    words = {"en": "the cat and the dog were running through green fields", "de": "der hund und die katze liefen über die grünen wiesen", "fr": "le chien et le chat couraient à travers les champs verts"}
    rows = [(i, words[lang] + f" {i}", lang) for i in range(60) for lang in words]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(labelled)
    assert model[0] == ["de", "en", "fr"]
    held = [(1, "the dogs and cats run", "en", "a"), (2, "die katze und der hund", None, None), (3, "les chats et les chiens", "xx", "b"), (4, None, "en", "a"), (5, "123 !!", "en", "a"), (5, "123 !!", "en", "a"), (None, "the cat", "en", "a"), (6, "", None, None)]
    docs = table(spark, [(i, t) for i, t, _, _ in held]).drop("lang", "source", "n_chars").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter([1, 2, 3, None])
    pages = spark.createDataFrame(
        [(1, "https://x.example.de/a", f"<html lang='de'><script>the the</script><p>{words['de']}</p></html>"), (2, None, None), (3, "nonsense", "<p>the cat and the dog</p>"), (4, "http://a.fr:80/", "<html><!-- the --></html>")],
        "page_id long, url string, html string",
    )
    out = {r["page_id"]: (r["language"], r["accepted"]) for r in language.identify_pages(pages, model).collect()}
    assert out == {1: ("de", True), 2: ("und", False), 3: ("en", True), 4: ("und", False)}


def spoken(rng, words, n):
    return " ".join(rng.choice(words.split()) for _ in range(n))


SPEECH = {
    "en": "the and of that with from this which have were their would there about when them other could time water people through where before right should between never",
    "de": "der die und nicht mit einer auch sich werden zwischen immer noch schon durch gegen unter wieder haben wurde zeit wasser leute warum nichts kinder sprache straße",
    "fr": "le les des une dans pour avec cette mais nous vous leur sont aussi entre toujours encore contre eau temps gens pourquoi rien enfants langue maison être jamais",
}
FOREIGN = {
    "fi": "ja oli että mutta kuin hänen jotka myös vain niin kaikki sitten koska ihmiset vesi aika talossa kieli lapset miksi mitään aina vielä välillä",
    "pl": "jest nie się przez który tylko może jeszcze między wszystko zawsze woda czas ludzie dlaczego nic dzieci język dom gdzie przed powinien",
}


def test_text_in_none_of_the_languages_is_rejected(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, SPEECH[lang], rng.randint(5, 80)), lang) for i in range(300) for lang in SPEECH]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [(i, spoken(rng, SPEECH[lang], 5 + i % 60), lang) for i in range(100) for lang in SPEECH]
    foreign = [(1000 + i, spoken(rng, FOREIGN[lang], 40), "en") for i in range(30) for lang in FOREIGN]
    noise = [(2000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)), "en") for i in range(60)]
    docs = spark.createDataFrame([(*r, "s") for r in clean + foreign + noise + [(3000, "жил был у бабушки серенький козлик", None)]], "doc_id long, text string, lang string, source string")
    kept = collections.Counter(r["doc_id"] for r in language.keep_identified(docs, model).collect())
    assert kept == collections.Counter(i for i, _, _ in clean)


@pytest.mark.parametrize("sample", [language.SAMPLE, 200])
def test_rare_languages_are_learned(spark, sample):
    """Here under 0.2% of the trigrams; also when only part of the rows is learned from."""
    rng = random.Random(4)
    rows = [(i, spoken(rng, SPEECH[lang], 120), lang) for i in range(400) for lang in SPEECH]
    rows += [(5000 + i, spoken(rng, FOREIGN["fi"], 12), "fi") for i in range(15)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=sample)
    assert model[0] == ["de", "en", "fi", "fr"]
    docs = [(i, spoken(rng, FOREIGN["fi"] if i % 2 else SPEECH["en"], 30), None, None) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    null = F.lit(None).cast("string")
    out = language.identify(docs, model, F.col("text"), null, null, null).collect()
    assert all(r["__accepted"] and r["__language"] == ("fi" if r["doc_id"] % 2 else "en") for r in out)


def test_language_sample_holds_copies_once(spark):
    """Whatever text a third of the rows shares."""
    for hot in range(8):
        rows = [("en", f"text {i}") for i in range(2000)] + [("en", f"copy {hot}")] * 1000
        rows = language.sampled(spark.createDataFrame(rows, "label string, text string"), 200).collect()
        assert 100 <= len(rows) <= 300 and len(set(rows)) == len(rows)


def test_host_prior_decides_where_the_text_cannot(spark):
    labelled = spark.createDataFrame([(1, "abc abc abc", "aa"), (2, "abc abc abd", "bb")] * 20, "doc_id long, text string, lang string")
    model = language.train(labelled)
    rows = [(i, "abd abd abd abd", "b") for i in range(50)] + [(i, "abc abc abc abc", "a") for i in range(50)] + [(900, "qqq qq", "a"), (901, "qqq qq", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    out = language.identify(docs, model, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("host"))
    found = {r["doc_id"]: r["__language"] for r in out.where("doc_id >= 900").collect()}
    assert found == {900: "aa", 901: "bb"}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert near_dup.classes(empty).count() == near_dup.remove(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert lm_score.score(empty).count() == 0
    assert pii.find(empty).count() == pii.redact(empty).count() == 0
    assert decontaminate.matches(empty, bench).count() == decontaminate.remove(empty, bench).count() == 0
    assert decontaminate.matches(table(spark), bench.where("false")).count() == 0
    assert mixing.mix(empty).count() == mixing.take(empty).count() == 0
    assert language.train(empty)[0] == []
    assert language.keep_identified(table(spark), language.train(empty)).count() == 0
    path = new_path(spark, "tokens")
    token_counts.write(empty, path)
    assert token_counts.count(spark, path).count() == 0
