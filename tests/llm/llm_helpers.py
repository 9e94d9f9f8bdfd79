"""Small documents with every awkward case, and brute-force counterparts."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# clashing names: what operators might call columns of their own
EXTRA = ["hash", "node", "key", "size", "label", "rank", "item", "shard", "tokens", "row_id", "value", "h", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts():
    """(id, text): nulls, empties, short, repeated, near copies, shared passages, long ones."""
    rng = random.Random(5)
    base, passage = [sentence(rng, 120) for _ in range(6)], sentence(rng, 60)
    rows = [(None, base[0]), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "...!?")]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t) for i, t in enumerate(base[:3])]  # exact copies
    for i in range(12):  # near copies: one word changed, or a tail added
        w = base[i % 4].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((40 + i, " ".join(w + (["tail"] if i % 2 else []))))
    rows += [(60 + i, f"{sentence(rng, 20)} {passage} {sentence(rng, 15)}") for i in range(5)]
    rows += [(70, sentence(rng, 6000)), (71, "x" * 30000), (72, "é ü ñ " * 40), (73, "word " * 300), (-5, base[5] + " end")]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ["en", "de", None][k % 3], ["s1", "s2", None, "s10"][k % 4], None if t is None else len(t), *["z"] * len(EXTRA)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def shingles(text):
    w = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (text or "").lower()).split()
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def jaccard(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)
