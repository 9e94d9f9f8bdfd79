"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The posterior of a language is proportional to the product of

- the text's likelihood under character trigrams (hashed to ``BUCKETS`` buckets, add-half smoothing),
  learned from a sample of at most about ``SAMPLE`` distinct labelled texts, as many of each label at most, so that
  rare labels are learned as well and none is left out; long texts count as ``EVIDENCE`` trigrams,
  as neighbouring trigrams are not independent;
- the declared language of the markup, right with probability ``DECLARED`` where it is known;
- the prior of the host, smoothed towards the prior of its address suffix, and that towards the
  whole: (n + STRENGTH * parent) / (N + STRENGTH).  The counts come from grouped
  aggregation over all rows, by the language of their text alone.

A row is accepted if its text has letters, its best language has a posterior of at least
``CERTAIN`` and its text fits that language.  The mean log likelihood of its trigrams fits unless
it is below that of none of these languages, for which every bucket is as likely, or

- nearer to what the labelled rows of the language get from the best other language, the stand-in
  for a language without labels, than a text with ``PART`` of its trigrams in the language, and also
- below nearly all labelled rows of the language: ``SPREAD`` standard deviations under their mean,
  the deviation being that of whole rows and, for short texts, of single trigrams.

Null or empty text, or text without letters, gets the language ``und`` and is not
accepted.  A null host, suffix or declared language adds what is known of rows like it, or nothing.  Rows
are never merged: repeated rows and null ids each get their result, and all columns are passed on.
Without labelled rows every row is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import flat, keep, pieces, short_batches

BUCKETS_LOG = 14
BUCKETS = 1 << BUCKETS_LOG
SAMPLE = 20_000
EVIDENCE = 200
DECLARED = 0.9
STRENGTH = 20.0
CERTAIN = 0.5
PART = 0.25  # texts of several languages stay
SPREAD = 4.0
DRAWS = 1 << 40
UNIFORM = -float(np.log(BUCKETS))
MOST_HOSTS = 100_000

LETTER = np.zeros(0x250, bool)
for _c in range(0x250):
    LETTER[_c] = chr(_c).isalpha()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every trigram whose middle is a letter."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    letter = (points >= 0x250) | LETTER[np.minimum(points, 0x24F)]
    points = np.where(letter, points, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    good = letter[1:-1] & (row[:-2] == row[2:])
    mixed = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BUCKETS_LOG)).astype(np.int64)[good], row[:-2][good]


def count_rows(batches):
    """(label, bucket, count) of each batch."""
    for batch in pieces(batches, "text"):
        labels = batch.column("label").dictionary_encode()
        bucket, row = trigrams(batch.column("text"))
        code = np.asarray(labels.indices)[row]
        size = len(labels.dictionary) * BUCKETS
        counts = np.bincount(code * BUCKETS + bucket, minlength=size)
        spot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [labels.dictionary.take(pa.array(spot // BUCKETS)), pa.array(spot % BUCKETS), pa.array(counts[spot])], ["label", "bucket", "n"]
        )


def fit_rows(names: list[str], table: np.ndarray):
    """(label's number, rows, sum, squares) of each batch: the mean log likelihood of a row's trigrams in its language, learned without that row."""
    whole = table.sum(0)
    number = {name: i for i, name in enumerate(names)}

    def run(batches):
        for batch in pieces(batches, "text"):
            bucket, row = trigrams(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            own = np.array([number.get(x, 0) for x in batch.column("label").to_pylist()], np.int64)
            _, spot, times = np.unique(row * BUCKETS + bucket, return_inverse=True, return_counts=True)
            left = np.maximum(table[bucket, own[row]] - times[spot], 0.5)
            logs = np.log(left / np.maximum(whole[own] - n, BUCKETS / 2)[row])
            mean = np.bincount(row, weights=logs, minlength=batch.num_rows) / np.maximum(n, 1)
            for i in np.unique(own[n > 0]):
                x = mean[(n > 0) & (own == i)]
                yield pa.RecordBatch.from_pydict({"i": [int(i)], "n": [len(x)], "sum": [float(x.sum())], "squares": [float((x * x).sum())]})

    return run


def floors(rows: DataFrame, counts: pd.DataFrame, names: list[str], table: np.ndarray) -> np.ndarray:
    """For every language the level of texts partly in it, and the mean and the deviations of its rows and of its trigrams."""
    found = rows.mapInArrow(fit_rows(names, table), "i long, n long, sum double, squares double").groupBy("i")
    found = {r["i"]: r for r in found.agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")]).collect()}
    logs, out = np.log(table / table.sum(0)), np.zeros((len(names), 4))
    for i, (_, mine) in enumerate(counts.groupby("label", sort=True)):
        n, own = mine["n"].to_numpy(float), logs[mine["bucket"].to_numpy()]
        by = n @ own / n.sum()
        mean = found[i]["sum"] / found[i]["n"]
        rows_sd = max(found[i]["squares"] / found[i]["n"] - mean * mean, 0.0) ** 0.5
        out[i] = PART * mean + (1 - PART) * max([UNIFORM, *np.delete(by, i)]), mean, rows_sd, (n @ (own[:, i] - by[i]) ** 2 / n.sum()) ** 0.5
    return out


def fits(mean: np.ndarray, n: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether texts of ``n`` trigrams with these means, a column for each language, are in the language."""
    partly, usual, rows_sd, sd = floor.T
    least = usual - SPREAD * np.sqrt(rows_sd**2 + sd**2 / np.clip(n, 1, EVIDENCE)[:, None])
    return mean >= np.maximum(np.minimum(partly, least), UNIFORM)


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows at most, chosen by hash among the distinct texts of each label, and of each label as many at most."""
    sizes = rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()
    most = sample / max(len(sizes), 1)
    rates = rows.sparkSession.createDataFrame([(r["label"], int(DRAWS * min(1.0, most / max(r["n"], 1)))) for r in sizes], "_label string, _rate long")
    drawn = (rows["label"] == rates["_label"]) & (F.pmod(F.xxhash64("text"), F.lit(DRAWS)) < rates["_rate"])
    return rows.join(F.broadcast(rates), drawn).select("label", "text").dropDuplicates()


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE):
    """Languages, log probabilities of the buckets and floors, from a sample of at most about ``sample`` distinct texts."""
    rows = labelled.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where(F.col("label").isNotNull())
    short_batches(labelled.sparkSession)
    rows = keep(sampled(rows, sample), "language-sample")
    counts = rows.mapInArrow(count_rows, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.toPandas()  # languages of a bounded sample times buckets
    names = sorted(counts["label"].unique())
    table = np.full((BUCKETS, len(names)), 0.5)
    for i, (_, mine) in enumerate(counts.groupby("label", sort=True)):
        table[mine["bucket"].to_numpy(), i] += mine["n"].to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32), floors(rows, counts, names, table)


def evidence(model) -> callable:
    """A UDF: the log likelihood of a text in every language and whether it fits, null for a text without letters."""
    names, table, floor = model

    @F.pandas_udf("logs array<double>, fits array<boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        logs, good = [], []
        for batch in pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], "text"):
            bucket, row = trigrams(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            sums = np.stack([np.bincount(row, weights=table[bucket, i], minlength=batch.num_rows) for i in range(len(names))], 1) if names else np.zeros((batch.num_rows, 0))
            mean = sums / np.maximum(n, 1)[:, None]
            scaled = mean * np.minimum(n, EVIDENCE)[:, None]
            logs += [list(x) if k and names else None for x, k in zip(scaled, n, strict=True)]
            good += [list(x) if k and names else None for x, k in zip(fits(mean, n, floor), n, strict=True)]
        return pd.DataFrame({"logs": pd.Series(logs, dtype=object), "fits": pd.Series(good, dtype=object)})

    return run


def smoothed(counts: Column, parent: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(counts, parent, lambda n, p: (n + F.lit(STRENGTH) * p) / (whole + F.lit(STRENGTH)))


def identify(df: DataFrame, model, text: Column, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """All rows and columns of ``df`` with ``__language``, ``__posterior`` and ``__accepted``."""
    names = model[0]
    if not names:
        return df.withColumns({"__language": F.lit("und"), "__posterior": F.lit(None).cast("double"), "__accepted": F.lit(False)})
    size = len(names)
    short_batches(df.sparkSession)
    marked = df.withColumn("__told", evidence(model)(F.coalesce(text, F.lit("")))).withColumns(
        {
            "__evidence": F.col("__told.logs"),
            "__declared": F.lower(declared),
            "__suffix": F.coalesce(F.lower(suffix), F.lit("")),
            "__host": F.coalesce(F.lower(host), F.lit("")),
        }
    )
    # priors by grouped aggregation: host within suffix within all
    best = F.array_position("__evidence", F.array_max("__evidence")) - 1
    votes = marked.select("__suffix", "__host", best.alias("best"))
    add = lambda c, i: F.sum(F.when(F.col(c) == i, 1.0).otherwise(0.0))
    by_host = votes.groupBy("__suffix", "__host").agg(F.array(*[add("best", i) for i in range(size)]).alias("n"))
    by_host = keep(by_host, "hosts")
    by_suffix = by_host.groupBy("__suffix").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(size)]).alias("s"))
    overall = np.array(by_host.agg(*[F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0.0)) for i in range(size)]).first(), float)
    overall = (overall + STRENGTH / size) / (overall.sum() + STRENGTH)
    top = F.array(*[F.lit(float(x)) for x in overall])
    by_suffix = by_suffix.select(F.col("__suffix").alias("_s"), smoothed(F.col("s"), top).alias("p"))
    priors = by_host.join(by_suffix, by_host["__suffix"] == by_suffix["_s"]).select(
        F.col("__suffix").alias("__s"), F.col("__host").alias("__h"), smoothed(F.col("n"), F.col("p")).alias("__prior")
    )
    if by_host.count() <= MOST_HOSTS:
        priors = F.broadcast(priors)
    joined = marked.join(priors, (marked["__suffix"] == priors["__s"]) & (marked["__host"] == priors["__h"]), "left")

    known = F.col("__declared").isin(names)
    logs = []
    for i, name in enumerate(names):
        says = F.when(known, F.when(F.col("__declared") == name, DECLARED).otherwise((1 - DECLARED) / max(size - 1, 1))).otherwise(1.0)
        logs.append(F.get("__evidence", F.lit(i)) + F.log(says) + F.log(F.get("__prior", F.lit(i))))
    out = joined.withColumn("__logs", F.array(*logs)).withColumn("__best", F.array_max("__logs"))
    total = F.aggregate("__logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("__best")))
    spot = (F.array_position("__logs", F.col("__best")) - 1).cast("int")
    chosen = F.get(F.array(*[F.lit(n) for n in names]), spot)
    out = out.withColumns(
        {
            "__language": F.when(F.col("__evidence").isNull(), F.lit("und")).otherwise(chosen),
            "__posterior": F.when(F.col("__evidence").isNotNull(), 1 / total),
        }
    )
    out = out.withColumn("__accepted", F.coalesce((F.col("__posterior") >= CERTAIN) & F.get("__told.fits", spot), F.lit(False)))
    return out.select(*[out[c] for c in df.columns], "__language", "__posterior", "__accepted")


# --- pages and documents ---------------------------------------------------------------


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, "&[#a-zA-Z0-9]+;", " ")


def declared_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)\.?$", 1), F.lit(""))


def identify_pages(pages: DataFrame, model) -> DataFrame:
    """(page_id, language, posterior, accepted) of every page."""
    host = host_of(F.col("url"))
    rows = pages.select("page_id", page_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), host.alias("host"))
    rows = rows.withColumn("suffix", suffix_of(F.col("host")))
    out = identify(rows, model, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"))
    return out.select("page_id", F.col("__language").alias("language"), F.col("__posterior").alias("posterior"), F.col("__accepted").alias("accepted"))


def keep_identified(docs: DataFrame, model) -> DataFrame:
    """The documents whose language is certain, with all their columns.

    The declared language is their ``lang``, the host their ``source``.
    """
    out = identify(docs, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    return out.where("__accepted").select(*docs.columns)
