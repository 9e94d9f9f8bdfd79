"""Survey answers: wording to ids, long to wide, rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.operators.dedupe import dedupe_first, dedupe_last
from cohortline.operators.skew import as_list, salted_join, small_side


def one_space(c: str | Column) -> Column:
    """Runs of white space as one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))


def literal_lookup(spark: SparkSession, entries: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A written-out map as a two-column frame.

    Keys are compared with white space normalised; two spellings that then coincide
    must agree on the value.
    """
    seen: dict[str, str] = {}
    for text, code in entries.items():
        norm = " ".join(text.split())
        if seen.setdefault(norm, code) != code:
            raise ValueError(f"two values for {norm!r}")
    return spark.createDataFrame(list(seen.items()), f"{key} string, {value} string")


def normalize_labels(df: DataFrame, text: str, lookup: Mapping[str, str], out: str) -> DataFrame:
    """Free text to id; text without an entry is kept as it is."""
    table = literal_lookup(df.sparkSession, lookup, "_text", out)  # a written-out constant
    joined = df.join(F.broadcast(table), one_space(text) == F.col("_text"), "left").drop("_text")
    return joined.withColumn(out, F.coalesce(out, text))


def pivot_answers(
    df: DataFrame, keys: str | Sequence[str], question: str, answer: str, values: Mapping[str, str] | Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """Long to wide: the largest answer per question, one column per listed value.

    ``values`` lists the questions, or maps question to output column.  One group-by with
    conditional maxima: map-side combined, one exchange, fixed schema.
    """
    names = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    cells = [F.max(F.when(F.col(question) == q, F.col(answer))).alias(name) for q, name in names.items()]
    return df.groupBy(*as_list(keys)).agg(*cells, *extra)


def attach_responses(answers: DataFrame, apps: DataFrame, person: str, question: str, when: str, app_order: str, app_tie: str | Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Latest answer per person and question, with the person's latest application.

    Both sides are cut to one row per key before the join, which gives the same row as
    joining first and ranking the pairs afterwards, without forming the pairs.
    """
    newest = dedupe_last(answers, [person, question], when, tie)
    application = dedupe_last(apps, person, app_order, app_tie)
    return newest.join(application, person)


def widen_rules(rules: DataFrame, keys: Sequence[str], seq: str, value: str, width: int, prefix: str = "product") -> DataFrame:
    """Rule rows (one per step) to one row per key with columns ``<prefix>1..n``.

    A repeated rule contributes its alphabetically first value.  A step that has no
    column (NULL or outside 1..``width``) fails the query: no rule is dropped silently.
    """
    lost = F.max(~F.coalesce(F.col(seq).between(1, width), F.lit(False)))
    error = F.raise_error(F.concat(F.lit(f"a rule step in {seq} has none of the {width} columns: "), F.to_json(F.struct(*keys))))
    wide = rules.groupBy(*keys).agg(
        lost.alias("_lost"), *[F.min(F.when(F.col(seq) == i, F.col(value))).alias(f"{prefix}{i}") for i in range(1, width + 1)]
    )
    # raised in the key columns, which every reader of the rules needs
    checked = {k: F.when(F.col("_lost"), error.cast(wide.schema[k].dataType)).otherwise(F.col(k)) for k in keys[:1]}
    return wide.withColumns(checked).drop("_lost")


def apply_rules(df: DataFrame, wide_rules: DataFrame, keys: Sequence[str], heavy: Sequence[int] = ()) -> DataFrame:
    """Left join on every key; rows without a rule keep NULL results.

    Few rule keys over many rows means heavy keys: a small rule table is broadcast once
    counted, a large one is joined with salting where ``heavy`` keys are given.
    """
    if not heavy:
        return df.join(small_side(wide_rules), list(keys), "left")
    return salted_join(df, wide_rules, keys, "left", heavy, [c for c in df.columns if c not in keys][:4])


def duplicate_rules(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule keys that occur more than once."""
    return rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmatched(df: DataFrame, wide_rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows no rule covers."""
    return df.join(small_side(wide_rules.select(*keys).distinct()), list(keys), "left_anti")


def rule_coverage(df: DataFrame, wide_rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both-way coverage per key combination: ``n`` rows and where the key occurs.

    Rows are counted per combination first, so the outer join runs on combinations only.
    """
    used = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_l", F.lit(1))
    known = wide_rules.select(*keys).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return used.join(known, list(keys), "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), side.alias("found_in"))


def earliest_answers(df: DataFrame, person: str, question: str, when: str, tie: Sequence[str] = ()) -> DataFrame:
    """First answer of each person to each question."""
    return dedupe_first(df, [person, question], when, tie)
