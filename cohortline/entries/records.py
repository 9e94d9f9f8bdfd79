"""Operators on parts, documents, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import blank_to_null, crosswalk, fill_missing, keep_listed, list_items, missing_if, rule_group
from cohortline.operators import (
    any_prefix_flag,
    apply_rules,
    coalesce_segment,
    disagreement,
    duplicate_rules,
    earliest_answers,
    heavy_keys,
    normalize_labels,
    null_profile,
    pivot_answers,
    rule_coverage,
    screen_test_records,
    share_by_group,
    unmatched,
    value_counts,
    widen_rules,
)
from cohortline.session import configure
from cohortline.sources import table_from

RULE_KEYS = ["p_brand", "p_type"]
ROLES = {"user": "asker", "assistant": "answerer"}


def part(spark, folder):
    return table_from(configure(spark), folder, "part")


def conversations(spark, folder):
    return table_from(configure(spark), folder, "conversations")


def labelled(spark, folder):
    """Documents with their labels, NULL where a document has none."""
    docs = table_from(configure(spark), folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table_from(spark, folder, "labels"), "doc_id", "left")


def rules(spark, folder):
    """Small parts of some brands as rule rows: step 1 to 3 by size."""
    p = part(spark, folder).where(F.col("p_brand").like("Brand#1%") & (F.col("p_size") <= 10))
    step = F.when(F.col("p_size") <= 3, 1).when(F.col("p_size") <= 6, 2).otherwise(3)
    return p.select(*RULE_KEYS, step.alias("seq"), F.col("p_name").alias("product"))


def wide_rules(spark, folder):
    return widen_rules(rules(spark, folder), RULE_KEYS, "seq", "product", 3)


RULES_SQL = """
WITH r AS (SELECT p_brand, p_type, CASE WHEN p_size <= 3 THEN 1 WHEN p_size <= 6 THEN 2 ELSE 3 END AS seq, p_name AS product
  FROM part WHERE p_brand LIKE 'Brand#1%' AND p_size <= 10),
w AS (SELECT p_brand, p_type, min(product) FILTER (seq = 1) AS product1, min(product) FILTER (seq = 2) AS product2,
  min(product) FILTER (seq = 3) AS product3 FROM r GROUP BY 1, 2),
p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part)
"""


def rule_rows(spark, folder):
    return part(spark, folder).select("p_partkey", *RULE_KEYS, "p_size")


def looked_up(spark, folder):
    p = rule_rows(spark, folder)
    return apply_rules(p, wide_rules(spark, folder), RULE_KEYS, heavy_keys(p, RULE_KEYS))


def grouped_parts(spark, folder):
    p, brand = part(spark, folder), F.col("p_brand")
    group = rule_group(
        [(brand == "Brand#1", "House"), (brand.isin("Brand#2", "Brand#3"), "Partner"), (F.col("p_type").startswith("PROMO"), "Promotion"), (F.col("p_size") > 40, "Large")]
    )
    return p.select("p_partkey", group.alias("part_group"))


LABELLED_SQL = "WITH l AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def recoded(spark, folder):
    return labelled(spark, folder).select(
        "doc_id",
        missing_if("lang", ["de", "fr"]).alias("lang_known"),
        keep_listed("source", ["src0", "src1", "src2"]).alias("source_kept"),
        crosswalk("quality", {1: "good", 0: "poor"}).alias("quality_label"),
        crosswalk("toxic", {1: "yes"}, default="no").alias("toxic_label"),
    )


ENTRIES = {
    "normalize_labels": (
        lambda s, d: normalize_labels(conversations(s, d).select("conv_id", "turn", "role"), "role", ROLES, "role_id"),
        """SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'asker' WHEN 'assistant' THEN 'answerer' ELSE role END AS role_id FROM conversations""",
    ),
    "pivot_answers": (
        lambda s, d: pivot_answers(
            conversations(s, d), "conv_id", "role", "turn", {"system": "last_system", "user": "last_user", "assistant": "last_assistant"}, [F.min("turn").alias("first_turn")]
        ),
        """SELECT conv_id, max(turn) FILTER (role = 'system') AS last_system, max(turn) FILTER (role = 'user') AS last_user,
        max(turn) FILTER (role = 'assistant') AS last_assistant, min(turn) AS first_turn FROM conversations GROUP BY 1""",
    ),
    "earliest_answers": (
        lambda s, d: earliest_answers(conversations(s, d), "conv_id", "role", "turn", ["text"]),
        "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1",
    ),
    "rule_group": (
        grouped_parts,
        """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'House' WHEN p_brand IN ('Brand#2', 'Brand#3') THEN 'Partner'
        WHEN p_type LIKE 'PROMO%' THEN 'Promotion' WHEN p_size > 40 THEN 'Large' ELSE 'Other' END AS part_group FROM part""",
    ),
    "rule_lookup": (
        looked_up,
        f"{RULES_SQL} SELECT p.*, product1, product2, product3 FROM p LEFT JOIN w ON w.p_brand = p.p_brand AND w.p_type = p.p_type",
    ),
    "rule_coverage": (
        lambda s, d: rule_coverage(rule_rows(s, d), wide_rules(s, d), RULE_KEYS),
        f"""{RULES_SQL}, u AS (SELECT p_brand, p_type, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT coalesce(u.p_brand, w.p_brand) AS p_brand, coalesce(u.p_type, w.p_type) AS p_type, coalesce(n, 0) AS n,
        CASE WHEN u.p_brand IS NULL THEN 'right_only' WHEN w.p_brand IS NULL THEN 'left_only' ELSE 'both' END AS found_in
        FROM u FULL JOIN w ON w.p_brand = u.p_brand AND w.p_type = u.p_type""",
    ),
    "rule_unmatched": (
        lambda s, d: unmatched(rule_rows(s, d), wide_rules(s, d), RULE_KEYS),
        f"{RULES_SQL} SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.p_brand = p.p_brand AND w.p_type = p.p_type)",
    ),
    "rule_duplicates": (
        lambda s, d: duplicate_rules(rules(s, d), [*RULE_KEYS, "seq"]),
        f"{RULES_SQL} SELECT p_brand, p_type, seq, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1",
    ),
    "share_by_group": (
        lambda s, d: share_by_group(part(s, d), "p_brand", "p_type").withColumn("percent", F.round("percent", 6)),
        """SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand) * 100, 6) AS percent
        FROM part GROUP BY 1, 2""",
    ),
    "any_prefix_flag": (
        lambda s, d: any_prefix_flag(part(s, d), "p_brand", "p_type", ["PROMO", "ECON"], "has_promo"),
        """SELECT p_brand, max(CASE WHEN p_type LIKE 'PROMO%' OR p_type LIKE 'ECON%' THEN 1 ELSE 0 END) AS has_promo
        FROM part GROUP BY 1""",
    ),
    "list_items": (
        lambda s, d: table_from(configure(s), d, "pages").select(
            "page_id", *[c.alias(f"item{i}") for i, c in enumerate(list_items("html", 3, "<li><a[^>]*>([^<]+)</a></li>"), 1)]
        ),
        """SELECT page_id, nullif(trim(regexp_extract(html, '<li><a[^>]*>([^<]+)</a></li>', 1)), '') AS item1,
        nullif(trim(regexp_extract(html, '<li><a[^>]*>([^<]+)</a></li><li><a[^>]*>([^<]+)</a></li>', 2)), '') AS item2,
        nullif(trim(regexp_extract(html, '<li><a[^>]*>([^<]+)</a></li><li><a[^>]*>([^<]+)</a></li><li><a[^>]*>([^<]+)</a></li>', 3)), '') AS item3
        FROM pages""",
    ),
    "blank_to_null": (
        lambda s, d: labelled(s, d).select("doc_id", blank_to_null("lang", "de").alias("lang"), blank_to_null(F.substring("source", 4, 9), "0").alias("source_no")),
        """SELECT doc_id, nullif(lang, 'de') AS lang, nullif(nullif(substr(source, 4, 9), ''), '0') AS source_no FROM documents""",
    ),
    "fill_missing": (
        lambda s, d: fill_missing(labelled(s, d), ["quality", "toxic"]),
        f"""{LABELLED_SQL} SELECT doc_id, lang, source, n_chars, coalesce(CAST(quality AS VARCHAR), 'Missing') AS quality,
        coalesce(CAST(toxic AS VARCHAR), 'Missing') AS toxic FROM l""",
    ),
    "enrich_recode": (
        recoded,
        f"""{LABELLED_SQL} SELECT doc_id, CASE WHEN lang IN ('de', 'fr') OR lang IS NULL THEN 'Missing' ELSE lang END AS lang_known,
        CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'Missing' END AS source_kept,
        CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS quality_label, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS toxic_label FROM l""",
    ),
    "null_profile": (
        lambda s, d: null_profile(labelled(s, d), ["quality", "lang"]),
        f"""{LABELLED_SQL} SELECT CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS missing_quality, CASE WHEN lang IS NULL THEN 1 ELSE 0 END AS missing_lang,
        count(*) AS n FROM l GROUP BY 1, 2""",
    ),
    "coalesce_segment": (
        lambda s, d: value_counts(
            labelled(s, d).withColumn("segment", coalesce_segment(crosswalk("quality", {1: "good"}), blank_to_null("lang", "en"))), "segment"
        ),
        f"{LABELLED_SQL} SELECT coalesce(CASE WHEN quality = 1 THEN 'good' END, nullif(lang, 'en'), 'Missing') AS segment, count(*) AS n FROM l GROUP BY 1",
    ),
    "disagreement": (
        lambda s, d: disagreement(labelled(s, d), "quality", "toxic"),
        "SELECT quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality <> toxic GROUP BY 1, 2",
    ),
    "screen_records": (
        lambda s, d: screen_test_records(labelled(s, d).withColumn("is_toxic", F.col("toxic") == 1), "source", "src1", {"lang": "de"}, "is_toxic"),
        f"""{LABELLED_SQL} SELECT *, toxic = 1 AS is_toxic FROM l WHERE lang <> 'de' AND lower(source) NOT LIKE 'src1%' AND NOT coalesce(toxic = 1, FALSE)""",
    ),
}
