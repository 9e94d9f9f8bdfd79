"""The operators over the given tables, and the same questions in SQL where SQL can ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import align, ann, chat, decontaminate, fim, language, line_dedup, lm_score, mixing, near_dup, oracles, pii, substrings, token_counts
from cohortline.llm.common import keep, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark, sf_dir):
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "first")


def op2_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity")


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_counts.write(table(spark, sf_dir, "documents"), path)
    found = token_counts.count(spark, path)
    return found.select(token_counts.document_id(F.col("head")).alias("doc_id"), "n_tokens")


def op6_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat.read_back(keep(chat.format_windows(turns.unionByName(odd)), "chat"))


def op7_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(ann.build_index(vectors), vectors.where(F.col("vec_id") % 20 == 0))


def op8_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model)


def op10_lm_scoring(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_fim(spark, sf_dir):
    out = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_alignment(spark, sf_dir):
    return align.link_counts(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def pipeline(spark, sf_dir):
    import corpus_pipeline  # the stages are one file at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


LLM_ENTRIES = {f.__name__: f for f in (op1_near_dedup, op2_pii, op3_decontamination, op4_mixing, op5_token_counts, op6_chat, op7_nearest, op8_substring_dedup, op9_language_id, op10_lm_scoring, op11_fim, op12_alignment, op13_line_dedup, pipeline)}
LLM_SQL = {"op2_pii": oracles.PII, "op3_decontamination": oracles.LEAKS, "op8_substring_dedup": oracles.REPEATS, "op11_fim": oracles.MIDDLES, "op13_line_dedup": oracles.LINES}
