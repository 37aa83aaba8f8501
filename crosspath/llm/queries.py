"""Registered queries of the operators for training text, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exactdedup, hardnegatives, langid, linededup, mixing, pages, pii, prefixtrie, quality, sharding, simhash
from .common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; trained on the language labels of all documents."""
    docs = read(spark, sf_dir, "documents")
    languages, model = langid.train(docs)
    both = langid.from_documents(docs).unionByName(langid.from_pages(read(spark, sf_dir, "pages")), allowMissingColumns=True)
    return langid.identify(both, languages, model)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.perspectives(read(spark, sf_dir, "conversations"))
    return parts.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ","))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.verdicts(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (linededup.deduplicated(read(spark, sf_dir, "documents"))
            .select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mixed(read(spark, sf_dir, "documents"))
            .select(F.col("row.doc_id").alias("doc_id"), *mixing.MARGINS, "n_tokens", F.round("weight", 3).alias("weight"),
                    F.round("epochs", 6).alias("epochs"), F.round("probability", 7).alias("probability"), "kept"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(read(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicates(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_chat, op3_decontamination, op4_pii, op5_quality, op6_line_dedup, op7_sharding, op8_mixing, op9_main_text, op10_simhash,
    op11_hard_negatives, op12_prefix_trie, op13_exact_dedup)}
SQL = {"op2_chat": chat.sql(), "op6_line_dedup": linededup.sql(), "op8_mixing": mixing.sql(),
       "op11_hard_negatives": hardnegatives.SQL, "op12_prefix_trie": prefixtrie.sql(), "op13_exact_dedup": exactdedup.SQL}
