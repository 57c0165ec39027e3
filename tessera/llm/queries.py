"""The registered queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.decontaminate import benchmark_matches
from tessera.llm.fertility import fertility_rules
from tessera.llm.fill_middle import fill_in_middle, restored
from tessera.llm.html_text import extract_main_text
from tessera.llm.jaccard_groups import linked_components
from tessera.llm.mixing import mixed_counts
from tessera.llm.ordinal import fit, quality_grade, scored
from tessera.llm.pivot_index import near_vectors
from tessera.llm.rows import few_files, temporary
from tessera.llm.substring_dedup import drop_repeated_windows
from tessera.llm.suffix_dedup import drop_repeated_bytes
from tessera.llm.token_counts import token_counts
from tessera.llm.token_planes import token_file_digest
from tessera.llm.turn_repair import damaged, repair_summary

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query("op2_substring_dedup", oracles.OP2)
def op2_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = few_files(drop_repeated_windows(_table(spark, root, "documents"), window=20))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_decontaminate", oracles.OP3)
def op3_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    found = benchmark_matches(_table(spark, root, "documents"), _table(spark, root, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_mixing", oracles.OP4)
def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    counts = few_files(mixed_counts(_table(spark, root, "documents"), weights=(1, 2, 3), max_copies=3))
    return counts.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = few_files(drop_repeated_bytes(_table(spark, root, "documents"), length=400))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return token_counts(_table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_token_planes")
def op9_token_planes(spark: SparkSession, root: str) -> DataFrame:
    return few_files(token_file_digest(_table(spark, root, "documents"), temporary(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"), end=2))


@query("op1_fertility")
def op1_fertility(spark: SparkSession, root: str) -> DataFrame:
    return fertility_rules(_table(spark, root, "documents"))


@query("op10_html_text")
def op10_html_text(spark: SparkSession, root: str) -> DataFrame:
    return extract_main_text(_table(spark, root, "pages"))


@query("op6_jaccard_join", oracles.OP6)
def op6_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return few_files(linked_components(_table(spark, root, "documents"), k=4, percent=85))


@query("op5_ordinal_quality")
def op5_ordinal_quality(spark: SparkSession, root: str) -> DataFrame:
    docs, labels = _table(spark, root, "documents"), _table(spark, root, "labels")
    ratings = labels.select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = scored(docs, fit(docs, ratings, grades=3))
    good = F.element_at("tails", 2)
    return out.select("doc_id", "expected_grade", F.element_at("tails", 1).alias("p_not_toxic"), good.alias("p_good"),
                      (good >= 0.5).alias("kept"))


@query("op11_fill_middle", oracles.OP11)
def op11_fill_middle(spark: SparkSession, root: str) -> DataFrame:
    out = fill_in_middle(_table(spark, root, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query("op12_pivot_near_dup")
def op12_pivot_near_dup(spark: SparkSession, root: str) -> DataFrame:
    return few_files(near_vectors(_table(spark, root, "embeddings"), cosine=0.9))


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, root: str) -> DataFrame:
    return few_files(repair_summary(damaged(_table(spark, root, "conversations")), stands=F.col("stands")))
