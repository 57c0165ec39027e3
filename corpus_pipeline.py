"""From raw documents to token ids on disk: rate, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of documents.  A stage works on all that its predecessor kept:

- quality classifier: documents whose probability of the top grade is under one
  half go; the model is fitted on the labelled ones among them;
- n-gram Jaccard join: of documents linked by five-word shingles at 0.8 the one
  with the smallest id stays;
- decontamination: spans of benchmark windows are cut out, texts mostly made of
  them go;
- mixing: documents stand as often as the mix of sources takes them;
- token output: ids are written in binary planes and reported as read back.

An empty table passes through as one; null texts are documents without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminated
from tessera.llm.jaccard_groups import one_of_each
from tessera.llm.mixing import mixed
from tessera.llm.ordinal import accepted, fit, quality_grade
from tessera.llm.rows import few_files, temporary
from tessera.llm.token_planes import token_file_digest


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return accepted(docs, fit(docs, ratings, grades=3), above=1, least=0.5)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few_files(one_of_each(docs, k=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = few_files(decontaminated(docs, items, window=10, max_share=0.5))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few_files(mixed(docs, weights=(1, 2, 3), max_copies=3))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return few_files(token_file_digest(docs, temporary(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"), end=2))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The first stage is a fitted model and the last needs a tokeniser: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the documents table, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = temporary(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
