"""Views of the driver tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.labels import label_sets
from tessera.sources.tables import table


def order_labels(spark: SparkSession, root: str, label: str = "p_type") -> DataFrame:
    """Subjects are orders with at least one line; labels come from their parts."""
    lines = table(spark, root, "lineitem", "l_orderkey", "l_partkey")
    parts = table(spark, root, "part", "p_partkey", label)
    long = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.col(label).alias("label"))
    return label_sets(long, "id", "label")


def assigned_orders(spark: SparkSession, root: str, label: str = "p_type") -> DataFrame:
    """(id, labels, cluster) with the order priority as the given cluster."""
    orders = table(spark, root, "orders", "o_orderkey", "o_orderpriority")
    sets = order_labels(spark, root, label)
    return sets.join(orders, F.col("id") == F.col("o_orderkey")).select(
        "id", "labels", F.col("o_orderpriority").alias("cluster"))


def scored_documents(spark: SparkSession, root: str) -> DataFrame:
    """(id, y, s): labelled documents with a score in (0, 1) from their length."""
    docs = table(spark, root, "documents", "doc_id", "n_chars")
    labels = table(spark, root, "labels", "doc_id", "quality")
    x = F.ln(F.col("n_chars").cast("double") + 1.0)
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("y"),
        F.round(x / (x + F.lit(4.0)), 9).alias("s"))


def embedded(spark: SparkSession, root: str) -> DataFrame:
    """(id, vec, cluster)."""
    return table(spark, root, "embeddings", "vec_id", "embedding", "label").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("bigint").alias("cluster"))
