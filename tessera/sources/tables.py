"""Parquet tables by name, with the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
