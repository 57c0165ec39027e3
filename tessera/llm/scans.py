"""Global running sums in DataFrame operations only, without a one-task window.

Rows are sorted into ranges once and written with the number of their range, so
that every later step sees the same ranges.  A running sum is then the sum of
the earlier ranges plus a window inside the range.  The order may end in a hash
or an id, so a hot group key is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import cut_small, parallelism

RANGE = "_scan_range"


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str, rows: int) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same `by` up to this one in `order`.

    Rows equal in `by` and `order` are taken one after the other in an arbitrary
    but, as they are written first, fixed sequence.  Null keys form a group.
    `rows` is about how many there are; it only sizes the files between.
    """
    spark = df.sparkSession
    keys = [F.col(b).asc_nulls_first() for b in by]
    ranged = df.repartitionByRange(parallelism(spark), *keys, *order).withColumn(RANGE, F.spark_partition_id())
    ranged = cut_small(ranged, rows)
    totals = ranged.groupBy(*by, RANGE).agg(F.sum(value).alias("_in"))
    earlier = Window.partitionBy(*by).orderBy(RANGE) if by else Window.orderBy(RANGE)
    totals = totals.select(*by, RANGE, F.coalesce(F.sum("_in").over(
        earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    same = F.lit(True)
    left = ranged.alias("l")
    right = totals.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(RANGE).alias("_r"), "_off")
    for i, b in enumerate(by):
        same = same & F.col(f"l.{b}").eqNullSafe(F.col(f"_k{i}"))
    joined = left.join(right, (F.col(f"l.{RANGE}") == F.col("_r")) & same)
    inside = Window.partitionBy(*by, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns]
    return joined.select(*[F.col(f"l.{c}") for c in kept], F.col(f"l.{RANGE}").alias(RANGE), "_off").withColumn(
        out, (F.col("_off") + F.sum(value).over(inside)).cast("bigint")).select(*kept, out)
