"""Value-driven typing of text columns, and label coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def typed_items(raw: DataFrame, id_col: str, drop: str = "(?i)^diagnosis") -> DataFrame:
    """Text columns to doubles where any value parses; one profiling pass."""
    import re

    items = [c for c in raw.columns if c != id_col and not re.search(drop, c)]
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    parsed = raw.agg(*[F.count(number(c)).alias(c) for c in items]).first()
    return raw.select(id_col, *[(number(c) if parsed[c] else F.col(c)).alias(c) for c in items])


def lenient_labels(raw: DataFrame, labels: Sequence[str]) -> DataFrame:
    """NULL and text become 0, numbers are clamped to 0 and 1."""
    clamp = lambda c: F.least(F.greatest(F.coalesce(F.expr(f"try_cast(`{c}` as int)"), F.lit(0)), F.lit(0)), F.lit(1))
    return raw.withColumns({c: clamp(c) for c in labels})


def check_labels(raw: DataFrame, labels: Sequence[str]) -> None:
    """Raise unless every label holds only 0, 1 or NULL."""
    bad = lambda c: F.sum((F.col(c).isNotNull() & ~F.col(c).cast("double").isin(0.0, 1.0)).cast("int"))
    facts = raw.agg(*[x for c in labels for x in (bad(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    for c in labels:
        if facts[f"n_{c}"]:
            raise ValueError(f"label {c} is not 0/1: values from {facts[f'lo_{c}']} to {facts[f'hi_{c}']}")


def binarise(df: DataFrame, columns: Sequence[str], cutoff: float = 0.5) -> DataFrame:
    """Columns within [0, 1] are cut at the threshold, others at zero."""
    facts = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for c in columns:
        lo, hi = facts[f"lo_{c}"], facts[f"hi_{c}"]
        unit = lo is not None and lo >= 0 and hi <= 1
        out[c] = (F.col(c) >= cutoff if unit else F.col(c) > 0).cast("int")
    return df.withColumns(out)


def unique_ids(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Later copies of an id get a numeric suffix.

    Only repeated ids are numbered, so unique ids skip the window.
    """
    from pyspark.sql import Window

    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col)
    single = df.join(repeated, id_col, "left_anti")
    rn = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    many = df.join(repeated, id_col, "left_semi").withColumn("_k", rn)
    named = F.when(F.col("_k") > 0, F.concat_ws(".", F.col(id_col).cast("string"), F.col("_k").cast("string"))).otherwise(
        F.col(id_col).cast("string"))
    return single.withColumn(id_col, F.col(id_col).cast("string")).unionByName(many.withColumn(id_col, named).drop("_k"))
