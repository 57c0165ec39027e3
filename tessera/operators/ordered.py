"""Global ordered scans without a one-task window.

A window over a whole table runs in one task.  Here rows are first collapsed to
distinct values (which also removes hot values, map-side), cut into value ranges
at approximate quantiles, scanned inside each range, and shifted by the totals
of the ranges before.  The split points decide only the balance of the work,
never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, parallelism

BUCKET = "_range"


def _split_points(df: DataFrame, value: str, ranges: int) -> list[float]:
    probs = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(value, probs, 1 / (4 * ranges)) if probs else []
    return [v for v in found if not math.isinf(v)]


def ranges_for(table: DataFrame, rows_per_range: int = 50_000) -> int:
    """Enough ranges that one holds a bounded number of rows, few for a small table."""
    n = table.count()
    return max(1, min(parallelism(table.sparkSession), math.ceil(n / 64)), math.ceil(n / rows_per_range))


def _cut(df: DataFrame, value: str, points: Sequence[float], out: str) -> DataFrame:
    if not points:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *sorted(set(points)), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def with_ranges(df: DataFrame, value: str, ranges: int | None = None, tie: str | None = None,
                sketch: DataFrame | None = None) -> DataFrame:
    """Add the index of the value range each row falls in.

    `sketch` is a cheaper table to take the split points from, such as the raw
    rows behind an aggregate.

    With `tie` (a numeric id) rows stay single and equal values are ordered by
    it: a value heavy enough to fill a range gets ranges of its own, cut by id.
    """
    ranges = ranges or parallelism(df.sparkSession)
    points = _split_points(df if sketch is None else sketch, value, ranges)
    if tie is None:
        return _cut(df, value, points, BUCKET)
    heavy = sorted({v for v in points if points.count(v) > 1})
    cut = _cut(df, value, [*points, *[math.nextafter(v, math.inf) for v in heavy]], BUCKET)
    if not heavy:
        return cut
    hot = F.col(value).isin(heavy)
    ids = _split_points(df.where(hot).select(F.col(tie).cast("double").alias("_t")), "_t", ranges)
    sub = _cut(cut.withColumn("_t", F.col(tie).cast("double")), "_t", ids, "_sub")
    # Room for the sub-ranges between two whole range numbers.
    step = F.when(hot, F.col("_sub") / F.lit(float(len(ids) + 2))).otherwise(0.0)
    return sub.withColumn(BUCKET, F.col(BUCKET) + step).drop("_t", "_sub")


def running_totals(
    table: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), ranges: int | None = None,
    tie: str | None = None, sketch: DataFrame | None = None,
) -> DataFrame:
    """For one row per (by, value[, tie]): sums strictly before, up to, and in total.

    Adds `before_s`, `upto_s` and `total_s` for each column of `sums`.
    """
    by = list(by)
    ranged = with_ranges(table, value, ranges, tie, sketch)
    per_range = ranged.groupBy(*by, BUCKET).agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    over_ranges = Window.partitionBy(*by, F.lit(0)).orderBy(BUCKET)
    earlier = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, BUCKET,
        *[F.coalesce(F.sum(f"_in_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_in_{s}").over(Window.partitionBy(*by, F.lit(0))).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*by, BUCKET).orderBy(value, *([tie] if tie else []))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.select(*ranged.columns, *[F.sum(s).over(upto).alias(f"_run_{s}") for s in sums])
    # One row per range and group: Catalyst broadcasts it while it is small.
    joined = scanned.join(offsets, [*by, BUCKET])
    keep = [c for c in table.columns]
    return joined.select(
        *keep,
        *[(F.col(f"_run_{s}") + F.col(f"_off_{s}") - F.col(s)).alias(f"before_{s}") for s in sums],
        *[(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"upto_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )


def with_previous(
    table: DataFrame, value: str, cols: Sequence[str], by: Sequence[str] = (), tie: str | None = None
) -> DataFrame:
    """Add `prev_c`: the value of c in the row before, in global order."""
    by = list(by)
    ranged = with_ranges(table, value, tie=tie)
    order = [value] + ([tie] if tie else [])
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)
    key = F.struct(*order)
    lasts = ranged.groupBy(*by, BUCKET).agg(F.max_by(F.struct(*cols), key).alias("_last"))
    over_ranges = Window.partitionBy(*by, F.lit(0)).orderBy(BUCKET)
    lasts = lasts.select(*by, BUCKET, F.lag("_last").over(over_ranges).alias("_carry"))
    lagged = ranged.select(*ranged.columns, F.lag(F.struct(*cols)).over(inside).alias("_prev"))
    prev = F.coalesce("_prev", "_carry")
    return lagged.join(lasts, [*by, BUCKET]).select(
        *table.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def average_rank(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Rank of each row, ties sharing their mean rank."""
    by = list(by)
    base = df.withColumn("_v", F.col(value).cast("double"))
    ranks = running_totals(value_counts(base, "_v", by), "_v", ["n"], by, sketch=base.select("_v")).select(
        *by, "_v", (F.col("before_n") + (F.col("n") + 1) / 2).alias(out)
    )
    return base.join(ranks, [*by, "_v"]).drop("_v")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles (type 7), one row per group."""
    raw = df.select(F.col(value).cast("double").alias(value))
    scan = running_totals(value_counts(df, value, by), value, ["n"], list(by), sketch=raw)
    picks, names = [], []
    for name, p in probs.items():
        h = (F.col("total_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.min(F.when(F.col("upto_n") > rank, F.col(value))).alias(f"_{name}_{side}"))
        names.append((name, p))
    picks.append(F.max("total_n").alias("n"))
    wide = scan.groupBy(*by).agg(*picks)
    cols = []
    for name, p in names:
        h = (F.col("n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return wide.select(*by, "n", *cols)


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "q", by: Sequence[str] = ()) -> DataFrame:
    """False-discovery adjustment; rows without a p value keep NULL and do not count."""
    by = list(by)
    if by:
        valid = F.col(p).isNotNull()
        group = Window.partitionBy(*by)
        rank = F.row_number().over(Window.partitionBy(*by, valid).orderBy(F.col(p)))
        m = F.count(p).over(group)
        # Ties: the last of equal p values carries the smallest ratio, and the
        # suffix minimum hands it to the others.
        ranked = df.withColumn("_raw", F.when(valid, F.col(p) * m / rank))
        suffix = Window.partitionBy(*by, F.col(p).isNotNull()).orderBy(F.col(p).desc()).rangeBetween(
            Window.unboundedPreceding, 0)
        return ranked.withColumn(out, F.when(valid, F.least(F.lit(1.0), F.min("_raw").over(suffix)))).drop("_raw")
    # Global scope takes several passes over this (small) table of results.
    df = cut_lineage(df)
    scan = running_totals(value_counts(df, p), p, ["n"]).select(
        p, (F.col(p) * F.col("total_n") / F.col("upto_n")).alias("_raw"))
    ranged = with_ranges(scan, p)
    later = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    tails = ranged.groupBy(BUCKET).agg(F.min("_raw").alias("_m")).select(
        BUCKET, F.min("_m").over(later).alias("_tail"))
    inside = Window.partitionBy(BUCKET).orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranged.withColumn("_q", F.min("_raw").over(inside)).join(tails, BUCKET).select(
        F.col(p).alias("_p"), F.least(F.lit(1.0), F.col("_q"), F.coalesce("_tail", F.lit(1.0))).alias(out))
    return df.join(adjusted, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")
