"""Typed items to distance-ready vectors, profiled in one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import Metric


def item_kinds(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """(item, kind, n_distinct) with kind binary, ordered, numeric or nominal.

    Values are unpivoted and collapsed per item first, so one shuffle of
    distinct values replaces a count-distinct per column.
    """
    long = df.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in items]), F.array(*[F.col(c).cast("string") for c in items])
    )).alias("item", "value"))
    seen = long.where("value is not null").distinct().withColumn("x", F.expr("try_cast(value as double)"))
    whole = F.max(F.when(F.col("x").isNull() | (F.col("x") != F.floor("x")), 1).otherwise(0)) == 0
    binary = (F.min("x") == 0) & (F.max("x") == 1) & (F.countDistinct("x") == 2)
    n = F.countDistinct(F.coalesce(F.col("x").cast("string"), F.col("value")))
    facts = seen.groupBy("item").agg(
        n.alias("n_distinct"), binary.alias("is_bin"), whole.alias("whole"), F.count("x").alias("parsed"))
    kind = (
        F.when(F.col("parsed") == 0, "nominal").when(F.col("is_bin"), "binary")
        .when(F.col("whole") & F.col("n_distinct").between(3, 7), "ordered").otherwise("numeric"))
    return facts.select("item", kind.alias("kind"), "n_distinct")


def gower_points(
    df: DataFrame, id_col: str, numeric: Sequence[str], nominal: Sequence[str], weights: dict | None = None
) -> tuple[DataFrame, Metric]:
    """(id, vec) plus the metric; every row stays, a missing item stays NULL in `vec`.

    Ranges come from the values there are.  Nominal values become 48-bit hashes:
    equal values keep equal codes and no dictionary has to be collected.
    """
    items = [*numeric, *nominal]
    rows = df.select(id_col, *items)
    facts = rows.agg(*[f(c).cast("double").alias(f"{t}_{c}") for c in numeric for t, f in (("lo", F.min), ("hi", F.max))],
                     F.count_if(F.greatest(F.lit(False), *[F.col(c).isNull() for c in items])).alias("_gaps")).first()
    vec = []
    for c in numeric:
        lo, hi = facts[f"lo_{c}"], facts[f"hi_{c}"]
        vec.append(F.col(c).cast("double") / F.lit(float(hi - lo) if lo is not None and hi > lo else 1.0))
    for c in nominal:
        code = F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 16).cast("double")
        vec.append(F.when(F.col(c).isNotNull(), code))
    w = tuple(float((weights or {}).get(c, 1.0)) for c in items)
    points = rows.select(F.col(id_col).cast("bigint").alias("id"), F.array(*vec).alias("vec"))
    return points, Metric("gower", len(numeric), w, gaps=facts["_gaps"] > 0)


def label_points(profiles: DataFrame, labels: Sequence[str], id_col: str = "first_id") -> tuple[DataFrame, Metric]:
    """Profiles as 0/1 vectors for the asymmetric-binary (Jaccard) distance."""
    bits = [F.array_contains("labels", c).cast("double") for c in labels]
    return profiles.select(F.col(id_col).cast("bigint").alias("id"), F.array(*bits).alias("vec")), Metric("jaccard")


def complete_cases(df: DataFrame, items: Sequence[str], min_sd: float = 1e-8) -> DataFrame:
    """Rows without gaps, then columns that vary (one profiling pass)."""
    rows = df.dropna(subset=list(items))
    types = dict(rows.dtypes)
    numeric = [c for c in items if types[c] != "string"]
    aggs = [F.stddev_samp(c).alias(c) for c in numeric]
    aggs += [(F.max(c) != F.min(c)).alias(c) for c in items if c not in numeric]
    facts = rows.agg(*aggs).first()
    flat = [c for c in items if not (facts[c] if types[c] == "string" else (facts[c] or 0.0) > min_sd)]
    return rows.drop(*flat)


def rare_levels_to_null(df: DataFrame, item: str, share: float = 0.01) -> DataFrame:
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    common = counts.where(F.col("_n") >= share * total).select(F.col(item).alias("_level"))
    kept = df.join(common, F.col(item) == F.col("_level"), "left")
    return kept.withColumn(item, F.col("_level")).drop("_level")


def z_scores(df: DataFrame, id_col: str, items: Sequence[str]) -> DataFrame:
    """Centre and scale by scalar subqueries: no window, no extra shuffle of rows."""
    facts = df.agg(*[f(c).alias(f"{n}_{c}") for c in items for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    cols = []
    for c in items:
        mean = facts.select(f"m_{c}").scalar()
        sd = facts.select(f"s_{c}").scalar()
        cols.append(F.when(sd > 0, (F.col(c) - mean) / sd).alias(f"z_{c}"))
    return df.select(id_col, *cols)


def check_levels(df: DataFrame, columns: Sequence[str], limit: int = 2000) -> None:
    """Raise before levels become columns when a sketch finds too many of them."""
    if not columns:
        return
    seen = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    many = {c: seen[c] for c in columns if seen[c] > limit}
    if many:
        raise ValueError(f"too many levels to encode, merge rare ones first: {many}")


def design(df: DataFrame, id_col: str, numeric: Sequence[str], nominal: Sequence[str], max_levels: int = 2000) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(id, vec) of numbers and indicators, and the (item, column) pair behind each entry.

    The first nominal item keeps all levels, later ones drop their first.  Levels
    become columns, so their number is checked.
    """
    entries, names = [F.col(c).cast("double") for c in numeric], [(c, c) for c in numeric]
    levels = {}
    check_levels(df, nominal, max_levels)
    if nominal:
        sets = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in nominal]).first()
        levels = {c: list(sets[c]) for c in nominal}
    for i, c in enumerate(nominal):
        for level in levels[c][1 if i else 0:]:
            entries.append((F.col(c).cast("string") == level).cast("double"))
            names.append((c, f"{c}={level}"))
    rows = df.dropna(subset=[*numeric, *nominal])
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.array(*entries).alias("vec")), names


def spread_weights(names: Sequence[tuple[str, str]], weights: dict | None = None) -> list[float]:
    """Square roots of item weights shared equally by the columns of an item."""
    items = [item for item, _ in names]
    return [(max(0.0, (weights or {}).get(i, 1.0)) / items.count(i)) ** 0.5 for i in items]


def mixed_factors(df: DataFrame, id_col: str, numeric: Sequence[str], nominal: Sequence[str], target: float = 0.99) -> tuple[DataFrame, int]:
    """Factor scores of mixed data: numbers standardised, indicators centred and divided
    by the square root of their share.  Without numbers this is multiple
    correspondence analysis.  Axes are kept up to the target share of variance.
    """
    from tessera.operators import linalg as LA

    check_levels(df, nominal)
    entries = [F.col(c).cast("double") for c in numeric]
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{t}_{c}") for c in numeric for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(e - facts[f"m_{c}"]) / (facts[f"s_{c}"] or 1.0) for c, e in zip(numeric, entries)]
    for c in nominal:
        for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("k")).orderBy(c).collect():
            share = r["k"] / facts["n"]
            scaled.append(((F.col(c) == r[c]).cast("double") - share) / share**0.5)
    pts = df.select(F.col(id_col).cast("bigint").alias("id"), F.array(*scaled).alias("vec"))
    cap = 100 if numeric else 80
    d = len(scaled)
    mean, axes, _ = LA.principal_axes(pts, d)
    import numpy as np

    spread = LA.axis_variances(pts, mean, axes)
    cum = np.cumsum(spread) / max(1e-300, spread.sum())
    keep = int(max(2, min(np.searchsorted(cum, target) + 1, cap, d)))
    return LA.project(pts, mean, axes[:, :keep]).select("id", F.col("score").alias("vec")), keep


def correlated_to_drop(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Later columns that correlate with an earlier kept one at the threshold or above."""
    from tessera.operators.linalg import covariance

    rows = covariance(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("vec")).where(
        ~F.exists("vec", lambda v: v.isNull()))).collect()
    cov = {(r["i"], r["j"]): r["cov"] for r in rows}
    dropped: set[int] = set()
    for i in range(len(columns)):
        if i in dropped:
            continue
        for j in range(i + 1, len(columns)):
            scale = (cov[(i, i)] * cov[(j, j)]) ** 0.5
            if scale > 0 and abs(cov[(i, j)]) >= threshold * scale:
                dropped.add(j)
    return [columns[j] for j in sorted(dropped)]
