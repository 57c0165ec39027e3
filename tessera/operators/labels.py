"""Label matrices in sparse form: a subject holds the sorted set of its labels.

Zeros are never materialised.  Every count that needs them comes from positive
counts and group sizes, after subjects have been collapsed to distinct profiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def label_sets(long: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, labels): one sorted label array per subject."""
    return long.groupBy(id_col).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def wide_to_sets(wide: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    """Label columns (0/1/NULL) to one array; NULL counts as 0."""
    picked = [F.when(F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1, F.lit(c)) for c in labels]
    return wide.select(F.col(id_col), F.array_sort(F.array_compact(F.array(*picked))).alias("labels"))


def sets_to_wide(sets: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    flags = [F.array_contains("labels", c).cast("int").alias(c) for c in labels]
    return sets.select(id_col, *flags)


def _weighted(sets: DataFrame) -> DataFrame:
    """Distinct label sets with counts, written once for the branches that follow."""
    return cut_lineage(sets.groupBy("labels").agg(F.count(F.lit(1)).alias("w")))


def any_label(sets: DataFrame) -> DataFrame:
    """Derived pair: any label at all, and its complement."""
    has = (F.size("labels") > 0).cast("bigint")
    return sets.withColumn("any_y", has).withColumn("no_label", F.lit(1) - has)


def profiles(sets: DataFrame, id_col: str) -> DataFrame:
    """Distinct label sets with multiplicity and first subject."""
    return sets.groupBy("labels").agg(
        F.count(F.lit(1)).alias("mult"), F.min(id_col).alias("first_id"))


def expand(sets: DataFrame, profile_values: DataFrame) -> DataFrame:
    """Hand a value found per profile back to every subject."""
    return sets.join(profile_values, "labels")


def label_counts(sets: DataFrame) -> DataFrame:
    """n1, n0 and prevalence per label that occurs."""
    weighted = _weighted(sets)
    total = weighted.agg(F.sum("w")).scalar()
    return (
        weighted.select("w", F.explode("labels").alias("label"))
        .groupBy("label").agg(F.sum("w").alias("n1"))
        .select("label", "n1", (total - F.col("n1")).alias("n0"),
                (F.col("n1") / total).alias("prev"))
    )


def prevalence_filter(counts: DataFrame, min_prev: float, max_prev: float, min_n: int = 1) -> DataFrame:
    return counts.where(F.col("prev").between(min_prev, max_prev) & (F.col("n1") >= min_n))


def relaxed_gate(counts: DataFrame, steps: Sequence[int] = (10, 8, 5, 3, 1)) -> DataFrame:
    """Keep labels with enough positives and negatives; relax the step until one passes."""
    support = F.least("n1", "n0")
    reached = F.max(
        F.coalesce(*[F.when(support >= s, F.lit(s)) for s in steps], F.lit(0))
    )
    threshold = counts.agg(reached).scalar()
    return counts.withColumn("threshold", threshold).where(support >= F.col("threshold"))


def degenerate_switch(sets: DataFrame, target: str) -> str:
    """A8: take the complement when one class of the derived target is empty."""
    row = any_label(sets).agg(F.sum("any_y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    other = {"any_y": "no_label", "no_label": "any_y"}[target]
    return other if row["p"] in (0, row["n"]) else target


def primary_label(sets: DataFrame, id_col: str) -> DataFrame:
    """The most prevalent of each subject's labels; ties go to the first name."""
    prof = _weighted(sets)
    counts = prof.select("w", F.explode("labels").alias("label")).groupBy("label").agg(F.sum("w").alias("n1"))
    best = (
        prof.select("labels", F.explode("labels").alias("label")).join(counts, "label")
        .groupBy("labels").agg(F.max_by("label", F.struct("n1", _reverse_key("label"))).alias("primary"))
    )
    return sets.join(best, "labels", "left").select(id_col, "primary")


def _reverse_key(label: str) -> Column:
    """Sorts names downward inside an upward comparison."""
    codes = F.transform(F.split(F.col(label), ""), lambda ch: -F.ascii(ch))
    # A longer name must lose against its own prefix: close with a large code.
    return F.concat(codes, F.array(F.lit(1)))


def co_occurrence(sets: DataFrame) -> DataFrame:
    """2x2 counts for every pair of labels, a < b, zero pairs included."""
    prof = _weighted(sets)
    total = prof.agg(F.sum("w")).scalar()
    ones = prof.select("w", F.explode("labels").alias("a")).groupBy("a").agg(F.sum("w").alias("na"))
    both = (
        prof.select("w", "labels", F.explode("labels").alias("a"))
        .select("w", "a", F.explode("labels").alias("b")).where("a < b")
        .groupBy("a", "b").agg(F.sum("w").alias("nab"))
    )
    names = ones.agg(F.collect_list("a")).scalar()
    grid = ones.withColumn("b", F.explode(names)).where("a < b")
    other = ones.select(F.col("a").alias("b"), F.col("na").alias("nb"))
    return (
        grid.join(other, "b").join(both, ["a", "b"], "left")
        .withColumn("nab", F.coalesce("nab", F.lit(0))).withColumn("n", total)
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct on keys, keeping the first row in the given order (map-side combine)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[F.col(c) for c in rest])).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """Row-number filter; Spark trims each task's groups to k before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(out, rn).where(F.col(out) <= k)
