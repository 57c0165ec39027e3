"""Label-by-cluster association: contingency cells, exact tests, lift, FDR."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions.scalar import ratio, stars, wilson
from tessera.operators.ordered import benjamini_hochberg
from tessera.session import cut_lineage


def cells(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, label, a, b, c, d, n_in, n): positives in/out, negatives in/out.

    Subjects collapse to (cluster, profile) counts before anything else.  Four
    branches read that small table, so it is written: the subjects are seen once.
    """
    prof = cut_lineage(
        assigned.groupBy(F.col(cluster).alias("cluster"), "labels").agg(F.count(F.lit(1)).alias("w")))
    sizes = prof.groupBy("cluster").agg(F.sum("w").alias("n_in"))
    inside = prof.select("cluster", "w", F.explode("labels").alias("label")).groupBy("cluster", "label").agg(
        F.sum("w").alias("a"))
    totals = inside.groupBy("label").agg(F.sum("a").alias("n_pos"))
    names = totals.agg(F.collect_list("label")).scalar()
    n = sizes.agg(F.sum("n_in")).scalar()
    a = F.coalesce("a", F.lit(0))
    return (
        sizes.withColumn("label", F.explode(names))
        .join(inside, ["cluster", "label"], "left").join(totals, "label")
        .select(
            "cluster", "label", a.alias("a"), (F.col("n_pos") - a).alias("b"), (F.col("n_in") - a).alias("c"),
            (n - F.col("n_in") - F.col("n_pos") + a).alias("d"), "n_in", n.alias("n"),
        )
    )


def with_lifts(t: DataFrame) -> DataFrame:
    """The three lifts in use, under separate names."""
    inn = F.col("a") / F.col("n_in")
    out = ratio("b", F.col("n") - F.col("n_in"))
    overall = (F.col("a") + F.col("b")) / F.col("n")
    return (
        t.withColumn("prev_in", inn).withColumn("prev_out", out).withColumn("prev_all", overall)
        .withColumn("lift_overall", F.when(overall > 0, inn / overall))
        .withColumn("lift_out", F.when(out > 0, inn / out))
        .withColumn("odds_ratio", F.when((F.col("b") > 0) & (F.col("c") > 0),
                                         F.col("a") * F.col("d") / (F.col("b") * F.col("c"))))
    )


def pearson_residuals(t: DataFrame) -> DataFrame:
    """Observed, expected, Pearson and adjusted residuals of cluster x label counts.

    The table holds positive counts only: rows are clusters, columns labels.
    """
    row, colw = Window.partitionBy("cluster"), Window.partitionBy("label")
    total = t.agg(F.sum("a")).scalar()
    r, c, n = F.sum("a").over(row), F.sum("a").over(colw), total.cast("double")
    base = t.select("cluster", "label", F.col("a").alias("obs"), r.alias("_r"), c.alias("_c"), n.alias("_n"))
    expected = F.col("_r") * F.col("_c") / F.col("_n")
    adj = expected * (1 - F.col("_r") / F.col("_n")) * (1 - F.col("_c") / F.col("_n"))
    return (
        base.withColumn("expected", expected)
        .withColumn("resid", (F.col("obs") - F.col("expected")) / F.sqrt("expected"))
        .withColumn("z", F.when(adj > 0, (F.col("obs") - F.col("expected")) / F.sqrt(adj)))
        .drop("_r", "_c", "_n")
    )


def residual_map(t: DataFrame) -> DataFrame:
    """Adjusted residuals with two-sided p and FDR over all cells."""
    z = pearson_residuals(t).withColumn("p", 2 * exact.normal_cdf(-F.abs("z")))
    return benjamini_hochberg(z, "p", "q")


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """chi2, n and V of a two-way table, one row; empty cells included."""
    t = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("o"))
    rows = t.groupBy("x").agg(F.sum("o").alias("r"))
    cols = t.groupBy("y").agg(F.sum("o").alias("c"))
    # sum (o-e)^2/e = n (sum o^2/(r c) - 1): empty cells add nothing.
    return (
        t.join(rows, "x").join(cols, "y")
        .agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
             F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"))
        .select((F.col("n") * (F.col("s") - 1)).alias("chi2"), "n",
                F.sqrt((F.col("s") - 1) / F.least(F.col("kx") - 1, F.col("ky") - 1)).alias("v"))
    )


def guarded(t: DataFrame, min_total: int = 10, min_in: int = 5, min_out: int = 5):
    return ((F.col("a") + F.col("b") >= min_total) & (F.col("a") >= min_in) & (F.col("b") >= min_out))


def audit(t: DataFrame, min_total: int = 10, min_in: int = 5, min_out: int = 5) -> DataFrame:
    """Per cell: two-sided Fisher when the guards hold, directional binomial otherwise."""
    t = with_lifts(t)
    ok = guarded(t, min_total, min_in, min_out) & (F.col("n") > F.col("n_in"))
    return t.withColumn(
        "p",
        F.when(ok, exact.fisher_two_sided("a", "b", "c", "d")).otherwise(
            exact.binomial_by_direction("a", "n_in", "prev_all")),
    )


def enrichment(
    t: DataFrame, alpha: float = 0.05, min_prev_in: float = 0.10, min_or: float = 2.0,
    min_total: int = 10, min_in: int = 5, min_out: int = 5, min_cluster: int = 0,
    within: Sequence[str] = ("cluster",),
) -> DataFrame:
    """One-sided enrichment per eligible cell, FDR inside each cluster (or each group of `within`), majors flagged."""
    t = with_lifts(t.where(guarded(t, min_total, min_in, min_out) & (F.col("n_in") >= min_cluster)))
    t = t.withColumn(
        "p",
        F.when(F.col("a") == F.col("n_in"), exact.binomial_by_direction("a", "n_in", "prev_all"))
        .otherwise(exact.fisher_greater("a", "b", "c", "d")),
    ).withColumn("or_cmle", exact.conditional_odds_ratio("a", "b", "c", "d"))
    t = benjamini_hochberg(t, "p", "q", list(within))
    major = (F.col("q") <= alpha) & (F.col("prev_in") >= min_prev_in) & (F.col("or_cmle") >= min_or)
    return t.withColumn("major", major.cast("bigint"))


def over_representation(t: DataFrame, min_in: int = 5, min_out: int = 5) -> DataFrame:
    """Inside against outside prevalence, FDR over all cells."""
    t = with_lifts(t.where((F.col("n_in") >= min_in) & (F.col("n") - F.col("n_in") >= min_out)
                           & (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)))
    t = t.withColumn("log2_lift", F.log2(F.greatest("lift_out", F.lit(1e-12)))).withColumn(
        "p", exact.fisher_greater("a", "b", "c", "d"))
    return benjamini_hochberg(t, "p", "q").withColumn("star", stars("q"))


def over_representation_ref(
    t: DataFrame, reference: DataFrame, cap: float = 2.0, min_total: int = 10, min_in: int = 5, min_out: int = 5
) -> DataFrame:
    """Lift against a fixed reference prevalence (label, prev_ref); FDR per cluster."""
    t = t.join(reference.select("label", "prev_ref"), "label", "left").withColumn(
        "prev_in", F.col("a") / F.col("n_in"))
    ok = guarded(t, min_total, min_in, min_out) & (F.col("n") > F.col("n_in"))
    t = t.withColumn("lift_ref", F.when(F.col("prev_ref") > 0, F.col("prev_in") / F.col("prev_ref"))).withColumn(
        "p",
        F.when(ok, exact.fisher_greater("a", "b", "c", "d")).otherwise(
            exact.binomial_by_direction("a", "n_in", "prev_ref")),
    )
    t = benjamini_hochberg(t, "p", "q", ["cluster"])
    val = F.log2(F.greatest("lift_ref", F.lit(1e-12)))
    return t.withColumn("val", F.least(F.greatest(val, F.lit(-cap)), F.lit(cap))).withColumn("star", stars("q"))


def unlabelled_cluster(assigned: DataFrame) -> DataFrame:
    """The cluster with the highest share of subjects without labels, if its lift exceeds 1."""
    per = assigned.groupBy("cluster").agg(
        F.avg((F.size("labels") == 0).cast("int")).alias("none_in"), F.count(F.lit(1)).alias("n"))
    overall = assigned.agg(F.avg((F.size("labels") == 0).cast("int"))).scalar()
    lifted = per.select("cluster", F.try_divide("none_in", overall).alias("lift")).where("lift > 1")
    return lifted.orderBy(F.desc("lift"), "cluster").limit(1)


def excluding_unlabelled(assigned: DataFrame) -> DataFrame:
    return assigned.join(unlabelled_cluster(assigned).select("cluster"), "cluster", "left_anti")


def detail(t: DataFrame) -> DataFrame:
    """Prevalence inside and outside with Wilson limits."""
    lo_in, hi_in = wilson("a", "n_in")
    lo_out, hi_out = wilson("b", F.col("n") - F.col("n_in"))
    return with_lifts(t).select(
        "cluster", "label", "prev_in", lo_in.alias("lo_in"), hi_in.alias("hi_in"), "prev_out",
        lo_out.alias("lo_out"), hi_out.alias("hi_out"))


def lift_pairs(pairs: DataFrame, adjust: bool = False) -> DataFrame:
    """Co-occurrence lift with a two-sided Fisher test."""
    pairs = pairs.where("na < n and nb < n")
    t = pairs.withColumn("lift", F.col("nab") * F.col("n") / (F.col("na") * F.col("nb")).cast("double")).withColumn(
        "p", exact.fisher_two_sided(
            "nab", F.col("na") - F.col("nab"), F.col("nb") - F.col("nab"),
            F.col("n") - F.col("na") - F.col("nb") + F.col("nab")))
    if adjust:
        t = benjamini_hochberg(t, "p", "q")
    return t


def primary_rows(enriched: DataFrame) -> DataFrame:
    return enriched.orderBy("cluster", "q", F.desc("odds_ratio"))
