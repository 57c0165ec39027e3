"""Complete-linkage groups of near copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.neighbours import Metric, _matrix, all_pairs_reduce, knn, pairs_within
from tessera.operators.ordered import quantiles
from tessera.session import cut_lineage


def _in_reach(points: DataFrame, eps: float, metric: Metric) -> DataFrame:
    """(cluster, other, h, n): pairs of different points within eps, each a group of its own, both ways; n is 1."""
    pts = points.select("id", "vec")
    if metric.boxed:
        t = pairs_within(pts, eps, metric).select(F.col("i").alias("cluster"), F.col("j").alias("other"), F.col("d").alias("h"))
        return t.withColumn("n", F.lit(1).cast("bigint"))

    def seen(x, y):
        d = metric.between(_matrix(x["vec"]), _matrix(y["vec"]))
        i, j = np.nonzero((d <= eps) & (x["id"].to_numpy()[:, None] != y["id"].to_numpy()[None, :]))
        return pd.DataFrame({"cluster": x["id"].to_numpy()[i], "other": y["id"].to_numpy()[j], "h": d[i, j], "n": 1})

    return all_pairs_reduce(pts, pts, seen, "cluster bigint, other bigint, h double, n bigint")


def complete_tree(points: DataFrame, eps: float, metric: Metric = Metric()) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the distinct points and (cluster, to, h) of all merges of complete linkage up to eps.

    Exact copies collapse first, and the pairs within eps are found once.  Then
    mutual nearest groups merge, all at once: complete linkage is reducible, so this
    gives the same tree as one merge at a time.  Two groups are in reach only if
    every cross pair is: a merge keeps the pairs of groups that both its parts had,
    so that the table of pairs shrinks and no distance is computed again.  A group
    is named by its smallest id, and merges into a smaller name.
    """
    def full(pairs, sizes):
        """One row for each pair of groups all of whose members are in reach."""
        size = lambda name, s: sizes.select(F.col("cluster").alias(name), F.col("s").alias(s))
        t = pairs.groupBy("cluster", "other").agg(F.max("h").alias("h"), F.sum("n").alias("n"))
        return cut_lineage(t.join(size("cluster", "sa"), "cluster").join(size("other", "sb"), "other").where("n = sa * sb").select("cluster", "other", "h", "n"))

    distinct, merges = cut_lineage(points.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")), None
    sizes = cut_lineage(distinct.groupBy(F.col("id").alias("cluster")).agg(F.count(F.lit(1)).alias("s")))
    pairs = full(_in_reach(distinct, eps, metric), sizes)
    while True:  # each round merges the nearest pair at least
        key = F.struct("h", F.least("cluster", "other"), F.greatest("cluster", "other"), "other")
        near = cut_lineage(pairs.groupBy("cluster").agg(F.min(key).alias("b")).select("cluster", F.col("b.other").alias("other"), F.col("b.h").alias("h")))
        back = near.select(F.col("other").alias("cluster"), F.col("cluster").alias("other"))
        merge = cut_lineage(near.join(back, ["cluster", "other"]).where("other < cluster").select("cluster", F.col("other").alias("to"), "h"))
        merges = merge if merges is None else merges.unionByName(merge)
        if merge.isEmpty():
            return distinct, cut_lineage(merges)
        to = merge.select(F.col("cluster").alias("_c"), "to")
        named = lambda t, c="cluster": t.join(to, t[c] == F.col("_c"), "left").withColumn(c, F.coalesce("to", c)).drop("_c", "to")
        sizes = cut_lineage(named(sizes).groupBy("cluster").agg(F.sum("s").alias("s")))
        pairs = full(named(named(pairs), "other").where("cluster <> other"), sizes)


def groups_at(points: DataFrame, tree: tuple[DataFrame, DataFrame], eps: float) -> DataFrame:
    """(id, cluster): the tree cut at eps; names follow their merges to the end, two steps at a time."""
    distinct, merges = tree
    name = cut_lineage(distinct.select("id").join(merges.where(F.col("h") <= eps).select(F.col("cluster").alias("id"), "to"), "id", "left").select(
        "id", F.coalesce("to", "id").alias("cluster")))
    while True:
        onward = name.select(F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        moved = cut_lineage(name.join(onward, "cluster").select("id", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")))
        name = moved.select("id", "cluster")
        if moved.where("moved").isEmpty():
            return points.select("id", "vec").join(distinct.join(name, "id").select("vec", "cluster"), "vec").select("id", "cluster")


def complete_groups(points: DataFrame, eps: float, metric: Metric = Metric()) -> DataFrame:
    """(id, cluster): complete linkage cut at eps; a group is named by its smallest id."""
    return groups_at(points, complete_tree(points, eps, metric), eps)


def cuts(points: DataFrame, metric: Metric = Metric(), step: float = 0.005) -> list[float]:
    """Cuts to try, from the distances of first neighbours.

    From 0.02 under the smaller of their 0.001 and 0.01 quantiles (not under 0) to
    their 0.3 quantile (not over 0.5).  These numbers are fixed values.
    """
    q = quantiles(knn(points, 1, metric).where(F.col("d") < float("inf")), "d", {"a": 0.001, "b": 0.01, "c": 0.30}).first()
    if q is None or q["c"] is None:
        return []
    low, high = max(0.0, min(q["a"], q["b"]) - 0.02), min(0.50, q["c"])
    return [low + i * step for i in range(int((high - low) / step + 1e-9) + 1)]


def collapse_curve(points: DataFrame, grid: list[float], tree: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(eps, n_groups, retained) of every cut, from one tree that reaches the largest.

    A cut has as many groups as there are distinct points, less the merges up to it.
    """
    distinct, merges = tree
    spark = points.sparkSession
    at = spark.createDataFrame([(float(e),) for e in grid], "eps double")
    index = F.array(*[F.lit(float(e)) for e in grid])
    first = merges.select(F.array_min(F.filter(index, lambda e: e >= F.col("h"))).alias("eps")).groupBy("eps").agg(F.count(F.lit(1)).alias("n"))
    upto = at.join(F.broadcast(first), "eps", "left").withColumn("merged", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("eps")))
    t = upto.select("eps", (F.lit(distinct.count()) - F.col("merged")).alias("n_groups"))
    return t.select("eps", "n_groups", (F.col("n_groups") / F.lit(points.count())).alias("retained"))


def steepest(curve: list[tuple[float, float]]) -> float:
    """Middle of the first step with the steepest drop; the cut itself where there is one only."""
    if len(curve) == 1:
        return curve[0][0]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(curve, curve[1:])]
    i = int(np.argmin(slopes))
    return (curve[i][0] + curve[i + 1][0]) / 2


def near_copies(points: DataFrame, metric: Metric = Metric(), step: float = 0.005) -> tuple[DataFrame, float]:
    """(id, cluster) and the cut: complete linkage at the steepest drop of the collapse curve.

    The curve and the groups come from one tree.  A table with fewer than two rows
    has no distances: its cut is 0.
    """
    pts = cut_lineage(points.select("id", "vec"))
    grid = cuts(pts, metric, step)
    if not grid:
        return pts.select("id", F.col("id").alias("cluster")), 0.0
    tree = complete_tree(pts, grid[-1], metric)
    eps = steepest([(r["eps"], r["retained"]) for r in collapse_curve(pts, grid, tree).orderBy("eps").collect()])
    return groups_at(pts, tree, eps), eps
