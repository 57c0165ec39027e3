"""Leftover vertices taken into the community that supports them, if it is no accident.

A vertex outside all communities (cluster 0) joins one when its neighbours there
carry most of its support, lie no farther than members do from each other, share
a label with it, and reach a support that shuffled memberships rarely reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways
from tessera.operators.neighbours import GRID, LARGEST_PART, MOST_ROWS, Metric, _added_up, _matrix
from tessera.operators.ordered import benjamini_hochberg
from tessera.session import cut_lineage

#: Members of a cluster whose distances are in memory at once are this many on each side at most.
BLOCK = 2_048
#: Distances count by their leading bits first: a range spans a 2^-20 part of its values at most.
SHIFT = 32


def _inside(points: DataFrame, reducer, schema: str, metric: Metric) -> DataFrame:
    """`reducer(cluster, distances, left rows)` over the pairs of members of each cluster; counts `n` are added up in the task.

    Large clusters are cut by a hash of the id, so that no task holds one whole.
    The number of parts does not grow with a cluster until a part would be too
    large for a task; blocks of two parts meet inside the task.
    """
    blocks = F.least(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.lit(GRID))
    size = points.groupBy("cluster").agg(F.greatest(blocks, F.ceil(F.count(F.lit(1)) / F.lit(LARGEST_PART))).cast("int").alias("_n"))
    cut = points.join(size, "cluster").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    left = cut.withColumn("_a", F.col("_own")).withColumn("_b", F.explode(F.sequence(F.col("_own"), F.col("_n") - 1)))
    # Fresh names: both sides come from one plan.
    right = cut.select(F.col("cluster").alias("_c"), F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("_own").alias("_e"),
                       F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_d"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo in range(0, len(x), BLOCK):
            part = x.iloc[lo:lo + BLOCK]
            same = part["_a"].iloc[0] == part["_b"].iloc[0]
            for at in range(0, len(y), BLOCK):
                other = y.iloc[at:at + BLOCK]
                d = metric.between(_matrix(part["vec"]), _matrix(other["vec"]))
                d = d[part["id"].to_numpy()[:, None] < other["id"].to_numpy()[None, :]] if same else d.ravel()
                if len(d):
                    out.append(reducer(part["cluster"].iloc[0], np.ascontiguousarray(d, np.float64), part)[names])
                if sum(map(len, out)) > MOST_ROWS:
                    out = [_added_up(pd.concat(out, ignore_index=True), names[:-1])]
        return _added_up(pd.concat(out, ignore_index=True), names[:-1]) if out else pd.DataFrame(columns=names)

    # A number of partitions of its own: small pairs of parts are long work, and are not put together.
    left, right = left.repartition(2 * GRID * GRID, "cluster", "_a", "_b"), right.repartition(2 * GRID * GRID, "_c", "_d", "_e")
    return left.groupBy("cluster", "_a", "_b").cogroup(right.groupBy("_c", "_d", "_e")).applyInPandas(run, schema)


def inner_quantile(points: DataFrame, share: float = 0.75, metric: Metric = Metric()) -> DataFrame:
    """(cluster, q): the interpolated quantile of the distances between members; clusters of one have no row.

    Exact, without a table of pairs: a first pass counts distances in narrow
    ranges, a second one counts single values in the one or two ranges that hold
    the order statistics.
    """
    pts = cut_lineage(points.select("id", "vec", "cluster"))

    def ranges(cluster, d, x):
        held, n = np.unique(d.view(np.int64) >> SHIFT, return_counts=True)
        return pd.DataFrame({"cluster": cluster, "range": held, "n": n})

    counts = cut_lineage(_inside(pts, ranges, "cluster bigint, range bigint, n bigint", metric).groupBy("cluster", "range").agg(F.sum("n").alias("n")))
    place = F.lit(share) * (F.col("total") - 1)
    rank = counts.groupBy("cluster").agg(F.sum("n").alias("total")).select("cluster", place.alias("h"), F.floor(place).alias("lo"), F.ceil(place).alias("hi"))
    upto = counts.withColumn("below", F.sum("n").over(Window.partitionBy("cluster").orderBy("range")) - F.col("n"))
    reached = lambda r: (F.col("below") <= F.col(r)) & (F.col(r) < F.col("below") + F.col("n"))
    wanted = upto.join(rank, "cluster").where(reached("lo") | reached("hi"))
    wanted = cut_lineage(wanted.groupBy("cluster").agg(F.collect_list("range").alias("ranges"), F.min("below").alias("before"),
                                                       *[F.first(c).alias(c) for c in ("h", "lo", "hi")]))

    def values(cluster, d, x):
        d = d[np.isin(d.view(np.int64) >> SHIFT, np.asarray(x["ranges"].iloc[0]))]
        held, n = np.unique(d, return_counts=True)
        return pd.DataFrame({"cluster": cluster, "d": held, "n": n})

    close = _inside(pts.join(wanted.select("cluster", "ranges"), "cluster"), values, "cluster bigint, d double, n bigint", metric)
    close = close.groupBy("cluster", "d").agg(F.sum("n").alias("n"))
    upto = close.withColumn("below", F.sum("n").over(Window.partitionBy("cluster").orderBy("d")) - F.col("n")).join(wanted, "cluster")
    upto = upto.withColumn("below", F.col("below") + F.col("before"))
    found = upto.groupBy("cluster").agg(F.max(F.when(reached("lo"), F.col("d"))).alias("a"), F.max(F.when(reached("hi"), F.col("d"))).alias("b"),
                                        F.first(F.col("h") - F.col("lo")).alias("part"))
    return found.select("cluster", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q"))


def candidates(edges: DataFrame, membership: DataFrame, points: DataFrame, labels: DataFrame, metric: Metric = Metric(), purity: float = 0.70,
               min_neighbours: int = 3, share: float = 0.75, min_shared: int = 1) -> DataFrame:
    """(id, cluster, purity, med_d, q, shared): leftovers that pass every fixed condition.

    edges (src, dst, w, d), membership (id, cluster, mult), points (id, vec),
    labels (id, labels).  Support is weight times the neighbour's multiplicity;
    equal supports go to the smaller cluster.  Members of a cluster of one have no
    distance to compare with and set none.  NULL or lacking labels are none.
    """
    ways = both_ways(edges, "w", "d")
    me = membership.where("cluster = 0").select(F.col("id").alias("src"))
    kept = membership.where("cluster <> 0").select(F.col("id").alias("dst"), F.col("cluster").alias("c"), F.coalesce("mult", F.lit(1)).alias("m"))
    near = cut_lineage(ways.join(me, "src").join(kept, "dst").select("src", "dst", "c", "d", (F.col("w") * F.col("m")).alias("s")))
    votes = near.groupBy("src", "c").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"), F.expr("median(d)").alias("med_d"))
    best = votes.groupBy("src").agg(F.max(F.struct("s", (-F.col("c")).alias("c"), "med_d")).alias("b"), F.sum("s").alias("total"), F.sum("k").alias("k"))
    best = best.where((F.col("k") >= min_neighbours) & (F.col("total") > 0) & (F.col("b.s") >= purity * F.col("total"))).select(
        "src", (-F.col("b.c")).alias("c"), (F.col("b.s") / F.col("total")).alias("purity"), F.col("b.med_d").alias("med_d"))
    reach = inner_quantile(points.join(membership.where("cluster <> 0").select("id", "cluster"), "id"), share, metric)
    best = best.join(reach.withColumnRenamed("cluster", "c"), "c", "left").where(F.col("q").isNull() | (F.col("med_d") <= F.col("q")))
    one = labels.select("id", F.explode("labels").alias("label")).distinct()
    theirs = near.join(best.select("src", "c"), ["src", "c"]).join(one.withColumnRenamed("id", "dst"), "dst").select("src", "label").distinct()
    shared = theirs.join(one.withColumnRenamed("id", "src"), ["src", "label"]).groupBy("src").agg(F.count(F.lit(1)).alias("shared"))
    t = best.join(shared, "src", "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint")).where(F.col("shared") >= min_shared)
    return t.select(F.col("src").alias("id"), F.col("c").alias("cluster"), "purity", "med_d", "q", "shared")


def support_p(edges: DataFrame, membership: DataFrame, asked: DataFrame, draws: int = 200, seed: int = 1) -> DataFrame:
    """(id, p): how often memberships shuffled over all kept vertices support a vertex as well.

    A shuffle gives the neighbours of one vertex places of the kept ones, drawn
    without repetition; that draw alone is made, with a generator of its own for
    every vertex.  The sizes of the clusters travel with the tasks, and a vertex
    brings its own neighbours.
    """
    sizes = membership.where("cluster <> 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("cluster")
    names, ends = sizes["cluster"].to_numpy(), np.cumsum(sizes["n"].to_numpy())
    kept = membership.where("cluster <> 0").select(F.col("id").alias("dst"), F.col("cluster").alias("c"), F.coalesce("mult", F.lit(1)).alias("m"))
    near = both_ways(edges, "w").join(asked.select(F.col("id").alias("src")), "src").join(kept, "dst")
    lists = near.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "c", (F.col("w") * F.col("m")).alias("s")))).alias("near"))
    lists = lists.select("id", F.col("near.c").alias("c"), F.col("near.s").alias("s"))

    def run(batches):
        for pdf in batches:
            out = []
            for vertex, c, s in zip(pdf["id"], pdf["c"], pdf["s"]):
                weight = np.asarray(s, float)
                support = lambda at: np.bincount(np.unique(at, return_inverse=True)[1], weight).max()
                observed, rng = support(np.searchsorted(names, np.asarray(c))), np.random.default_rng([seed, int(vertex) & (2**63 - 1)])
                null = [support(np.searchsorted(ends, rng.choice(ends[-1], len(weight), replace=False), side="right")) for _ in range(draws)]
                # The same weights added in another order count as equal.
                out.append((1 + np.sum(np.asarray(null) >= observed * (1 - 1e-12))) / (1 + draws))
            yield pd.DataFrame({"id": pdf["id"], "p": np.asarray(out, float)})

    return lists.mapInPandas(run, "id bigint, p double")


def absorb(edges: DataFrame, membership: DataFrame, points: DataFrame, labels: DataFrame, metric: Metric = Metric(), alpha: float = 0.05,
           draws: int = 200, seed: int = 1, **conditions) -> DataFrame:
    """Candidates with p, fdr over all of them, and whether they are absorbed (fdr of at most `alpha`)."""
    asked = cut_lineage(candidates(edges, membership, points, labels, metric, **conditions))
    tested = asked.join(support_p(edges, membership, asked, draws, seed), "id")
    return benjamini_hochberg(tested, "p", "fdr").withColumn("absorbed", F.col("fdr") <= alpha)
