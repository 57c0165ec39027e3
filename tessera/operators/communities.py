"""Modularity communities by distributed local moving and contraction.

Vertices move in synchronous rounds, a hashed half of them at a time so that
neighbours do not chase each other.  Communities then become vertices of a
smaller graph and the rounds start again.  Graphs are told apart by a key `g`, so
replicates (nulls, bootstraps, sweeps) run together as one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways
from tessera.session import cut_lineage

EPS = 1e-10


def _round(adj: DataFrame, nodes: DataFrame, turn: int, gamma: float) -> DataFrame:
    """One synchronous round; `adj` is symmetric (g, src, dst, w), `nodes` (g, id, comm, k, m2)."""
    totals = nodes.groupBy("g", "comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    theirs = nodes.select("g", F.col("id").alias("dst"), "comm")
    links = adj.join(theirs, ["g", "dst"]).groupBy("g", F.col("src").alias("id"), "comm").agg(F.sum("w").alias("w"))
    active = nodes.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
    own = active.select("g", "id", F.col("comm").alias("own"), "k", "m2")
    stay = active.select("g", "id", "comm", F.lit(0.0).alias("w"))
    options = links.join(own.select("g", "id"), ["g", "id"], "left_semi").unionByName(stay).groupBy("g", "id", "comm").agg(
        F.sum("w").alias("w"))
    scored = options.join(own, ["g", "id"]).join(totals, ["g", "comm"])
    rest = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0.0)
    scored = scored.withColumn("gain", F.col("w") - gamma * F.col("k") * rest / F.col("m2"))
    here = F.max(F.when(F.col("comm") == F.col("own"), F.col("gain")))
    best = scored.groupBy("g", "id").agg(
        F.max_by("comm", F.struct(F.round("gain", 9), -F.col("comm"))).alias("to"), F.max("gain").alias("top"), here.alias("here"))
    moved = best.where(F.col("top") > F.col("here") + EPS).select("g", "id", "to")
    return nodes.join(moved, ["g", "id"], "left").select(
        "g", "id", F.coalesce("to", "comm").alias("comm"), "k", "m2", F.col("to").isNotNull().alias("moved"))


def _quality(adj: DataFrame, nodes: DataFrame, gamma: float) -> DataFrame:
    """(g, q) with self-links included in `k` and given in `adj` as src = dst."""
    a = nodes.select("g", F.col("id").alias("src"), F.col("comm").alias("cs"))
    b = nodes.select("g", F.col("id").alias("dst"), F.col("comm").alias("cd"))
    inside = adj.join(a, ["g", "src"]).join(b, ["g", "dst"]).groupBy("g").agg(
        F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("win"))
    tot = nodes.groupBy("g", "comm", "m2").agg(F.sum("k").alias("t")).groupBy("g", "m2").agg(F.sum(F.col("t") * F.col("t")).alias("sq"))
    return tot.join(inside, "g", "left").select(
        "g", (F.coalesce("win", F.lit(0.0)) / F.col("m2") - gamma * F.col("sq") / (F.col("m2") * F.col("m2"))).alias("q"))


def louvain(edges: DataFrame, gamma: float = 1.0, max_levels: int = 6, max_rounds: int = 10,
            vertices: DataFrame | None = None) -> DataFrame:
    """(g, id, community) of weighted undirected edges (src, dst, w[, g]).

    `vertices` (id[, g]) adds vertices without edges as communities of their own.
    """
    if "g" not in edges.columns:
        edges = edges.withColumn("g", F.lit(0).cast("bigint"))
        if vertices is not None:
            vertices = vertices.withColumn("g", F.lit(0).cast("bigint"))
    adj = cut_lineage(both_ways(edges.select("g", "src", "dst", "w"), "g", "w").select("g", "src", "dst", "w"))
    member = None
    for level in range(max_levels):
        nodes = adj.groupBy("g", F.col("src").alias("id")).agg(F.sum("w").alias("k"))
        nodes = nodes.join(adj.groupBy("g").agg(F.sum("w").alias("m2")), "g").select("g", "id", F.col("id").alias("comm"), "k", "m2")
        loose = adj.where("src <> dst")
        quiet, turn = 0, level * 1000
        for _ in range(max_rounds):
            state = cut_lineage(_round(loose, nodes, turn, gamma))
            facts = state.agg(F.sum(F.col("moved").cast("int")).alias("moved"), F.count(F.lit(1)).alias("n")).first()
            nodes = state.drop("moved")
            turn += 1
            quiet = quiet + 1 if facts["moved"] <= 0.005 * facts["n"] else 0
            if quiet >= 2:
                break
        found = nodes.select("g", "id", "comm")
        # A community takes the name of its smallest vertex: stable whatever the order of moves.
        named = found.join(found.groupBy("g", "comm").agg(F.min("id").alias("name")), ["g", "comm"]).select("g", "id", F.col("name").alias("comm"))
        named = cut_lineage(named)
        before = facts["n"]
        after = named.select("g", "comm").distinct().count()
        if member is None:
            member = named.select("g", "id", "comm")
        else:
            up = named.select("g", F.col("id").alias("comm"), F.col("comm").alias("up"))
            member = cut_lineage(member.join(up, ["g", "comm"]).select("g", "id", F.col("up").alias("comm")))
        if after == before:
            break
        a = named.select("g", F.col("id").alias("src"), F.col("comm").alias("cs"))
        b = named.select("g", F.col("id").alias("dst"), F.col("comm").alias("cd"))
        adj = cut_lineage(adj.join(a, ["g", "src"]).join(b, ["g", "dst"]).groupBy("g", F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(
            F.sum("w").alias("w")))
    out = member.select("g", "id", F.col("comm").alias("community"))
    if vertices is not None:
        lone = vertices.select("g", "id").join(out, ["g", "id"], "left_anti")
        out = out.unionByName(lone.select("g", "id", F.col("id").alias("community")))
    return out


def modularity_by_graph(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(g, q) for many graphs at once; `membership` is (g, id, community)."""
    adj = both_ways(edges.select("g", "src", "dst", "w"), "g", "w")
    k = adj.groupBy("g", F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    m2 = adj.groupBy("g").agg(F.sum("w").alias("m2"))
    nodes = k.join(m2, "g").join(membership.select("g", "id", F.col("community").alias("comm")), ["g", "id"])
    return _quality(adj, nodes, gamma)


def keep_large(membership: DataFrame, min_size: int, weights: DataFrame | None = None, min_weight: float | None = None) -> DataFrame:
    """(g, id, cluster): communities below the limits become 0, the others 1.. by size.

    Both limits must hold; `weights` is (id, mult).
    """
    m = membership
    m = m.join(weights.select("id", "mult"), "id", "left") if weights is not None else m.withColumn("mult", F.lit(1))
    size = m.groupBy("g", "community").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("mult", F.lit(1))).alias("mass"))
    kept = size.where((F.col("n") >= min_size) & (F.col("mass") >= (min_weight or 0)))
    # One row per kept community.
    order = Window.partitionBy("g").orderBy(F.desc("mass"), "community")
    kept = kept.select("g", "community", F.row_number().over(order).cast("bigint").alias("cluster"))
    return membership.join(kept, ["g", "community"], "left").select("g", "id", F.coalesce("cluster", F.lit(0)).cast("bigint").alias("cluster"))
