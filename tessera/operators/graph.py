"""Neighbour graphs as edge tables (src < dst, d, w) and measures on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def knn_graph(
    nn: DataFrame, mode: str = "union", divisor: float = 2.0, mult: DataFrame | None = None,
    floor: float = 1e-12, weighted: bool = True,
) -> DataFrame:
    """Gaussian weights exp(-d^2 / (divisor * s_i * s_j)); s is the k-th distance.

    `mode` union keeps a pair that either end names, mutual needs both.  With
    `mult` (id, mult) weights grow by the square root of both multiplicities.
    """
    pairs = nn.groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(
        F.max("d").alias("d"), F.count(F.lit(1)).alias("_votes"))
    if mode == "mutual":
        pairs = pairs.where("_votes = 2")
    pairs = pairs.drop("_votes")
    if not weighted:
        return pairs.withColumn("w", F.lit(1.0))
    scale = nn.groupBy("i").agg(F.max("d").alias("s"))
    # Copies alone within reach: fall back to the mean positive distance named.
    spare = nn.where("d > 0").agg(F.avg("d")).scalar()
    scale = scale.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce(spare, F.lit(1.0))))
    for end in ("src", "dst"):
        pairs = pairs.join(scale.select(F.col("i").alias(end), F.col("s").alias(f"s_{end}")), end)
    w = F.exp(-(F.col("d") * F.col("d")) / (F.lit(divisor) * F.col("s_src") * F.col("s_dst")))
    if mult is not None:
        for end in ("src", "dst"):
            m = mult.select(F.col("id").alias(end), F.greatest(F.coalesce("mult", F.lit(1)), F.lit(1)).alias(f"m_{end}"))
            pairs = pairs.join(m, end, "left")
        w = w * F.sqrt(F.coalesce("m_src", F.lit(1)) * F.coalesce("m_dst", F.lit(1)))
    return pairs.select("src", "dst", "d", F.greatest(w, F.lit(floor)).alias("w"))


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """Each edge in both directions, in one pass over the table."""
    two = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                  F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(two).alias("_e"), *cols).select("_e.src", "_e.dst", *cols)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges, "w").groupBy(F.col("src").alias("id")).agg(
        F.sum("w").alias("strength"), F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): large-star / small-star, only minima move, never groups."""
    state = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where(
        "u <> v").distinct()
    state = cut_lineage(state)
    seen = None
    for _ in range(max_rounds):
        sym = state.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
                                     ).alias("e")).select("e.u", "e.v")
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e")
        ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        # A file holds about half a million rows, by the size of the round before.
        state = cut_lineage(small if seen is None else small.repartition(max(1, seen[0] // 500_000)))
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components still merge after {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


def spanning_tree(edges: DataFrame, length: str = "d", max_rounds: int = 60) -> DataFrame:
    """(src, dst, length) of the edges of the least spanning tree, of each component one.

    Rounds after Boruvka: every component names its shortest edge (ties by the
    ends), components that an edge joins become one, and edges inside go.
    Components halve at least, so rounds grow with the logarithm of the graph.
    """
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    live = edges.where("src <> dst").select(*ends, F.col(length).alias("len")).groupBy("src", "dst").agg(F.min("len").alias("len"))
    live = cut_lineage(live.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("len", "src", "dst").alias("e")))
    tree = live.limit(0)
    for _ in range(max_rounds):
        if live.isEmpty():
            return tree.select("e.src", "e.dst", F.col("e.len").alias(length))
        sides = live.select(F.explode(F.array("a", "b")).alias("c"), F.struct("e", "a", "b").alias("e"))
        named = cut_lineage(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.e").distinct())
        tree = cut_lineage(tree.unionByName(named))
        joined = components(named.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for end in ("a", "b"):  # every component with an edge has named one
            live = live.join(joined.select(F.col("id").alias(end), F.col("component").alias(f"{end}_new")), end).drop(end).withColumnRenamed(f"{end}_new", end)
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e")
        live = cut_lineage(live.groupBy("a", "b").agg(F.min("e").alias("e")))
    raise RuntimeError(f"components still join after {max_rounds} rounds")


def tree_levels(tree: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, parent, level) of the vertices that the roots (id), one of a tree, reach, level by level."""
    ways = cut_lineage(both_ways(tree))
    found = cut_lineage(roots.select("id", F.lit(None).cast(dict(tree.dtypes)["src"]).alias("parent"), F.lit(0).alias("level")))
    front = found
    for level in range(1, max_rounds):
        back = front.select(F.col("id").alias("src"), F.col("parent").alias("came"))
        # In a tree only the parent has been seen before.
        front = cut_lineage(ways.join(back, "src").where("came IS NULL OR dst <> came").select(
            F.col("dst").alias("id"), F.col("src").alias("parent"), F.lit(level).alias("level")))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"the tree is deeper than {max_rounds} levels")


def graph_report(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: V, E, components, largest, isolates."""
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    v = vertices.select(F.col("id")).distinct().agg(F.count(F.lit(1)).alias("v"))
    e = edges.agg(F.count(F.lit(1))).scalar()
    linked = comp.agg(F.count(F.lit(1))).scalar()
    lone = F.col("v") - linked
    count = sizes.agg(F.count(F.lit(1))).scalar()
    largest = sizes.agg(F.max("n")).scalar()
    return v.select("v", e.alias("e"), (count + lone).alias("components"),
                    F.greatest(F.coalesce(largest, F.lit(0)), F.least(F.lit(1), "v")).cast("bigint").alias("largest"),
                    lone.alias("isolates"))


def _with_ends(edges: DataFrame, membership: DataFrame, value: str) -> DataFrame:
    a = membership.select(F.col("id").alias("src"), F.col(value).alias("c_src"))
    b = membership.select(F.col("id").alias("dst"), F.col(value).alias("c_dst"))
    return edges.join(a, "src").join(b, "dst")


def modularity(edges: DataFrame, membership: DataFrame, cluster: str = "cluster", resolution: float = 1.0) -> DataFrame:
    """(q) of a given partition; edge ends are summed per cluster in one pass."""
    ends = _with_ends(edges, membership, cluster)
    parts = F.array(F.struct(F.col("c_src").alias("c"), F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0).alias("win")),
                    F.struct(F.col("c_dst").alias("c"), F.lit(0.0).alias("win")))
    per = ends.select(F.explode(parts).alias("p"), "w").groupBy("p.c").agg(
        F.sum("p.win").alias("win"), F.sum("w").alias("tot"))
    facts = per.agg(F.sum("win").alias("win"), F.sum("tot").alias("two_m"), F.sum(F.col("tot") * F.col("tot")).alias("sq"))
    two_m = F.col("two_m")
    return facts.where(two_m > 0).select((2 * F.col("win") / two_m - resolution * F.col("sq") / (two_m * two_m)).alias("q"))


def assortativity(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(label, r) from the symmetrised 2x2 edge mix; `sets` holds (id, labels).

    Per label only edges that touch it are expanded; the rest follows from the
    edge count.
    """
    ends = _with_ends(edges, sets, "labels")
    e = edges.agg(F.count(F.lit(1))).scalar()
    touched = ends.select(
        F.explode(F.array_union("c_src", "c_dst")).alias("label"), "c_src", "c_dst")
    both = F.expr("array_contains(c_src, label) and array_contains(c_dst, label)")
    per = touched.groupBy("label").agg(
        F.sum(both.cast("int")).alias("n11"), F.count(F.lit(1)).alias("n_any")).withColumn("e", e.cast("double"))
    e11, e10 = F.col("n11") / F.col("e"), (F.col("n_any") - F.col("n11")) / (2 * F.col("e"))
    e00 = 1 - F.col("n_any") / F.col("e")
    a1, a0 = e11 + e10, e00 + e10
    ab = a1 * a1 + a0 * a0
    return per.select("label", F.when(F.abs(1 - ab) >= 1e-12, (e11 + e00 - ab) / (1 - ab)).alias("r"))


def neighbour_purity(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(label, purity): mean share of positive neighbours among positive vertices."""
    ways = both_ways(edges)
    own = sets.select(F.col("id").alias("src"), F.col("labels").alias("own"))
    other = sets.select(F.col("id").alias("dst"), F.col("labels").alias("theirs"))
    pairs = ways.join(own, "src").join(other, "dst")
    per = pairs.select("src", F.explode("own").alias("label"), "theirs").groupBy("src", "label").agg(
        F.avg(F.expr("array_contains(theirs, label)").cast("int")).alias("share"))
    return per.groupBy("label").agg(F.avg("share").alias("purity"))


def cluster_diagnostics(edges: DataFrame, membership: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: vertices, mass, internal edges and weight, cut, conductance, density."""
    ends = _with_ends(edges, membership, cluster)
    same = F.col("c_src") == F.col("c_dst")
    parts = F.array(
        F.struct(F.col("c_src").alias("c"), same.alias("inner"), F.lit(True).alias("lead")),
        F.struct(F.col("c_dst").alias("c"), same.alias("inner"), F.lit(False).alias("lead")))
    per = ends.select(F.explode(parts).alias("p"), "w").groupBy(F.col("p.c").alias(cluster)).agg(
        F.sum((F.col("p.inner") & F.col("p.lead")).cast("int")).alias("e_internal"),
        F.sum(F.when(F.col("p.inner") & F.col("p.lead"), F.col("w")).otherwise(0.0)).alias("w_internal"),
        F.sum(F.when(~F.col("p.inner"), F.col("w")).otherwise(0.0)).alias("cut_weight"),
        F.sum("w").alias("_vol"))
    mass = F.sum("mult") if "mult" in membership.columns else F.count(F.lit(1))
    size = membership.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_profiles"), mass.alias("weight"))
    n = F.col("n_profiles")
    return size.join(per, cluster, "left").select(
        cluster, "n_profiles", "weight", F.coalesce("e_internal", F.lit(0)).alias("e_internal"),
        F.coalesce("w_internal", F.lit(0.0)).alias("w_internal"), F.coalesce("cut_weight", F.lit(0.0)).alias("cut_weight"),
        F.when(F.col("_vol") > 0, F.coalesce("cut_weight", F.lit(0.0)) / F.col("_vol")).alias("conductance"),
        F.when(n > 1, 2 * F.coalesce("e_internal", F.lit(0)) / (n * (n - 1))).alias("density"))


def soft_scores(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(s_nn, q_soft) of soft memberships (id, u ARRAY<DOUBLE>) with rows summing to one.

    s_nn is the edge-weighted mean of u_i . u_j.  q_soft subtracts the degree
    expectation over the same edges, scaled by the mean squared membership.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    deg = degrees(edges).join(membership, "id").select("id", F.struct("strength", "u").alias("e"))
    ends = _with_ends(edges, deg, "e")
    facts = ends.agg(
        F.sum(F.col("w") * dot("c_src.u", "c_dst.u")).alias("wd"), F.sum("w").alias("m"),
        F.sum(F.col("c_src.strength") * F.col("c_dst.strength")).alias("kk"))
    square = membership.agg(F.avg(dot("u", "u"))).scalar()
    m = F.col("m")
    return facts.select((F.col("wd") / m).alias("s_nn"),
                        ((F.col("wd") - F.col("kk") * square / (2 * m)) / (2 * m)).alias("q_soft"))


def absorb_support(edges: DataFrame, membership: DataFrame, cluster: str = "cluster",
                   purity: float = 0.70, min_neighbours: int = 3) -> DataFrame:
    """Leftover vertices (cluster 0) with the cluster that supports them best."""
    ways = both_ways(edges, "w", "d")
    me = membership.where(F.col(cluster) == 0).select(F.col("id").alias("src"))
    near = membership.where(F.col(cluster) != 0).select(
        F.col("id").alias("dst"), F.col(cluster).alias("c"), F.coalesce("mult", F.lit(1)).alias("m"))
    votes = ways.join(me, "src").join(near, "dst").groupBy("src", "c").agg(
        F.sum(F.col("w") * F.col("m")).alias("s"), F.count(F.lit(1)).alias("k"), F.expr("median(d)").alias("med_d"))
    per = votes.groupBy("src").agg(
        F.max_by(F.struct("c", "med_d"), F.struct("s", -F.col("c"))).alias("best"), F.max("s").alias("top"),
        F.sum("s").alias("all"), F.sum("k").alias("k"))
    return per.where((F.col("k") >= min_neighbours) & (F.col("top") >= purity * F.col("all"))).select(
        F.col("src").alias("id"), F.col("best.c").alias(cluster), (F.col("top") / F.col("all")).alias("purity"),
        F.col("best.med_d").alias("med_d"))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two labelings, from the contingency counts."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(c.cast("double") * (c.cast("double") - 1) / 2)
    ra = t.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).scalar()
    rb = t.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).scalar()
    cells = t.agg(F.sum("n").alias("n"), pairs(F.col("n")).alias("ij"))
    cells = cells.select("n", "ij", ra.alias("ra"), rb.alias("rb"))
    all_ = F.col("n").cast("double") * (F.col("n") - 1) / 2
    expected = F.col("ra") * F.col("rb") / all_
    den = (F.col("ra") + F.col("rb")) / 2 - expected
    return cells.select("n", F.when(den <= 0, 0.0).otherwise((F.col("ij") - expected) / den).alias("ari"))


def adjusted_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mi, emi, ami): mutual information against its expectation under fixed margins.

    The normaliser is the larger of the two entropies.
    """
    from tessera.functions.exact import expected_information

    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra = t.groupBy("a").agg(F.sum("n").alias("r"))
    rb = t.groupBy("b").agg(F.sum("n").alias("c"))
    total = t.agg(F.sum("n")).scalar()
    n = total.cast("double")
    cells = t.join(ra, "a").join(rb, "b").withColumn("t", n)
    mi = cells.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("t") * F.col("n") / (F.col("r") * F.col("c"))))).scalar()
    entropy = lambda m, c: m.withColumn("t", n).agg(-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).scalar()
    # Cells with equal margins share their expectation.
    rows = ra.groupBy("r").agg(F.count(F.lit(1)).alias("kr"))
    cols = rb.groupBy("c").agg(F.count(F.lit(1)).alias("kc")).agg(F.collect_list(F.struct("c", "kc"))).scalar()
    grid = rows.select("r", "kr", F.explode(cols).alias("e")).select("r", "kr", "e.c", "e.kc").withColumn("t", n)
    emi = grid.agg(F.sum(F.col("kr") * F.col("kc") * expected_information("r", "c", "t")).alias("emi"))
    top = F.greatest(entropy(ra, "r"), entropy(rb, "c"))
    return emi.select(mi.alias("mi"), "emi", top.alias("h")).select("mi", "emi", ((F.col("mi") - F.col("emi")) / (F.col("h") - F.col("emi"))).alias("ami"))
