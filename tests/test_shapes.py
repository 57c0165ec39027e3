"""Planted truth for curves, groups, frames and factorisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bundle as B
from tessera.operators import curves as Cu
from tessera.operators import encoding as E
from tessera.operators import graph as G
from tessera.operators import linkage as K
from tessera.operators import neighbours as N
from tessera.operators import resample as Rs
from tessera.operators import soft_clusters as S
from tessera.operators import weights as W
from tessera.operators.geometry import convex_hull, grid
from tessera.session import cut_lineage


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")


def brute_complete(d, eps):
    groups = [{i} for i in range(len(d))]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                h = max(d[i, j] for i in groups[a] for j in groups[b])
                if h <= eps and (best is None or h < best[0]):
                    best = (h, a, b)
        if best is None:
            return {frozenset(g) for g in groups}
        _, a, b = best
        groups[a] |= groups.pop(b)


def test_complete_linkage_matches_one_merge_at_a_time(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (1, 0), (0.4, 0.7))])
    x[5] = x[6]
    got = {}
    for r in K.complete_groups(points(spark, x), 0.3).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {frozenset(g) for g in got.values()} == brute_complete(d, 0.3)


def test_medoids_of_blobs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.2, (25, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    t = N.medoid_clusters(points(spark, x), 3).select("id", "cluster").withColumn("truth", F.floor(F.col("id") / 25))
    assert G.partition_agreement(t, "cluster", "truth").first()["ari"] == 1.0


def test_curve_through_an_arc(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, np.pi, 200)
    x = np.column_stack([np.cos(a), np.sin(a)]) + rng.normal(0, 0.03, (200, 2))
    p = points(spark, x)
    c = cut_lineage(Cu.principal_curve(p))
    t = np.array([r["t"] for r in c.orderBy("id").collect()])
    assert Cu.curve_r2(p, c) > 0.98
    assert abs(np.corrcoef(t, a)[0, 1]) > 0.98
    # Residuals along the rolling normal carry the whole distance to the curve in two dimensions.
    w = Cu.rolling_normal(c, span=50).join(c.select("id", "d2"), "id")
    assert w.count() == 200 and w.agg(F.corr(F.abs("w"), F.sqrt("d2"))).first()[0] > 0.9


def test_curved_sheet_beats_its_linear_baseline(spark):
    rng = np.random.default_rng(4)
    u = rng.uniform(-1, 1, (400, 2))
    x = np.column_stack([3 * u[:, 0], 3 * u[:, 1], 2 * u[:, 0] ** 2 - u[:, 1] ** 2]) + rng.normal(0, 0.02, (400, 3))
    r = Cu.manifold_r2(points(spark, x), 2)
    assert r["r2_cv"] > 0.97 and r["delta_r2"] > 0.01


def test_flat_frames_have_no_curvature(spark):
    rng = np.random.default_rng(5)
    base = rng.uniform(-1, 1, (400, 2))
    x = np.zeros((400, 6))
    x[:, :2] = rng.normal(0, 1, (400, 2)) * [2, 1]
    x += rng.normal(0, 1e-3, x.shape)
    rows = [(i, [float(v) for v in base[i]], [float(v) for v in x[i]]) for i in range(400)]
    pts = spark.createDataFrame(rows, "id bigint, base array<double>, x array<double>")
    framed = B.frames(pts, grid(spark, (-1, 1), (-1, 1), 4, 4))
    assert B.common_rank(framed) == 2
    framed = B.along_tree(framed, 2)
    edges = B.connection(framed, 2)
    assert edges.count() == 24 and edges.agg(F.max("theta_rms")).first()[0] < 0.05
    curv = B.curvature(edges, framed, 2)
    assert curv.count() == 9 and curv.agg(F.max("curv")).first()[0] < 0.05
    energy = np.array([r["energy"] for r in B.fibre_energy(pts, framed, 2).orderBy("id").collect()])
    assert np.corrcoef(energy, (x[:, :2] ** 2).sum(1))[0, 1] > 0.9


def test_factorisation_finds_two_groups(spark):
    rng = np.random.default_rng(6)
    p = np.vstack([[0.9, 0.8, 0.1, 0.1]] * 30 + [[0.1, 0.1, 0.9, 0.7]] * 30) + rng.uniform(-0.05, 0.05, (60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(p)], "id bigint, p array<double>")
    edges = cut_lineage(G.knn_graph(N.knn(df.select("id", F.col("p").alias("vec")), 6)))
    table, best = S.sweep(df, edges, [2], [0.1], 2, starts=1, n_iter=6)
    hard = best.select("id", F.array_position("u", F.array_max("u")).alias("c"), F.floor(F.col("id") / 30).alias("truth"))
    assert G.partition_agreement(hard, "c", "truth").first()["ari"] == 1.0
    assert table[0]["eff_k"] == 2 and table[0]["recon"] > 0.8


def test_matching_is_optimal():
    rng = np.random.default_rng(7)
    import itertools

    for n in (2, 4, 5):
        t = rng.integers(0, 20, (n, n)).astype(float)
        got = sum(t[i, j] for i, j in enumerate(S.best_matching(t)))
        assert got == max(sum(t[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_noise_item_loses_weight(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([np.linspace(0, 1, 120), rng.random(120)])
    w, history = W.optimise(points(spark, x), 2, ["signal", "noise"], max_iter=1)
    assert history[-1]["dim"] < history[0]["dim"] and min(w.values()) < 1


def test_hull_of_a_square(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.uniform(0.1, 0.9, (200, 2)), [[0, 0], [1, 0], [1, 1], [0, 1]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "x double, y double").repartition(5)
    assert {(r["x"], r["y"]) for r in convex_hull(df, "x", "y").collect()} == {(0, 0), (1, 0), (1, 1), (0, 1)}


def test_group_weights_equal_row_weights(spark):
    rows = [(i, f"g{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g string").repartition(4)
    got = {(r["g"], r["rep"]): r["w"] for r in Rs.poisson_counts(df, ["g"], 4).collect()}
    w = Rs.poisson_weights(np.arange(300), np.arange(4), 42)
    assert all(got[(f"g{g}", r)] == w[g::3, r].sum() for g in range(3) for r in range(4))


def test_levels_are_checked_before_they_become_columns(spark):
    with pytest.raises(ValueError, match="levels"):
        E.design(spark.range(500).select("id", F.col("id").cast("string").alias("s")), "id", [], ["s"], max_levels=50)


def test_frames_follow_the_tree(spark):
    """One frame turned at random at every node of a lattice: along the tree all turns are undone."""
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(6, 3)))[0]
    rows = []
    for ix in range(4):
        for iy in range(3):
            if (ix, iy) in ((1, 0), (1, 1), (1, 2)):
                continue  # two parts
            r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
            r[:, 0] *= np.sign(np.linalg.det(r))
            rows.append((10 * ix + iy, ix, iy, float(ix), float(iy), 3, [0.0] * 6, (base @ r).T.ravel().tolist()))
    framed = spark.createDataFrame(rows, "node bigint, ix int, iy int, gx double, gy double, rank int, mu array<double>, q array<double>")
    assert B.connection(framed, 3).agg({"fro_log": "max"}).first()[0] > 0.5
    turned = B.along_tree(framed, 3)
    assert turned.count() == len(rows) and turned.columns == framed.columns
    assert B.connection(turned, 3).agg({"fro_log": "max"}).first()[0] < 1e-6
    assert B.connection(turned, 3).agg({"theta_rms": "max"}).first()[0] < 1e-6


def test_medoids_against_all_swaps(spark):
    x = np.random.default_rng(31).normal(size=(60, 2))
    x[7] = x[8]
    d, k = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 4
    cost = lambda m: d[:, sorted(m)].min(1).sum()
    best = lambda options: min(options, key=lambda o: (round(cost(o[0]), 9), *o[1:]))[0]
    taken = set()
    while len(taken) < k:
        taken = best([(taken | {c}, c) for c in range(60) if c not in taken])
    while True:
        swapped = best([(taken - {m} | {c}, c, i) for i, m in enumerate(sorted(taken)) for c in range(60) if c not in taken])
        if cost(swapped) > cost(taken) - 1e-9:
            break
        taken = swapped
    got = {r.id: r.cluster for r in N.medoid_clusters(points(spark, x), k).collect()}
    assert got == {i: int(d[i, sorted(taken)].argmin()) for i in range(60)}
    assert len({r.cluster for r in N.medoid_clusters(points(spark, x[:3]), 5).collect()}) == 3


def test_matching_and_relabelling(spark):
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(60):
        rows, cols = rng.integers(1, 6, 2)
        table = rng.integers(0, 4, (rows, cols)).astype(float)
        n = max(rows, cols)
        full = np.zeros((n, n))
        full[:rows, :cols] = table
        want = min(permutations(range(n)), key=lambda p: (-sum(full[i, j] for i, j in enumerate(p)), p))
        assert S.first_matching(table) == list(want[:rows])
    rows = [(i, i % 3, "bca"[i % 3] if i % 7 else "a") for i in range(60)]
    t = spark.createDataFrame(rows, "id bigint, cluster bigint, name string")
    names, counts = S.relabel(t.select("id", "cluster"), t.select("id", F.col("name").alias("cluster")))
    assert {r.cluster: r.reference for r in names.collect()} == {0: "b", 1: "c", 2: "a"}
    assert counts.agg({"n": "sum"}).first()[0] == 60
    soft = spark.createDataFrame([(1, [0.2, 0.3, 0.5])], "id bigint, u array<double>")
    assert S.aligned(soft, names).first().u == [0.5, 0.2, 0.3]


def brute_local(t, y, node, span=0.2):
    gap = np.abs(t - node)
    h = np.sort(gap)[int(np.floor(span * len(t) + 1e-5)) - 1]
    near = gap < h if h > 0 else gap <= h
    x = (t[near] - node) / (h or 1.0)
    root = np.sqrt((1 - np.abs(x) ** 3) ** 3)
    return np.linalg.lstsq(root[:, None] * x[:, None] ** np.arange(3), root * y[near], rcond=1e-10)[0][0]


def test_local_regression_equals_weighted_least_squares_with_ties_and_gaps(spark):
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.uniform(0, 1, 120), np.repeat([0.3, 0.31, 0.5], 20), rng.uniform(4, 5, 60)])
    y = np.sin(3 * t) + rng.normal(0, 0.1, len(t))
    rows = [(float(a), float(b)) for a, b in zip(t, y)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "t double, y double").repartition(5)
    nodes = [0.0, 0.3, 0.31, 0.77, 2.5, 5.0]
    got = [r["y"] for r in Cu.local_regression(df, nodes, ["y"]).orderBy("node").collect()]
    assert got == pytest.approx([brute_local(t, y, n) for n in nodes], abs=1e-7)
    assert Cu.reach(df.dropna(), np.array(nodes), 48).tolist() == [np.sort(np.abs(t - n))[47] for n in nodes]


def test_local_regression_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)] * 5, "t double, y double")
    assert Cu.local_regression(df, [1.0], ["y"]).first()["y"] == pytest.approx(3.0)
    assert Cu.local_regression(df.where("t > 1"), [1.0], ["y"]).first()["y"] is None
