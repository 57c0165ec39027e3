"""Planted truth, invariants and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scalar import fold_of
from tessera.operators import association as A
from tessera.operators import communities as C
from tessera.operators import encoding as E
from tessera.operators import graph as G
from tessera.operators import intrinsic as I
from tessera.operators import labels as L
from tessera.operators import linalg as LA
from tessera.operators import metrics as M
from tessera.operators import models as Md
from tessera.operators import neighbours as N
from tessera.operators import ordered as O
from tessera.operators import resample as Rs
from tessera.operators import weights as W
from tessera.session import cut_lineage


def points(spark, x, cluster=None):
    rows = [(i, [float(v) for v in r], int(cluster[i]) if cluster is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, cluster bigint")


def scored(spark, pairs):
    return spark.createDataFrame([(i, int(y), float(s)) for i, (y, s) in enumerate(pairs)], "id bigint, y int, s double")


# --- neighbours ----------------------------------------------------------------------

@pytest.mark.parametrize("block", [16, 64, None])
@pytest.mark.parametrize("kind", ["euclid", "gower", "jaccard"])
def test_knn_equals_brute_force(spark, kind, block):
    rng = np.random.default_rng(3)
    if kind == "jaccard":
        x, metric = rng.integers(0, 2, (150, 8)).astype(float), N.Metric("jaccard")
    elif kind == "gower":
        x, metric = np.column_stack([rng.random((150, 2)), rng.integers(0, 3, (150, 2))]), N.Metric("gower", 2, (1.0, 1.0, 0.5, 2.0))
    else:
        # A third of the points are copies of one.
        x, metric = rng.normal(size=(150, 2)), N.Metric()
        x[:50] = x[0]
    d = metric.between(x, x)
    got = {}
    for r in N.knn(points(spark, x), 4, metric, block=block).collect():
        got.setdefault(r["i"], {})[r["rank"]] = r["j"]
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in want]


def test_knn_between_two_tables(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(90, 3)), rng.normal(size=(70, 3))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for r in N.knn(points(spark, b), 1, queries=points(spark, a), block=16).collect():
        assert d[r["i"]].argmin() == r["j"]


def test_knn_with_fewer_points_than_k(spark):
    assert N.knn(points(spark, np.eye(3)), 10).count() == 6


def test_gower_is_symmetric_and_bounded():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.random((30, 2)), rng.integers(0, 3, 30)])
    d = N.Metric("gower", 2, (1.0, 1.0, 1.0)).between(x, x)
    assert np.allclose(d, d.T) and d.min() >= 0 and d.max() <= 1


# --- ordered operators ---------------------------------------------------------------

def test_running_totals_with_a_heavy_value(spark):
    values = [5.0] * 400 + list(np.random.default_rng(1).normal(size=300)) + [9.0] * 100
    df = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(values)], "id bigint, v double, one int")
    got = O.running_totals(df, "v", ["one"], tie="id").orderBy("upto_one").collect()
    want = sorted((v, i) for i, v in enumerate(values))
    assert [(r["v"], r["id"]) for r in got] == want
    assert [r["upto_one"] for r in got] == list(range(1, len(values) + 1))


def test_previous_row_across_ranges(spark):
    values = np.random.default_rng(2).permutation(200).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id bigint, v double")
    for r in O.with_previous(df, "v", ["v"]).collect():
        assert r["prev_v"] == (None if r["v"] == 0 else r["v"] - 1)


def test_quantiles_and_ranks_match_numpy(spark):
    x = np.round(np.random.default_rng(3).normal(size=301), 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id bigint, v double")
    q = O.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    assert [q["a"], q["b"], q["c"]] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.975]))
    ranks = {r["id"]: r["rank"] for r in O.average_rank(df, "v").collect()}
    assert all(ranks[i] == (x < v).sum() + ((x == v).sum() + 1) / 2 for i, v in enumerate(x))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_benjamini_hochberg(spark, by):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5, 0.04]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(p)], "i int, p double, g int")
    got = {r["i"]: r["q"] for r in O.benjamini_hochberg(df, by=by).collect()}
    valid = [(v, i) for i, v in enumerate(p) if v is not None]
    for v, i in valid:
        want = min(1.0, min(w * len(valid) / sum(u <= w for u, _ in valid) for w, _ in valid if w >= v))
        assert got[i] == pytest.approx(want)
    assert got[4] is None


# --- labels and association ------------------------------------------------------------

def test_profiles_then_expand_is_the_identity(spark):
    wide = spark.createDataFrame([(1, 1, 0, None), (2, 1, 0, 0), (3, 0, 0, 0), (4, 0, 1, 1)], "id int, a int, b int, c int")
    sets = L.wide_to_sets(wide, "id", ["a", "b", "c"])
    pr = L.profiles(sets, "id")
    # NULL counts as 0 in the signature, so 1 and 2 share a profile.
    assert {tuple(r["labels"]): r["mult"] for r in pr.collect()} == {("a",): 2, (): 1, ("b", "c"): 1}
    back = {r["id"]: r["labels"] for r in L.expand(sets, pr).collect()}
    assert back == {r["id"]: r["labels"] for r in sets.collect()}


def test_planted_label_is_found_and_null_labels_are_not(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2000):
        c = i % 4
        labels = ["hot"] if rng.random() < (0.5 if c == 1 else 0.1) else []
        rows.append((i, f"c{c}", labels + (["flat"] if rng.random() < 0.3 else [])))
    t = A.enrichment(A.cells(spark.createDataFrame(rows, "id bigint, cluster string, labels array<string>"))).collect()
    major = {(r["cluster"], r["label"]) for r in t if r["major"]}
    assert major == {("c1", "hot")}


def test_three_lifts_are_different_things(spark):
    t = A.with_lifts(spark.createDataFrame([("x", "l", 30, 10, 70, 190, 100, 300)], "cluster string, label string, a int, b int, c int, d int, n_in int, n int"))
    r = t.first()
    assert (r["lift_overall"], r["lift_out"]) == pytest.approx((0.3 / (40 / 300), 0.3 / 0.05))


def test_primary_label_breaks_ties_by_name(spark):
    sets = spark.createDataFrame([(1, ["a", "ab"]), (2, ["ab"]), (3, ["a"])], "id int, labels array<string>")
    assert {r["id"]: r["primary"] for r in L.primary_label(sets, "id").collect()} == {1: "a", 2: "ab", 3: "a"}


# --- metrics -----------------------------------------------------------------------------

def test_auc_flips_with_the_score_and_halves_on_ties(spark):
    rng = np.random.default_rng(6)
    pairs = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(200)]
    a = M.auc(M.score_table(scored(spark, pairs))).first()["auc"]
    b = M.auc(M.score_table(scored(spark, [(y, -s) for y, s in pairs]))).first()["auc"]
    assert a + b == pytest.approx(1.0)
    assert M.auc(M.score_table(scored(spark, [(1, 1), (0, 1), (0, 1)]))).first()["auc"] == 0.5


def test_weighted_auc_never_exceeds_one(spark):
    # Ties with the negatives count half, not one and a half.
    df = spark.createDataFrame([(1, 0.9, 5.0), (0, 0.9, 5.0), (0, 0.1, 1.0)], "y int, s double, w double")
    assert M.auc(M.score_table(df, w="w")).first()["auc"] == pytest.approx((1 + 2.5) / 6)


def test_one_class_gives_null(spark):
    t = M.score_table(scored(spark, [(1, 0.2), (1, 0.4)]))
    assert M.auc(t).first()["auc"] is None and M.auprc(t).first()["auprc"] is None and M.brier(t).first()["brier_r2"] is None


def test_perfect_scores(spark):
    t = M.score_table(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]))
    assert M.auc(t).first()["auc"] == 1.0 and M.auprc(t).first()["auprc"] == 1.0 and M.auprg(t).first()["auprg"] == pytest.approx(1.0)


def test_isotonic_matches_sequential_pooling(spark):
    rng = np.random.default_rng(7)
    s = rng.random(400)
    y = (rng.random(400) < 0.3 + 0.4 * s).astype(int)
    t = M.score_table(scored(spark, list(zip(y, s))))
    blocks = []
    for _, v in sorted(zip(s, y)):
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1]]
    got = M.isotonic_blocks(t).orderBy("lo").collect()
    assert [r["m"] for r in got] == pytest.approx([a / b for a, b in blocks])
    assert [r["w"] for r in got] == [b for _, b in blocks]


# --- graphs and communities -----------------------------------------------------------------

def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + j) for j in range(1, 40)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("w", F.lit(1.0))
    c = {r["id"]: r["component"] for r in G.components(df).collect()}
    assert {c[i] for i in range(61)} == {0} and {c[100 + j] for j in range(40)} == {100}


def test_modularity_of_one_community_is_zero(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0)], "src bigint, dst bigint, w double")
    m = spark.createDataFrame([(i, 0) for i in range(4)], "id bigint, cluster bigint")
    assert G.modularity(df, m).first()["q"] == pytest.approx(0.0)


def test_communities_of_linked_cliques(spark):
    edges = [(8 * c + i, 8 * c + j) for c in range(4) for i in range(8) for j in range(i + 1, 8)] + [(7, 8), (15, 16), (23, 24)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("w", F.lit(1.0))
    m = C.louvain(df)
    t = m.select("id", F.col("community").alias("a"), F.floor(F.col("id") / 8).alias("b"))
    assert G.partition_agreement(t, "a", "b").first()["ari"] >= 0.95


def test_rewiring_keeps_degrees_and_makes_no_loops_or_copies(spark):
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (150, 2)).tolist() if p[0] != p[1]}
    df = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint").withColumn("w", F.rand(1))
    out = cut_lineage(Rs.rewired(df, 2, 4))
    before = {r["id"]: r["degree"] for r in G.degrees(df).collect()}
    for g in (0, 1):
        one = out.where(F.col("g") == g)
        assert {r["id"]: r["degree"] for r in G.degrees(one).collect()} == before
        assert one.select("src", "dst").distinct().count() == len(pairs) and one.where("src = dst").isEmpty()
    assert out.where("g = 0").join(df, ["src", "dst"]).count() < len(pairs)


def test_silhouette_of_separate_blobs(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 5)])
    assert N.silhouettes(points(spark, x, [0] * 20 + [1] * 20)).agg(F.min("width")).first()[0] > 0.9


# --- dimension, linear algebra ------------------------------------------------------------------

def test_two_neighbour_dimension_of_a_cube(spark):
    x = np.random.default_rng(10).random((1500, 3))
    nn = N.knn(points(spark, x), 15)
    assert I.two_nn(nn).first()["dim"] == pytest.approx(3, rel=0.15)
    assert I.levina_bickel(nn).agg(F.avg("dim")).first()[0] == pytest.approx(3, rel=0.2)


def test_trust_is_one_for_the_same_space(spark):
    p = points(spark, np.random.default_rng(11).normal(size=(80, 3))).select("id", "vec")
    r = I.trust_continuity(p, p, [5]).first()
    assert r["trust"] == 1.0 and r["continuity"] == 1.0


def test_principal_axes_match_numpy(spark):
    x = np.random.default_rng(12).normal(size=(300, 5)) * [5, 3, 1, 1, 1] + 1e6
    mean, axes, shares = LA.principal_axes(points(spark, x), 2)
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert shares == pytest.approx(val[:2] / val.sum(), rel=1e-6) and mean == pytest.approx(x.mean(0))


def test_scaling_recovers_euclidean_distances(spark):
    x = np.random.default_rng(13).normal(size=(60, 2)) * [3, 1]
    p = points(spark, x)
    r = LA.pair_agreement(p, LA.classical_scaling(p, 2)).first()
    assert r["stress1"] < 1e-3


def test_eigenmaps_match_the_dense_solution(spark):
    rng = np.random.default_rng(14)
    x = np.vstack([rng.normal(c, 0.4, (30, 2)) for c in ((0, 0), (1.6, 0), (0.8, 1.4))])
    g = cut_lineage(G.knn_graph(N.knn(points(spark, x), 8)))
    n = len(x)
    w = np.zeros((n, n))
    for r in g.collect():
        w[r["src"], r["dst"]] = w[r["dst"], r["src"]] = r["w"]
    k = w.sum(1)
    _, vec = np.linalg.eigh(np.eye(n) - w / np.sqrt(np.outer(k, k)))
    got = np.array([r["v"] for r in LA.laplacian_eigenmaps(g, 2, rounds=3, degree=10).orderBy("id").collect()])
    assert np.linalg.svd(vec[:, 1:3].T @ got)[1].min() > 0.99


def test_shortest_paths(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "src bigint, dst bigint, d double")
    got = {r["id"]: r["d"] for r in LA.shortest_paths(df, spark.createDataFrame([(0,)], "id bigint")).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}


# --- models and resampling ------------------------------------------------------------------------

def test_surface_recovers_a_logistic_field(spark):
    df = spark.range(6000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("u"))
    p = 1 / (1 + F.exp(-(2 * F.sin(6 * F.col("a")) + 2 * F.col("b") - 1)))
    rows = cut_lineage(df.select("id", F.array("a", "b").alias("x"), fold_of("id", 5).cast("int").alias("fold"),
                                 F.array((F.col("u") < p).cast("double")).alias("y"), p.alias("p_true")))
    m = Md.fit(rows, ["l"], Md.surface_basis(rows, 36))
    assert Md.predict(rows, m).join(rows, "id").agg(F.corr("p", "p_true")).first()[0] > 0.95


def test_linear_model_matches_least_squares(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=200)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 5, [float(y[i])]) for i in range(200)], "id bigint, x array<double>, fold int, y array<double>")
    m = Md.fit(rows, ["y"], Md.Basis("linear", 2), "gaussian", penalties=[0.0])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert m.beta[0] == pytest.approx(want, abs=1e-5)


def test_bootstrap_is_centred_and_repeatable(spark):
    rng = np.random.default_rng(16)
    y = rng.random(400) < 0.4
    s = rng.normal(size=400) + y
    d = scored(spark, list(zip(y, s))).withColumn("label", F.lit("l"))
    t = cut_lineage(M.score_table(d, by=["label"]))
    want = M.auc(t, ["label"]).first()["auc"]
    one, two = (Rs.stratified_bootstrap(t, 100).agg(F.avg("auc"), F.avg("auprg")).first() for _ in range(2))
    assert one[0] == pytest.approx(want, abs=0.01) and one[0] == pytest.approx(two[0])
    assert one[1] == pytest.approx(M.auprg(t, ["label"]).first()["auprg"], abs=0.05)
    draws = Rs.bootstrap_auc(d.withColumn("model", F.lit("m")), 100).agg(F.avg("auc")).first()[0]
    assert draws == pytest.approx(want, abs=0.01)


def test_identical_models_have_no_difference(spark):
    d = scored(spark, [(i % 2, float(i % 7)) for i in range(60)]).withColumn("label", F.lit("l"))
    both = d.withColumn("model", F.lit("a")).unionByName(d.withColumn("model", F.lit("b")))
    r = Rs.paired_delta(Rs.bootstrap_auc(both, 50), "a", "b").first()
    assert (r["p"], r["win"], r["delta_mean"]) == (1.0, 0.5, 0.0)


def test_permutations_rearrange_inside_strata(spark):
    ids = spark.range(90).select("id", (F.col("id") % 3).alias("g"))
    t = Rs.permutation(ids, 2, strata=["g"]).collect()
    for rep in (0, 1):
        part = [r for r in t if r["rep"] == rep]
        assert sorted(r["id"] for r in part) == sorted(r["source"] for r in part) == list(range(90))
        assert all(r["id"] % 3 == r["source"] % 3 for r in part) and any(r["id"] != r["source"] for r in part)


def test_row_shuffle_null_sees_smooth_structure(spark):
    rng = np.random.default_rng(17)
    x = rng.random((150, 2))
    p = points(spark, x)
    vals = spark.createDataFrame([(i, float(x[i, 0])) for i in range(150)], "id bigint, y double")
    noise = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=150))], "id bigint, y double")
    nn = N.knn(p, 6)
    assert Rs.neighbour_mean_r2(nn, vals, 49).first()["p"] <= 0.02
    assert Rs.neighbour_mean_r2(nn, noise, 49).first()["p"] > 0.02


def test_knee_and_survivors():
    assert W.knee([1.0, 0.9, 0.2, 0.1, 0.05])[0] == 3
    keep = W.survivors({"a": 1.0, "b": 0.9, "c": 0.85, "d": 0.1, "e": 0.05}, k_min=1)
    assert "a" in keep and "e" not in keep


def test_constant_item_leaves_the_neighbours_alone(spark):
    rng = np.random.default_rng(18)
    x = rng.random((60, 2))
    a = N.knn(points(spark, x), 3, N.Metric("gower", 2, (1.0, 1.0)))
    b = N.knn(points(spark, np.column_stack([x, np.ones(60)])), 3, N.Metric("gower", 3, (1.0, 1.0, 1.0)))
    key = lambda t: sorted((r["i"], r["rank"], r["j"]) for r in t.collect())
    assert key(a) == key(b)


def test_constant_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0, "x", 2), (2, 1.0, "x", 3), (3, None, "y", 4)], "id int, a double, b string, c int")
    assert E.complete_cases(df, ["a", "b", "c"]).columns == ["id", "c"]


def test_neighbours_of_far_apart_points(spark):
    """Cells and bounds at large coordinates: exact against whole numbers."""
    n = 300
    p = spark.createDataFrame([(i, [float(i * 10_000_000)]) for i in range(n)], "id bigint, vec array<double>")
    got = {r["i"]: r["j"] for r in N.knn(p, 1, block=16).collect()}
    assert got == {i: 1 if i == 0 else i - 1 for i in range(n)}


def test_isomap_against_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [3, 1, 0.3]
    p = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    edges = G.knn_graph(N.knn(p, 5), weighted=False)
    d = np.full((60, 60), np.inf)
    for r in edges.collect():
        d[r["src"], r["dst"]] = d[r["dst"], r["src"]] = r["d"]
    np.fill_diagonal(d, 0)
    for k in range(60):
        d = np.minimum(d, d[:, k][:, None] + d[k][None])
    paths = LA.geodesics(edges, p, batch=25)
    got = {(r["source"], r["id"]): r["d"] for r in paths.collect()}
    assert len(got) == np.isfinite(d).sum() and all(abs(v - d[k]) < 1e-9 for k, v in got.items())
    d[~np.isfinite(d)] = 10 * d[np.isfinite(d)].max()
    j = np.eye(60) - 1 / 60
    val, vec = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    found = {r["m"]: r["resvar"] for r in LA.isomap_residual(paths, LA.geodesic_scaling(paths, p, 2), [1, 2]).collect()}
    for m in (1, 2):
        y = vec[:, ::-1][:, :m] * np.sqrt(val[::-1][:m])
        e = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
        assert abs(found[m] - (1 - np.corrcoef(d.ravel(), e.ravel())[0, 1] ** 2)) < 1e-4


def test_noise_rank_counts_what_stands_out():
    from tessera.operators.bundle import noise_rank

    rng = np.random.default_rng(5)
    noise = rng.normal(size=(200, 12))
    signal = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 12)) * 4
    assert noise_rank(noise + signal, shrink=1.6) == 2 and noise_rank(noise, shrink=1.6) == 0 and noise_rank(noise[:4]) == 0 and noise_rank(np.zeros((20, 5))) == 0


def test_survivors_are_the_heaviest():
    w = {"a": 1.0, "b": 1.0, "c": 0.9, "d": 0.85, "e": 0.1, "f": 0.05, "g": 0.0}
    assert W.survivors(w, k_min=1) == ["a", "b", "c", "d", "e"] and W.survivors(w) == list(w)
    assert W.survivors({"a": 1.0, "b": 0.0}, k_min=1) == ["a"] and W.survivors({"a": 1.0, "b": 0.4, "c": 0.2}, k_min=1) == ["a", "b"]


def test_pair_agreement_ranks_and_perfect_fit(spark):
    def spearman(u, v):
        rank = lambda z: np.array([(z < t).sum() + ((z == t).sum() + 1) / 2 for t in z])
        return np.corrcoef(rank(u), rank(v))[0, 1]

    x = np.random.default_rng(21).normal(size=(70, 3))
    x[5] = x[6]
    p = points(spark, x)
    low = p.select("id", F.slice("vec", 1, 1).alias("v"))
    r = LA.pair_agreement(p, low).first()
    i, j = np.triu_indices(70, 1)
    a, b = np.linalg.norm(x[i] - x[j], axis=1), np.abs(x[i, 0] - x[j, 0])
    a, b = a[(a > 0) & (b > 0)], b[(a > 0) & (b > 0)]
    assert r["n"] == len(a)
    assert abs(r["spearman"] - spearman(a, b)) < 1e-6 and abs(r["pearson"] - np.corrcoef(a, b)[0, 1]) < 1e-9
    assert abs(r["stress1"] - np.sqrt(((a - b) ** 2).sum() / (a ** 2).sum())) < 1e-9
    same = LA.pair_agreement(p, p.select("id", F.col("vec").alias("v"))).first()
    assert same["stress1"] == 0 and abs(same["spearman"] - 1) < 1e-12 and abs(same["pearson"] - 1) < 1e-12


def test_spanning_tree_against_kruskal(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(rng.integers(1, 6))) for a, b in rng.integers(0, 60, (150, 2))] + [(100, 101, 1.0), (101, 100, .5), (7, 7, 0.0)]
    label, want = {v: v for r in rows for v in r[:2]}, set()
    for d, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in rows):
        if label[a] != label[b]:
            want.add((a, b, d))
            old = label[b]
            label = {v: label[a] if c == old else c for v, c in label.items()}
    tree = G.spanning_tree(spark.createDataFrame(rows, "src bigint, dst bigint, d double"))
    assert {tuple(r) for r in tree.collect()} == want
    level = {r.id: (r.parent, r.level) for r in G.tree_levels(tree, spark.createDataFrame([(100,), (min(label),)], "id bigint")).collect()}
    assert level[100] == (None, 0) and level[101] == (100, 1)
    around = {frozenset(e[:2]) for e in want}
    for v, (parent, depth) in level.items():
        assert depth == 0 or (level[parent][1] == depth - 1 and frozenset((v, parent)) in around)
    assert set(level) == {v for v, c in label.items() if c in (label[100], label[min(label)])}
    assert G.spanning_tree(spark.createDataFrame([], "src bigint, dst bigint, d double")).count() == 0
