"""A third of the rows on one key, value or copy must not change a result."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import association as A
from tessera.operators import communities as C
from tessera.operators import labels as L
from tessera.operators import metrics as M
from tessera.operators import neighbours as N
from tessera.operators import ordered as O
from tessera.operators import resample as Rs


def test_hot_subject_and_hot_cluster(spark):
    rng = np.random.default_rng(1)
    long = [(0, f"l{j % 5}") for j in range(400)] + [(int(i), f"l{int(j)}") for i, j in zip(rng.integers(1, 300, 800), rng.integers(0, 5, 800))]
    sets = L.label_sets(spark.createDataFrame(long, "id bigint, label string").repartition(6), "id", "label")
    t = sets.withColumn("cluster", F.when(F.col("id") < 100, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))))
    want, sizes = {}, {}
    truth = {}
    for i, l in long:
        truth.setdefault(i, set()).add(l)
    for i, ls in truth.items():
        c = "hot" if i < 100 else f"c{i % 4}"
        sizes[c] = sizes.get(c, 0) + 1
        for l in ls:
            want[(c, l)] = want.get((c, l), 0) + 1
    for r in A.cells(t).collect():
        assert r["a"] == want.get((r["cluster"], r["label"]), 0) and r["n_in"] == sizes[r["cluster"]]
        assert r["a"] + r["b"] + r["c"] + r["d"] == len(truth)


def test_hot_score_in_metrics_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    s = np.where(rng.random(600) < 0.4, 0.5, rng.random(600))
    y = (rng.random(600) < s).astype(int)
    d = spark.createDataFrame([(i, int(a), float(b), "l", "m") for i, (a, b) in enumerate(zip(y, s))], "id bigint, y int, s double, label string, model string")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert abs(M.auc(M.score_table(d)).first()["auc"] - want) < 1e-12
    w = Rs.poisson_weights(np.arange(600), np.arange(20), 42)
    got = {r["rep"]: r["auc"] for r in Rs.bootstrap_auc(d, 20).collect()}
    for r in range(20):
        wp, wn = w[y == 1, r], w[y == 0, r]
        win = (pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])
        assert abs(got[r] - (wp[:, None] * wn[None] * win).sum() / (wp.sum() * wn.sum())) < 1e-9


def test_ranges_split_a_heavy_value(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i)) for i in range(900)], "id bigint, v double")
    sizes = [r["count"] for r in O.with_ranges(df, "v", 8, tie="id").groupBy(O.BUCKET).count().collect()]
    assert max(sizes) < 300


def test_copies_and_a_dense_cell(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    x[:80] = x[0]
    x[80:160] = x[80] + rng.normal(0, 1e-3, (80, 2))
    p = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    d = N.Metric().between(x, x)
    got = {}
    for r in N.knn(p, 3, block=20).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    for i in range(240):
        assert [j for _, j in sorted(got[i])] == [j for _, j in sorted((d[i, j], j) for j in range(240) if j != i)[:3]]


def test_hub_in_a_graph(spark):
    edges = [(0, i) for i in range(1, 120)] + [(i, i + 1) for i in range(1, 119)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumn("w", F.lit(1.0))
    m = C.louvain(df, max_levels=2)
    assert m.count() == 120 and m.groupBy("id").count().where("count > 1").isEmpty()
