"""Steps that must not grow faster than their input, on rows built here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import absorption as Ab
from tessera.operators import models as Md
from tessera.operators import neighbours as N
from tessera.operators import soft_clusters as S


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _classified(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = (x @ np.array([[1.0, -1.0], [0.5, 2.0]]) + rng.normal(size=(n, 2)) > 0).astype(float)
    # Ids that repeat, one response that is missing.
    rows = [(int(i * 5 // 6), x[i].tolist(), int(i * 5 // 6 % 5), [None if i == 7 else float(y[i, 0]), float(y[i, 1])]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, fold int, y array<double>")


def test_responses_meet_predictions_without_a_broadcast(spark):
    rows = _classified(spark)
    assert "Broadcast" not in _plan(Md.out_of_fold(rows, ["a", "b"], Md.Basis("linear", 2), "binomial", 5, [1.0]))


def test_ridge_takes_the_penalty_of_least_held_out_deviance(spark):
    rows = _classified(spark).cache()
    found, chosen = Md.ridge_logistic(rows, ["a", "b"], 2, n_penalties=4)
    assert "BatchEvalPython" not in _plan(found) and "MapInPandas" not in _plan(found)  # scored once
    grid = [rows.count() * v for v in np.logspace(-5, 0, 4)]
    every = Md.out_of_fold(rows, ["a", "b"], Md.Basis("linear", 2), "binomial", 5, grid).toPandas()
    p = every["p"].clip(1e-12, 1 - 1e-12)
    every["dev"] = -np.where(every["y"] > 0, np.log(p), np.log(1 - p))
    for label, part in every.groupby("label"):
        best = part.groupby("lam_index")["dev"].sum().idxmin()
        assert chosen[label] == grid[best]
        key = lambda t: sorted(zip(t["id"], t["fold"], t["y"].fillna(-1), t["p"].round(9)))
        assert key(part[part["lam_index"] == best]) == key(found.where(F.col("label") == label).toPandas())


def test_mean_silhouettes_of_several_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))[rng.integers(0, 60, 200)]  # many copies
    parts = [rng.integers(0, 2, 200), (x[:, 0] > 0).astype(int) + 2 * (np.arange(200) == 5), np.zeros(200, int)]
    points = spark.createDataFrame([(r, i, x[i].tolist(), int(c[i])) for r, c in enumerate(parts) for i in range(200)],
                                   "run int, id bigint, vec array<double>, cluster bigint")
    found = {r["run"]: r["width"] for r in N.mean_silhouettes(points).collect()}
    assert set(found) == {0, 1}
    for run in found:
        each = N.silhouettes(points.where(F.col("run") == run)).agg(F.avg("width")).first()[0]
        assert abs(found[run] - each) < 1e-9


def test_an_edge_carries_all_runs_at_once(spark):
    p = spark.createDataFrame([(i, [0.9, 0.1] if i < 6 else [0.1, 0.8]) for i in range(12)], "id bigint, p array<double>")
    edges = spark.createDataFrame([(i, j, 0.1 + 0.05 * i) for i in range(11) for j in range(i + 1, 11) if (i + j) % 3], "src bigint, dst bigint, w double")
    state, runs, facts = S.factorise(p, edges, [2, 3], [0.0, 0.1], starts=1, n_iter=3)
    rows = state.toPandas()
    w = np.zeros((12, 12))
    for e in edges.collect():
        w[e.src, e.dst] = w[e.dst, e.src] = e.w
    for i, r in enumerate(runs):
        u = np.vstack(rows[rows["run"] == i].sort_values("id")["u"].to_numpy())
        assert u.shape == (12, r.k)
        assert abs(facts[i]["rough"] - (u * (w.sum(1)[:, None] * u - w @ u)).sum()) < 1e-9


def test_members_of_a_cluster_meet_in_few_parts(spark, monkeypatch):
    monkeypatch.setattr(Ab, "BLOCK", 4)
    points = spark.createDataFrame([(i, [float(i)], 1) for i in range(120)], "id bigint, vec array<double>, cluster bigint")
    one = lambda cluster, d, x: pd.DataFrame({"cluster": [cluster], "range": [0], "n": [len(d)]})
    met = Ab._inside(points, one, "cluster bigint, range bigint, n bigint", N.Metric()).toPandas()
    assert met["n"].sum() == 120 * 119 // 2
    assert len(met) <= N.GRID * (N.GRID + 1) // 2  # 30 blocks would meet 465 times
