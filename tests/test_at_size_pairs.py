"""Sums over pairs that follow from sums over rows, and rank counts without a sort of ids for each row."""

import numpy as np
import pytest

from tessera.operators import linalg as LA
from tessera.operators import neighbours as N
from tessera.operators import scaling as Sc


def _points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")


def test_euclidean_scaling_is_linear(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(80, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] + 1000.0
    monkeypatch.setattr(Sc, "all_pairs_reduce", None)
    got = np.array([r["v"] for r in LA.classical_scaling(_points(spark, x), 2).orderBy("id").collect()])
    y = x - x.mean(0)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_rank_counts_sort_no_ids(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (90, 2)).astype(float)  # many ties
    seen, reduce = [], N.all_pairs_reduce
    monkeypatch.setattr(N, "all_pairs_reduce", lambda left, right, run, *a, **k: seen.append((left, right, run)) or reduce(left, right, run, *a, **k))
    pairs = spark.createDataFrame([(i, (i * 7 + s) % 90) for i in range(90) for s in (1, 40)], "i bigint, j bigint").where("i <> j")
    d = N.Metric().between(x, x)
    want = {(r["i"], r["j"]): 1 + sum((d[r["i"], m], m) < (d[r["i"], r["j"]], r["j"]) for m in range(90) if m != r["i"]) for r in pairs.collect()}
    assert {(r["i"], r["j"]): r["rank"] for r in N.closer_counts(pairs, _points(spark, x)).collect()} == want
    left, right, run = seen[0]
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **k: sorts.append(1) or lexsort(keys, *a, **k))
    assert len(run(left.toPandas(), right.toPandas())) == len(want) and not sorts
