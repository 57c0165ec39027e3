"""Complete linkage, its collapse curve and the cut it gives, against merging one pair at a time."""

import numpy as np
import pytest

from tessera.operators import linkage as K
from tessera.operators.neighbours import Metric


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")


def brute(d, eps):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(p, q)].max(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if h > eps:
            break
        groups[a] = sorted(groups[a] + groups.pop(b))
    return {i: min(g) for g in groups for i in g}


def test_curve_cut_and_groups(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.random((30, 2)) * 4, np.repeat(rng.random((10, 2)) * 4, 2, axis=0) + rng.normal(0, 0.03, (20, 2))])
    x[29] = x[0]
    p, d = table(spark, x), Metric().between(x, x)
    first = np.where(np.eye(len(d)) > 0, np.inf, d).min(1)
    low, high = max(0.0, np.quantile(first, [0.001, 0.01]).min() - 0.02), min(0.5, np.quantile(first, 0.3))
    grid = K.cuts(p)
    assert grid == pytest.approx(np.arange(low, high + 1e-12, 0.005)) and len(grid) > 3
    tree = K.complete_tree(p, grid[-1])
    got = [(r["eps"], r["n_groups"], r["retained"]) for r in K.collapse_curve(p, grid, tree).orderBy("eps").collect()]
    want = [len(set(brute(d, e).values())) for e in grid]
    assert [g[1] for g in got] == want and [g[2] for g in got] == pytest.approx([n / len(x) for n in want])
    groups, eps = K.near_copies(p)
    i = int(np.argmin(np.diff(want)))
    assert eps == pytest.approx((grid[i] + grid[i + 1]) / 2)
    assert {r["id"]: r["cluster"] for r in groups.collect()} == brute(d, eps)


def test_small_tables(spark):
    groups, eps = K.near_copies(table(spark, [[1.0, 2.0]]))
    assert eps == 0.0 and [tuple(r) for r in groups.collect()] == [(0, 0)]
    groups, _ = K.near_copies(table(spark, [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0]]))
    assert {r["id"]: r["cluster"] for r in groups.collect()} == {0: 0, 1: 0, 2: 0}


def test_mixed_tree_finds_pairs_once(spark, monkeypatch):
    """Mixed items merge as one pair at a time would, and distances are searched once, not in every round."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.random(120), rng.random(120), rng.integers(0, 2, 120) * 5.0])
    x[100:] = x[:20] + np.column_stack([rng.normal(0, 0.01, (20, 2)), np.zeros(20)])
    metric, searches = Metric("gower", 2, (1.0, 1.0, 1.0)), []
    for name in ("pairs_within", "all_pairs_reduce"):
        if hasattr(K, name):
            monkeypatch.setattr(K, name, lambda *a, f=getattr(K, name), **more: searches.append(f) or f(*a, **more))
    p, d = table(spark, x), metric.between(x, x)
    tree = K.complete_tree(p, 0.08, metric)
    for eps in (0.0, 0.02, 0.08):
        assert {r["id"]: r["cluster"] for r in K.groups_at(p, tree, eps).collect()} == brute(d, eps)
    assert len(searches) == 1
