"""Mixed-type distances searched by boxes: exact whatever the weights, copies and ids, at a cost that grows with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes as B
from tessera.operators import neighbours as N


def _points(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id bigint, vec array<double>")


def _mixed(n, seed):
    r = np.random.default_rng(seed)
    return np.column_stack([r.integers(0, 50, n) / 49, r.random(n), r.integers(0, 5, n) * 7.0, r.integers(0, 4, n) * 3.0])


def _brute(x, k, metric, queries=None):
    d = metric.between(x if queries is None else queries, x)
    out = set()
    for a in range(len(d)):
        near = sorted((d[a, b], b) for b in range(len(x)) if queries is not None or a != b)[:k]
        out |= {(a, r + 1, j, round(v, 9)) for r, (v, j) in enumerate(near)}
    return out


def _found(nn):
    return {(r["i"], r["rank"], r["j"], round(r["d"], 9)) for r in nn.collect()}


@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0, 1.0), (1.0, 0.5, 0.25, 0.75), (0.01, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)])
def test_mixed_neighbours_are_exact(spark, weights):
    x, metric = _mixed(700, 1), N.Metric("gower", 2, weights)
    x[:150] = x[0]  # a hot cell of copies
    assert _found(N.knn(_points(spark, x), 5, metric, block=32)) == _brute(x, 5, metric)


def test_mixed_neighbours_of_other_rows(spark):
    x, q, metric = _mixed(500, 2), _mixed(60, 3), N.Metric("gower", 2, (1.0, 1.0, 0.5, 0.5))
    q[:3, 2:] = -1.0  # codes that no point has
    assert _found(N.knn(_points(spark, x), 4, metric, _points(spark, q), block=32)) == _brute(x, 4, metric, q)


def test_mixed_neighbours_meet_few_rows(spark, monkeypatch):
    """A query meets the rows its bound leaves, not a block, and visits few other blocks."""
    x, metric = _mixed(6000, 4), N.Metric("gower", 2, (1.0, 0.5, 0.25, 0.75))
    x[:, 0] = np.random.default_rng(5).random(6000)
    met, ids = [], np.arange(len(x))
    near = N.Metric.nearest
    monkeypatch.setattr(N.Metric, "nearest", lambda self, a, b, *rest: met.append(len(a) * len(b)) or near(self, a, b, *rest))
    found = B.nearest(ids, x, np.full(len(x), np.inf), ids, x, 5, metric, True)
    assert {(a, j, round(v, 9)) for a, j, v in found.itertuples(index=False)} == {(a, j, d) for a, _, j, d in _brute(x, 5, metric)}
    assert sum(met) < 0.4 * len(x) ** 2
    asked, meet = [], N._meet

    def counted(queries, *rest):
        asked.append(queries.count())
        return meet(queries, *rest)

    monkeypatch.setattr(N, "_meet", counted)
    N.knn(_points(spark, x), 5, metric, block=512)
    assert asked[0] == 6000 and asked[1] <= 2 * 6000


def test_several_metrics_search_together(spark):
    x = _mixed(400, 6)
    metrics = [N.Metric("gower", 2, w, all_bits=True) for w in ((1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.5, 0.0), (0.0, 0.01, 0.0, 1.0))]
    ids = np.arange(400) * 10**13 - 10**15
    got = {}
    for r in N.nearest_under(_points(spark, x, ids), 2, metrics).collect():
        got.setdefault((r["g"], r["id"]), []).append(r["d"])
    for g, metric in enumerate(metrics):
        d = metric.between(x, x)
        np.fill_diagonal(d, np.inf)
        for i, row in zip(ids, np.sort(d, axis=1)[:, :2]):
            assert sorted(got[g, int(i)]) == list(row)


def test_pairs_within_reach(spark):
    x, metric = _mixed(500, 7), N.Metric("gower", 2, (1.0, 1.0, 1.0, 1.0))
    ids = np.arange(500)
    got = B.within(ids, x, ids, x, 0.06, metric)
    d = metric.between(x, x)
    assert {(i, j) for i, j in zip(got["i"], got["j"])} == {(i, j) for i, j in zip(*np.nonzero(d <= 0.06)) if i != j}


def test_weight_candidates_without_all_pairs(spark, monkeypatch):
    """Large tables search for the two nearest under all candidates at once; dimensions are those of all pairs."""
    from tessera.operators import weights as W

    x = _mixed(900, 8)
    x[:40] = x[40:80]
    candidates = [[1.0, 1.0, 1.0, 1.0], [1.0, 0.0, 1.0, 1.0], [0.5, 1.0, 0.0, 1.0]]
    want = W.candidate_dimensions(_points(spark, x), 2, candidates)
    monkeypatch.setattr(W, "FEW", 100)
    monkeypatch.setattr(W, "all_pairs_reduce", None)
    assert W.candidate_dimensions(_points(spark, x), 2, candidates) == pytest.approx(want, rel=1e-12)


def test_weights_descend_until_no_move_helps(spark, monkeypatch):
    from tessera.operators import weights as W
    from tessera.plans.registry import QUERIES

    seen, optimise = [], W.optimise

    def kept(*args, **more):
        seen.append(optimise(*args, **more))
        return seen[-1]

    monkeypatch.setattr(W, "optimise", kept)
    from harness import DATA

    import tessera.plans as plans

    plans.load()
    rows = {r["item"]: r["weight"] for r in QUERIES["i5_weight_optimiser"](spark, DATA).collect()}
    (weights, history), = seen
    assert rows == weights and max(h["iter"] for h in history) > 1
