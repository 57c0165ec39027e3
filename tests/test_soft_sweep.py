"""Graph-regularised factorisation: runs in tasks of their own give what shared passes give, and run until they settle."""

import numpy as np
import pytest
from harness import DATA

from tessera import plans
from tessera.operators import soft_clusters as S
from tessera.plans.registry import QUERIES


def test_runs_apart_equal_shared_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((40, 3))
    p = spark.createDataFrame([(i * 7, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, p array<double>")
    edges = spark.createDataFrame([(i * 7, j * 7, float(rng.random() + 0.1)) for i in range(38) for j in range(i + 1, 38) if (i * j) % 5 == 1],
                                  "src bigint, dst bigint, w double")
    got = []
    for whole in (S.WHOLE_ROWS, 0):
        monkeypatch.setattr(S, "WHOLE_ROWS", whole)
        state, runs, facts = S.factorise(p, edges, [2, 3], [0.0, 0.3], starts=1, n_iter=10)
        rows = state.toPandas().sort_values(["run", "id"])
        got.append((runs, facts, [np.vstack(part["u"].to_numpy()) for _, part in rows.groupby("run")]))
    (a, fa, ua), (b, fb, ub) = got
    for i in range(4):
        assert ua[i] == pytest.approx(ub[i], abs=1e-9) and a[i].v == pytest.approx(b[i].v, rel=1e-7)
        assert a[i].obj == pytest.approx(b[i].obj) and (a[i].iters, a[i].done, a[i].reseeds) == (b[i].iters, b[i].done, b[i].reseeds)
        assert fa[i]["rough"] == pytest.approx(fb[i]["rough"])


def test_sweep_is_whole(spark, monkeypatch):
    """Every number of clusters and penalty, three starts, until a run settles."""
    plans.load()
    seen, factorise = [], S.factorise
    monkeypatch.setattr(S, "factorise", lambda *a, **k: (out := factorise(*a, **k), seen.append(out[1]))[0])
    assert QUERIES["i39_soft_memberships"](spark, DATA).count() > 0
    (runs,) = seen
    assert {(r.k, r.lam) for r in runs} == {(k, lam) for k in (2, 3, 4) for lam in (0.0, 0.05, 0.1, 0.2, 0.4, 0.8)} and len(runs) == 54
    assert all(r.done or r.iters == 700 for r in runs) and max(r.iters for r in runs) > 8
