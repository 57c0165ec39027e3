"""Neighbours and all-pairs sums whose copies that move grow with the rows alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as N


def _points(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [None if np.isnan(c) else float(c) for c in v]) for i, v in zip(ids, x)], "id bigint, vec array<double>")


def _brute(ids, x, k, metric):
    d = metric.between(x, x)
    out = set()
    for a in range(len(x)):
        near = sorted((d[a, b], ids[b]) for b in range(len(x)) if ids[b] != ids[a] and np.isfinite(d[a, b]))[:k]
        out |= {(ids[a], r + 1, j, round(v, 9)) for r, (v, j) in enumerate(near)}
    return out


def _found(nn):
    return {(r["i"], r["rank"], r["j"], round(r["d"], 9)) for r in nn.collect()}


def test_open_queries_go_through_the_grid(spark, monkeypatch):
    """Where bounds rule nothing out, no query is copied to more than MAX_VISITS blocks."""
    x = np.random.default_rng(3).normal(size=(900, 32))
    asked = []
    meet = N._meet

    def counted(queries, *rest):
        asked.append(queries.count())
        return meet(queries, *rest)

    monkeypatch.setattr(N, "_meet", counted)
    nn = N.knn(_points(spark, x), 5, block=32)
    assert _found(nn) == _brute(list(range(900)), x, 5, N.Metric())
    assert asked[0] == 900 and asked[1] <= 900 * N.MAX_VISITS


@pytest.mark.parametrize("gaps", [False, True])
def test_copies_search_once(spark, monkeypatch, gaps):
    r = np.random.default_rng(4)
    x = np.column_stack([r.integers(0, 4, 600) / 4.0, r.integers(0, 3, 600).astype(float)])
    x[r.random(600) < 0.2, 1] = np.nan if gaps else 0.0
    metric = N.Metric("gower", 1, (1.0, 1.0), gaps)
    sizes = []
    knn = N.knn

    def counted(points, *rest, **more):
        sizes.append(points.count())
        return knn(points, *rest, **more)

    monkeypatch.setattr(N, "knn", counted)
    nn = knn(_points(spark, x, range(7, 607)), 5, metric, block=64)
    assert _found(nn) == _brute(list(range(7, 607)), x, 5, metric)
    assert sizes and sizes[0] <= 4 * 4


def test_repeated_ids_hide_each_other(spark):
    x = np.repeat(np.random.default_rng(5).normal(size=(40, 3)), 2, axis=0)
    nn = N.knn(_points(spark, x, np.repeat(np.arange(40), 2)), 3)
    assert nn.where("i = j").isEmpty() and nn.groupBy("i").count().where("count <> 3").isEmpty()


def test_pair_sums_leave_a_task_once(spark):
    x = np.random.default_rng(6).normal(size=(1000, 8))
    points = _points(spark, x).withColumn("cluster", F.col("id") % 3)

    def sums(a, b):
        d = N.Metric().between(N._matrix(a["vec"]), N._matrix(b["vec"]))
        return pd.DataFrame({"id": a["id"].to_numpy(), "s": list(np.column_stack([d.sum(1), np.full(len(a), len(b))]))})

    parts = N.all_pairs_reduce(points, points, sums, "id bigint, s array<double>", block=20, keys=["id"]).collect()
    assert len(parts) == 1000 * N.GRID
    total = np.zeros((1000, 2))
    for r in parts:
        total[r["id"]] += r["s"]
    assert np.allclose(total[:, 0], N.Metric().between(x, x).sum(1)) and (total[:, 1] == 1000).all()


def test_rounding_to_40_bits():
    d = np.concatenate([[0.0, np.inf, 1.0, 3.0], np.random.default_rng(7).random(10_000) * 1e3])
    mantissa, exponent = np.frexp(d[2:])
    assert (N._to_40_bits(d)[2:] == np.ldexp(np.round(mantissa * 2.0**40) / 2.0**40, exponent)).all()
    assert N._to_40_bits(d)[0] == 0 and np.isinf(N._to_40_bits(d)[1]) and np.isnan(N._to_40_bits(np.array([np.nan])))[0]


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-4), (0.0, 1e25)])
def test_single_precision_loses_no_neighbour(shift, scale):
    """Far from the origin, in dense clusters and beyond what single precision holds."""
    r = np.random.default_rng(8)
    x = (np.repeat(r.normal(size=(20, 6)), 30, axis=0) + scale * r.normal(size=(600, 6))) + shift
    ids = np.arange(600)
    got = N._best(ids, ids, x, x, N.Metric(), 4, True, np.full(600, np.inf))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got["d"].to_numpy().reshape(600, 4), np.sort(d, 1)[:, :4], rtol=1e-9)
    assert got.groupby("i").size().eq(4).all() and (got["i"] != got["j"]).all()


def test_ranges_of_distances_leave_a_task_once(spark, monkeypatch):
    """Pair agreement sends a row for each range and task, not for each pair of blocks."""
    from tessera.operators import linalg as LA

    x = np.round(np.random.default_rng(9).normal(size=(1200, 2)) * 2) / 2
    points = _points(spark, x)
    sent = []

    def counted(*args, **more):
        t = N.all_pairs_reduce(*args, **more)
        sent.append((args[3], t.count()))
        return t

    monkeypatch.setattr(LA, "all_pairs_reduce", counted)
    got = LA.pair_agreement(points, points.select("id", F.slice("vec", 1, 1).alias("v"))).first()
    upper = np.triu_indices(1200, 1)
    a, b = (N.Metric().between(v, v)[upper] for v in (x, x[:, :1]))
    use = (a > 0) & (b > 0)
    assert got["n"] == use.sum() and abs(got["pearson"] - np.corrcoef(a[use], b[use])[0, 1]) < 1e-9
    kinds = len(np.unique(a[use])) + len(np.unique(b[use]))
    tasks = 2 * 2  # 1,200 rows make two parts a side
    assert [n for schema, n in sent if schema.startswith("side")][0] <= kinds * tasks


def test_rank_counts_move_no_vectors_of_targets(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(150, 5))
    points, seen = _points(spark, x), []
    reduce = N.all_pairs_reduce

    def watched(left, *rest, **more):
        seen.append(sum("array<array" in kind for _, kind in left.dtypes))
        return reduce(left, *rest, **more)

    monkeypatch.setattr(N, "all_pairs_reduce", watched)
    pairs = spark.createDataFrame([(i, (i * 7 + s) % 150) for i in range(150) for s in (1, 40)], "i bigint, j bigint").where("i <> j")
    got = N.closer_counts(pairs, points).collect()
    d = N.Metric().between(x, x)
    assert seen == [0] and len(got) == pairs.count()
    for r in got:
        assert r["rank"] == 1 + sum((d[r["i"], m], m) < (d[r["i"], r["j"]], r["j"]) for m in range(150) if m != r["i"])


def test_weight_search_sends_two_distances_a_task(spark, monkeypatch):
    from tessera.operators import weights as W

    x = np.random.default_rng(11).random((2500, 2))
    sent, reduce = [], N.all_pairs_reduce

    def counted(*args, **more):
        t = reduce(*args, **more)
        sent.append(t.count())
        return t

    monkeypatch.setattr(W, "all_pairs_reduce", counted)
    dim = W.candidate_dimensions(_points(spark, x), 2, [[1.0, 1.0]], trim=0.0)[0]
    d = np.abs(x[:, None, :] - x[None, :, :]).sum(2) / 2
    np.fill_diagonal(d, np.inf)
    first = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1)
    assert sent == [2500 * 2 * 3]  # 2,500 rows make three parts a side
    assert abs(dim - 1 / np.log(first[:, 1] / first[:, 0]).mean()) < 1e-3


def test_paths_in_blocks(spark):
    """All pairs by rounds over blocks: many hops across blocks, two parts of the graph, a vertex alone, sources given; no job for each hop."""
    import numpy as np

    from tessera.operators import linalg as LA
    from tessera.operators.paths import path_blocks

    n = 120
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1, float(1 + rng.random())) for i in range(n - 1) if i != 99] + [(int(a), int(b), 30.0) for a, b in rng.integers(0, 90, (10, 2))]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint, d double")
    d = np.full((n + 1, n + 1), np.inf)
    np.fill_diagonal(d, 0.0)
    for a, b, w in pairs:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n + 1):
        d = np.minimum(d, d[:, k][:, None] + d[k][None])
    ids = spark.range(n + 1)
    before = spark._jsc.sc().dagScheduler().nextJobId()
    blocks = path_blocks(edges, ids, side=30)
    got = {(r["source"], r["id"]): r["d"] for r in blocks.rows().collect()}
    jobs = spark._jsc.sc().dagScheduler().nextJobId() - before
    assert len(blocks.sizes) > 2 and len(got) == np.isfinite(d).sum()
    assert all(abs(v - d[k]) < 1e-9 for k, v in got.items())
    assert jobs < 20 * len(blocks.sizes)
    some = {(r["source"], r["id"]) for r in LA.geodesics(edges, ids.where("id >= 118"), batch=30).collect()}
    assert some == {(s, t) for s in (118, 119, 120) for t in range(n + 1) if np.isfinite(d[s, t])}


def test_isomap_counts_rows_with_one_id(spark):
    """The matrix in blocks gives what the table of paths gave, with and without repeated ids."""
    from tessera.operators import linalg as LA
    from tessera.operators.paths import path_blocks

    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(39)] + [(0, 39, 2.0)], "src bigint, dst bigint, d double")
    ids = spark.range(40)
    coords = ids.selectExpr("id", "array(cos(id / 6.0), sin(id / 6.0)) as v")
    blocks, table = path_blocks(edges, ids, side=16), LA.geodesics(edges, ids)
    one = [tuple(r) for r in LA.isomap_residual(blocks, coords, [1, 2]).collect()]
    two = [tuple(r) for r in LA.isomap_residual(table, coords.unionByName(coords), [1, 2]).collect()]
    assert [m for m, _ in one] == [1, 2] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(one, two)) and 0 < one[1][1] < one[0][1] < 1


def test_products_in_parts(spark):
    """A product in several parts: rows without entries, repeated entries, chunks that end inside a part; sums leave a task, not edges."""
    from tessera.operators import sparse

    rng = np.random.default_rng(6)
    n, m = 90, 3
    cells = [(int(a), int(b), float(w)) for (a, b), w in zip(rng.integers(0, n - 5, (1500, 2)), rng.random(1500))]
    dense = np.zeros((n, n))
    for a, b, w in cells:
        dense[a, b] += w
    v = rng.random((n, m))
    parts = sparse.in_parts(spark.createDataFrame(cells, "src bigint, dst bigint, w double"), spark.range(n), part=40)
    assert len(parts.sizes) > 1 and parts.entries.count() <= len(parts.sizes) ** 2
    start = parts.packed(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, v array<double>"))
    one = parts.stepped(start.selectExpr("part", "v", "CAST(NULL AS BINARY) AS prev"), m, lambda x, y, _: y)
    two = parts.stepped(one, m, lambda x, y, prev: 2 * y - prev)
    got = np.array([r["v"] for r in parts.unpacked(two, m).orderBy("id").collect()])
    assert np.allclose(got, 2 * dense @ (dense @ v) - v)


def test_strips_of_a_side_are_made_once(spark, monkeypatch):
    """A task prepares each strip of its two parts once, not once for each pair of strips."""
    import pandas as pd

    made, first = [], N._Side.__init__
    monkeypatch.setattr(N._Side, "__init__", lambda self, x, *more: (made.append(len(x)), first(self, x, *more))[1])
    monkeypatch.setattr(N, "TALL", 50)
    monkeypatch.setattr(N, "BROAD", 100)
    x = np.random.default_rng(2).normal(size=(400, 4))
    side = pd.DataFrame({"id": np.arange(400), "vec": list(x), "theta": np.inf})
    got = N._nearest_of(side, side, 2, N.Metric(), True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert sum(made) == 800
    assert np.allclose(got["d"].to_numpy().reshape(400, 2), np.sort(d, 1)[:, :2])
