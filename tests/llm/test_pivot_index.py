"""Links of the pivot index against all cosines of small tables."""

import math

import numpy as np
import pytest
from fixtures import by_id

from tessera.llm import pivot_index as P
from tessera.llm.pivot_index import near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, rid int, v string, pivot int"


def table(spark, rows):
    """rows: (id, vector), with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", 3)
                                  for i, v in rows], SCHEMA)


def near(rng, v, cosine):
    z = rng.normal(size=v.shape)
    z -= (z @ v) / (v @ v) * v
    z /= np.linalg.norm(z)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine ** 2) * z


def links(vectors, cosine=0.9):
    """Pairs of row numbers, by all cosines in double precision."""
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(vectors[i]) for i in ok)
    x = np.array([np.r_[np.float32(vectors[i]), np.zeros(width - len(vectors[i]))] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {(ok[a], ok[b]) for a, b in zip(*np.where(np.triu(x @ x.T >= cosine, 1)))}


def expected(n, pairs):
    label, count = list(range(n)), [0] * n
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    again = True
    while again:
        again = False
        for a, b in pairs:
            low = min(label[a], label[b])
            again |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return count, label


def planted(seed=0, n=1500, d=32):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, d)))
    for c in (.905, .92, .95, .99, .895, .88):
        rows += [near(rng, rows[i], c) for i in rng.integers(0, n, 60)]
    rows += [rows[3]] * 40 + [rows[4] * 2.5] * 10
    return [np.float32(v).tolist() for v in rows]


def test_recall_and_truth(spark):
    vectors = planted()
    want, _ = expected(len(vectors), links(vectors))
    got = by_id(near_vectors(table(spark, list(enumerate(vectors)))), "vec_id")
    assert len(got) == len(vectors)
    n = [got[i]["n_links"] for i in range(len(vectors))]
    assert all(a <= b for a, b in zip(n, want))  # no link below the cosine
    assert sum(n) >= 0.97 * sum(want)
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and r["component_id"] <= i


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_hot_group_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    vectors = [np.float32(near(rng, base, .985)).tolist() for _ in range(120)] + rng.normal(size=(200, 16)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 50
    pairs = links(vectors)
    want, label = expected(len(vectors), pairs)
    got = by_id(near_vectors(table(spark, list(enumerate(vectors))), block=block), "vec_id")
    assert [got[i]["n_links"] for i in range(len(vectors))] == want
    assert [got[i]["component_id"] for i in range(len(vectors))] == label


def test_meet_against_all_pairs():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8))
    v[40:] = [near(rng, v[i % 40], .93) for i in range(50)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots = rng.normal(size=(20, 8))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    where = np.sort(P.permutations(v, pivots, 5), axis=1)
    copies = rng.integers(1, 4, 90)
    for own in range(20):
        some = np.flatnonzero((where == own).any(axis=1))
        if len(some) < 4:
            continue
        common = [[set(where[a]) & set(where[b]) for b in some] for a in some]
        linked = np.array([[a != b and len(common[a][b]) >= 2 and min(common[a][b]) == own and v[some[a]] @ v[some[b]] >= .9
                            for b in range(len(some))] for a in range(len(some))])
        got, label = P.meet(v[some], where[some], copies[some], len(some), own, 2, .9)
        assert (got == linked @ copies[some]).all()
        assert all(label[a] == label[b] for a, b in zip(*np.where(linked)))
        k = len(some) // 2
        linked[:k, :k] = linked[k:, k:] = False
        got, label = P.meet(v[some], where[some], copies[some], k, own, 2, .9)
        assert (got == linked @ copies[some]).all()


def test_awkward_rows(spark):
    rows = [(1, [1, 0, 0]), (2, [1, 0]), (3, None), (4, []), (5, [0, 0, 0]), (6, [float("nan"), 1, 0]), (7, [1, None, 0]),
            (8, [float("inf"), 0, 0]), (9, [2e30, 1e29, 0]), (10, [-1, 0, 0]), (11, [1e-30, 0, 0]), (12, None), (13, [float("nan"), 1, 0])]
    got = by_id(near_vectors(table(spark, rows)), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {
        1: (3, 1), 2: (3, 1), 9: (3, 1), 11: (3, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 10, 12, 13)}}


def test_repeated_and_null_ids_and_empty(spark):
    out = near_vectors(table(spark, [(5, [1, 0]), (5, [1, .1]), (None, [1, .2]), (7, [0, 1])])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == [
        ("5", 2, "None", False), ("5", 2, "None", False), ("7", 0, "7", True), ("None", 2, "None", True)]
    assert near_vectors(table(spark, [])).count() == 0
    assert near_vectors(table(spark, [(1, None)])).collect() == [(1, 0, 1, True)]
