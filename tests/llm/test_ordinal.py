"""The cumulative-link model: slopes, order of thresholds, held-out accuracy, awkward rows."""

import random

import numpy as np
import pytest
from fixtures import by_id, documents, enumerated, texts

from tessera.llm import arrays as A
from tessera.llm.ordinal import accepted, features, fit, log_likelihood, minimised, scored


def test_slopes_match_differences():
    rng = np.random.default_rng(0)
    score, grade, raw = rng.normal(size=50), rng.integers(0, 4, 50), np.array([-1.0, 0.2, -0.5])
    own, slope, by_raw = log_likelihood(score, grade, raw)
    eps = 1e-6
    near = (log_likelihood(score + eps, grade, raw)[0] - own) / eps
    assert np.allclose(slope, near, atol=1e-4)
    for j in range(3):
        to = raw.copy()
        to[j] += eps
        assert np.allclose(by_raw[:, j], (log_likelihood(score, grade, to)[0] - own) / eps, atol=1e-4)


def test_minimum_is_found():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([1.0, -2.0, 3.0])
    x = minimised(lambda x: (x @ a @ x / 2 - b @ x, a @ x - b), np.zeros(3), 60, close=1e-12)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-3)


def test_features_are_local():
    raw = [b"Abc abc  x!! x!! 12\n", b"", b"\xc3\xa9t\xc3\xa9 abc"]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    place, value, bounds = features(buf, offs)
    for i, text in enumerate(raw):
        p, v, b = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        got = sorted(zip(place[bounds[i]:bounds[i + 1]], value[bounds[i]:bounds[i + 1]]))
        assert got == sorted(zip(p, v))
    assert bounds[1] == bounds[2] and A.U(1) == 1


@pytest.fixture(scope="module")
def graded():
    rnd = random.Random(4)
    pool = [f"n{i}" for i in range(60)]
    rows = []
    for i in range(900):
        grade = rnd.choice([0, 1, 2, 2])
        mark = {0: ["vile", "nasty"], 1: ["spam!!"], 2: []}[grade]
        rows.append((i, " ".join(rnd.sample([*rnd.choices(pool, k=rnd.randint(8, 30)), *mark], k=8 + len(mark)) + mark), grade))
    return rows


def test_held_out(spark, graded):
    docs = documents(spark, [(i, t) for i, t, _ in graded])
    ratings = spark.createDataFrame([(i, g) for i, _, g in graded if i % 3], "doc_id bigint, grade int")
    model = fit(docs, ratings, grades=3, least_docs=3)
    assert (np.diff(model.thresholds) > 0).all()
    out = by_id(scored(docs, model))
    held = [(out[i], g) for i, _, g in graded if i % 3 == 0]
    right = sum((r["tails"][1] >= 0.5) == (g == 2) for r, g in held)
    assert right >= 0.97 * len(held)
    means = [np.mean([r["expected_grade"] for r, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(r["tails"][0] >= r["tails"][1] for r, _ in held)
    kept = accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r["tails"][1] >= 0.5}
    again = fit(docs, ratings, grades=3, least_docs=3)
    assert np.allclose(again.weights, model.weights, atol=1e-3)


def test_awkward(spark):
    values = texts(3)
    docs = enumerated(spark, values)
    none = spark.createDataFrame([], "doc_id bigint, grade int")
    model = fit(docs, none, grades=3)
    assert accepted(docs, model).count() == len(values)
    one = spark.createDataFrame([(0, 2), (0, 1), (None, 1), (3, None), (99_999, 0)], "doc_id bigint, grade int")
    model = fit(docs, one, grades=3)
    assert scored(docs, model).count() == len(values)
    assert scored(docs.limit(0), model).count() == 0 and accepted(docs.limit(0), model).count() == 0
    twice = documents(spark, [(1, "a"), (1, "a"), (None, None)])
    assert scored(twice, model).count() == 3
