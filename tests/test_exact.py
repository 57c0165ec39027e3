"""Closed forms for exact tests and scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions.scalar import wilson


def brute(a, b, c, d):
    n, k, m = a + b + c + d, a + b, a + c
    return {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m + k - n), min(k, m) + 1)}


TABLES = [(10, 20, 5, 60), (0, 7, 3, 5), (8, 2, 1, 9), (50, 1, 2, 40), (3, 3, 3, 3), (1, 0, 0, 1), (120, 380, 90, 410)]


def test_fisher_against_integers(spark):
    df = spark.createDataFrame(TABLES, "a int, b int, c int, d int")
    rows = df.select("*", exact.fisher_greater("a", "b", "c", "d").alias("g"), exact.fisher_two_sided("a", "b", "c", "d").alias("t")).collect()
    for r in rows:
        pmf = brute(r.a, r.b, r.c, r.d)
        assert r.g == pytest.approx(sum(p for x, p in pmf.items() if x >= r.a), rel=1e-9)
        assert r.t == pytest.approx(sum(p for p in pmf.values() if p <= pmf[r.a] * (1 + 1e-7)), rel=1e-9)


def test_fisher_known_value(spark):
    df = spark.createDataFrame([(10, 20, 5, 60)], "a int, b int, c int, d int")
    assert df.select(exact.fisher_greater("a", "b", "c", "d")).first()[0] == pytest.approx(0.0026200602, abs=1e-9)


def test_fisher_with_billions_of_subjects(spark):
    df = spark.createDataFrame([(10**9, 10**9, 10**9, 10**9 + 50000)], "a long, b long, c long, d long")
    p = df.select(exact.fisher_greater("a", "b", "c", "d")).first()[0]
    # Normal limit: the cell exceeds its expectation by 12500, about 0.79 sd.
    n, w, m = 4e9 + 5e4, 2e9, 2e9
    sd = math.sqrt(m * (w / n) * (1 - w / n) * (n - m) / (n - 1))
    z = (1e9 - 0.5 - w * m / n) / sd
    assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-4)


def test_conditional_odds_ratio_solves_its_equation(spark):
    df = spark.createDataFrame(TABLES[:1] + TABLES[2:3], "a int, b int, c int, d int")
    for r in df.select("*", exact.conditional_odds_ratio("a", "b", "c", "d").alias("o")).collect():
        pmf = brute(r.a, r.b, r.c, r.d)
        w = {x: p * r.o**x for x, p in pmf.items()}
        assert sum(x * v for x, v in w.items()) / sum(w.values()) == pytest.approx(r.a, rel=1e-8)


def test_binomial_direction_and_quantile(spark):
    df = spark.createDataFrame([(7, 20, 0.2), (1, 20, 0.2)], "x int, n int, p double")
    got = [r[0] for r in df.select(exact.binomial_by_direction("x", "n", "p")).collect()]
    pmf = [math.comb(20, k) * 0.2**k * 0.8 ** (20 - k) for k in range(21)]
    assert got == pytest.approx([sum(pmf[7:]), sum(pmf[:2])], rel=1e-9)
    q = df.select(exact.binomial_quantile(F.lit(0.975), "n", "p")).first()[0]
    assert sum(pmf[: int(q) + 1]) >= 0.975 > sum(pmf[: int(q)])


def test_rank_sum_exact_small(spark):
    # Three positives above three negatives: one arrangement of twenty.
    df = spark.createDataFrame([(9.0, 3, 3, 0.0)], "u double, m int, n int, t double")
    assert df.select(exact.rank_sum_greater("u", "m", "n", "t")).first()[0] == pytest.approx(1 / 20)


def test_normal_functions(spark):
    df = spark.createDataFrame([(1.96,)], "z double").select(exact.normal_cdf("z").alias("p"))
    assert df.first()[0] == pytest.approx(0.9750021, abs=1e-6)
    assert df.select(exact.normal_quantile("p")).first()[0] == pytest.approx(1.96, abs=1e-6)


def test_wilson_of_nothing_is_null(spark):
    lo, hi = wilson("k", "n")
    row = spark.createDataFrame([(0, 0)], "k int, n int").select(lo, hi).first()
    assert row[0] is None and row[1] is None
