"""Exact tests on small tables of counts, as Arrow-batched column functions.

The inputs are aggregates (one row per cluster and label), so the batches stay
small whatever the size of the data behind them.  Probabilities follow the
saddle-point form of the binomial and hypergeometric densities (Loader, 2000),
which keeps full relative precision for counts in the billions; tails are summed
outward from the observed cell until the terms no longer matter.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 8192


def _stirling_error(n: float) -> float:
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    n2 = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n2)) / n2) / n2) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x/m) + m - x without cancellation when x is close to m."""
    delta = x - m
    if abs(delta) < 0.1 * (x + m):
        v = delta / (x + m)
        total, term, j = delta * v, 2 * x * v, 1
        while True:
            term *= v * v
            step = term / (2 * j + 1)
            if total + step == total:
                return total
            total += step
            j += 1
    return x * math.log(x / m) - delta


def log_binom_pmf(x: float, n: float, p: float) -> float:
    q = 1 - p
    if p <= 0 or q <= 0:
        hit = x == 0 if p <= 0 else x == n
        return 0.0 if hit else -math.inf
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    if x < 0 or x > n:
        return -math.inf
    core = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    core -= _deviance(x, n * p) + _deviance(n - x, n * q)
    return core + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hyper_pmf(x: float, white: float, drawn: float, total: float) -> float:
    if x < max(0, drawn + white - total) or x > min(white, drawn):
        return -math.inf
    if drawn == 0 or drawn == total:
        return 0.0
    p = drawn / total
    return (
        log_binom_pmf(x, white, p)
        + log_binom_pmf(drawn - x, total - white, p)
        - log_binom_pmf(drawn, total, p)
    )


def _sum_outward(log_start: float, start: int, stop: int, step: int, ratio) -> float:
    """Sum of a density from `start` to `stop`; `ratio(k)` is pmf(k+step)/pmf(k)."""
    if (stop - start) * step < 0 or log_start == -math.inf:
        return 0.0
    total, log_term, k = 0.0, log_start, start
    while True:
        count = min(CHUNK, abs(stop - k))
        if count == 0:
            return total + math.exp(log_term)
        ks = k + step * np.arange(count, dtype=float)
        steps = np.log(ratio(ks))
        logs = log_term + np.concatenate(([0.0], np.cumsum(steps)))
        total += float(np.exp(logs[:-1]).sum())
        k += step * count
        log_term = float(logs[-1])
        if steps[-1] < 0 and log_term < math.log(total + 1e-320) - 45:
            return total


class _Hyper:
    def __init__(self, a, b, c, d):
        self.white, self.drawn, self.total = a + b, a + c, a + b + c + d
        self.lo = max(0, self.drawn + self.white - self.total)
        self.hi = min(self.white, self.drawn)
        self.mode = (self.white + 1) * (self.drawn + 1) // (self.total + 2)

    @classmethod
    def of(cls, white: int, drawn: int, total: int) -> "_Hyper":
        a = max(0, white + drawn - total)
        return cls(a, white - a, drawn - a, total - white - drawn + a)

    def log_pmf(self, x):
        return log_hyper_pmf(x, self.white, self.drawn, self.total)

    def _up_ratio(self, k):
        rest = self.total - self.white - self.drawn
        return (self.white - k) * (self.drawn - k) / ((k + 1) * (rest + k + 1))

    def _down_ratio(self, k):
        rest = self.total - self.white - self.drawn
        return k * (rest + k) / ((self.white - k + 1) * (self.drawn - k + 1))

    def upper(self, x):
        if x > self.hi:
            return 0.0
        return _sum_outward(self.log_pmf(x), x, self.hi, 1, self._up_ratio)

    def lower(self, x):
        if x < self.lo:
            return 0.0
        return _sum_outward(self.log_pmf(x), x, self.lo, -1, self._down_ratio)

    def greater(self, x):
        return self.upper(x) if x > self.mode else 1.0 - self.lower(x - 1)

    def two_sided(self, x):
        limit = self.log_pmf(x) + math.log1p(1e-7)
        # Outside its mode the density is monotone: bisect for the far side.
        lo, hi = self.mode, self.hi + 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.log_pmf(mid) <= limit:
                hi = mid
            else:
                lo = mid + 1
        first_up = lo
        lo, hi = self.lo - 1, self.mode
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.log_pmf(mid) <= limit:
                lo = mid
            else:
                hi = mid - 1
        last_down = lo
        if last_down >= first_up:
            return 1.0
        return min(1.0, self.upper(first_up) + self.lower(last_down))

    def odds_ratio(self, x):
        """Conditional maximum-likelihood odds ratio: E[X | psi] = x."""
        if self.lo == self.hi:
            return math.nan
        if x == self.lo:
            return 0.0
        if x == self.hi:
            return math.inf

        def mean_at(log_psi):
            psi = math.exp(log_psi)
            # Mode of the tilted density solves a quadratic; sum 14 sd around it.
            qa = psi - 1
            qb = -(psi * (self.white + self.drawn + 2) + self.total - self.white - self.drawn)
            qc = psi * (self.white + 1) * (self.drawn + 1)
            mode = qc / -qb if abs(qa) < 1e-12 else 2 * qc / (-qb + math.sqrt(max(qb * qb - 4 * qa * qc, 0)))
            m = min(max(mode, self.lo + 1e-9), self.hi)
            rest = self.total - self.white - self.drawn
            curvature = sum(1 / max(v, 0.5) for v in (m, self.white - m, self.drawn - m, rest + m))
            half = int(14 / math.sqrt(curvature)) + 25
            ks = np.arange(max(self.lo, int(m) - half), min(self.hi, int(m) + half) + 1, dtype=float)
            logs = np.concatenate(([0.0], np.cumsum(np.log(self._up_ratio(ks[:-1])) + log_psi)))
            w = np.exp(logs - logs.max())
            return float((w * ks).sum() / w.sum())

        lo, hi = -1.0, 1.0
        while mean_at(lo) > x:
            lo *= 2
        while mean_at(hi) < x:
            hi *= 2
        for _ in range(80):
            mid = 0.5 * (lo + hi)
            if mean_at(mid) < x:
                lo = mid
            else:
                hi = mid
        return math.exp(0.5 * (lo + hi))


def _each(fn, *cols: pd.Series) -> pd.Series:
    out = []
    for row in zip(*cols):
        out.append(None if any(v is None or v != v for v in row) else fn(*row))
    return pd.Series(out, dtype="float64", index=cols[0].index)


def _counts(fn):
    return lambda a, b, c, d: fn(_Hyper(int(a), int(b), int(c), int(d)), int(a))


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """P(X >= a) for the 2x2 table [[a, b], [c, d]]."""
    return _each(_counts(_Hyper.greater), a, b, c, d)


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Sum of the outcomes no more likely than the observed one."""
    return _each(_counts(_Hyper.two_sided), a, b, c, d)


@F.pandas_udf(T.DoubleType())
def conditional_odds_ratio(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(_counts(_Hyper.odds_ratio), a, b, c, d)


def binomial_tail(x: int, n: int, p: float, greater: bool) -> float:
    mode = int((n + 1) * p)

    def upper(k):
        return 0.0 if k > n else _sum_outward(
            log_binom_pmf(k, n, p), k, n, 1, lambda v: (n - v) / (v + 1) * (p / (1 - p)))

    def lower(k):
        return 0.0 if k < 0 else _sum_outward(
            log_binom_pmf(k, n, p), k, 0, -1, lambda v: v / (n - v + 1) * ((1 - p) / p))

    if p <= 0 or p >= 1:
        return 1.0 if (x <= n * p if greater else x >= n * p) else 0.0
    if greater:
        return upper(x) if x > mode else 1.0 - lower(x - 1)
    return lower(x) if x < mode else 1.0 - upper(x + 1)


@F.pandas_udf(T.DoubleType())
def binomial_by_direction(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact one-sided binomial, upper tail when x/n >= p, lower tail otherwise."""
    return _each(lambda k, m, q: binomial_tail(int(k), int(m), float(q), k / m >= q), x, n, p)


@F.pandas_udf(T.DoubleType())
def binomial_quantile(prob: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Smallest k with P(X <= k) >= prob."""

    def one(u, m, q):
        m = int(m)
        if q <= 0 or q >= 1:
            return float(m * (q >= 1))
        lo, hi = 0, m
        while lo < hi:
            mid = (lo + hi) // 2
            if binomial_tail(mid, m, q, False) >= u - 1e-12:
                hi = mid
            else:
                lo = mid + 1
        return float(lo)

    return _each(one, prob, n, p)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), z)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    dist = NormalDist()
    return _each(lambda v: -math.inf if v <= 0 else math.inf if v >= 1 else dist.inv_cdf(v), p)


@F.pandas_udf(T.DoubleType())
def rank_sum_greater(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
    """One-sided rank-sum p.  Exact without ties below 50 per class, otherwise
    the normal limit with tie (sum of t^3 - t) and continuity corrections."""

    def one(stat, m, n, tie):
        m, n = int(m), int(n)
        if m < 50 and n < 50 and tie == 0:
            # Gaussian binomial coefficient: number of arrangements per statistic.
            ways = np.zeros(m * n + 1)
            ways[0] = 1.0
            for j in range(1, m + 1):
                up = np.zeros_like(ways)
                up[: len(ways)] = ways
                if n + j < len(ways):
                    up[n + j:] -= ways[: -(n + j)]
                for i in range(j, len(up)):
                    up[i] += up[i - j]
                ways = up
            return float(ways[int(math.ceil(stat)):].sum() / ways.sum())
        total = m + n
        sd = math.sqrt(m * n / 12 * (total + 1 - tie / (total * (total - 1))))
        return 0.5 * math.erfc((stat - m * n / 2 - 0.5) / sd / math.sqrt(2)) if sd > 0 else 1.0

    return _each(one, u, n1, n0, ties)


@F.pandas_udf(T.DoubleType())
def expected_information(row: pd.Series, column: pd.Series, total: pd.Series) -> pd.Series:
    """Expected mutual-information term of one cell with fixed margins."""

    def one(r, c, n):
        h = _Hyper.of(int(r), int(c), int(n))
        mean = r * c / n
        sd = math.sqrt(max(1e-12, mean * (1 - r / n) * (n - c) / max(1.0, n - 1)))
        lo, hi = max(h.lo, 1, int(mean - 14 * sd) - 25), min(h.hi, int(mean + 14 * sd) + 25)
        if lo > hi:
            return 0.0
        ks = np.arange(lo, hi + 1, dtype=float)
        logs = h.log_pmf(lo) + np.concatenate(([0.0], np.cumsum(np.log(h._up_ratio(ks[:-1])))))
        return float((np.exp(logs) * ks / n * np.log(n * ks / (r * c))).sum())

    return _each(one, row, column, total)
