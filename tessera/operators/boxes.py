"""Cells for the mixed-type distance: a tree cuts the rows on one item at a time.

A box holds the least and the largest value of each item.  The weighted gaps
between a row and a box, item by item, bound its distance to every row inside:
a nominal item counts in full where its code lies outside the box.  Cuts come from
some rows of the table, boxes from all of them, so cuts change the cost alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, and of a strip of queries, inside a task.
LEAF, STRIP = 256, 256
#: Rows the cuts are taken from, for each cell and in all.
ROWS_A_CELL, MOST_ROWS = 64, 65_536
#: Blocks a query is copied to at most.
MOST_VISITS = 64
#: Bits that number the rows where several metrics search together.
ROW_BITS = 48
SLACK = 2.0**-36


def _cut_at(x: np.ndarray, weights: np.ndarray, n_numeric: int) -> tuple[int, float] | None:
    """Item and value where some rows fall in two parts; None if they agree in all that counts."""
    lo, hi = x.min(0), x.max(0)
    with np.errstate(invalid="ignore"):
        spread = np.where(np.arange(x.shape[1]) < n_numeric, hi - lo, 2.0 * (hi > lo)) * weights
    spread = np.where(hi > lo, np.nan_to_num(spread, nan=0.0), 0.0)
    j = int(spread.argmax())
    if not spread[j] > 0:
        return None
    v = np.sort(x[:, j])
    first, last = np.searchsorted(v, v[len(v) // 2], "left"), np.searchsorted(v, v[len(v) // 2], "right")
    # Rows of one value stay together; the part that is nearer to a half.
    at = first if first and (last == len(v) or 2 * first >= len(v) or len(v) - 2 * first <= 2 * last - len(v)) else last
    return j, float(v[at - 1])


def leaves(x: np.ndarray, metric, most: int) -> list[np.ndarray]:
    """Places of the rows in parts of at most so many, unless they agree."""
    w, todo, out = np.asarray(metric.weights, dtype=float), [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        cut = _cut_at(x[rows], w, metric.n_numeric) if len(rows) > most else None
        if cut is None:
            out.extend(rows[lo:lo + 16 * most] for lo in range(0, len(rows), 16 * most))
            continue
        low = x[rows, cut[0]] <= cut[1]
        if low.all() or not low.any():  # not a number
            out.extend(rows[lo:lo + 16 * most] for lo in range(0, len(rows), 16 * most))
            continue
        todo += [rows[low], rows[~low]]
    return out


def gaps(metric, lo: np.ndarray, hi: np.ndarray, box_lo: np.ndarray, box_hi: np.ndarray) -> np.ndarray:
    """Least distance between rows in two boxes each, over arrays that broadcast; items come last."""
    w = np.asarray(metric.weights, dtype=float)
    out = 0.0
    for j in range(len(w)):
        with np.errstate(invalid="ignore"):
            apart = np.fmax(np.fmax(box_lo[..., j] - hi[..., j], lo[..., j] - box_hi[..., j]), 0.0)
        out = out + w[j] * (apart if j < metric.n_numeric else apart > 0)
    return out / w.sum()


def _reached(low: np.ndarray, reach: np.ndarray, near: float) -> np.ndarray:
    """Where a bound does not rule out what is within reach; `near` is the error of a bound."""
    return low <= reach * (1 + SLACK) + near


def _error(metric, *sides: np.ndarray) -> float:
    """Bound of the rounding of numbers of this size."""
    most = max((float(np.abs(s[:, :metric.n_numeric][np.isfinite(s[:, :metric.n_numeric])]).max(initial=0.0)) for s in sides), default=0.0)
    return 1e-13 * (1.0 + most)


def _meetings(q: np.ndarray, p: np.ndarray, reach: np.ndarray, metric, best_first: bool):
    """(strip, rows of the strip, leaf) in the order in which they should meet; `reach` may shrink meanwhile."""
    parts = leaves(p, metric, LEAF)
    lo, hi = np.array([p[c].min(0) for c in parts]), np.array([p[c].max(0) for c in parts])
    near = _error(metric, q, p)
    for strip in leaves(q, metric, STRIP):
        x = q[strip]
        low = gaps(metric, x.min(0), x.max(0), lo, hi)
        order = np.argsort(low, kind="stable") if best_first else np.arange(len(low))
        for c in order:
            if not _reached(low[c], reach[strip].max(), near):
                if best_first:
                    break
                continue
            rows = strip[_reached(gaps(metric, x, x, lo[c], hi[c]), reach[strip], near)]
            if len(rows):
                yield strip, rows, parts[c]


def nearest(qid: np.ndarray, q: np.ndarray, theta: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, metric, same: bool) -> pd.DataFrame:
    """The k nearest per query and within its reach, ties by id."""
    from tessera.operators.neighbours import _same_ids

    reach, none = theta.copy(), (np.zeros(0, "int64"), np.zeros(0, "int64"))
    out_i, out_j, out_d = [], [], []
    strip, i, j, d = None, *none, np.zeros(0)

    def closed():
        out_i.append(i), out_j.append(j), out_d.append(d)

    for now, rows, leaf in _meetings(q, p, reach, metric, True):
        if now is not strip:
            if strip is not None:
                closed()
            strip, i, j, d = now, *none, np.zeros(0)
        hidden = _same_ids(qid[rows], pid[leaf]) if same else none
        a, b, gap = metric.nearest(q[rows], p[leaf], k, reach[rows], hidden)
        if not len(a):
            continue
        i, j, d = np.concatenate([i, rows[a]]), np.concatenate([j, pid[leaf[b]]]), np.concatenate([d, gap])
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        reach[i[place == k - 1]] = d[place == k - 1]
        i, j, d = i[place < k], j[place < k], d[place < k]
    closed()
    i = np.concatenate(out_i)
    return pd.DataFrame({"i": qid[i], "j": np.concatenate(out_j), "d": np.concatenate(out_d)})


def within(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, eps: float, metric) -> pd.DataFrame:
    """All pairs (i, j, d) of different ids up to a distance."""
    out = []
    for _, rows, leaf in _meetings(q, p, np.full(len(q), eps), metric, False):
        d = metric.between(q[rows], p[leaf])
        a, b = np.nonzero((d <= eps) & (qid[rows][:, None] != pid[leaf][None, :]))
        if len(a):
            out.append(pd.DataFrame({"i": qid[rows[a]], "j": pid[leaf[b]], "d": d[a, b]}))
    return pd.concat(out) if out else pd.DataFrame({"i": np.zeros(0, "int64"), "j": np.zeros(0, "int64"), "d": np.zeros(0)})


class Tree:
    """Cuts of one metric; leaves are numbered from `first`."""

    def __init__(self, x: np.ndarray, metric, cells: int, first: int = 0):
        w = np.asarray(metric.weights, dtype=float)
        self.item, self.value, self.low, self.high, self.cell = [], [], [], [], []
        self.cells = 0
        # The largest part is cut next, until there are enough.
        parts = [(self._node(), np.arange(len(x)))]
        done = []
        while parts and len(parts) + len(done) < cells:
            at = max(range(len(parts)), key=lambda n: len(parts[n][1]))
            node, rows = parts.pop(at)
            cut = _cut_at(x[rows], w, metric.n_numeric) if len(rows) > 1 else None
            low = x[rows, cut[0]] <= cut[1] if cut else np.zeros(0, bool)
            if not cut or low.all() or not low.any():
                done.append(node)
                continue
            self.item[node], self.value[node] = cut
            self.low[node], self.high[node] = self._node(), self._node()
            parts += [(self.low[node], rows[low]), (self.high[node], rows[~low])]
        for node in sorted([n for n, _ in parts] + done):
            self.cell[node] = first + self.cells
            self.cells += 1
        self.item, self.value, self.low, self.high, self.cell = (np.array(v) for v in (self.item, self.value, self.low, self.high, self.cell))

    def _node(self) -> int:
        for v, none in ((self.item, 0), (self.value, 0.0), (self.low, -1), (self.high, -1), (self.cell, -1)):
            v.append(none)
        return len(self.item) - 1

    def find(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        while True:
            inner = np.flatnonzero(self.cell[node] < 0)
            if not len(inner):
                return self.cell[node]
            at = node[inner]
            node[inner] = np.where(x[inner, self.item[at]] <= self.value[at], self.low[at], self.high[at])


class Boxes:
    """The cells of one or more metrics and what is known of each; small by construction."""

    def __init__(self, sample: np.ndarray, metrics: Sequence, cells: int, ties: bool = True):
        self.metrics, self.ties, self.trees = list(metrics), ties, []
        # Queries of several metrics have no grid that all could meet in.
        self.most_visits = MOST_VISITS if len(self.metrics) == 1 else 1 << 30
        for metric in self.metrics:
            self.trees.append(Tree(sample, metric, cells, sum(t.cells for t in self.trees)))
        n = sum(t.cells for t in self.trees)
        self.owner = np.repeat(np.arange(len(self.trees)), [t.cells for t in self.trees])
        self.counts, self.parts = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
        self.lo, self.hi = np.full((n, sample.shape[1]), np.inf), np.full((n, sample.shape[1]), -np.inf)

    def metric_of(self, cell: int):
        return self.metrics[self.owner[int(cell)]]

    def placed(self, pdf: pd.DataFrame):
        from tessera.operators.neighbours import _matrix

        x = _matrix(pdf["vec"])
        for g, tree in enumerate(self.trees):
            out = pdf.assign(cell=tree.find(x).astype("int32"))
            yield out if len(self.trees) == 1 else out.assign(id=out["id"] + (g << ROW_BITS))

    def measure(self, placed: DataFrame, block: int) -> None:
        d = range(self.lo.shape[1])
        ends = [f(F.col("vec")[j]).alias(f"{t}{j}") for j in d for t, f in (("lo", F.min), ("hi", F.max))]
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
            c = r["cell"]
            self.counts[c], self.parts[c] = r["n"], math.ceil(r["n"] / block)
            self.lo[c], self.hi[c] = [r[f"lo{j}"] for j in d], [r[f"hi{j}"] for j in d]

    def open(self, pdf: pd.DataFrame) -> np.ndarray:
        """Which cells the bound of each query leaves open."""
        from tessera.operators.neighbours import _matrix

        x, theta, own = _matrix(pdf["vec"]), pdf["theta"].to_numpy(dtype=float), self.owner[pdf["cell"].to_numpy()]
        out = np.zeros((len(x), len(self.counts)), bool)
        for g, metric in enumerate(self.metrics):
            rows, cells = np.flatnonzero(own == g), np.flatnonzero((self.owner == g) & (self.counts > 0))
            for lo in range(0, len(rows), 2048):
                some = rows[lo:lo + 2048]
                y = x[some][:, None, :]
                low = gaps(metric, y, y, self.lo[cells][None], self.hi[cells][None])
                out[np.ix_(some, cells)] = _reached(low, theta[some][:, None], _error(metric, x))
        # Where ties do not matter nothing is nearer than none.
        return out if self.ties else out & (theta > 0)[:, None]


def boxes(points: DataFrame, total: int, block: int, metrics: Sequence, ties: bool = True) -> Boxes:
    cells = max(1, math.ceil(1.5 * total / block))
    wanted = min(MOST_ROWS, ROWS_A_CELL * cells)
    share = max(1, min(1 << 20, math.ceil((1 << 20) * wanted / max(1, total))))
    rows = points.where(F.pmod(F.xxhash64("id", "vec", F.lit(17)), F.lit(1 << 20)) < share).select("vec").limit(2 * wanted).collect()
    width = len(metrics[0].weights)
    return Boxes(np.array([r["vec"] for r in rows], dtype=float).reshape(-1, width), metrics, cells, ties)
