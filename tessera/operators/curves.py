"""Principal curves, smooth manifolds of principal coordinates, and rolling fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import fold_of
from tessera.operators import linalg as LA
from tessera.operators import models as Md
from tessera.operators.neighbours import _matrix
from tessera.operators.ordered import running_totals
from tessera.session import cut_lineage

NODES = 200


def _dims(points: DataFrame) -> int:
    return len(points.select("vec").first()["vec"])


def total_squares(points: DataFrame, d: int) -> float:
    return float(points.agg(sum((F.var_pop(F.col("vec")[j]) for j in range(d)), F.lit(0.0)) * F.count(F.lit(1))).first()[0])


def _onto(nodes: np.ndarray):
    """Nearest point on a polyline: arc length, squared distance, foot."""
    seg = np.diff(nodes, axis=0)
    length = np.sqrt((seg * seg).sum(1))
    start = np.concatenate([[0.0], np.cumsum(length)])[:-1]

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo:lo + 2048]
                x = _matrix(part["vec"])
                gap = x[:, None, :] - nodes[None, :-1, :]
                along = np.clip((gap * seg[None]).sum(2) / np.maximum(length**2, 1e-300)[None], 0, 1)
                rest = gap - along[:, :, None] * seg[None]
                d2 = (rest * rest).sum(2)
                best = d2.argmin(1)
                row = np.arange(len(x))
                a = along[row, best]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "t": start[best] + a * length[best], "d2": d2[row, best],
                                    "foot": list(nodes[best] + a[:, None] * seg[best]), "vec": part["vec"]})

    return run


def principal_curve(points: DataFrame, knots: int = 8, rounds: int = 10, tol: float = 1e-3) -> DataFrame:
    """(id, t, d2, foot, vec): arc length along a smooth curve through the middle of the points.

    Rounds of smoothing the coordinates on t and projecting onto the fitted
    curve; each is one pass for the cross-products and one for the projection.
    """
    d = _dims(points)
    mean, axes, _ = LA.principal_axes(points, 1)
    now = LA.project(points.select("id", "vec"), mean, axes).select("id", "vec", F.col("score")[0].alias("t"))
    last, names = None, [f"c{j}" for j in range(d)]
    for _ in range(rounds):
        rows = now.select("id", F.array("t").alias("x"), F.lit(0).alias("fold"), F.col("vec").alias("y"))
        basis = Md.additive_basis(rows, 1, knots)
        m = Md.fit(rows, names, basis, "gaussian")
        lo, hi = now.agg(F.min("t"), F.max("t")).first()
        nodes = basis.design(np.linspace(lo, hi, NODES)[:, None]) @ m.beta.T
        now = cut_lineage(now.select("id", "vec").mapInPandas(
            _onto(nodes), "id bigint, t double, d2 double, foot array<double>, vec array<double>"))
        rss = now.agg(F.sum("d2")).first()[0]
        if last is not None and abs(last - rss) <= tol * max(last, 1e-300):
            break
        last = rss
    return now


def curve_r2(points: DataFrame, curve: DataFrame) -> float:
    return 1 - float(curve.agg(F.sum("d2")).first()[0]) / total_squares(points, _dims(points))


def rolling_normal(curve: DataFrame, half: int = 15, span: int = 2000) -> DataFrame:
    """(id, t, w): residual along the first axis of residuals in a centred row window.

    Ranks cut the order into spans; rows near a border are copied to the next
    span, so every window is whole and no task sees all rows.
    """
    gap = F.zip_with("vec", "foot", lambda a, b: a - b)
    ranked = running_totals(curve.select("id", "t", gap.alias("r"), F.lit(1).alias("one")), "t", ["one"], tie="id")
    k = F.col("upto_one") - 1
    block, at = F.floor(k / span), k % span
    copies = F.array_compact(F.array(block, F.when(at < half, block - 1), F.when(at >= span - half, block + 1)))
    rows = ranked.select("id", "t", "r", k.alias("k"), F.explode(copies).alias("b")).where("b >= 0")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        r, k, b = _matrix(pdf["r"]), pdf["k"].to_numpy(), pdf["b"].iloc[0]
        own = np.nonzero(k // span == b)[0]
        w = np.zeros(len(own))
        for n, i in enumerate(own):
            win = r[max(0, i - half):i + half + 1]
            _, vec = np.linalg.eigh(np.cov(win.T) if len(win) > 1 else np.eye(r.shape[1]))
            axis = vec[:, -1]
            w[n] = r[i] @ (axis * np.sign(axis[np.abs(axis).argmax()]))
        return pd.DataFrame({"id": pdf["id"].to_numpy()[own], "t": pdf["t"].to_numpy()[own], "w": w})

    return rows.groupBy("b").applyInPandas(fit, "id bigint, t double, w double")


def manifold_r2(points: DataFrame, m: int, folds: int = 3, knots: Sequence[int] = (4, 6), extra: int = 3) -> dict:
    """Held-out R2 of all coordinates as a smooth function of the first m principal ones.

    Axes and surface come from the training folds alone.  Also the linear
    baseline: the share of variance of the same m axes.
    """
    d = _dims(points)
    names = [f"c{j}" for j in range(d)]
    pts = cut_lineage(points.select("id", "vec", fold_of("id", folds).cast("int").alias("fold")))
    per_axis = [*knots, *[extra] * max(0, m - 2)][:m]
    rss = 0.0
    for f in range(folds):
        mean, axes, _ = LA.principal_axes(pts.where(F.col("fold") != f), m)
        rows = cut_lineage(LA.project(pts, mean, axes).select("id", F.col("score").alias("x"), "fold", F.col("vec").alias("y")))
        fitted = Md.fit(rows, names, Md.volume_basis(rows, m, per_axis), "gaussian", [f])
        test = rows.where(F.col("fold") == f)
        gap = Md.answered(Md.predict(test, fitted, True), test, names)
        rss += float(gap.agg(F.sum(F.pow(F.col("y") - F.col("p"), 2))).first()[0] or 0.0)
    mean, axes, _ = LA.principal_axes(pts, d)
    spread = LA.axis_variances(pts, mean, axes)
    linear = float(spread[:m].sum() / spread.sum())
    r2 = 1 - rss / total_squares(pts, d)
    return {"m": m, "r2_cv": r2, "r2_linear": linear, "delta_r2": r2 - linear}


def surface_shape(points: DataFrame, grid: DataFrame, knots: int = 36, step: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Gradient norms on a lattice (gx, gy, du, dv, jac), and (curv_med, curv_p95) of second differences."""
    d = _dims(points)
    mean, axes, _ = LA.principal_axes(points, 2)
    rows = cut_lineage(LA.project(points, mean, axes).select("id", F.col("score").alias("x"), F.lit(0).alias("fold"), F.col("vec").alias("y")))
    m = Md.fit(rows, [f"c{j}" for j in range(d)], Md.surface_basis(rows, knots), "gaussian")
    basis, beta = m.basis, m.beta

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = pdf[["gx", "gy"]].to_numpy(dtype=float)
                y = basis.design(x) @ beta.T
                du = (basis.design(x + [step, 0.0]) @ beta.T - y) / step
                dv = (basis.design(x + [0.0, step]) @ beta.T - y) / step
                yield pdf.assign(du=np.sqrt((du * du).sum(1)), dv=np.sqrt((dv * dv).sum(1)), y=list(y))

    full = cut_lineage(grid.mapInPandas(run, "ix bigint, iy bigint, gx double, gy double, du double, dv double, y array<double>"))
    along, across = Window.partitionBy("iy").orderBy("ix"), Window.partitionBy("ix").orderBy("iy")
    bend = lambda w: F.transform(F.arrays_zip(F.lag("y").over(w).alias("a"), F.col("y").alias("b"), F.lead("y").over(w).alias("c")),
                                 lambda e: e["a"] - 2 * e["b"] + e["c"])
    inner = full.withColumn("d2u", bend(along)).withColumn("d2v", bend(across))
    hess = F.aggregate(F.zip_with("d2u", "d2v", lambda a, b: F.sqrt(a * a + b * b)), F.lit(0.0), lambda s, v: s + v)
    from tessera.operators.ordered import quantiles

    curv = quantiles(inner.select(hess.alias("h")).where("h is not null"), "h", {"curv_med": 0.5, "curv_p95": 0.95}).select("curv_med", "curv_p95")
    return full.select("gx", "gy", "du", "dv", F.sqrt(F.col("du") ** 2 + F.col("dv") ** 2).alias("jac")), curv


#: Distances are narrowed down by this many bits a pass.
RADIX = 12


def reach(values: DataFrame, nodes: np.ndarray, q: int) -> np.ndarray:
    """Distance from each node to its q-th nearest value of the column `t`, exactly.

    A radix selection on the bits of the distance: each pass counts, per node, the
    distances that share the leading bits found so far by their next 12 bits.
    """
    nodes = np.asarray(nodes, dtype=float)
    known, left = np.zeros(len(nodes), dtype=np.int64), np.full(len(nodes), q, dtype=np.int64)
    for done in range(0, 72, RADIX):
        shift = max(0, 64 - done - RADIX)
        above = 64 - done
        prefix = known.copy()

        def count(batches):
            for pdf in batches:
                t = pdf["t"].to_numpy(dtype=float)
                for i, node in enumerate(nodes):
                    bits = np.abs(t - node).view(np.int64)
                    same = bits if done == 0 else bits[bits >> above == prefix[i]]
                    digit, n = np.unique(same >> shift, return_counts=True)
                    yield pd.DataFrame({"node": i, "digit": digit, "n": n})

        found = values.select("t").mapInPandas(count, "node int, digit bigint, n bigint").groupBy("node", "digit").agg(
            F.sum("n").alias("n")).toPandas()
        for i, part in found.sort_values("digit").groupby("node"):
            upto = part["n"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, left[i]))
            left[i] -= upto[at - 1] if at else 0
            known[i] = part["digit"].iloc[at]
        if shift == 0:
            break
    return known.view(np.float64)


def local_regression(rows: DataFrame, nodes, responses: list[str], span: float = 0.2, degree: int = 2) -> DataFrame:
    """(node, t, responses...): tricube-weighted local polynomials of the responses on `t`, at the nodes.

    A neighbourhood is the floor(span * n) nearest rows and those that tie with the
    farthest of them, which weigh nothing; rows with a NULL in t or a response do not count.
    Each task reduces its rows to a few weighted moments per node, so what moves
    does not grow with the rows.  Where a neighbourhood cannot carry the
    polynomial (few distinct t) the solution of least norm is taken; a
    neighbourhood of one distinct t gives the mean of its rows.
    """
    nodes = np.asarray(nodes, dtype=float)
    used = cut_lineage(rows.select(F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in responses]).dropna())
    q = int(np.floor(span * used.count() + 1e-5))
    schema = "node bigint, t double, " + ", ".join(f"{c} double" for c in responses)
    if q < 1:
        return used.sparkSession.createDataFrame([(i, float(x), *[None] * len(responses)) for i, x in enumerate(nodes)], schema)
    h = reach(used, nodes, q)
    powers = 2 * degree + 1
    width = powers + (degree + 1) * len(responses)

    def moments(batches):
        total = np.zeros((len(nodes), width))
        for pdf in batches:
            t, y = pdf["t"].to_numpy(), pdf[responses].to_numpy()
            for i, node in enumerate(nodes):
                gap = t - node
                near = np.abs(gap) <= h[i] if h[i] == 0 else np.abs(gap) < h[i]
                x = gap[near] / h[i] if h[i] > 0 else np.zeros(near.sum())
                w = (1 - np.abs(x) ** 3) ** 3
                p = w[:, None] * x[:, None] ** np.arange(powers)
                total[i, :powers] += p.sum(0)
                total[i, powers:] += (p[:, :degree + 1].T @ y[near]).ravel()
        yield pd.DataFrame({"node": np.arange(len(nodes)), "m": list(total)})

    sums = used.mapInPandas(moments, "node bigint, m array<double>").groupBy("node").agg(
        F.array(*[F.sum(F.col("m")[j]) for j in range(width)]).alias("m")).toPandas().set_index("node")["m"]
    out = []
    for i, node in enumerate(nodes):
        m = np.asarray(sums[i])
        gram = m[np.add.outer(np.arange(degree + 1), np.arange(degree + 1))]
        beta = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ m[powers:].reshape(degree + 1, -1)
        out.append((i, float(node), *map(float, beta[0] if m[0] > 0 else np.full(len(responses), np.nan))))
    return used.sparkSession.createDataFrame(out, schema)
