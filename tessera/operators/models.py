"""Penalised regression fitted from distributed cross-products.

Many models share one scan: per label, per held-out fold, per penalty.  Each
task folds its rows into X'WX, X'Wz and z'Wz of every model; those small sums
travel, rows never do.  Gaussian models take one pass, binomial ones one pass per
reweighting step, whatever the number of labels and folds.

Smooth terms are low-rank thin-plate splines on a quantile lattice of knots; the
penalty weight minimises generalised cross-validation.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Penalty weights searched, relative to the scale of the data.
LAMBDAS = tuple(10.0**e for e in np.arange(-6.0, 7.0, 0.5))
GRAM_BYTES = 256 << 20


@dataclass(frozen=True)
class Basis:
    """Columns of a design and the penalty on their coefficients.

    kind linear    intercept and coordinates, ridge on the latter
         surface   thin-plate spline in all coordinates
         additive  one cubic spline per coordinate
         varying   surface, plus the last coordinate times a second surface
         added     surface, plus the last coordinate as a linear term
    """

    kind: str
    dims: int
    knots: tuple = field(default=())

    def _radial(self, x: np.ndarray, knots: np.ndarray) -> np.ndarray:
        gap = x[:, None, :] - knots[None, :, :]
        r2 = (gap * gap).sum(2)
        # Cubes of distances need only the linear null space, in any dimension.
        if knots.shape[1] != 2:
            return r2 ** 1.5
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1.0)), 0.0)

    def _spline(self, x: np.ndarray, knots: np.ndarray):
        """Unpenalised part, penalised part and its penalty."""
        t = np.column_stack([np.ones(len(knots)), knots])
        q, _ = np.linalg.qr(t, mode="complete")
        z = q[:, t.shape[1]:]
        e = self._radial(knots, knots)
        s = z.T @ e @ z
        # Work in the eigenbasis of the penalty: it becomes the identity.
        val, vec = np.linalg.eigh((s + s.T) / 2)
        sign = 1.0 if abs(val.max()) >= abs(val.min()) else -1.0
        val = np.maximum(sign * val, 1e-10 * np.abs(val).max())
        root = z @ (vec / np.sqrt(val))
        return np.column_stack([np.ones(len(x)), x]), self._radial(x, knots) @ root

    def design(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return np.column_stack([np.ones(len(x)), x])
        knots = [np.array(k, dtype=float) for k in self.knots]
        if self.kind == "additive":
            parts = [np.ones((len(x), 1))]
            for j in range(self.dims):
                flat, wavy = self._spline(x[:, [j]], knots[j].reshape(-1, 1))
                parts += [flat[:, 1:], wavy]
            return np.column_stack(parts)
        plane = x[:, : len(self.knots[0][0])]
        flat, wavy = self._spline(plane, knots[0])
        out = [flat, wavy]
        if self.kind == "varying":
            v = x[:, [2]]
            out += [flat * v, wavy * v]
        elif self.kind == "added":
            out.append(x[:, [2]])
        return np.column_stack(out)

    def penalty(self) -> np.ndarray:
        """Diagonal penalty, one entry per column."""
        if self.kind == "linear":
            return np.concatenate([[0.0], np.ones(self.dims)])
        if self.kind == "additive":
            return np.concatenate([[0.0]] + [np.concatenate([[0.0], np.ones(len(k) - 2)]) for k in self.knots])
        m, free = len(self.knots[0]), len(self.knots[0][0]) + 1
        one = np.concatenate([np.zeros(free), np.ones(m - free)])
        return {"surface": one, "varying": np.concatenate([one, one]), "added": np.concatenate([one, [0.0]])}[self.kind]


def quantile_knots(rows: DataFrame, dims: int, per_axis: int) -> list[list[float]]:
    """Distinct approximate quantiles of each coordinate of `x`; knots need no exactness."""
    axes = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(dims)])
    probs = [(i + 0.5) / per_axis for i in range(per_axis)]
    found = axes.approxQuantile(axes.columns, probs, 0.005)
    return [sorted(set(q)) for q in found]


def surface_basis(rows: DataFrame, k: int = 60, kind: str = "surface") -> Basis:
    per_axis = max(2, math.ceil(math.sqrt(k)))
    qx, qy = quantile_knots(rows, 2, per_axis)
    grid = tuple((a, b) for a in qx for b in qy)
    return Basis(kind, 2 if kind == "surface" else 3, (grid,))


def volume_basis(rows: DataFrame, dims: int, per_axis: Sequence[int]) -> Basis:
    """Spline over a lattice with its own number of knots per coordinate."""
    axes = [quantile_knots(rows, dims, k)[j] for j, k in enumerate(per_axis)]
    return Basis("surface", dims, (tuple(itertools.product(*axes)),))


def additive_basis(rows: DataFrame, dims: int, k: int = 6) -> Basis:
    return Basis("additive", dims, tuple(tuple(q) for q in quantile_knots(rows, dims, k)))


@dataclass
class Models:
    """Coefficients of a family of models; their number grows with labels only."""

    labels: list[str]
    held: list[int]
    basis: Basis
    family: str
    keys: list[tuple[int, int, float | None]]  # label index, held-out fold (-1: none), fixed penalty
    beta: np.ndarray
    cov: list | None = None
    lam: np.ndarray | None = None
    edf: np.ndarray | None = None


def _working(family, eta, y):
    if family == "gaussian":
        return np.ones_like(y), y
    mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    w = np.maximum(mu * (1 - mu), 1e-6)
    return w, eta + (y - mu) / w


def _grams(basis, family, keys, beta):
    def run(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = basis.design(np.vstack(pdf["x"].to_numpy()).astype(float))
            ys = np.vstack(pdf["y"].to_numpy()).astype(float)
            fold = pdf["fold"].to_numpy()
            p = x.shape[1]
            if total is None:
                total = np.zeros((len(keys), p * p + p + 2))
            eta = x @ beta.T if beta is not None else None
            for m, (label, held, _) in enumerate(keys):
                use = (fold != held) & np.isfinite(ys[:, label])
                if not use.any():
                    continue
                xm, ym = x[use], ys[use, label]
                w, z = _working(family, eta[use, m] if eta is not None else np.zeros(len(ym)), ym)
                xw = xm * w[:, None]
                total[m, : p * p] += (xw.T @ xm).ravel()
                total[m, p * p: p * p + p] += xw.T @ z
                total[m, -2] += float((w * z * z).sum())
                total[m, -1] += len(ym)
        if total is not None:
            # A retried task must send its sums to the same place.
            salt = TaskContext.get().partitionId() % 32
            yield pd.DataFrame({"model": np.arange(len(keys)), "salt": salt, "sums": list(total)})

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "sums": [np.sum(np.vstack(pdf["sums"].to_numpy()), axis=0)]})


def _solve(gram, rhs, pen, lam):
    a = gram + np.diag(lam * pen)
    a[np.diag_indices_from(a)] += 1e-8 * max(1e-8, np.trace(gram) / len(gram))
    chol = np.linalg.cholesky(a)
    inv = np.linalg.solve(chol, np.eye(len(a)))
    inv = inv.T @ inv
    return inv @ rhs, inv


def _fit_sums(p, pen, fixed, binomial, slack):
    """Choose the penalty and solve, from the summed cross-products of one model."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["model"].iloc[0])
        sums = np.sum(np.vstack(pdf["sums"].to_numpy()), axis=0)
        gram, rhs, zz, n = sums[: p * p].reshape(p, p), sums[p * p: p * p + p], sums[-2], sums[-1]
        scale = np.trace(gram * (pen > 0)) / max(1.0, pen.sum()) if pen.any() else 1.0
        best = None
        for lam in ([fixed[m]] if fixed[m] is not None else [v * scale for v in LAMBDAS] if pen.any() else [0.0]):
            try:
                beta, inv = _solve(gram, rhs, pen, lam)
            except np.linalg.LinAlgError:
                continue
            edf = float(np.trace(inv @ gram))
            rss = max(1e-12, zz - 2 * beta @ rhs + beta @ gram @ beta)
            score = n * rss / max(1e-9, n - slack * edf) ** 2
            if best is None or score < best[0]:
                best = (score, beta, inv, lam, edf, rss)
        if best is None:
            raise ValueError(f"model {m} cannot be solved with any penalty")
        _, beta, inv, lam, edf, rss = best
        phi = 1.0 if binomial else rss / max(1.0, n - edf)
        return pd.DataFrame({"model": [m], "beta": [beta], "cov": [(phi * inv).ravel()], "lam": [lam], "edf": [edf]})

    return run


def fit(rows: DataFrame, labels: Sequence[str], basis: Basis, family: str = "binomial", folds: Sequence[int] = (-1,),
        penalties: Sequence[float] | None = None, max_steps: int = 12, tol: float = 1e-5, slack: float = 1.0) -> Models:
    """Fit every (label, held-out fold, penalty) from `rows` (x, fold, y ARRAY per label).

    Fold -1 holds nothing out.  A NULL or NaN response drops that row for that
    label.  Without `penalties` the weight comes from cross-validation scores.
    """
    keys = [(i, int(h), lam) for i in range(len(labels)) for h in folds for lam in (penalties or [None])]
    pen = basis.penalty()
    p = len(pen)
    per_pass = max(1, GRAM_BYTES // (8 * (p * p + p + 2)))
    beta = np.zeros((len(keys), p))
    cov, lams, edfs = [None] * len(keys), np.zeros(len(keys)), np.zeros(len(keys))
    data = rows.select("x", "fold", "y")
    for lo in range(0, len(keys), per_pass):
        part = keys[lo:lo + per_pass]
        current = None
        for _ in range(1 if family == "gaussian" else max_steps):
            sums = data.mapInPandas(_grams(basis, family, part, current), "model int, salt int, sums array<double>")
            sums = sums.groupBy("model", "salt").applyInPandas(_add_up, "model int, sums array<double>")
            out = sums.groupBy("model").applyInPandas(
                _fit_sums(p, pen, [k[2] for k in part], family == "binomial", slack),
                "model int, beta array<double>, cov array<double>, lam double, edf double").collect()
            new = np.zeros((len(part), p))
            for r in out:
                new[r["model"]] = r["beta"]
                cov[lo + r["model"]] = np.array(r["cov"]).reshape(p, p)
                lams[lo + r["model"]], edfs[lo + r["model"]] = r["lam"], r["edf"]
            change = np.inf if current is None else np.max(np.abs(new - current)) / (1e-8 + np.max(np.abs(new)))
            current = new
            if change < tol:
                break
        beta[lo:lo + len(part)] = current
    return Models(list(labels), [int(h) for h in folds], basis, family, keys, beta, cov, lams, edfs)


def predict(rows: DataFrame, models: Models, out_of_fold: bool = False, se: bool = False) -> DataFrame:
    """(id, label, lam_index, eta, p[, se]); out of fold each row meets the model that never saw it."""
    basis, keys, beta, names = models.basis, models.keys, models.beta, models.labels
    cov = models.cov if se else None
    penalties = sorted({k[2] for k in keys if k[2] is not None})
    index = np.array([penalties.index(k[2]) if k[2] is not None else 0 for k in keys])
    binomial = models.family == "binomial"

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = basis.design(np.vstack(pdf["x"].to_numpy()).astype(float))
            fold = pdf["fold"].to_numpy()
            for m, (label, held, _) in enumerate(keys):
                use = np.nonzero(fold == held)[0] if out_of_fold else np.arange(len(x))
                if not len(use):
                    continue
                eta = x[use] @ beta[m]
                err = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", x[use], cov[m], x[use]))) if cov else np.nan
                p = 1 / (1 + np.exp(-np.clip(eta, -30, 30))) if binomial else eta
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[use], "label": names[label], "lam_index": index[m],
                                    "eta": eta, "p": p, "se": err})

    return rows.select("id", "x", "fold").mapInPandas(
        run, "id bigint, label string, lam_index int, eta double, p double, se double")


def responses(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(id, label, y, fold): the responses in long form, to meet predictions."""
    names = F.array(*[F.lit(n) for n in labels])
    return rows.select("id", "fold", F.explode(F.arrays_zip(names.alias("label"), F.col("y").alias("y"))).alias("e")).select(
        "id", "fold", "e.label", "e.y")


def out_of_fold(rows: DataFrame, labels: Sequence[str], basis: Basis, family: str = "binomial", k: int = 5,
                penalties: Sequence[float] | None = None) -> DataFrame:
    """(id, label, y, p): every row predicted by models that did not see its fold."""
    m = fit(rows, labels, basis, family, range(k), penalties)
    return answered(predict(rows, m, True), rows, labels).select("id", "label", "fold", "y", "p", "eta", "lam_index")


def answered(predicted: DataFrame, rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Predictions with their responses: as many rows on both sides, whose files look small enough to broadcast."""
    return predicted.join(responses(rows, labels).hint("merge"), ["id", "label"])


def _by_penalty(rows: DataFrame, models: Models) -> DataFrame:
    """(id, label, ps): out-of-fold probabilities of binomial models, one for each penalty in ascending order."""
    basis, names = models.basis, models.labels
    order = sorted(range(len(models.keys)), key=lambda m: models.keys[m][2])
    betas = {(label, held): [models.beta[m] for m in order if models.keys[m][:2] == (label, held)]
             for label in range(len(names)) for held in models.held}

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = basis.design(np.vstack(pdf["x"].to_numpy()).astype(float))
            fold = pdf["fold"].to_numpy()
            for (label, held), some in betas.items():
                use = np.nonzero(fold == held)[0]
                if len(use):
                    ps = np.stack([1 / (1 + np.exp(-np.clip(x[use] @ beta, -30, 30))) for beta in some], 1)
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[use], "label": names[label], "ps": list(ps)})

    return rows.select("id", "x", "fold").mapInPandas(run, "id bigint, label string, ps array<double>")


def ridge_logistic(rows: DataFrame, labels: Sequence[str], dims: int, k: int = 5, n_penalties: int = 12) -> tuple[DataFrame, dict]:
    """Out-of-fold ridge-logistic probabilities, the penalty chosen per label by held-out deviance."""
    from tessera.session import cut_lineage

    n = rows.count()
    grid = [n * v for v in np.logspace(-5, 0, n_penalties)]
    m = fit(rows, labels, Basis("linear", dims), "binomial", range(k), grid)
    scored = cut_lineage(answered(_by_penalty(rows, m), rows, labels))
    p = lambda i: F.least(F.greatest(F.col("ps")[i], F.lit(1e-12)), F.lit(1 - 1e-12))
    dev = [F.sum(-F.when(F.col("y") > 0, F.ln(p(i))).otherwise(F.ln(1 - p(i)))) for i in range(n_penalties)]
    table = scored.groupBy("label").agg(F.array(*dev).alias("dev")).collect()
    best = {r["label"]: min(range(n_penalties), key=lambda i: (math.isnan(r["dev"][i]), r["dev"][i], i)) for r in table}
    place = F.coalesce(*[F.when(F.col("label") == name, F.lit(i)) for name, i in best.items()], F.lit(None).cast("int"))
    return scored.select("label", "id", "fold", "y", F.col("ps")[place].alias("p")), {name: grid[i] for name, i in best.items()}


def stacked(rows: DataFrame, labels: Sequence[str], base_dims: int, k: int = 5, ridge: float = 1e-3) -> DataFrame:
    """(id, label, y, p_base, p_full): base model, fibre model, and their logit stack.

    `x` holds base coordinates first.  The stack is a second logistic model on
    the two out-of-fold logits with the same folds.
    """
    n = rows.count()
    dims = len(rows.select("x").first()["x"])
    side = lambda lo, hi: rows.withColumn("x", F.slice("x", lo + 1, hi - lo))
    base = out_of_fold(side(0, base_dims), labels, Basis("linear", base_dims), "binomial", k, [ridge * n])
    fibre = out_of_fold(side(base_dims, dims), labels, Basis("linear", dims - base_dims), "binomial", k, [ridge * n])
    joined = base.select("id", "label", "fold", "y", F.col("p").alias("p_base"), F.col("eta").alias("e1")).join(
        fibre.select("id", "label", F.col("p").alias("p_fibre"), F.col("eta").alias("e2")), ["id", "label"])
    from tessera.session import cut_lineage

    joined = cut_lineage(joined)
    # Labels have their own logits as inputs, so each contributes rows of its own.
    order = {name: i for i, name in enumerate(labels)}
    position = F.coalesce(*[F.when(F.col("label") == name, F.lit(i)) for name, i in order.items()])
    ys = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda i: F.when(i == position, F.col("y").cast("double")))
    long = joined.select("id", "label", "fold", F.array("e1", "e2").alias("x"), ys.alias("y"))
    m = fit(long, labels, Basis("linear", 2), "binomial", range(k), [1e-4 * n])
    stack = predict(long.select(F.xxhash64("id", "label").alias("id"), "x", "fold"), m, True).select(
        F.col("id").alias("key"), F.col("label").alias("label2"), F.col("p").alias("p_stack"))
    keyed = joined.withColumn("key", F.xxhash64("id", "label"))
    return keyed.join(stack, (keyed.key == stack.key) & (keyed.label == stack.label2)).select(
        "id", "label", "y", "p_base", "p_fibre", "p_stack")


def residuals(rows: DataFrame, columns: Sequence[str], basis: Basis, k: int = 5) -> DataFrame:
    """(id, label, e): response minus its out-of-fold smooth prediction."""
    return out_of_fold(rows, columns, basis, "gaussian", k).select("id", "label", "fold", (F.col("y") - F.col("p")).alias("e"))


def field(spark_rows: DataFrame, grid: DataFrame, labels: Sequence[str], k: int = 60, z: float = 1.959963984540054) -> DataFrame:
    """(label, gx, gy, p, p_lo, p_hi, z): smooth probability fields with pointwise bands.

    z is the standardised distance of the link from the label's overall logit.
    """
    basis = surface_basis(spark_rows, k)
    m = fit(spark_rows, labels, basis)
    pred = predict_points(grid, m)
    prev = responses(spark_rows, labels).groupBy("label").agg(F.avg("y").alias("prev"))
    base = F.ln(F.col("prev") / (1 - F.col("prev")))
    inv = lambda c: 1 / (1 + F.exp(-c))
    return pred.join(F.broadcast(prev), "label").select(
        "label", "gx", "gy", "p", inv(F.col("eta") - z * F.col("se")).alias("p_lo"), inv(F.col("eta") + z * F.col("se")).alias("p_hi"),
        F.when(F.col("se") > 0, (F.col("eta") - base) / F.col("se")).alias("z"))


def max_z_threshold(rows: DataFrame, labels: Sequence[str], grid: DataFrame, reps: int, k: int = 60, seed: int = 42,
                    level: float = 0.95) -> DataFrame:
    """(label, threshold): family-wise quantile of max |z| over a grid under shuffled rows.

    Every draw rearranges the label rows as a whole; the draws are extra
    responses of one joint fit, so all of them share its scans.
    """
    from tessera.operators.ordered import quantiles
    from tessera.operators.resample import permutation

    moves = permutation(rows.select("id"), reps, seed)
    sent = moves.join(rows.select(F.col("id").alias("source"), "y"), "source")
    drawn = sent.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rep", "y"))), lambda e: e["y"])).alias("ys"))
    both = rows.select("id", "x", "fold").join(drawn, "id").select("id", "x", "fold", F.col("ys").alias("y"))
    from tessera.session import cut_lineage

    both = cut_lineage(both)
    names = [f"{r}|{c}" for r in range(reps) for c in labels]
    m = fit(both, names, surface_basis(rows, k), max_steps=6)
    pred = predict_points(grid, m)
    prev = responses(rows, labels).groupBy("label").agg(F.avg("y").alias("prev")).select(
        F.col("label").alias("name"), F.ln(F.col("prev") / (1 - F.col("prev"))).alias("base"))
    parts = F.split("label", "[|]")
    pred = pred.select(parts[0].alias("rep"), parts[1].alias("name"), "eta", "se").join(F.broadcast(prev), "name")
    top = pred.where("se > 0").groupBy("name", "rep").agg(F.max(F.abs(F.col("eta") - F.col("base")) / F.col("se")).alias("top"))
    return quantiles(cut_lineage(top), "top", {"threshold": level}, ["name"]).select(F.col("name").alias("label"), "threshold")


def predict_points(points: DataFrame, models: Models) -> DataFrame:
    """Predictions that keep the coordinates they belong to."""
    basis, keys, beta, names, cov = models.basis, models.keys, models.beta, models.labels, models.cov

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = basis.design(pdf[["gx", "gy"]].to_numpy(dtype=float))
            for m, (label, _, _) in enumerate(keys):
                eta = x @ beta[m]
                err = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", x, cov[m], x)))
                yield pd.DataFrame({"label": names[label], "gx": pdf["gx"], "gy": pdf["gy"], "eta": eta,
                                    "p": 1 / (1 + np.exp(-np.clip(eta, -30, 30))), "se": err})

    return points.select("gx", "gy").mapInPandas(
        run, "label string, gx double, gy double, eta double, p double, se double")


def r2_two(df: DataFrame, y: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, r2) of y on two regressors, from three correlations."""
    c = df.groupBy(*by).agg(F.corr(y, a).alias("ra"), F.corr(y, b).alias("rb"), F.corr(a, b).alias("rab"))
    num = F.col("ra") ** 2 + F.col("rb") ** 2 - 2 * F.col("ra") * F.col("rb") * F.col("rab")
    return c.select(*by, F.when(F.abs("rab") < 1, num / (1 - F.col("rab") ** 2)).alias("r2"))


def ols_out_of_fold(df: DataFrame, y: str = "y", x: str = "x", fold: str = "fold", id_col: str = "id") -> DataFrame:
    """(id, residual) of a one-regressor fit on the other folds, from sums per fold."""
    v = df.select(id_col, F.col(fold).alias("fold"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    sums = dict(n=F.lit(1.0), sx=F.col("x"), sy=F.col("y"), sxx=F.col("x") * F.col("x"), sxy=F.col("x") * F.col("y"))
    per = v.groupBy("fold").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    tot = per.agg(*[F.sum(k).alias(k) for k in sums])
    rest = per.select("fold", *[(tot.select(k).scalar() - F.col(k)).alias(k) for k in sums])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    line = rest.withColumn("slope", slope).withColumn("icept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    # One row per fold.
    return v.join(F.broadcast(line.select("fold", "slope", "icept")), "fold").select(
        id_col, (F.col("y") - F.col("icept") - F.col("slope") * F.col("x")).alias("residual"))


def item_roles(t: DataFrame, alpha: float = 0.05, base_r2: float = 0.08, fibre_r2: float = 0.05) -> DataFrame:
    """Roles from (item, r2_base, q_base, r2_fibre, q_fibre).

    Effect sizes decide, unless they find no base-aligned item at all; then the
    FDR roles do.
    """
    role = lambda b, f: F.when(b & f, "mixed").when(b, "base-aligned").when(f, "fibre-structured").otherwise("weak")
    yes = lambda c: F.coalesce(c, F.lit(False))
    fdr = role(yes(F.col("q_base") < alpha), yes(F.col("q_fibre") < alpha))
    es = role(yes(F.col("r2_base") >= base_r2), yes(F.col("r2_fibre") >= fibre_r2))
    t = t.withColumn("role_fdr", fdr).withColumn("role_es", es)
    found = t.agg(F.max((F.col("role_es") == "base-aligned").cast("int"))).scalar()
    return t.withColumn("role_final", F.when(found == 1, F.col("role_es")).otherwise(F.col("role_fdr")))
