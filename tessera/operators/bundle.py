"""Local frames over a base lattice: ranks, connection, curvature, energy.

The lattice is fixed in size; what grows is the table of points, which meets it
through neighbour joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.neighbours import _matrix, knn
from tessera.session import cut_lineage


def noise_rank(x: np.ndarray, cap: int = 4, shrink: float = 0.9) -> int:
    """How many principal variances stand out of noise, at most `cap`.

    Pure noise of variance s spreads its sample variances up to s (1 + sqrt(p / n))^2
    (Marchenko and Pastur), n counting degrees of freedom.  s is read off the lower
    half of the spectrum, which signals leave alone; `shrink` lowers the edge.
    """
    rows, columns = x.shape
    if rows < 5 or columns < 2:
        return 0
    centred = x - x.mean(0)
    freedom = rows - 1
    gram = centred @ centred.T if rows < columns else centred.T @ centred
    spectrum = np.clip(np.linalg.eigvalsh(gram / freedom), 0, None)  # ascending
    noise = next((m for m in (np.median(spectrum[: len(spectrum) // 2 + 1]), np.median(spectrum)) if m > 1e-12 * spectrum[-1]), 0.0)
    above = np.searchsorted(spectrum, shrink * noise * (1 + np.sqrt(columns / freedom)) ** 2, "right")
    return min(cap, len(spectrum) - int(above))


def frames(points: DataFrame, lattice: DataFrame, k: int = 40, cap: int = 4, min_n: int = 15) -> DataFrame:
    """(node, ix, iy, gx, gy, rank, mu, q): local principal frame at each lattice node.

    `points` is (id, base, x).  `q` holds `cap` axes of length p, one after the
    other; nested axes serve any common rank.
    """
    nodes = cut_lineage(lattice.select((F.col("iy") * 1000000 + F.col("ix")).alias("node"), "ix", "iy", "gx", "gy"))
    near = knn(points.select("id", F.col("base").alias("vec")), k, queries=nodes.select(F.col("node").alias("id"), F.array("gx", "gy").alias("vec")))
    rows = near.join(points.select(F.col("id").alias("j"), "x"), "j").select(F.col("i").alias("node"), "j", "x")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("j")["x"])
        if len(x) < min_n:
            return pd.DataFrame(columns=["node", "rank", "mu", "q"])
        mu = x.mean(0)
        _, _, vt = np.linalg.svd(x - mu, full_matrices=False)
        q = np.zeros((cap, x.shape[1]))
        q[: min(cap, len(vt))] = vt[:cap]
        q *= np.where(q[np.arange(cap), np.abs(q).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "rank": [noise_rank(x, cap)], "mu": [mu], "q": [q.ravel()]})

    # At most k rows per node.
    found = rows.groupBy("node").applyInPandas(local, "node bigint, rank int, mu array<double>, q array<double>")
    return cut_lineage(nodes.join(found, "node"))


def common_rank(framed: DataFrame, cap: int = 4) -> int:
    row = framed.where("rank > 0").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rank").first()
    return max(1, min(cap, row["rank"])) if row else 1


def _rotation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(a.T @ b)
    if np.linalg.det(u @ vt) < 0:
        u[:, -1] = -u[:, -1]
    return u @ vt, np.clip(s, -1, 1)


def _log_norm(r: np.ndarray) -> float:
    """Frobenius norm of the logarithm of a rotation, from its eigenvalue angles."""
    return float(np.sqrt((np.angle(np.linalg.eigvals(r)) ** 2).sum()))


def connection(framed: DataFrame, k: int) -> DataFrame:
    """(src, dst, theta_rms, unlike, angle_like, fro_log, rot) for lattice edges; unlike: one less the mean cosine."""
    width = len(framed.first()["mu"])
    a = framed.select(F.col("node").alias("src"), "ix", "iy", F.col("q").alias("qa"))
    step = lambda dx, dy: framed.select(F.col("node").alias("dst"), (F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.col("q").alias("qb"))
    pairs = a.join(step(1, 0), ["ix", "iy"]).unionByName(a.join(step(0, 1), ["ix", "iy"]))

    def edge(batches):
        for pdf in batches:
            out = []
            for s, t, qa, qb in zip(pdf["src"], pdf["dst"], pdf["qa"], pdf["qb"]):
                r, sv = _rotation(np.asarray(qa).reshape(-1, width)[:k].T, np.asarray(qb).reshape(-1, width)[:k].T)
                norm = _log_norm(r)
                out.append((s, t, float(np.sqrt((np.arccos(sv) ** 2).mean())), float(1 - sv.mean()), norm / np.sqrt(2), norm, r.ravel()))
            yield pd.DataFrame(out, columns=["src", "dst", "theta_rms", "unlike", "angle_like", "fro_log", "rot"])

    return cut_lineage(pairs.mapInPandas(edge, "src bigint, dst bigint, theta_rms double, unlike double, angle_like double, fro_log double, rot array<double>"))


def _frames_of(column, width: int, k: int) -> list[np.ndarray]:
    return [np.asarray(q, dtype=float).reshape(-1, width)[:k].T for q in column]


def along_tree(framed: DataFrame, k: int) -> DataFrame:
    """Frames turned, inside their own span, to follow each other along a spanning tree: a common gauge.

    The tree takes the lattice edges whose frames are most alike; in each of its
    parts the node nearest the middle keeps its frame.  The turn of a node is the
    product of the turns on its path, found by doubling: after each round a node
    knows the product up to an ancestor twice as far away.
    """
    width = len(framed.first()["mu"])
    edges = connection(framed, k)
    tree = cut_lineage(G.spanning_tree(edges.select("src", "dst", F.col("unlike").alias("d"))))
    middle = framed.agg(F.expr("percentile(gx, 0.5)"), F.expr("percentile(gy, 0.5)")).first()
    off = (F.col("gx") - F.lit(middle[0])) ** 2 + (F.col("gy") - F.lit(middle[1])) ** 2
    parts = G.components(tree)
    roots = framed.join(parts, framed["node"] == parts["id"]).groupBy("component").agg(
        F.min_by("node", F.struct(off, "node")).alias("id")).select("id")
    levels = cut_lineage(G.tree_levels(tree, roots))
    deepest = levels.agg(F.max("level")).first()[0] or 0

    def steps(batches):
        for pdf in batches:
            turn = [_rotation(c, p)[0].ravel() for c, p in zip(_frames_of(pdf["q"], width, k), _frames_of(pdf["qp"], width, k))]
            yield pd.DataFrame({"node": pdf["id"], "up": pdf["parent"], "turn": turn})

    frame = framed.select("node", "q")
    above = levels.where("level > 0").join(frame.withColumnRenamed("node", "id"), "id").join(
        frame.select(F.col("node").alias("parent"), F.col("q").alias("qp")), "parent")
    path = cut_lineage(above.select("id", "parent", "q", "qp").mapInPandas(steps, "node bigint, up bigint, turn array<double>"))

    def joined(batches):
        for pdf in batches:
            turn = [t if u is None else (np.reshape(t, (k, k)) @ np.reshape(u, (k, k))).ravel() for t, u in zip(pdf["turn"], pdf["next"])]
            yield pd.DataFrame({"node": pdf["node"], "up": pdf["up"], "turn": turn})

    for _ in range(int(deepest).bit_length()):
        ahead = path.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("turn").alias("next"))
        both = path.join(ahead, "up", "left").select("node", F.coalesce("far", "up").alias("up"), "turn", "next")
        path = cut_lineage(both.mapInPandas(joined, path.schema))

    def turned(batches):
        for pdf in batches:
            own = [(f if t is None else f @ np.reshape(t, (k, k))).T.ravel() for f, t in zip(_frames_of(pdf["q"], width, k), pdf["turn"])]
            yield pdf.drop(columns="turn").assign(q=own)

    return cut_lineage(framed.join(path.select("node", "turn"), "node", "left").select(*framed.columns, "turn").mapInPandas(turned, framed.schema))


def node_angles(edges: DataFrame, framed: DataFrame) -> DataFrame:
    """(node, gx, gy, theta): mean principal angle of the edges at a node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "theta_rms")
    return framed.select("node", "gx", "gy").join(ends.groupBy("node").agg(F.avg("theta_rms").alias("theta")), "node", "left")


def curvature(edges: DataFrame, framed: DataFrame, k: int) -> DataFrame:
    """(gx, gy, curv): norm of the rotation picked up around each lattice cell."""
    xy = framed.select("node", "ix", "iy", "gx", "gy")
    named = edges.select("src", "dst", "rot").join(xy.select(F.col("node").alias("src"), "ix", "iy", "gx", "gy"), "src").join(
        xy.select(F.col("node").alias("dst"), F.col("ix").alias("jx"), F.col("gx").alias("hx"), F.col("gy").alias("hy")), "dst")
    right = named.where("jx > ix").select("ix", "iy", F.col("rot").alias("low"), "gx", "gy", "hx")
    up = named.where("jx = ix").select("ix", "iy", F.col("rot").alias("left"), F.col("hy").alias("top"))
    cells = right.join(up, ["ix", "iy"]).join(
        named.where("jx > ix").select("ix", (F.col("iy") - 1).alias("iy"), F.col("rot").alias("high")), ["ix", "iy"]).join(
        named.where("jx = ix").select((F.col("ix") - 1).alias("ix"), "iy", F.col("rot").alias("right")), ["ix", "iy"])

    def holonomy(batches):
        for pdf in batches:
            mat = lambda v: np.asarray(v, dtype=float).reshape(k, k)
            norm = [_log_norm(mat(lo) @ mat(r) @ mat(h).T @ mat(le).T) for lo, r, h, le in zip(pdf["low"], pdf["right"], pdf["high"], pdf["left"])]
            yield pd.DataFrame({"gx": (pdf["gx"] + pdf["hx"]) / 2, "gy": (pdf["gy"] + pdf["top"]) / 2, "curv": np.array(norm, dtype=float)})

    return cells.mapInPandas(holonomy, "gx double, gy double, curv double")


def fibre_energy(points: DataFrame, framed: DataFrame, k: int) -> DataFrame:
    """(id, energy): squared length of the projection on the frame of the nearest node."""
    near = knn(framed.select(F.col("node").alias("id"), F.array("gx", "gy").alias("vec")), 1, queries=points.select("id", F.col("base").alias("vec")))
    width = len(framed.first()["mu"])
    rows = near.select(F.col("i").alias("id"), F.col("j").alias("node")).join(points.select("id", "x"), "id").join(framed.select("node", "mu", "q"), "node")

    def energy(batches):
        for pdf in batches:
            if len(pdf):
                gap = _matrix(pdf["x"]) - _matrix(pdf["mu"])
                q = _matrix(pdf["q"]).reshape(len(pdf), -1, width)[:, :k]
                z = np.einsum("np,nkp->nk", gap, q)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "energy": (z * z).sum(1)})

    return rows.mapInPandas(energy, "id bigint, energy double")


def composite_risk(parts: DataFrame) -> DataFrame:
    """(id, risk): sum of robust z scores of energy, theta and inverse density, rescaled to [0, 1].

    `parts` is (id, energy, theta, dinv).
    """
    from tessera.operators.ordered import quantiles

    t = cut_lineage(parts)
    cols = []
    for c in ("energy", "theta", "dinv"):
        med = quantiles(t, c, {"m": 0.5}).first()["m"]
        dev = t.select(F.abs(F.col(c) - F.lit(med)).alias("d"))
        mad = 1.4826 * quantiles(dev, "d", {"m": 0.5}).first()["m"]
        z = F.least(F.greatest((F.col(c) - F.lit(med)) / F.lit(mad), F.lit(-6.0)), F.lit(6.0)) if mad > 0 else F.lit(0.0)
        cols.append(F.coalesce(z, F.lit(0.0)).alias(f"z_{c}"))
    z = t.select("id", *cols).withColumn("s", F.col("z_energy") + F.col("z_theta") + F.col("z_dinv"))
    lo, hi = z.agg(F.min("s")).scalar(), z.agg(F.max("s")).scalar()
    return z.withColumn("risk", F.when(hi > lo, (F.col("s") - lo) / (hi - lo)).otherwise(0.0)).drop("s")
