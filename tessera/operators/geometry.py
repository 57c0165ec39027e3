"""Points against fixed polygons, hulls, grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import col


def inside_polygon(x, y, polygon: Sequence[tuple[float, float]], eps: float = 1e-9) -> Column:
    """Ray casting with the boundary inside, as one expression over the vertices."""
    x, y = col(x), col(y)
    on_edge, crossings = F.lit(False), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        cross = F.lit(x2 - x1) * (y - F.lit(y1)) - F.lit(y2 - y1) * (x - F.lit(x1))
        within = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        on_edge = on_edge | ((F.abs(cross) <= eps) & within)
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (
                x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
            crossings = crossings + hit.cast("int")
    return on_edge | (crossings % 2 == 1)


def _turn(pts: np.ndarray) -> np.ndarray:
    """Monotone-chain hull of a few points."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (
                out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hull(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """(by, pos, x, y): hull vertices, counter-clockwise.

    Every task reduces its batches to their own hulls, then salted groups reduce
    again; the hull of hulls is the hull of all.
    """
    key = F.lit(0).cast("bigint") if by is None else F.col(by).cast("bigint")
    pts = df.select(key.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _turn(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"g": pdf["g"].iloc[0], "pos": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    def batches(it):
        for pdf in it:
            for _, part in pdf.groupby("g"):
                yield shrink(part)

    schema = "g bigint, pos bigint, x double, y double"
    local = pts.mapInPandas(batches, schema).drop("pos")
    salted = local.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    middle = salted.groupBy("g", "salt").applyInPandas(lambda p: shrink(p), schema).drop("pos")
    out = middle.groupBy("g").applyInPandas(shrink, schema)
    return out if by is None else out.withColumnRenamed("g", by)


def grid(spark, x: tuple[float, float], y: tuple[float, float], nx: int, ny: int, pad: float = 0.0) -> DataFrame:
    """(ix, iy, gx, gy): a regular lattice, generated in parallel from one range."""
    px, py = (x[1] - x[0]) * pad, (y[1] - y[0]) * pad
    x0, y0 = x[0] - px, y[0] - py
    sx, sy = (x[1] - x[0] + 2 * px) / max(1, nx - 1), (y[1] - y[0] + 2 * py) / max(1, ny - 1)
    ids = spark.range(nx * ny)
    ix, iy = (F.col("id") % nx), F.floor(F.col("id") / nx)
    return ids.select(ix.alias("ix"), iy.alias("iy"), (F.lit(x0) + ix * F.lit(sx)).alias("gx"), (F.lit(y0) + iy * F.lit(sy)).alias("gy"))
