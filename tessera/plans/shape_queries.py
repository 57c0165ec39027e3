"""Curves, manifolds, encodings and local frames of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import r6
from tessera.operators import bundle as B
from tessera.operators import curves as Cu
from tessera.operators import encoding as E
from tessera.operators import linalg as LA
from tessera.operators import neighbours as N
from tessera.operators.geometry import grid
from tessera.plans.registry import query
from tessera.plans.stand_ins import embedded
from tessera.session import cut_lineage
from tessera.sources.tables import table


def _three(spark, root):
    e = embedded(spark, root)
    mean, axes, _ = LA.principal_axes(e, 3)
    return cut_lineage(LA.project(e, mean, axes).select("id", F.col("score").alias("vec")))


@query("j31_principal_curve")
def principal_curve(spark, root):
    return Cu.principal_curve(_three(spark, root), rounds=4).select("id", r6("t").alias("t"), r6("d2").alias("d2"))


@query("e7_rolling_normal")
def rolling_normal(spark, root):
    return Cu.rolling_normal(Cu.principal_curve(_three(spark, root), rounds=2))


@query("j34_local_regression", """
WITH e AS (SELECT embedding[1]::DOUBLE AS t, embedding[2]::DOUBLE AS u, embedding[3]::DOUBLE AS v FROM embeddings),
k AS (SELECT min(t) AS lo, max(t) AS hi, floor(0.2::DOUBLE * count(*) + 0.00001::DOUBLE)::BIGINT AS q FROM e),
g AS (SELECT i AS node, lo + i * (hi - lo) / 39 AS x, q FROM k, range(40) r(i)),
d AS (SELECT node, x, q, t - x AS gap, u, v, row_number() OVER (PARTITION BY node ORDER BY abs(t - x)) AS r FROM g, e),
h AS (SELECT node, max(abs(gap)) AS h FROM d WHERE r <= q GROUP BY node),
w AS (SELECT node, x, gap / h AS z, pow(1 - pow(abs(gap / h), 3), 3) AS w, u, v FROM d JOIN h USING (node) WHERE abs(gap) < h),
m AS (SELECT node, x, sum(w) AS s0, sum(w*z) AS s1, sum(w*z*z) AS s2, sum(w*z*z*z) AS s3, sum(w*z*z*z*z) AS s4,
  sum(w*u) AS u0, sum(w*z*u) AS u1, sum(w*z*z*u) AS u2, sum(w*v) AS v0, sum(w*z*v) AS v1, sum(w*z*z*v) AS v2 FROM w GROUP BY 1, 2),
c AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2) AS det FROM m)
SELECT node, round(x, 6) + 0.0 AS t, round((u0*(s2*s4 - s3*s3) - s1*(u1*s4 - s3*u2) + s2*(u1*s3 - s2*u2)) / det, 6) + 0.0 AS u,
  round((v0*(s2*s4 - s3*s3) - s1*(v1*s4 - s3*v2) + s2*(v1*s3 - s2*v2)) / det, 6) + 0.0 AS v FROM c""")
def local_regression(spark, root):
    """Two coordinates smoothed along the first, at 40 nodes over its range."""
    e = table(spark, root, "embeddings", "embedding").select(*[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("tuv")])
    lo, hi = e.agg(F.min("t"), F.max("t")).first()
    nodes = [lo + i * (hi - lo) / 39 for i in range(40)]
    return Cu.local_regression(e, nodes, ["u", "v"]).select("node", *[r6(c).alias(c) for c in "tuv"])


@query("j33_manifold_sweep")
def manifold_sweep(spark, root):
    e = embedded(spark, root)
    rows = []
    for nd in (3, 4):
        r = Cu.manifold_r2(e.select("id", F.slice("vec", 1, nd).alias("vec")), nd - 1)
        rows.append((nd, r["m"], r["r2_cv"], r["r2_linear"], r["delta_r2"]))
    return spark.createDataFrame(rows, "ndim int, m int, r2_cv double, r2_linear double, delta_r2 double")


@query("j33_surface_gradient")
def surface_gradient(spark, root):
    return Cu.surface_shape(_three(spark, root), grid(spark, (-0.3, 0.3), (-0.3, 0.3), 30, 30))[0]


@query("j33_surface_curvature")
def surface_curvature(spark, root):
    return Cu.surface_shape(_three(spark, root), grid(spark, (-0.3, 0.3), (-0.3, 0.3), 30, 30))[1]


@query("i19_mixed_factors")
def mixed_factors(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    f, keep = E.mixed_factors(p, "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return f.select("id", F.lit(keep).alias("kept"), F.slice("vec", 1, 2).alias("v")).select(
        "id", "kept", r6(F.col("v")[0]).alias("f1"), r6(F.col("v")[1]).alias("f2"))


@query("b15_design", """
WITH t AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_type FROM part), l AS (SELECT DISTINCT p_type FROM part)
SELECT id, 'p_size' AS col, p_size AS value FROM t UNION ALL
SELECT id, 'p_type=' || l.p_type, (t.p_type = l.p_type)::INT::DOUBLE FROM t, l""")
def design(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_type")
    d, names = E.design(p, "p_partkey", ["p_size"], ["p_type"])
    cols = F.array(*[F.lit(c) for _, c in names])
    return d.select("id", F.explode(F.arrays_zip(cols.alias("col"), F.col("vec").alias("value"))).alias("e")).select("id", "e.col", "e.value")


@query("b14_correlation_trim", """
WITH c AS (SELECT corr(o_totalprice, o_totalprice * 2 + o_custkey * 0.001) AS r FROM orders) SELECT 'doubled' AS dropped FROM c WHERE abs(r) >= 0.95""")
def correlation_trim(spark, root):
    o = table(spark, root, "orders", "o_totalprice", "o_custkey").select(
        F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"),
        (F.col("o_totalprice") * 2 + F.col("o_custkey") * 0.001).alias("doubled"))
    return spark.createDataFrame([(c,) for c in E.correlated_to_drop(o, ["price", "cust", "doubled"])], "dropped string")


def _framed(spark, root):
    e = embedded(spark, root)
    mean, axes, _ = LA.principal_axes(e, 2)
    pts = cut_lineage(LA.project(e, mean, axes).select("id", F.col("score").alias("base"), F.col("vec").alias("x")))
    framed = B.frames(pts, grid(spark, (-0.25, 0.25), (-0.25, 0.25), 12, 12))
    k = B.common_rank(framed)
    return pts, framed, k


@query("i44_local_frames")
def local_frames(spark, root):
    return _framed(spark, root)[1].select("node", "gx", "gy", "rank")


@query("i46_connection")
def connection(spark, root):
    _, framed, k = _framed(spark, root)
    return B.connection(B.along_tree(framed, k), k).select("src", "dst", "theta_rms", "angle_like", "fro_log")


@query("i46_curvature")
def curvature(spark, root):
    _, framed, k = _framed(spark, root)
    return B.curvature(B.connection(framed, k), framed, k)


@query("i47_fibre_risk")
def fibre_risk(spark, root):
    """Fibre energy, principal angle and inverse density in one robust score."""
    pts, framed, k = _framed(spark, root)
    theta = B.node_angles(B.connection(framed, k), framed)
    near = N.knn(framed.select(F.col("node").alias("id"), F.array("gx", "gy").alias("vec")), 1, queries=pts.select("id", F.col("base").alias("vec")))
    angle = near.select(F.col("i").alias("id"), F.col("j").alias("node")).join(theta.select("node", "theta"), "node").select("id", "theta")
    dens = N.knn(pts.select("id", F.col("base").alias("vec")), 10).groupBy(F.col("i").alias("id")).agg((F.max("d") ** 2).alias("dinv"))
    return B.composite_risk(B.fibre_energy(pts, framed, k).join(angle, "id").join(dens, "id"))
