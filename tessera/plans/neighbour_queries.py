"""Distances, neighbour graphs and what is measured on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import fold_of, r6
from tessera.operators import encoding as E
from tessera.operators import graph as G
from tessera.operators import intrinsic as I
from tessera.operators import labels as L
from tessera.operators import metrics as M
from tessera.operators import neighbours as N
from tessera.operators import ordered as O
from tessera.plans import registry as R
from tessera.plans.registry import query
from tessera.plans.stand_ins import embedded, order_labels
from tessera.session import cut_lineage
from tessera.sources.tables import table


def label_names(spark, root, label="p_type") -> list[str]:
    """The label vocabulary, which is the column list of the wide matrix."""
    part = table(spark, root, "part", label)
    E.check_levels(part, [label])
    rows = part.distinct().orderBy(label).collect()
    return [r[0] for r in rows]


def order_profiles(spark, root, label="p_type"):
    """(profiles checkpointed, points, metric)."""
    pr = cut_lineage(L.profiles(order_labels(spark, root, label), "id"))
    pts, metric = E.label_points(pr, label_names(spark, root, label))
    return pr, pts, metric


def profile_nn(spark, root, k, label="p_type"):
    pr, pts, metric = order_profiles(spark, root, label)
    return pr, N.knn(pts, k, metric)


_PT = """pt AS (SELECT p_partkey AS id, p_size::DOUBLE / (SELECT max(p_size) - min(p_size) FROM part) AS x,
  p_retailprice / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS y, p_brand AS b, p_type AS t FROM part)"""


def gower_sql(w):
    tot = sum(w)
    return f"""WITH {_PT}, nn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 11), j) AS rank FROM (
    SELECT u.id AS i, v.id AS j, ({w[0]}::DOUBLE * abs(u.x - v.x) + {w[1]}::DOUBLE * abs(u.y - v.y) + {w[2]}::DOUBLE * (u.b <> v.b)::INT + {w[3]}::DOUBLE * (u.t <> v.t)::INT) / {tot}::DOUBLE AS d
    FROM pt u JOIN pt v ON u.id <> v.id) z QUALIFY rank <= 5)
    SELECT i, rank::BIGINT AS rank, j, round(d, 6) AS d FROM nn"""


def _gower(spark, root, weights=None):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    pts, metric = E.gower_points(p, "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"], weights)
    return N.knn(pts, 5, metric).select("i", F.col("rank").cast("bigint").alias("rank"), "j", r6("d").alias("d"))


@query("i1_gower_neighbours", gower_sql([1.0, 1.0, 1.0, 1.0]))
def gower(spark, root):
    return _gower(spark, root)


@query("i2_weighted_gower_neighbours", gower_sql([1.0, 0.5, 0.25, 0.75]))
def weighted_gower(spark, root):
    return _gower(spark, root, {"p_size": 1.0, "p_retailprice": 0.5, "p_brand": 0.25, "p_type": 0.75})


@query("b12_gower_rare_levels", """
WITH lv AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(*) FROM part)),
pt AS (SELECT p_partkey AS id, p_size::DOUBLE / (SELECT max(p_size) - min(p_size) FROM part) AS x, lv.p_brand AS b FROM part LEFT JOIN lv USING (p_brand)),
nn AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 11), j) AS rank FROM (
  SELECT u.id AS i, v.id AS j, CASE WHEN u.b IS NULL OR v.b IS NULL THEN abs(u.x - v.x) ELSE (abs(u.x - v.x) + (u.b <> v.b)::INT) / 2.0::DOUBLE END AS d
  FROM pt u JOIN pt v ON u.id <> v.id) z QUALIFY rank <= 5)
SELECT i, rank::BIGINT AS rank, j, round(d, 6) AS d FROM nn""")
def gower_rare_levels(spark, root):
    """Rare levels become missing and leave the mean of the pairs they are in; all rows stay."""
    p = E.rare_levels_to_null(table(spark, root, "part", "p_partkey", "p_size", "p_brand"), "p_brand", 0.04)
    pts, metric = E.gower_points(p, "p_partkey", ["p_size"], ["p_brand"])
    return N.knn(pts, 5, metric).select("i", F.col("rank").cast("bigint").alias("rank"), "j", r6("d").alias("d"))


@query("i3_jaccard_neighbours", f"WITH {R.jaccard_nn(5)} SELECT i, rank::BIGINT AS rank, j, round(d, 6) AS d FROM nn")
def jaccard(spark, root):
    _, nn = profile_nn(spark, root, 5)
    return nn.select("i", F.col("rank").cast("bigint").alias("rank"), "j", r6("d").alias("d"))


@query("e1_embedding_neighbours", f"WITH {R.embedded_nn(10)} SELECT i, rank::BIGINT AS rank, j, round(d, 6) AS d FROM nn")
def embedding_neighbours(spark, root):
    return N.knn(embedded(spark, root), 10).select("i", F.col("rank").cast("bigint").alias("rank"), "j", r6("d").alias("d"))


@query("c8_knn_join", """
WITH c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier),
d AS (SELECT c.id AS i, s.id AS j, sqrt((c.x-s.x)*(c.x-s.x) + (c.y-s.y)*(c.y-s.y)) AS d FROM c, s)
SELECT i, row_number() OVER (PARTITION BY i ORDER BY round(d, 11), j)::BIGINT AS rank, j, round(d, 6) AS d FROM d QUALIFY rank <= 3""")
def knn_join(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("vec"))
    s = table(spark, root, "supplier", "s_suppkey", "s_acctbal", "s_nationkey").select(
        F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("vec"))
    return N.knn(s, 3, queries=c).select("i", F.col("rank").cast("bigint").alias("rank"), "j", r6("d").alias("d"))


@query("i7_first_distance", f"WITH {R.embedded_nn(1)} SELECT i, round(d, 6) AS d1 FROM nn")
def first_distance(spark, root):
    return N.knn(embedded(spark, root), 1).select("i", r6("d").alias("d1"))


@query("i7_group_medoids", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cluster FROM embeddings),
s AS (SELECT a.cluster, a.id, round(sum(list_distance(a.v, b.v)), 8) AS s FROM e a JOIN e b USING (cluster) GROUP BY 1, 2)
SELECT cluster, min(id) FILTER (WHERE r = 1) AS medoid, count(*) AS mult FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s, id) AS r FROM s) GROUP BY 1""")
def group_medoids(spark, root):
    s = N.cluster_distances(embedded(spark, root)).where("cluster = other")
    return s.groupBy("cluster").agg(F.min_by("id", F.struct(F.round("s", 8), "id")).alias("medoid"), F.count(F.lit(1)).alias("mult"))


def _edges(df):
    return df.select("src", "dst", r6("w").alias("w"))


@query("i8_knn_selftuned", f"WITH {R.embedded_nn(10)}, {R.graph('union', 1.0)} SELECT src, dst, round(w, 6) AS w FROM ed")
def knn_selftuned(spark, root):
    return _edges(G.knn_graph(N.knn(embedded(spark, root), 10), "union", 1.0))


@query("i9_knn_union", f"WITH {R.jaccard_nn(9)}, {R.graph('union', 2.0, True)} SELECT src, dst, round(w, 6) AS w FROM ed")
def knn_union(spark, root):
    return _edges(profile_graph(spark, root, 9, "union"))


@query("i9_knn_mutual", f"WITH {R.jaccard_nn(9)}, {R.graph('mutual', 2.0, True)} SELECT src, dst, round(w, 6) AS w FROM ed")
def knn_mutual(spark, root):
    return _edges(profile_graph(spark, root, 9, "mutual"))


def profile_graph(spark, root, k, mode):
    pr, nn = profile_nn(spark, root, k)
    return G.knn_graph(nn, mode, 2.0, pr.select(F.col("first_id").alias("id"), "mult"))


@query("i10_base_graph", f"WITH {R.embedded_nn(15)}, {R.graph('union', 2.0, floor='1e-10')} SELECT src, dst, round(w, 6) AS w FROM ed")
def base_graph(spark, root):
    return _edges(G.knn_graph(N.knn(embedded(spark, root), 15), "union", 2.0, floor=1e-10))


@query("i11_unweighted", f"WITH {R.embedded_nn(15)} SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM nn")
def unweighted(spark, root):
    return G.knn_graph(N.knn(embedded(spark, root), 15), weighted=False).select("src", "dst")


_EG = f"{R.embedded_nn(10)}, {R.graph('union', 2.0)}"
_EGM = f"{R.embedded_nn(10)}, {R.graph('mutual', 2.0)}"


def embedded_graph(spark, root, mode="union", k=10):
    return cut_lineage(G.knn_graph(N.knn(embedded(spark, root), k), mode, 2.0))


@query("i43_spanning_tree", f"""WITH RECURSIVE {R.embedded_nn(10)}, {R.graph('union', 2.0)},
v AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT src AS id FROM ed UNION SELECT dst FROM ed)),
e2 AS (SELECT row_number() OVER (ORDER BY d, src, dst) AS step, src, dst, d, a.pos AS pa, b.pos AS pb FROM ed JOIN v a ON a.id = src JOIN v b ON b.id = dst),
f AS (SELECT 0::BIGINT AS step, (SELECT list(pos ORDER BY pos) FROM v) AS l, false AS took
    UNION ALL SELECT e2.step, CASE WHEN l[pa] = l[pb] THEN l ELSE list_transform(l, lambda x: CASE WHEN x = l[pb] THEN l[pa] ELSE x END) END, l[pa] <> l[pb]
    FROM f JOIN e2 ON e2.step = f.step + 1)
SELECT src, dst, round(d, 6) AS d FROM f JOIN e2 USING (step) WHERE took""")
def spanning_tree(spark, root):
    return G.spanning_tree(embedded_graph(spark, root)).select("src", "dst", r6("d").alias("d"))


@query("i12_graph_report", f"""
WITH RECURSIVE {_EGM}, bi AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed),
walk AS (SELECT id, id AS root FROM e UNION SELECT dst, root FROM walk JOIN bi ON bi.src = walk.id),
comp AS (SELECT id, min(root) AS c FROM walk GROUP BY id), sz AS (SELECT c, count(*) AS n FROM comp GROUP BY c)
SELECT (SELECT count(*) FROM e) AS v, (SELECT count(*) FROM ed) AS e, count(*) AS components, max(n) AS largest,
  (SELECT count(*) FROM e WHERE id NOT IN (SELECT src FROM bi)) AS isolates FROM sz""")
def graph_report(spark, root):
    return G.graph_report(embedded_graph(spark, root, "mutual"), embedded(spark, root))


@query("i14_degrees", f"""
WITH {_EG}, bi AS (SELECT src AS id, w FROM ed UNION ALL SELECT dst, w FROM ed)
SELECT id, round(sum(w), 6) AS strength, count(*) AS degree FROM bi GROUP BY id""")
def degrees(spark, root):
    return G.degrees(embedded_graph(spark, root)).select("id", r6("strength").alias("strength"), "degree")


@query("i21_twonn", f"""
WITH {R.embedded_nn(2)}, r AS (SELECT i, max(d) / min(d) AS mu FROM nn GROUP BY i HAVING min(d) > 0)
SELECT count(*) AS n, round(1 / avg(ln(mu)), 6) AS dim FROM r""")
def two_nn(spark, root):
    return I.two_nn(N.knn(embedded(spark, root), 2)).select("n", r6("dim").alias("dim"))


@query("i22_twonn_local", f"""
WITH {R.embedded_nn(10)}, r AS (SELECT i, max(d) / min(d) AS mu FROM nn WHERE rank IN (1, 10) GROUP BY i HAVING min(d) > 0)
SELECT cluster, count(*) AS n, round(1 / avg(ln(mu)), 6) AS dim FROM r JOIN e ON id = i GROUP BY cluster""")
def two_nn_local(spark, root):
    e = embedded(spark, root)
    return I.two_nn_local(N.knn(e, 10), e, 10).select("cluster", "n", r6("dim").alias("dim"))


@query("i23_twonn_trimmed", f"""
WITH {R.embedded_nn(2)}, r AS (SELECT i, greatest(max(d), greatest(min(d), 1e-8) + 1e-8) / greatest(min(d), 1e-8) AS mu FROM nn GROUP BY i),
o AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu) AS k, count(*) OVER () AS n FROM r WHERE mu > 1)
SELECT count(*) AS n, round(1 / avg(x), 6) AS dim FROM o WHERE k > floor(0.02 * n) AND k <= n - floor(0.02 * n)""")
def two_nn_trimmed(spark, root):
    return I.two_nn_trimmed(N.knn(embedded(spark, root), 2)).select("n", r6("dim").alias("dim"))


@query("i24_core_by_slope", f"""
WITH {R.embedded_nn(2)}, r AS (SELECT i, ln(greatest(max(d) / greatest(min(d), 2.220446049250313e-16), 1 + 1e-12)) AS x FROM nn GROUP BY i),
o AS (SELECT x, i, row_number() OVER (ORDER BY x, i) AS k, count(*) OVER () AS m FROM r),
y AS (SELECT *, ln(1 - (k - 0.5) / (m + 1)) AS y FROM o),
s AS (SELECT k, m, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x*x) OVER w AS sxx, sum(x*y) OVER w AS sxy, sum(y*y) OVER w AS syy FROM y WINDOW w AS (ORDER BY x, i ROWS UNBOUNDED PRECEDING)),
f AS (SELECT k, m, (sxy - sx*sy/k) / (sxx - sx*sx/k) AS slope, sqrt(greatest(0, ((syy - sy*sy/k) - (sxy - sx*sy/k)*(sxy - sx*sy/k) / (sxx - sx*sx/k)) / k)) AS rmse
  FROM s WHERE k >= greatest(20, floor(0.3 * m)) AND k <= m - 2),
g AS (SELECT k, m, rmse, max(slope) OVER w - min(slope) OVER w AS span FROM f WINDOW w AS (ORDER BY k ROWS 19 PRECEDING))
SELECT greatest(3, least(coalesce(max(k) FILTER (WHERE span <= 0.08 AND rmse <= 0.10), floor(0.6 * any_value(m))), any_value(m) - 2))::BIGINT AS k_star, any_value(m)::BIGINT AS n FROM g""")
def core_by_slope(spark, root):
    return I.core_by_slope(N.knn(embedded(spark, root), 2))


@query("i25_levina_bickel", f"""
WITH {R.embedded_nn(15)}, l AS (SELECT a.i, a.rank AS k, avg(ln(a.d / b.d)) AS v FROM nn a JOIN nn b ON a.i = b.i AND b.rank < a.rank WHERE a.rank >= 5 GROUP BY 1, 2)
SELECT k::BIGINT AS k, round(avg(1 / v), 6) AS dim FROM l WHERE v > 0 GROUP BY k""")
def levina_bickel(spark, root):
    return I.levina_bickel(N.knn(embedded(spark, root), 15)).select("k", r6("dim").alias("dim"))


@query("i26_core_band", f"""
WITH {R.embedded_nn(10)}, r AS (SELECT i, max(d) AS rk FROM nn GROUP BY i), q AS (SELECT quantile_cont(rk, 0.15) AS lo, quantile_cont(rk, 0.85) AS hi FROM r)
SELECT i, round(rk, 6) AS rk FROM r, q WHERE rk BETWEEN lo AND hi""")
def core_band(spark, root):
    return I.core_band(N.knn(embedded(spark, root), 10)).select("i", r6("rk").alias("rk"))


@query("i27_trust_continuity", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, embedding[1:2]::DOUBLE[] AS u FROM embeddings),
p AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 11), b.id) AS rh,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.u, b.u), 11), b.id) AS rl FROM e a JOIN e b ON a.id <> b.id),
c AS (SELECT count(*)::DOUBLE AS n FROM e)
SELECT k::BIGINT AS k, round(1 - 2 / (any_value(n) * k * (2 * any_value(n) - 3 * k - 1)) * sum(CASE WHEN rl <= k AND rh > k THEN rh - k ELSE 0 END), 6) AS trust,
  round(1 - 2 / (any_value(n) * k * (2 * any_value(n) - 3 * k - 1)) * sum(CASE WHEN rh <= k AND rl > k THEN rl - k ELSE 0 END), 6) AS continuity
FROM p, c, (VALUES (10), (20), (30)) r(k) GROUP BY k""")
def trust_continuity(spark, root):
    e = embedded(spark, root)
    low = e.select("id", F.slice("vec", 1, 2).alias("vec"))
    t = I.trust_continuity(e.select("id", "vec"), low, [10, 20, 30])
    return t.select("k", r6("trust").alias("trust"), r6("continuity").alias("continuity"))


@query("i30_modularity_fixed", f"""
WITH {_EG}, m AS (SELECT sum(w) AS m FROM ed),
c AS (SELECT cluster, sum(wi) AS wi, sum(w) AS tot FROM (SELECT a.cluster, CASE WHEN a.cluster = b.cluster THEN w ELSE 0 END AS wi, w FROM ed JOIN e a ON a.id = src JOIN e b ON b.id = dst
  UNION ALL SELECT b.cluster, 0, w FROM ed JOIN e b ON b.id = dst) GROUP BY cluster)
SELECT round(sum(wi / m - (tot / (2 * m)) * (tot / (2 * m))), 6) AS q FROM c, m""")
def modularity(spark, root):
    return G.modularity(embedded_graph(spark, root), embedded(spark, root).select("id", "cluster")).select(r6("q").alias("q"))


@query("i31_silhouette", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cluster FROM embeddings),
s AS (SELECT a.id, a.cluster, b.cluster AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON TRUE GROUP BY 1, 2, 3),
w AS (SELECT id, cluster, max(CASE WHEN cluster = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN s / n END) AS b FROM s GROUP BY 1, 2)
SELECT cluster, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS mean, round(median((b - a) / greatest(a, b)), 6) + 0.0 AS median FROM w GROUP BY cluster""")
def silhouette(spark, root):
    s = cut_lineage(N.silhouettes(embedded(spark, root)))
    mean = s.groupBy("cluster").agg(F.avg("width").alias("mean"))
    return O.quantiles(s, "width", {"median": 0.5}, ["cluster"]).join(mean, "cluster").select("cluster", "n", r6("mean").alias("mean"), r6("median").alias("median"))


@query("i34_ari", """
WITH t AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n*(n-1)/2) FROM t) AS ij, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM t GROUP BY x)) AS ra, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM t GROUP BY y)) AS rb, (SELECT sum(n) FROM t) AS n)
SELECT n::BIGINT AS n, round((ij - ra*rb/(n*(n-1)/2)) / ((ra+rb)/2 - ra*rb/(n*(n-1)/2)), 6) + 0.0 AS ari FROM s""")
def ari(spark, root):
    return G.partition_agreement(table(spark, root, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority").select("n", r6("ari").alias("ari"))


@query("i40_soft_scores", f"""
WITH {_EG}, u AS (SELECT id, [CASE WHEN cluster < 5 THEN 0.8 ELSE 0.3 END, CASE WHEN cluster < 5 THEN 0.2 ELSE 0.7 END]::DOUBLE[] AS u FROM e),
bi AS (SELECT src AS id, w FROM ed UNION ALL SELECT dst, w FROM ed), k AS (SELECT id, sum(w) AS k FROM bi GROUP BY id),
d AS (SELECT sum(w) AS m, sum(w * list_dot_product(a.u, b.u)) AS wd, sum(ka.k * kb.k) AS kk FROM ed JOIN u a ON a.id = src JOIN u b ON b.id = dst JOIN k ka ON ka.id = src JOIN k kb ON kb.id = dst),
s AS (SELECT avg(list_dot_product(u, u)) AS sq FROM u)
SELECT round(wd / m, 6) AS s_nn, round((wd - kk * sq / (2 * m)) / (2 * m), 6) + 0.0 AS q_soft FROM d, s""")
def soft_scores(spark, root):
    u = embedded(spark, root).select("id", F.when(F.col("cluster") < 5, F.array(F.lit(0.8), F.lit(0.2))).otherwise(F.array(F.lit(0.3), F.lit(0.7))).alias("u"))
    return G.soft_scores(embedded_graph(spark, root), u).select(r6("s_nn").alias("s_nn"), r6("q_soft").alias("q_soft"))


@query("i48_density_robust_z", f"""
WITH {R.embedded_nn(10)}, r AS (SELECT i AS id, 1 / power(max(d), 2) AS dens FROM nn GROUP BY i), m AS (SELECT median(dens) AS med FROM r),
a AS (SELECT 1.4826 * median(abs(dens - med)) AS mad FROM r, m), z AS (SELECT id, dens, least(greatest((dens - med) / mad, -6.0), 6.0)::DOUBLE AS z FROM r, m, a)
SELECT id, round(dens, 6) AS density, round(z, 6) + 0.0 AS z, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 6) AS score01 FROM z""")
def density(spark, root):
    t = I.density_risk(N.knn(embedded(spark, root), 10), 10, 2)
    return t.select("id", r6("density").alias("density"), r6("z").alias("z"), r6("score01").alias("score01"))


@query("i49_jaccard_overlap", f"""
WITH {R.embedded_nn(15)}, b AS (SELECT i, count(*) FILTER (WHERE rank <= 10) / count(*)::DOUBLE AS jac FROM nn GROUP BY i)
SELECT count(*) AS n, round(avg(jac), 6) AS mean_jaccard FROM b""")
def overlap(spark, root):
    nn = N.knn(embedded(spark, root), 15)
    return I.neighbour_overlap(nn.where("rank <= 10"), nn).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("jaccard")).alias("mean_jaccard"))


@query("i50_cluster_diag", f"""
WITH {_EG}, l AS (SELECT a.cluster AS c1, b.cluster AS c2, w FROM ed JOIN e a ON a.id = src JOIN e b ON b.id = dst),
x AS (SELECT c1 AS cluster, CASE WHEN c1 = c2 THEN 1 ELSE 0 END AS inn, w, c1 = c2 AS same FROM l UNION ALL SELECT c2, 0, w, c1 = c2 FROM l),
y AS (SELECT cluster, sum(inn)::BIGINT AS e_internal, sum(inn * w) AS wi, sum(CASE WHEN same THEN 0 ELSE w END) AS cut, sum(w) AS vol FROM x GROUP BY 1), k AS (SELECT cluster, count(*) AS n FROM e GROUP BY 1)
SELECT cluster, n AS n_profiles, e_internal, round(wi, 6) AS w_internal, round(cut, 6) AS cut_weight, round(cut / vol, 6) AS conductance, round(2.0 * e_internal / (n * (n - 1)), 6)::DOUBLE AS density FROM k JOIN y USING (cluster)""")
def cluster_diag(spark, root):
    t = G.cluster_diagnostics(embedded_graph(spark, root), embedded(spark, root).select("id", "cluster"))
    return t.select("cluster", "n_profiles", "e_internal", *[r6(c).alias(c) for c in ("w_internal", "cut_weight", "conductance", "density")])


@query("i50_intra_distance", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cluster FROM embeddings)
SELECT a.cluster, round(avg(list_distance(a.v, b.v)), 6) AS intra_dist_mean FROM e a JOIN e b ON a.cluster = b.cluster AND a.id < b.id GROUP BY 1""")
def intra_distance(spark, root):
    s = N.cluster_distances(embedded(spark, root)).where("cluster = other")
    n = F.sum(F.col("n") - 1)
    return s.groupBy("cluster").agg((F.sum("s") / n).alias("m")).select("cluster", r6("m").alias("intra_dist_mean"))


_PG = f"{R.jaccard_nn(9, 'p_type')}, {R.graph('mutual', 2.0, True)}, lab AS (SELECT DISTINCT label FROM sub)"


def _profile_sets(spark, root):
    pr, nn = profile_nn(spark, root, 9)
    g = cut_lineage(G.knn_graph(nn, "mutual", 2.0, pr.select(F.col("first_id").alias("id"), "mult")))
    return g, pr.select(F.col("first_id").alias("id"), "labels")


@query("q3_assortativity", f"""
WITH {_PG}, z AS (SELECT label, CASE WHEN list_contains(a.labels, label) THEN 1 ELSE 0 END AS x, CASE WHEN list_contains(b.labels, label) THEN 1 ELSE 0 END AS y
  FROM ed JOIN pr a ON a.pid = src JOIN pr b ON b.pid = dst CROSS JOIN lab),
t AS (SELECT label, avg(x * y) AS e11, avg((1-x)*(1-y)) AS e00, avg(x*(1-y) + y*(1-x)) / 2 AS e10 FROM z GROUP BY label),
u AS (SELECT *, (e11+e10)*(e11+e10) + (e00+e10)*(e00+e10) AS ab FROM t)
SELECT label, round((e11 + e00 - ab) / (1 - ab), 6) + 0.0 AS r FROM u""")
def assortativity(spark, root):
    g, sets = _profile_sets(spark, root)
    return G.assortativity(g, sets).select("label", r6("r").alias("r"))


@query("q3_purity", f"""
WITH {_PG}, bi AS (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed),
s AS (SELECT label, src, avg(CASE WHEN list_contains(b.labels, label) THEN 1.0 ELSE 0.0 END) AS share FROM bi JOIN pr a ON a.pid = src JOIN pr b ON b.pid = dst CROSS JOIN lab WHERE list_contains(a.labels, label) GROUP BY 1, 2)
SELECT label, round(avg(share), 6) AS purity FROM s GROUP BY label""")
def purity(spark, root):
    g, sets = _profile_sets(spark, root)
    return G.neighbour_purity(g, sets).select("label", r6("purity").alias("purity"))


@query("j27_weighted_knn_auc", f"""
WITH {R.profiles()}, lab AS (SELECT DISTINCT label FROM sub),
base AS (SELECT label, pid, mult, CASE WHEN list_contains(labels, label) THEN 1 ELSE 0 END AS y, list_filter(labels, lambda x: x <> label) AS rest FROM pr, lab),
d AS (SELECT a.label, a.pid AS i, a.y AS yi, a.mult AS wi, b.pid AS j, b.y AS yj, b.mult AS wj,
  CASE WHEN len(list_concat(a.rest, b.rest)) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect(a.rest, b.rest))::DOUBLE / len(list_distinct(list_concat(a.rest, b.rest))) END AS d
  FROM base a JOIN base b ON a.label = b.label AND a.pid <> b.pid),
n AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY round(d, 11), j) AS r FROM d),
s AS (SELECT label, i, any_value(yi) AS y, any_value(wi) AS w, round(sum(yj * wj)::DOUBLE / sum(wj), 12) AS s FROM n WHERE r <= 10 GROUP BY 1, 2),
t AS (SELECT label, s, sum(y * w)::DOUBLE AS pos, sum((1 - y) * w)::DOUBLE AS neg FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY label ORDER BY s) - neg AS below FROM t),
u AS (SELECT label, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM c GROUP BY label)
SELECT label, round(greatest(a, 1 - a), 6) AS auc FROM u""")
def weighted_knn_auc(spark, root):
    pr = cut_lineage(L.profiles(order_labels(spark, root), "id"))
    names = label_names(spark, root)
    return weighted_auc(pr, names).select("label", r6("auc").alias("auc"))


def weighted_auc(pr, names, k=10):
    """Per label: neighbours without that label's column, score = weight share of positives."""
    total = pr.count()
    scored = None
    for name in names:
        pts, metric = E.label_points(pr, [c for c in names if c != name])
        nn = N.knn(pts, k, metric, total=total).select("i", "j")
        part = nn.withColumn("label", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    facts = pr.select(F.col("first_id").alias("id"), "labels", "mult")
    other = facts.select(F.col("id").alias("j"), F.col("labels").alias("lj"), F.col("mult").alias("wj"))
    own = facts.select(F.col("id").alias("i"), F.col("labels").alias("li"), F.col("mult").alias("w"))
    hit = F.expr("CASE WHEN array_contains(lj, label) THEN wj ELSE 0 END")
    s = scored.join(other, "j").groupBy("label", "i").agg(F.round(F.sum(hit) / F.sum("wj"), 12).alias("s"))
    s = s.join(own, "i").withColumn("y", F.expr("array_contains(li, label)").cast("int"))
    t = cut_lineage(M.score_table(s, by=["label"], w="w"))
    return M.auc(t, ["label"]).select("label", F.col("auc_oriented").alias("auc"))


@query("j12_neighbour_r2", f"""
WITH {R.embedded_nn(20)}, x AS (SELECT id, v[1] AS y, ('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM e),
mu AS (SELECT a.fold, (SELECT avg(y) FROM x b WHERE b.fold <> a.fold) AS m FROM (SELECT DISTINCT fold FROM x) a),
p AS (SELECT k, a.id, any_value(a.y) AS y, any_value(a.fold) AS fold, avg(CASE WHEN b.fold <> a.fold THEN b.y END) AS pr FROM nn JOIN x a ON a.id = i JOIN x b ON b.id = j, (VALUES (6), (10), (15), (20)) r(k) WHERE rank <= k GROUP BY k, a.id)
SELECT k::BIGINT AS k, round(greatest(0, 1 - avg((y - coalesce(pr, m)) * (y - coalesce(pr, m))) / var_samp(y)), 6) AS r2 FROM p JOIN mu USING (fold) GROUP BY k""")
def neighbour_r2(spark, root):
    e = embedded(spark, root)
    nn = N.knn(e, 20)
    values = e.select("id", F.col("vec")[0].alias("y"), fold_of("id", 5).alias("fold"))
    return I.neighbour_r2(nn, values, [6, 10, 15, 20]).select(F.col("k").cast("bigint").alias("k"), r6("r2").alias("r2"))
