"""Single-step operators: alignment, filling, gates, grids, formatting, clustering by medoids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions.scalar import choose2, clip, estimate_text, r6
from tessera.operators import association as A
from tessera.operators import labels as L
from tessera.operators import neighbours as N
from tessera.operators import soft_clusters as S
from tessera.operators.geometry import grid
from tessera.plans import registry as R
from tessera.plans.registry import query
from tessera.plans.stand_ins import assigned_orders, embedded, order_labels
from tessera.session import cut_lineage
from tessera.sources import delimited as D
from tessera.sources.tables import table


@query("b4_pattern_rows", """
SELECT p_brand AS brand, count(*) AS n FROM part WHERE regexp_matches(p_brand, '#1[0-9]$') GROUP BY 1""")
def pattern_rows(spark, root):
    return table(spark, root, "part", "p_brand").where(F.col("p_brand").rlike("#1[0-9]$")).groupBy(
        F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("b5_align_to_ids", """
SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def align(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    ids = table(spark, root, "orders", "o_custkey").select(F.col("o_custkey").alias("id")).distinct()
    return D.align(c, ids.join(c.select("id"), "id", "left_semi"), "id")


@query("b6_common_ids", """
SELECT doc_id AS id, n_chars::BIGINT AS n_chars, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)""")
def common_ids(spark, root):
    d = table(spark, root, "documents", "doc_id", "n_chars").withColumnRenamed("doc_id", "id")
    q = table(spark, root, "labels", "doc_id", "quality").withColumnRenamed("doc_id", "id")
    a, b = D.align_all("id", d, q)
    return a.join(b, "id").select("id", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("quality").cast("bigint").alias("quality"))


@query("b7_mean_fill", """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT id, round(coalesce(v, (SELECT avg(v) FROM t)), 4) AS v FROM t""")
def mean_fill(spark, root):
    t = table(spark, root, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    mean = t.agg(F.avg("v")).scalar()
    return t.select("id", F.round(F.coalesce("v", mean), 4).alias("v"))


@query("b11_prevalence_gate", f"""
WITH {R.cells('p_brand')} SELECT DISTINCT label, (a + b)::BIGINT AS cases FROM cell WHERE (a + b)::DOUBLE / n >= 0.15 AND a + b >= 10""")
def prevalence_gate(spark, root):
    return L.prevalence_filter(L.label_counts(order_labels(spark, root, "p_brand").join(
        table(spark, root, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "id"), "id", "left_semi")), 0.15, 1.0, 10).select(
        "label", F.col("n1").alias("cases"))


@query("b20_clip", """
SELECT s_suppkey AS id, round(least(greatest(s_acctbal / 10000, 1e-6), 1 - 1e-6)::DOUBLE, 6) AS p FROM supplier""")
def clipped(spark, root):
    s = table(spark, root, "supplier", "s_suppkey", "s_acctbal")
    return s.select(F.col("s_suppkey").alias("id"), r6(clip(F.col("s_acctbal") / 10000, 1e-6, 1 - 1e-6)).alias("p"))


@query("b21_data_grid", """
WITH b AS (SELECT min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part)
SELECT ix::BIGINT AS ix, iy::BIGINT AS iy, round(x0 + ix * (x1 - x0) / 9, 6) AS gx, round(y0 + iy * (y1 - y0) / 9, 6) AS gy FROM b, range(0, 10) r(ix), range(0, 10) s(iy)""")
def data_grid(spark, root):
    f = table(spark, root, "part", "p_size", "p_retailprice").agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    g = grid(spark, (float(f[0]), float(f[1])), (f[2], f[3]), 10, 10)
    return g.select("ix", F.col("iy").cast("bigint").alias("iy"), r6("gx").alias("gx"), r6("gy").alias("gy"))


@query("c2_right_join", """
SELECT o_orderkey AS row, c_mktsegment AS segment FROM customer RIGHT JOIN orders ON c_custkey = o_custkey""")
def right_join(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment")
    o = table(spark, root, "orders", "o_orderkey", "o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "right").select(F.col("o_orderkey").alias("row"), F.col("c_mktsegment").alias("segment"))


@query("c5_first_match_lookup", """
SELECT c_custkey AS id, f AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def first_match(spark, root):
    first = table(spark, root, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("first_order"))
    return table(spark, root, "customer", "c_custkey").withColumnRenamed("c_custkey", "id").join(first, "id", "left")


@query("d9_cluster_mass", f"""
WITH {R.profiles()}, k AS (SELECT len(labels) AS cluster, count(*) AS n, sum(mult)::BIGINT AS mass FROM pr GROUP BY 1)
SELECT cluster::BIGINT AS cluster, n, mass FROM k WHERE n >= 5""")
def cluster_mass(spark, root):
    pr = L.profiles(order_labels(spark, root), "id")
    return pr.groupBy(F.size("labels").cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("mult").alias("mass")).where("n >= 5")


@query("d12_best_per_key", """
SELECT l_discount AS k, round(max(l_extendedprice), 6) AS top, round(avg(l_quantity), 6) AS m, round(sum(l_tax), 4) AS s FROM lineitem GROUP BY 1""")
def best_per_key(spark, root):
    li = table(spark, root, "lineitem", "l_discount", "l_extendedprice", "l_quantity", "l_tax")
    return li.groupBy(F.col("l_discount").alias("k")).agg(r6(F.max("l_extendedprice")).alias("top"), r6(F.avg("l_quantity")).alias("m"), F.round(F.sum("l_tax"), 4).alias("s"))


@query("f5_union_by_name", """
SELECT 'customer' AS src, c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_mktsegment").select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, root, "supplier", "s_suppkey", "s_acctbal").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s, allowMissingColumns=True)


@query("g2_math", """
SELECT s_suppkey AS id, round(ln(s_suppkey + 1), 6) AS a, round(log2(s_suppkey + 1), 6) AS b, round(atan2(s_acctbal, 1000), 6) + 0.0 AS c, floor(s_acctbal)::BIGINT AS d, ceil(s_acctbal)::BIGINT AS e,
  round(s_suppkey::DOUBLE * (s_suppkey - 1) / 2, 6) AS f, greatest(s_suppkey, s_nationkey)::BIGINT AS g FROM supplier""")
def math_functions(spark, root):
    s = table(spark, root, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    k = F.col("s_suppkey")
    return s.select(k.alias("id"), r6(F.ln(k + 1)).alias("a"), r6(F.log2(k + 1)).alias("b"), r6(F.atan2("s_acctbal", F.lit(1000.0))).alias("c"),
                    F.floor("s_acctbal").alias("d"), F.ceil("s_acctbal").alias("e"), r6(choose2("s_suppkey")).alias("f"), F.greatest("s_suppkey", "s_nationkey").cast("bigint").alias("g"))


@query("g9_estimate_text", """
SELECT p_brand AS brand, printf('%.3f [%.3f, %.3f]', avg(p_size), min(p_size)::DOUBLE, max(p_size)::DOUBLE) AS txt FROM part GROUP BY 1""")
def estimate(spark, root):
    t = table(spark, root, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("brand")).agg(
        F.avg("p_size").alias("m"), F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    return t.select("brand", estimate_text("m", "lo", "hi").alias("txt"))


@query("g12_binomial_quantile", f"""
WITH t AS (SELECT p_brand AS brand, count(*) AS n, avg((p_size <= 10)::INT) AS p FROM part GROUP BY 1),
q AS (SELECT brand, n, p, k, exp({R.lf('n')} - {R.lf('k')} - {R.lf('n - k')} + k * ln(p) + (n - k) * ln(1 - p)) AS pmf FROM t, LATERAL (SELECT unnest(range(0, n + 1)) AS k)),
c AS (SELECT brand, n, k, sum(pmf) OVER (PARTITION BY brand ORDER BY k) AS cdf FROM q)
SELECT brand, n, min(k) FILTER (WHERE cdf >= 0.025 - 1e-12)::BIGINT AS lo, min(k) FILTER (WHERE cdf >= 0.975 - 1e-12)::BIGINT AS hi FROM c GROUP BY 1, 2""")
def binomial_quantile(spark, root):
    t = table(spark, root, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("brand")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") <= 10).cast("int")).alias("p"))
    q = lambda u: exact.binomial_quantile(F.lit(u), "n", "p").cast("bigint")
    return t.select("brand", "n", q(0.025).alias("lo"), q(0.975).alias("hi"))


@query("h17_medoid_clusters")
def medoid_clusters(spark, root):
    return N.medoid_clusters(cut_lineage(embedded(spark, root).select("id", "vec")), 4).select("id", "cluster")


_TWO = """WITH e AS (SELECT vec_id AS id, (label % 4)::BIGINT AS cluster,
    (CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END)::BIGINT AS reference FROM embeddings),
n AS (SELECT cluster, reference, count(*) AS n FROM e GROUP BY 1, 2)"""


def _two_partitions(spark, root):
    e = table(spark, root, "embeddings", "vec_id", "embedding", "label")
    side = lambda i: (F.element_at("embedding", i) > 0).cast("bigint")
    own = e.select(F.col("vec_id").alias("id"), (F.col("label") % 4).cast("bigint").alias("cluster"))
    return own, e.select(F.col("vec_id").alias("id"), (2 * side(1) + side(2)).cast("bigint").alias("cluster"))


@query("i42_relabel", _TWO + """, k AS (SELECT DISTINCT reference AS r FROM n),
p AS (SELECT a.r AS c0, b.r AS c1, c.r AS c2, d.r AS c3 FROM k a, k b, k c, k d WHERE a.r NOT IN (b.r, c.r, d.r) AND b.r NOT IN (c.r, d.r) AND c.r <> d.r),
w AS (SELECT c0, c1, c2, c3, sum(n) AS total FROM p JOIN n ON reference = CASE cluster WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END GROUP BY ALL),
b AS (SELECT * FROM w ORDER BY total DESC, c0, c1, c2, c3 LIMIT 1)
SELECT cluster, reference, n FROM n, b WHERE reference = CASE cluster WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END""")
def relabel(spark, root):
    """Each cluster, the reference name it gets, and the rows that agree."""
    names, counts = S.relabel(*_two_partitions(spark, root))
    return names.join(counts, ["cluster", "reference"]).select("cluster", "reference", "n")


@query("i42_contingency", _TWO + " SELECT cluster, reference, n FROM n")
def contingency_after(spark, root):
    return S.relabel(*_two_partitions(spark, root))[1]


def _part_points(spark, root):
    from tessera.operators import encoding as E

    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    pts, metric = E.gower_points(p, "p_partkey", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return cut_lineage(pts), metric


@query("i7_epsilon_groups")
def epsilon_groups(spark, root):
    """Groups of near copies; the cut is where the collapse curve of these data drops most."""
    from tessera.operators import linkage as K

    return K.near_copies(*_part_points(spark, root))[0]


@query("i7_collapse_curve")
def collapse_curve(spark, root):
    from tessera.operators import linkage as K

    pts, metric = _part_points(spark, root)
    grid = K.cuts(pts, metric)
    t = K.collapse_curve(pts, grid, K.complete_tree(pts, grid[-1], metric))
    return t.select(r6("eps").alias("eps"), "n_groups", r6("retained").alias("retained"))
