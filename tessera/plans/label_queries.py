"""Queries on label matrices, items, joins, aggregates and ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, fold_of, inverse_logit, logit, r6, safe_name, stars, wilson
from tessera.operators import encoding as E
from tessera.operators import labels as L
from tessera.operators import ordered as O
from tessera.plans.registry import query, sub
from tessera.plans.stand_ins import assigned_orders, embedded, order_labels
from tessera.sources.tables import table


@query("a5_id_validation", """
SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def duplicate_ids(spark, root):
    return table(spark, root, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")


@query("a6_any_label", """
SELECT o_orderkey AS id, CASE WHEN k.id IS NULL THEN 0 ELSE 1 END::BIGINT AS any_y,
       CASE WHEN k.id IS NULL THEN 1 ELSE 0 END::BIGINT AS no_label
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey) k ON k.id = o_orderkey""")
def any_label(spark, root):
    orders = table(spark, root, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "id")
    sets = orders.join(order_labels(spark, root), "id", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>")))
    return L.any_label(sets).select("id", "any_y", "no_label")


@query("a7_prevalence_filter", f"""
WITH {sub('p_brand')}, t AS (SELECT count(DISTINCT id) AS n FROM sub)
SELECT label, count(*)::BIGINT AS n1, (any_value(n) - count(*))::BIGINT AS n0, round(count(*)::DOUBLE / any_value(n), 6) AS prev
FROM sub, t GROUP BY label HAVING count(*)::DOUBLE / any_value(n) BETWEEN 0.14 AND 0.16 AND count(*) >= 5""")
def prevalence_filter(spark, root):
    counts = L.label_counts(order_labels(spark, root, "p_brand"))
    return L.prevalence_filter(counts, 0.14, 0.16, 5).select("label", "n1", "n0", r6("prev").alias("prev"))


@query("a10_membership_fill", """
SELECT c_custkey AS id, coalesce(k, 0)::BIGINT AS cluster FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON c_custkey = o_custkey""")
def membership_fill(spark, root):
    from tessera.sources.delimited import attach_membership

    ids = table(spark, root, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")
    member = table(spark, root, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").groupBy(
        F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("cluster"))
    return attach_membership(ids, member)


@query("a15_run_report", """
SELECT * FROM (
SELECT 'o_totalprice' AS col, count(*) AS n, round(min(o_totalprice), 6) AS lo, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
  round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 6) AS hi FROM orders
UNION ALL SELECT 'c_acctbal', count(*), round(min(c_acctbal), 6), round(quantile_cont(c_acctbal, 0.25), 6),
  round(median(c_acctbal), 6), round(quantile_cont(c_acctbal, 0.75), 6), round(max(c_acctbal), 6) FROM customer)""")
def run_report(spark, root):
    out = None
    for name, col in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        df = table(spark, root, name, col)
        q = O.quantiles(df, col, {"lo": 0.0, "q25": 0.25, "med": 0.5, "q75": 0.75, "hi": 1.0})
        q = q.select(F.lit(col).alias("col"), "n", *[r6(c).alias(c) for c in ("lo", "q25", "med", "q75", "hi")])
        out = q if out is None else out.unionByName(q)
    return out


@query("a16_label_audit", f"""
WITH {sub('p_brand')}, t AS (SELECT count(DISTINCT id) AS n FROM sub)
SELECT label, count(*)::BIGINT AS n_pos, (any_value(n) - count(*))::BIGINT AS n_neg, any_value(n)::BIGINT AS n_total
FROM sub, t GROUP BY label""")
def label_audit(spark, root):
    c = L.label_counts(order_labels(spark, root, "p_brand"))
    return c.select("label", F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"),
                    (F.col("n1") + F.col("n0")).alias("n_total")).orderBy(F.desc("n_pos"), "label")


@query("b1_item_kinds", """
SELECT 'p_size' AS item, 'numeric' AS kind, count(DISTINCT p_size)::BIGINT AS n_distinct FROM part
UNION ALL SELECT 'p_retailprice', 'numeric', count(DISTINCT p_retailprice) FROM part
UNION ALL SELECT 'p_brand', 'nominal', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', 'nominal', count(DISTINCT p_type) FROM part""")
def item_kinds(spark, root):
    items = ["p_size", "p_retailprice", "p_brand", "p_type"]
    return E.item_kinds(table(spark, root, "part", *items), items)


@query("b1_small_scales", """
SELECT 'l_linenumber' AS item, CASE WHEN count(DISTINCT l_linenumber) BETWEEN 3 AND 7 THEN 'ordered' ELSE 'numeric' END AS kind,
  count(DISTINCT l_linenumber)::BIGINT AS n_distinct FROM lineitem
UNION ALL SELECT 'l_linestatus', 'nominal', count(DISTINCT l_linestatus) FROM lineitem
UNION ALL SELECT 'l_discount', 'numeric', count(DISTINCT l_discount) FROM lineitem""")
def small_scales(spark, root):
    items = ["l_linenumber", "l_linestatus", "l_discount"]
    return E.item_kinds(table(spark, root, "lineitem", *items), items)


@query("b3_complete_cases", """
SELECT doc_id, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id)
WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def complete_cases(spark, root):
    d = table(spark, root, "documents", "doc_id", "n_chars").join(
        table(spark, root, "labels", "doc_id", "quality", "toxic"), "doc_id", "left").withColumn("constant", F.lit(1))
    kept = E.complete_cases(d, ["n_chars", "quality", "toxic", "constant"])
    return kept.select(*[F.col(c).cast("bigint").alias(c) for c in kept.columns])


@query("b8_threshold_labels", """
SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END::BIGINT AS y FROM customer""")
def threshold_labels(spark, root):
    from tessera.sources.typing import binarise

    c = table(spark, root, "customer", "c_custkey", "c_acctbal")
    return binarise(c, ["c_acctbal"]).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("bigint").alias("y"))


@query("b9_relaxed_label_gate", f"""
WITH {sub('p_brand')}, t AS (SELECT count(DISTINCT id) AS n FROM sub),
k AS (SELECT label, count(*) AS n_pos, any_value(n) - count(*) AS n_neg FROM sub, t GROUP BY label),
s AS (SELECT max(CASE WHEN least(n_pos, n_neg) >= 10 THEN 10 WHEN least(n_pos, n_neg) >= 8 THEN 8 WHEN least(n_pos, n_neg) >= 5 THEN 5
  WHEN least(n_pos, n_neg) >= 3 THEN 3 WHEN least(n_pos, n_neg) >= 1 THEN 1 ELSE 0 END) AS threshold FROM k)
SELECT label, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, threshold::BIGINT AS threshold FROM k, s WHERE least(n_pos, n_neg) >= threshold""")
def relaxed_gate(spark, root):
    g = L.relaxed_gate(L.label_counts(order_labels(spark, root, "p_brand")))
    return g.select("label", F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"), F.col("threshold").cast("bigint").alias("threshold"))


@query("b10_cluster_gate", """
SELECT o_orderpriority AS cluster, count(*) AS n_in, (SELECT count(*) FROM orders) - count(*) AS n_out FROM orders
GROUP BY o_orderpriority HAVING count(*) >= 10 AND (SELECT count(*) FROM orders) - count(*) >= 10""")
def cluster_gate(spark, root):
    o = table(spark, root, "orders", "o_orderpriority").groupBy(F.col("o_orderpriority").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n_in"))
    n = o.agg(F.sum("n_in")).scalar()
    return o.withColumn("n_out", n - F.col("n_in")).where("n_in >= 10 and n_out >= 10")


@query("b12_rare_levels", """
WITH k AS (SELECT p_name, count(*) AS c FROM part GROUP BY p_name)
SELECT p_partkey AS id, CASE WHEN c >= 0.01 * (SELECT count(*) FROM part) THEN p_name END AS level FROM part JOIN k USING (p_name)""")
def rare_levels(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_name")
    return E.rare_levels_to_null(p, "p_name").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("level"))


@query("b16_weight_spread", """
WITH k AS (SELECT 'p_brand' AS item, p_brand AS level FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type FROM part GROUP BY 2)
SELECT item, level, round(sqrt(1.0::DOUBLE / count(*) OVER (PARTITION BY item)), 6) AS w FROM k""")
def weight_spread(spark, root):
    p = table(spark, root, "part", "p_brand", "p_type")
    long = p.select(F.explode(F.array(
        F.struct(F.lit("p_brand").alias("item"), F.col("p_brand").alias("level")),
        F.struct(F.lit("p_type").alias("item"), F.col("p_type").alias("level")))).alias("e")).select("e.*").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("item"))
    return long.withColumn("w", r6(F.sqrt(1.0 / n)))


@query("b19_zscore", """
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) + 0.0 AS z_size,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) + 0.0 AS z_price FROM part""")
def z_score(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice")
    z = E.z_scores(p, "p_partkey", ["p_size", "p_retailprice"])
    return z.select("p_partkey", r6("z_p_size").alias("z_size"), r6("z_p_retailprice").alias("z_price"))


POLYGON = [(0.0, 2.0), (4000.0, 0.0), (9000.0, 6.0), (7000.0, 20.0), (3000.0, 15.0), (1000.0, 22.0)]


def _edges_sql() -> str:
    rows = [(*p, *POLYGON[(i + 1) % len(POLYGON)]) for i, p in enumerate(POLYGON)]
    return ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in rows)


@query("b22_point_in_polygon", f"""
WITH g(x1, y1, x2, y2) AS (VALUES {_edges_sql()}),
p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer)
SELECT id, CASE WHEN bool_or(abs((x2-x1)*(y-y1) - (y2-y1)*(x-x1)) <= 1e-9 AND x BETWEEN least(x1,x2) AND greatest(x1,x2) AND y BETWEEN least(y1,y2) AND greatest(y1,y2))
  OR sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2-x1)*(y-y1)/(y2-y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS inside
FROM p, g GROUP BY id""")
def point_in_polygon(spark, root):
    from tessera.operators.geometry import inside_polygon

    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    inside = inside_polygon("c_acctbal", F.col("c_nationkey").cast("double"), POLYGON)
    return c.select(F.col("c_custkey").alias("id"), inside.cast("bigint").alias("inside"))


@query("c1_left_fill", """
SELECT c_custkey AS id, CASE WHEN k.o_custkey IS NULL THEN 0 ELSE 1 END::BIGINT AS y FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') k ON o_custkey = c_custkey""")
def left_fill(spark, root):
    flags = table(spark, root, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("id"), F.lit(1).alias("y")).distinct()
    return table(spark, root, "customer", "c_custkey").withColumnRenamed("c_custkey", "id").join(
        flags, "id", "left").select("id", F.coalesce("y", F.lit(0)).cast("bigint").alias("y"))


@query("c3_inner_equi", """
SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def inner_equi(spark, root):
    c = table(spark, root, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    n = table(spark, root, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, root, "region", "r_regionkey", "r_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("k").alias("n"))


@query("c6_match_rate", """
SELECT count(*) AS n, count(k) AS matched, round(count(k)::DOUBLE / count(*), 6) AS rate FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey""")
def match_rate(spark, root):
    o = table(spark, root, "orders", "o_orderkey")
    keys = table(spark, root, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    matched = o.join(keys, "o_orderkey", "left_semi").agg(F.count(F.lit(1))).scalar()
    return o.agg(F.count(F.lit(1)).alias("n")).select("n", matched.alias("matched"), r6(matched / F.col("n")).alias("rate"))


@query("c6_missing_ids", """
SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def missing_ids(spark, root):
    keys = table(spark, root, "lineitem", "l_orderkey")
    o = table(spark, root, "orders", "o_orderkey")
    return o.join(keys, o.o_orderkey == keys.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("id"))


@query("d1_label_counts", f"""
WITH {sub()}, t AS (SELECT count(DISTINCT id) AS n FROM sub)
SELECT label, count(*)::BIGINT AS n1, (any_value(n) - count(*))::BIGINT AS n0, round(count(*)::DOUBLE / any_value(n), 6) AS prev FROM sub, t GROUP BY label""")
def label_counts(spark, root):
    return L.label_counts(order_labels(spark, root)).select("label", "n1", "n0", r6("prev").alias("prev"))


_SETS = "sets AS (SELECT id, array_to_string(list_sort(list(label)), ',') AS profile FROM sub GROUP BY id)"


@query("d2_profiles", f"""
WITH {sub()}, {_SETS} SELECT profile, count(*) AS mult, min(id) AS first_id FROM sets GROUP BY profile""")
def profiles(spark, root):
    return L.profiles(order_labels(spark, root), "id").select(F.array_join("labels", ",").alias("profile"), "mult", "first_id")


@query("d3_expand", f"""
WITH {sub()}, {_SETS}, pr AS (SELECT profile, min(id) AS profile_id, count(*) AS mult FROM sets GROUP BY profile)
SELECT id, profile_id, mult FROM sets JOIN pr USING (profile)""")
def expand(spark, root):
    sets = order_labels(spark, root)
    pr = L.profiles(sets, "id").withColumnRenamed("first_id", "profile_id")
    return L.expand(sets, pr).select("id", "profile_id", "mult")


@query("d8_cluster_means", """
SELECT label::BIGINT AS cluster, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS m1, round(avg(embedding[2]::DOUBLE), 6) + 0.0 AS m2 FROM embeddings GROUP BY label""")
def cluster_means(spark, root):
    return embedded(spark, root).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("vec")[0])).alias("m1"), r6(F.avg(F.col("vec")[1])).alias("m2"))


@query("d10_sweep_summary", """
SELECT l_returnflag AS g, l_linestatus AS h, count(*) AS n, round(median(l_extendedprice), 6) AS med, round(stddev_samp(l_extendedprice), 4) AS sd,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr,
  round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share, min(m) AS mode_line
FROM lineitem JOIN (SELECT g, h, m FROM (SELECT g, h, m, row_number() OVER (PARTITION BY g, h ORDER BY k DESC, m) AS r FROM (
    SELECT l_returnflag AS g, l_linestatus AS h, l_linenumber::BIGINT AS m, count(*) AS k FROM lineitem GROUP BY 1, 2, 3)) WHERE r = 1)
  ON g = l_returnflag AND h = l_linestatus GROUP BY 1, 2""")
def sweep_summary(spark, root):
    li = table(spark, root, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_linenumber")
    li = li.withColumnsRenamed({"l_returnflag": "g", "l_linestatus": "h"})
    q = O.quantiles(li, "l_extendedprice", {"med": 0.5, "q1": 0.25, "q3": 0.75}, ["g", "h"])
    flat = li.groupBy("g", "h").agg(
        F.stddev_samp("l_extendedprice").alias("sd"), F.avg((F.col("l_discount") < 0.05).cast("double")).alias("share"))
    modes = li.groupBy("g", "h", "l_linenumber").agg(F.count(F.lit(1)).alias("k")).groupBy("g", "h").agg(
        F.max_by("l_linenumber", F.struct("k", -F.col("l_linenumber"))).cast("bigint").alias("mode_line"))
    return q.join(flat, ["g", "h"]).join(modes, ["g", "h"]).select(
        "g", "h", "n", r6("med").alias("med"), F.round("sd", 4).alias("sd"), r6(F.col("q3") - F.col("q1")).alias("iqr"),
        r6("share").alias("share"), "mode_line").orderBy(F.desc("med"), F.desc("share"), F.desc("n"))


@query("d11_primary_label", f"""
WITH {sub()}, k AS (SELECT label, count(*) AS n1 FROM sub GROUP BY label)
SELECT id, label AS primary_label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n1 DESC, label) AS r FROM sub JOIN k USING (label)) WHERE r = 1""")
def primary_label(spark, root):
    return L.primary_label(order_labels(spark, root), "id").withColumnRenamed("primary", "primary_label")


@query("d14_count_distinct", """
SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem""")
def count_distinct(spark, root):
    # Two single-column distincts: no row expansion per aggregate.
    li = table(spark, root, "lineitem", "l_partkey", "l_suppkey")
    supp = li.select("l_suppkey").distinct().agg(F.count(F.lit(1))).scalar()
    return li.select("l_partkey").distinct().agg(F.count(F.lit(1)).alias("parts")).select("parts", supp.alias("suppliers"))


@query("d15_field_range_top", """
SELECT p_brand AS label, round(max(p_retailprice) - min(p_retailprice), 6) AS field_range,
  round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS iqr FROM part GROUP BY p_brand
ORDER BY iqr DESC, label LIMIT 6""")
def field_range_top(spark, root):
    p = table(spark, root, "part", "p_brand", "p_retailprice").withColumnRenamed("p_brand", "label")
    q = O.quantiles(p, "p_retailprice", {"lo": 0.0, "q1": 0.25, "q3": 0.75, "hi": 1.0}, ["label"])
    return q.select("label", r6(F.col("hi") - F.col("lo")).alias("field_range"), r6(F.col("q3") - F.col("q1")).alias("iqr")).orderBy(
        F.desc("iqr"), "label").limit(6)


@query("d16_mad_iqr", """
WITH m AS (SELECT c_mktsegment AS g, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr,
  quantile_cont(c_acctbal, 0.025) AS q025, quantile_cont(c_acctbal, 0.975) AS q975 FROM customer GROUP BY 1)
SELECT g, round(med, 6) AS med, round(1.4826 * median(abs(c_acctbal - med)), 6) AS mad, round(any_value(iqr), 6) AS iqr,
  round(any_value(q025), 6) AS q025, round(any_value(q975), 6) AS q975 FROM customer JOIN m ON g = c_mktsegment GROUP BY g, med""")
def mad_iqr(spark, root):
    c = table(spark, root, "customer", "c_mktsegment", "c_acctbal").withColumnRenamed("c_mktsegment", "g")
    q = O.quantiles(c, "c_acctbal", {"med": 0.5, "q1": 0.25, "q3": 0.75, "q025": 0.025, "q975": 0.975}, ["g"])
    dev = c.join(q.select("g", "med"), "g").select("g", F.abs(F.col("c_acctbal") - F.col("med")).alias("dev"))
    mad = O.quantiles(dev, "dev", {"mad": 0.5}, ["g"]).select("g", "mad")
    return q.join(mad, "g").select("g", r6("med").alias("med"), r6(F.lit(1.4826) * F.col("mad")).alias("mad"),
                                   r6(F.col("q3") - F.col("q1")).alias("iqr"), r6("q025").alias("q025"), r6("q975").alias("q975"))


@query("e2_avg_rank", """
SELECT o_orderkey AS id, round(rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0, 6)::DOUBLE AS rank FROM orders""")
def average_rank(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_totalprice")
    return O.average_rank(o, "o_totalprice").select(F.col("o_orderkey").alias("id"), r6("rank").alias("rank"))


@query("e3_arc_length", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
o AS (SELECT id, v, lag(v) OVER (ORDER BY v[1], id) AS p FROM e)
SELECT id, round(sum(coalesce(list_distance(v, p), 0)) OVER (ORDER BY v[1], id), 6) AS s FROM o""")
def arc_length(spark, root):
    e = embedded(spark, root).select("id", "vec", F.col("vec")[0].alias("t"))
    prev = O.with_previous(e, "t", ["vec"], tie="id")
    gap = F.aggregate(F.zip_with("vec", "prev_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    steps = prev.select("id", "t", F.coalesce(F.sqrt(gap), F.lit(0.0)).alias("step"))
    return O.running_totals(steps, "t", ["step"], tie="id").select("id", r6("upto_step").alias("s"))


@query("e5_bh", """
WITH t AS (SELECT supp AS k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM (
  SELECT s_suppkey AS supp, (s_suppkey * 7919 % 1009 + 1)::DOUBLE / 1010 AS p FROM supplier) x)
SELECT k, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM t""")
def bh(spark, root):
    s = table(spark, root, "supplier", "s_suppkey").select(
        F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 7919 % 1009 + 1) / 1010).alias("p"))
    return O.benjamini_hochberg(s).select("k", r6("p").alias("p"), r6("q").alias("q"))


@query("e6_prefix_regression", """
WITH o AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer),
r AS (SELECT row_number() OVER w AS k, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x*x) OVER w AS sxx, sum(x*y) OVER w AS sxy, sum(y*y) OVER w AS syy
  FROM o WINDOW w AS (ORDER BY x, id ROWS UNBOUNDED PRECEDING))
SELECT k, round((sxy - sx*sy/k) / (sxx - sx*sx/k), 6) + 0.0 AS slope,
  round(sqrt(greatest(0, ((syy - sy*sy/k) - (sxy - sx*sy/k)*(sxy - sx*sy/k) / (sxx - sx*sx/k)) / k)), 5) AS rmse FROM r WHERE k >= 20""")
def prefix_regression(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    c = c.selectExpr("id", "x", "y", "x * x AS xx", "x * y AS xy", "y * y AS yy", "1 AS k")
    run = O.running_totals(c, "x", ["k", "x", "y", "xx", "xy", "yy"], tie="id")
    k = F.col("upto_k")
    sxx, sxy, syy = (F.col(f"upto_{a}{b}") - F.col(f"upto_{a}") * F.col(f"upto_{b}") / k for a, b in ("xx", "xy", "yy"))
    return run.where(k >= 20).select(
        k.cast("bigint").alias("k"), r6(sxy / sxx).alias("slope"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), (syy - sxy * sxy / sxx) / k)), 5).alias("rmse"))


@query("e8_quantile_slices", """
WITH q AS (SELECT quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS lo,
  quantile_cont(c_acctbal, [0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]) AS hi FROM customer),
b AS (SELECT i, lo[i + 1] AS lo, hi[i + 1] AS hi FROM q, range(0, 9) r(i))
SELECT i::BIGINT AS slice, count(*) AS n, round(avg(c_acctbal), 6) AS m FROM b JOIN customer ON c_acctbal BETWEEN lo AND hi GROUP BY i HAVING count(*) >= 20""")
def quantile_slices(spark, root):
    c = table(spark, root, "customer", "c_acctbal")
    probs = {f"q{i}": i * 0.1 for i in range(9)} | {f"h{i}": min(1.0, i * 0.1 + 0.15) for i in range(9)}
    facts = O.quantiles(c, "c_acctbal", probs)
    inside = [F.when(F.col("c_acctbal").between(facts.select(f"q{i}").scalar(), facts.select(f"h{i}").scalar()), F.lit(i)) for i in range(9)]
    return c.select("c_acctbal", F.explode(F.array_compact(F.array(*inside))).alias("i")).groupBy(
        F.col("i").cast("bigint").alias("slice")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c_acctbal")).alias("m")).where("n >= 20")


@query("e9_topk_per_group", """
SELECT type, brand, rank::BIGINT AS rank, value FROM (SELECT p_type AS type, p_brand AS brand, round(avg(p_retailprice), 6) AS value,
  row_number() OVER (PARTITION BY p_type ORDER BY round(avg(p_retailprice), 6) DESC, p_brand) AS rank FROM part GROUP BY 1, 2) WHERE rank <= 3""")
def top_per_group(spark, root):
    p = table(spark, root, "part", "p_type", "p_brand", "p_retailprice").groupBy(
        F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).agg(r6(F.avg("p_retailprice")).alias("value"))
    return L.top_k(p, ["type"], [F.desc("value"), F.asc("brand")], 3).select(
        "type", "brand", F.col("rank").cast("bigint").alias("rank"), "value")


@query("f1_mixed_sort_top", """
SELECT o_orderkey AS id, o_orderpriority AS pr, o_totalprice AS v FROM orders ORDER BY pr, v DESC, id LIMIT 25""")
def mixed_sort_top(spark, root):
    return table(spark, root, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pr"), F.col("o_totalprice").alias("v")).orderBy(
        "pr", F.desc("v"), "id").limit(25)


@query("f3_arg_extreme", """
SELECT p_brand AS brand, min(p_partkey) FILTER (WHERE p_retailprice = hi) AS top_id, min(p_partkey) FILTER (WHERE p_retailprice = lo) AS low_id
FROM part JOIN (SELECT p_brand AS b, max(p_retailprice) AS hi, min(p_retailprice) AS lo FROM part GROUP BY 1) ON b = p_brand GROUP BY 1""")
def arg_extreme(spark, root):
    p = table(spark, root, "part", "p_brand", "p_partkey", "p_retailprice")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("top_id"),
        F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("low_id"))


@query("f4_row_argmax", """
SELECT vec_id AS id, list_position(embedding, list_max(embedding))::BIGINT AS argmax FROM embeddings""")
def row_argmax(spark, root):
    return embedded(spark, root).select("id", F.array_position("vec", F.array_max("vec")).alias("argmax"))


@query("f6_key_sets", """
WITH a AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size <= 2), b AS (SELECT DISTINCT p_brand AS brand FROM part WHERE p_size >= 49)
SELECT brand, CASE WHEN a.brand IS NOT NULL AND b.brand IS NOT NULL THEN 'both' WHEN a.brand IS NOT NULL THEN 'left' ELSE 'right' END AS membership
FROM a FULL JOIN b USING (brand)""")
def key_sets(spark, root):
    p = table(spark, root, "part", "p_brand", "p_size")
    # One pass: membership of both sets follows from two flags.
    s = p.groupBy(F.col("p_brand").alias("brand")).agg(
        F.bool_or(F.col("p_size") <= 2).alias("a"), F.bool_or(F.col("p_size") >= 49).alias("b")).where("a or b")
    return s.select("brand", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "left").otherwise("right").alias("membership"))


@query("f7_first_per_key", """
SELECT o_custkey AS cust, o_orderkey AS id, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_key(spark, root):
    o = table(spark, root, "orders", "o_custkey", "o_orderkey", "o_totalprice").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return L.first_rows(o, ["cust"], ["id"])


@query("f9_custom_order", """
SELECT pos::BIGINT AS pos, lvl AS level, count(*) AS n FROM orders JOIN (VALUES (1, '5-LOW'), (2, '3-MEDIUM'), (3, '1-URGENT')) v(pos, lvl) ON lvl = o_orderpriority GROUP BY 1, 2""")
def custom_order(spark, root):
    wanted = F.array(F.lit("5-LOW"), F.lit("3-MEDIUM"), F.lit("1-URGENT"))
    o = table(spark, root, "orders", "o_orderpriority").withColumn("pos", F.array_position(wanted, F.col("o_orderpriority")))
    return o.where("pos > 0").groupBy("pos", F.col("o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("pos")


@query("f10_unpivot", """
SELECT p_partkey AS id, 'p_size' AS item, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def unpivot(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice").withColumn("p_size", F.col("p_size").cast("double"))
    return p.withColumnRenamed("p_partkey", "id").unpivot("id", ["p_size", "p_retailprice"], "item", "value")


@query("g1_logit", """
WITH s AS (SELECT c_custkey AS id, least(greatest(c_acctbal / 10000, 1e-6), 1 - 1e-6)::DOUBLE AS p FROM customer)
SELECT id, round(ln(p / (1 - p)), 6) + 0.0 AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM s""")
def logit_roundtrip(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal").select(
        F.col("c_custkey").alias("id"), clip(F.col("c_acctbal") / 10000, 1e-6, 1 - 1e-6).alias("p"))
    return c.select("id", r6(logit("p")).alias("logit"), r6(inverse_logit(logit("p"))).alias("back"))


@query("g5_wilson", """
WITH t AS (SELECT p_brand AS brand, count(*) AS n, sum(CASE WHEN p_size <= 5 THEN 1 ELSE 0 END)::BIGINT AS k FROM part GROUP BY 1),
u AS (SELECT *, k::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM t)
SELECT brand, k, n, round(greatest(0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS lo,
  round(least(1, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS hi FROM u""")
def wilson_interval(spark, root):
    t = table(spark, root, "part", "p_brand", "p_size").groupBy(F.col("p_brand").alias("brand")).agg(
        F.sum((F.col("p_size") <= 5).cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson("k", "n")
    return t.select("brand", "k", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("g7_text_functions", """
SELECT p_partkey AS id, upper(trim(p_name)) AS name, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe,
  (length(p_name) - length(replace(p_name, ' ', '')))::BIGINT AS blanks, CASE WHEN p_size < 5 THEN '**' WHEN p_size < 15 THEN '*' ELSE 'ns' END AS star FROM part""")
def text_functions(spark, root):
    from tessera.functions.scalar import count_of

    p = table(spark, root, "part", "p_partkey", "p_name", "p_brand", "p_size")
    return p.select(F.col("p_partkey").alias("id"), F.upper(F.trim("p_name")).alias("name"),
                    F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), safe_name("p_name").alias("safe"),
                    count_of("p_name", " ").cast("bigint").alias("blanks"), stars("p_size", 15, 5).alias("star"))


@query("h18_hash_folds", """
SELECT doc_id AS id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM labels""")
def hash_folds(spark, root):
    return table(spark, root, "labels", "doc_id").select(F.col("doc_id").alias("id"), fold_of("doc_id", 5).alias("fold"))
