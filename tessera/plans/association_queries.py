"""Label-by-cluster association over whole order and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import r6, stars
from tessera.operators import association as A
from tessera.operators import labels as L
from tessera.plans import registry as R
from tessera.plans.registry import query
from tessera.plans.stand_ins import assigned_orders, order_labels
from tessera.sources.tables import table


def _cells(spark, root, label="p_type"):
    return A.cells(assigned_orders(spark, root, label))


@query("d4_contingency", f"""
WITH {R.assigned()} SELECT cluster, label, count(*) AS n FROM sub JOIN ids USING (id) GROUP BY 1, 2""")
def contingency(spark, root):
    return _cells(spark, root).select("cluster", "label", F.col("a").alias("n")).where("n > 0")


_RES = f"""WITH {R.assigned()},
t AS (SELECT cluster, label, count(*)::DOUBLE AS o FROM sub JOIN ids USING (id) GROUP BY 1, 2),
m AS (SELECT cluster, label, o, sum(o) OVER (PARTITION BY cluster) AS r, sum(o) OVER (PARTITION BY label) AS c, sum(o) OVER () AS n FROM t),
x AS (SELECT *, r * c / n AS e FROM m),
zz AS (SELECT *, (o - e) / sqrt(e * (1 - r/n) * (1 - c/n)) AS z FROM x)"""


@query("d5_pearson_resid", _RES + """
SELECT cluster, label, o::BIGINT AS obs, round(e, 6) AS expected, round((o - e) / sqrt(e), 6) + 0.0 AS resid FROM x""")
def pearson(spark, root):
    return A.pearson_residuals(_cells(spark, root)).select("cluster", "label", "obs", r6("expected").alias("expected"), r6("resid").alias("resid"))


@query("d6_adj_resid", _RES + f""",
pp AS (SELECT *, {R.two_sided_normal('z')} AS p FROM zz), b AS (SELECT *, {R.raw_bh('p')} AS raw FROM pp)
SELECT cluster, label, round(z, 6) + 0.0 AS z, round(p, 6) AS p, round({R.bh('p')}, 6) AS q FROM b""")
def adjusted(spark, root):
    return A.residual_map(_cells(spark, root)).select("cluster", "label", r6("z").alias("z"), r6("p").alias("p"), r6("q").alias("q"))


@query("d7_cramers_v", """
WITH t AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e FROM t)
SELECT round(sum((o-e)*(o-e)/e), 6) AS chi2, sum(o)::BIGINT AS n,
  round(sqrt(sum((o-e)*(o-e)/e) / (sum(o) * least(count(DISTINCT x) - 1, count(DISTINCT y) - 1))), 6) AS v FROM m""")
def cramers_v(spark, root):
    return A.cramers_v(table(spark, root, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority").select(
        r6("chi2").alias("chi2"), "n", r6("v").alias("v"))


@query("h1_fisher_greater", f"""
WITH {R.cells()} SELECT cluster, label, round({R.fisher_greater()}, 6) AS p FROM cell""")
def fisher_greater(spark, root):
    from tessera.functions import exact

    return _cells(spark, root).select("cluster", "label", r6(exact.fisher_greater("a", "b", "c", "d")).alias("p"))


@query("h2_fisher_two_sided", f"""
WITH {R.cells()} SELECT cluster, label, round({R.fisher_two_sided()}, 6) AS p FROM cell""")
def fisher_two_sided(spark, root):
    from tessera.functions import exact

    return _cells(spark, root).select("cluster", "label", r6(exact.fisher_two_sided("a", "b", "c", "d")).alias("p"))


@query("h3_conditional_odds_ratio")
def conditional_odds_ratio(spark, root):
    from tessera.functions import exact

    return A.with_lifts(_cells(spark, root, "p_brand")).select(
        "cluster", "label", r6("odds_ratio").alias("odds_ratio"), r6(exact.conditional_odds_ratio("a", "b", "c", "d")).alias("or_cmle"))


@query("h4_binomial", f"""
WITH {R.cells()}, u AS (SELECT *, (a + b)::DOUBLE / n AS pa FROM cell)
SELECT cluster, label, round({R.binomial('a', 'n_in', 'pa')}, 6) AS p FROM u""")
def binomial(spark, root):
    from tessera.functions import exact

    t = A.with_lifts(_cells(spark, root))
    return t.select("cluster", "label", r6(exact.binomial_by_direction("a", "n_in", "prev_all")).alias("p"))


_OK = "a + b >= 10 AND a >= 5 AND b >= 5"


@query("q1_audit", f"""
WITH {R.cells('p_brand')}
SELECT label, cluster, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, n_in::BIGINT AS n_in, (n - n_in)::BIGINT AS n_out,
  round(a::DOUBLE / n_in, 6) AS prev_in, round((a + b)::DOUBLE / n, 6) AS prev_all, round((a::DOUBLE / n_in) / ((a + b)::DOUBLE / n), 6) AS lift_overall,
  round(CASE WHEN {_OK} AND n > n_in THEN {R.fisher_two_sided()} ELSE {R.binomial('a', 'n_in', '((a + b)::DOUBLE / n)')} END, 6) AS p FROM cell""")
def audit(spark, root):
    t = A.audit(_cells(spark, root, "p_brand"))
    return t.select("label", "cluster", "a", "b", "c", "d", "n_in", (F.col("n") - F.col("n_in")).alias("n_out"), r6("prev_in").alias("prev_in"),
                    r6("prev_all").alias("prev_all"), r6("lift_overall").alias("lift_overall"), r6("p").alias("p"))


def enrichment_sql(label: str) -> str:
    return f"""WITH {R.cells(label)},
    t AS (SELECT *, a::DOUBLE / n_in AS prev_in, (a::DOUBLE / n_in) / ((a + b)::DOUBLE / n) AS lift, CASE WHEN b > 0 AND c > 0 THEN (a::DOUBLE * d) / (b::DOUBLE * c) END AS orr,
      {R.fisher_greater()} AS p FROM cell WHERE {_OK}),
    u AS (SELECT *, {R.raw_bh('p', 'cluster')} AS raw FROM t),
    w AS (SELECT *, {R.bh('p', 'cluster')} AS q, 1.96::DOUBLE AS z FROM u)
    SELECT cluster, label, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, n_in::BIGINT AS n_in, round(prev_in, 6) AS prev_in,
      round(lift, 6) AS lift_overall, round(orr, 6) AS odds_ratio, round(p, 6) AS p, round(q, 6) AS q,
      round(greatest(0, ((prev_in + z*z/(2*n_in)) - z * sqrt(prev_in*(1-prev_in)/n_in + z*z/(4.0*n_in*n_in))) / (1 + z*z/n_in)), 6) AS lo,
      round(least(1, ((prev_in + z*z/(2*n_in)) + z * sqrt(prev_in*(1-prev_in)/n_in + z*z/(4.0*n_in*n_in))) / (1 + z*z/n_in)), 6) AS hi FROM w"""


def enrichment_query(spark, root, label="p_type"):
    from tessera.functions.scalar import wilson

    lo, hi = wilson("a", "n_in")
    t = A.enrichment(_cells(spark, root, label))
    return t.select("cluster", "label", "a", "b", "c", "d", "n_in", r6("prev_in").alias("prev_in"), r6("lift_overall").alias("lift_overall"),
                    r6("odds_ratio").alias("odds_ratio"), r6("p").alias("p"), r6("q").alias("q"), r6(lo).alias("lo"), r6(hi).alias("hi"))


query("q2_enrichment", enrichment_sql("p_type"))(enrichment_query)


@query("q2_enrichment_wide", enrichment_sql("p_brand"))
def enrichment_wide(spark, root):
    return enrichment_query(spark, root, "p_brand")


@query("q6_overrep", f"""
WITH {R.cells('p_brand')}, t AS (SELECT *, {R.fisher_greater()} AS p, (a::DOUBLE / n_in) / (b::DOUBLE / (n - n_in)) AS lift FROM cell),
u AS (SELECT *, {R.raw_bh('p')} AS raw FROM t), w AS (SELECT *, {R.bh('p')} AS q FROM u)
SELECT cluster, label, n_in::BIGINT AS n_in, a::BIGINT AS pos_in, b::BIGINT AS pos_out, round(lift, 6) AS lift_out, round(log2(greatest(lift, 1e-12)), 6) + 0.0 AS log2_lift,
  round(p, 6) AS p, round(q, 6) AS q, CASE WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS star FROM w""")
def over_representation(spark, root):
    t = A.over_representation(_cells(spark, root, "p_brand"))
    return t.select("cluster", "label", "n_in", F.col("a").alias("pos_in"), F.col("b").alias("pos_out"), r6("lift_out").alias("lift_out"),
                    r6("log2_lift").alias("log2_lift"), r6("p").alias("p"), r6("q").alias("q"), "star")


def ref_sql(keep: str = "TRUE") -> str:
    return f"""
t AS (SELECT cell.*, a::DOUBLE / n_in AS prev_in, pr AS prev_ref FROM cell JOIN ref USING (label)),
p0 AS (SELECT *, prev_in / prev_ref AS lift, CASE WHEN {_OK} AND n > n_in THEN {R.fisher_greater()} ELSE {R.binomial('a', 'n_in', 'prev_ref')} END AS p FROM t),
u AS (SELECT *, {R.raw_bh('p', 'cluster')} AS raw FROM p0), w AS (SELECT *, {R.bh('p', 'cluster')} AS q FROM u)
SELECT cluster, label, a::BIGINT AS a, n_in::BIGINT AS n_in, round(lift, 6) AS lift_ref, round(least(greatest(log2(greatest(lift, 1e-12)), -2.0), 2.0), 6) + 0.0 AS val,
  round(p, 6) AS p, round(q, 6) AS q FROM w WHERE {keep}"""


@query("q7_overrep_ref", f"""
WITH {R.cells('p_brand')},
ref AS (SELECT p_brand AS label, count(DISTINCT l_orderkey)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN part ON l_partkey = p_partkey) AS pr
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),{ref_sql()}""")
def over_representation_ref(spark, root):
    a = assigned_orders(spark, root, "p_brand")
    ref = L.label_counts(order_labels(spark, root, "p_brand")).withColumnRenamed("prev", "prev_ref")
    t = A.over_representation_ref(A.cells(a), ref)
    return t.select("cluster", "label", "a", "n_in", r6("lift_ref").alias("lift_ref"), r6("val").alias("val"), r6("p").alias("p"), r6("q").alias("q"))


def customer_status(spark, root):
    """Customers with their set of order states; segment is the cluster, no orders means no labels."""
    o = table(spark, root, "orders", "o_custkey", "o_orderstatus")
    sets = L.label_sets(o.withColumnsRenamed({"o_custkey": "id", "o_orderstatus": "label"}), "id", "label")
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cluster"))
    return c.join(sets, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


_CUST = """sub0 AS (SELECT DISTINCT o_custkey AS id, o_orderstatus AS label FROM orders JOIN customer ON o_custkey = c_custkey),
all_ids AS (SELECT c_custkey AS id, c_mktsegment AS cluster FROM customer),
none AS (SELECT cluster, avg(CASE WHEN s.id IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM all_ids LEFT JOIN (SELECT DISTINCT id FROM sub0) s USING (id) GROUP BY 1),
overall AS (SELECT avg(CASE WHEN s.id IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM all_ids LEFT JOIN (SELECT DISTINCT id FROM sub0) s USING (id)),
gone AS (SELECT none.cluster FROM none, overall WHERE none.share > overall.share ORDER BY none.share DESC, none.cluster LIMIT 1),
ids AS (SELECT * FROM all_ids WHERE cluster NOT IN (SELECT cluster FROM gone)),
sub AS (SELECT sub0.* FROM sub0 JOIN ids USING (id)),"""


@query("q8_exclude", "WITH " + _CUST + R.cells().split("ON o_orderkey = id),", 1)[-1].split("ON id = o_orderkey),", 1)[-1] + f""",
ref AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM all_ids) AS pr FROM sub0 GROUP BY label),{ref_sql()}""")
def exclude_unlabelled(spark, root):
    a = customer_status(spark, root)
    ref = L.label_counts(a).withColumnRenamed("prev", "prev_ref")
    t = A.over_representation_ref(A.cells(A.excluding_unlabelled(a)), ref)
    return t.select("cluster", "label", "a", "n_in", r6("lift_ref").alias("lift_ref"), r6("val").alias("val"), r6("p").alias("p"), r6("q").alias("q"))


def _wilson_sql(k, n, side):
    p, z = f"({k}::DOUBLE / ({n}))", "1.96::DOUBLE"
    sign, fn, lim = ("-", "greatest", "0") if side == "lo" else ("+", "least", "1")
    return f"round({fn}({lim}, (({p} + {z}*{z}/(2*({n}))) {sign} {z} * sqrt({p}*(1-{p})/({n}) + {z}*{z}/(4.0*({n})*({n})))) / (1 + {z}*{z}/({n}))), 6)"


@query("q9_detail", f"""
WITH {R.cells('p_brand')}
SELECT cluster, label, round(a::DOUBLE / n_in, 6) AS prev_in, {_wilson_sql('a', 'n_in', 'lo')} AS lo_in, {_wilson_sql('a', 'n_in', 'hi')} AS hi_in,
  round(b::DOUBLE / (n - n_in), 6) AS prev_out, {_wilson_sql('b', 'n - n_in', 'lo')} AS lo_out, {_wilson_sql('b', 'n - n_in', 'hi')} AS hi_out FROM cell""")
def detail(spark, root):
    t = A.detail(_cells(spark, root, "p_brand"))
    return t.select("cluster", "label", *[r6(c).alias(c) for c in t.columns[2:]])


@query("q10_cooccurrence", f"""
WITH {R.sub('p_brand')}, t AS (SELECT count(DISTINCT id) AS n FROM sub), k AS (SELECT label, count(*) AS m FROM sub GROUP BY label),
ab AS (SELECT x.label AS la, y.label AS lb, count(*) AS nab FROM sub x JOIN sub y ON x.id = y.id AND x.label < y.label GROUP BY 1, 2),
g AS (SELECT ka.label AS la, kb.label AS lb, coalesce(nab, 0) AS a, ka.m - coalesce(nab, 0) AS b, kb.m - coalesce(nab, 0) AS c, n - ka.m - kb.m + coalesce(nab, 0) AS d, ka.m AS ma, kb.m AS mb, n
  FROM k ka JOIN k kb ON ka.label < kb.label CROSS JOIN t LEFT JOIN ab ON ab.la = ka.label AND ab.lb = kb.label WHERE ka.m < n AND kb.m < n)
SELECT la AS label_a, lb AS label_b, round(a::DOUBLE * n / (ma::DOUBLE * mb), 6) AS lift, round({R.fisher_two_sided()}, 6) AS p,
  CASE WHEN {R.fisher_two_sided()} < 0.01 THEN '**' WHEN {R.fisher_two_sided()} < 0.05 THEN '*' ELSE 'ns' END AS star FROM g""")
def co_occurrence(spark, root):
    t = A.lift_pairs(L.co_occurrence(order_labels(spark, root, "p_brand")))
    return t.select(F.col("a").alias("label_a"), F.col("b").alias("label_b"), r6("lift").alias("lift"), r6("p").alias("p"), stars("p").alias("star"))


@query("q13_cluster_resid", f"""
WITH t AS (SELECT o_orderstatus AS cluster, o_orderpriority AS label, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY cluster) AS r, sum(o) OVER (PARTITION BY label) AS c, sum(o) OVER () AS n FROM t),
zz AS (SELECT cluster, label, o, r*c/n AS e, (o - r*c/n) / sqrt(r*c/n * (1 - r/n) * (1 - c/n)) AS z FROM m),
pp AS (SELECT *, {R.two_sided_normal('z')} AS p FROM zz), b AS (SELECT *, {R.raw_bh('p')} AS raw FROM pp)
SELECT cluster, label, o::BIGINT AS obs, round(e, 6) AS expected, round(z, 6) + 0.0 AS z, round(p, 6) AS p, round({R.bh('p')}, 6) AS q FROM b""")
def cluster_residuals(spark, root):
    t = table(spark, root, "orders", "o_orderstatus", "o_orderpriority").groupBy(
        F.col("o_orderstatus").alias("cluster"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("a"))
    return A.residual_map(t).select("cluster", "label", "obs", r6("expected").alias("expected"), r6("z").alias("z"), r6("p").alias("p"), r6("q").alias("q"))
