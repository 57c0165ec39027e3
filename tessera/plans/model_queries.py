"""Linear algebra, models, fields, communities and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import fold_of, r6
from tessera.operators import association as A
from tessera.operators import communities as C
from tessera.operators import graph as G
from tessera.operators import linalg as LA
from tessera.operators import metrics as M
from tessera.operators import models as Md
from tessera.operators import neighbours as N
from tessera.operators import ordered as O
from tessera.operators import resample as Rs
from tessera.operators import scaling as Sc
from tessera.operators.geometry import convex_hull, grid
from tessera.operators.paths import path_blocks
from tessera.plans import registry as R
from tessera.plans.association_queries import customer_status
from tessera.plans.neighbour_queries import _profile_sets, embedded_graph, label_names, profile_graph
from tessera.plans.registry import query
from tessera.plans.stand_ins import embedded, scored_documents
from tessera.session import cut_lineage
from tessera.sources.tables import table

STATES = ["F", "O", "P"]


def customer_rows(spark, root):
    """(id, x, fold, y): customers on two standardised coordinates, order states as labels."""
    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    xy = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 5000.0 - 1).alias("b1"), (F.col("c_nationkey") / 12.0 - 1).alias("b2"))
    sets = customer_status(spark, root).select("id", "labels")
    y = F.array(*[F.array_contains("labels", s).cast("double") for s in STATES])
    # Both sides grow with the customers, however small their files are.
    return xy.join(sets.hint("merge"), "id").select("id", F.array("b1", "b2").alias("x"), fold_of("id", 5).cast("int").alias("fold"), y.alias("y"), "b1", "b2")


@query("i16_covariance", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM e)
SELECT a.k::BIGINT AS i, b.k::BIGINT AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov FROM u a JOIN u b ON a.id = b.id AND a.k <= b.k GROUP BY 1, 2""")
def covariance(spark, root):
    return LA.covariance(embedded(spark, root)).select("i", "j", r6("cov").alias("cov"))


@query("i16_pca_scores")
def pca_scores(spark, root):
    e = embedded(spark, root)
    mean, axes, _ = LA.principal_axes(e, 3)
    return LA.project(e, mean, axes).select("id", *[r6(F.col("score")[j]).alias(f"pc{j + 1}") for j in range(3)])


@query("i17_classical_scaling")
def scaling(spark, root):
    v = LA.classical_scaling(embedded(spark, root), 2)
    return v.select("id", r6(F.col("v")[0]).alias("m1"), r6(F.col("v")[1]).alias("m2"))


@query("i17_scaling_cv")
def scaling_cv(spark, root):
    """Mean over five folds of the squared correlation of distances, for one to eight coordinates."""
    t = Sc.scaling_cv(embedded(spark, root).select("id", "vec"))
    return t.groupBy("k").agg(F.count("r2").alias("folds"), r6(F.avg("r2")).alias("r2"))


@query("i15_laplacian_eigenmaps")
def eigenmaps(spark, root):
    v = LA.laplacian_eigenmaps(embedded_graph(spark, root), 3)
    return v.select("id", *[F.col("v")[j].alias(f"le{j + 1}") for j in range(3)])


@query("i13_geodesics", f"""
WITH RECURSIVE {R.embedded_nn(10)}, bi AS (SELECT DISTINCT * FROM (SELECT i AS a, j AS b, d FROM nn UNION ALL SELECT j, i, d FROM nn)),
ev AS (SELECT a, b, min(d) AS d FROM bi GROUP BY 1, 2),
walk(source, id, d) USING KEY (source, id) AS (SELECT id, id, 0.0::DOUBLE FROM e UNION
  SELECT w.source, ev.b, min(w.d + ev.d) FROM walk w JOIN ev ON ev.a = w.id LEFT JOIN recurring.walk k ON k.source = w.source AND k.id = ev.b
  WHERE k.d IS NULL OR w.d + ev.d < k.d GROUP BY w.source, ev.b)
SELECT source, id, round(d, 6) AS d FROM walk""")
def geodesics(spark, root):
    e = embedded(spark, root)
    return LA.geodesics(G.knn_graph(N.knn(e, 10), weighted=False), e).select("source", "id", r6("d").alias("d"))


@query("i18_isomap_residual")
def isomap(spark, root):
    e = embedded(spark, root)
    paths = path_blocks(G.knn_graph(N.knn(e, 10), weighted=False), e)
    coords = cut_lineage(LA.geodesic_scaling(paths, e, 3))
    return LA.isomap_residual(paths, coords, [1, 2, 3]).select("m", r6("resvar").alias("resvar"))


@query("i28_pair_agreement", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, embedding[1:2]::DOUBLE[] AS u FROM embeddings),
p AS (SELECT list_distance(a.v, b.v) AS x, list_distance(a.u, b.u) AS y FROM e a JOIN e b ON a.id < b.id),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p WHERE x > 0 AND y > 0)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(sqrt(sum((x - y) * (x - y)) / sum(x * x)), 6) AS stress1 FROM k""")
def pair_agreement(spark, root):
    e = embedded(spark, root)
    t = LA.pair_agreement(e, e.select("id", F.slice("vec", 1, 2).alias("v")))
    return t.select("n", *[r6(c).alias(c) for c in ("pearson", "spearman", "stress1")])


@query("i35_ami", f"""
WITH t AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT x, sum(n) AS r FROM t GROUP BY x), s AS (SELECT y, sum(n) AS s FROM t GROUP BY y),
k AS (SELECT sum(n) AS t FROM t), mi AS (SELECT sum(n / k.t * ln(k.t * n / (r * s))) AS mi FROM t JOIN r USING (x) JOIN s USING (y), k),
em AS (SELECT sum(list_sum(list_transform(range(greatest(1, (r + s - k.t)::BIGINT), least(r, s)::BIGINT + 1), lambda q: exp({R.lf('r')} - {R.lf('q')} - {R.lf('r - q')} + {R.lf('k.t - r')} - {R.lf('s - q')} - {R.lf('k.t - r - s + q')} - {R.lf('k.t')} + {R.lf('s')} + {R.lf('k.t - s')}) * q / k.t * ln(k.t * q / (r * s))))) AS emi FROM r, s, k),
h AS (SELECT greatest((SELECT -sum(r / t * ln(r / t)) FROM r, k), (SELECT -sum(s / t * ln(s / t)) FROM s, k)) AS h)
SELECT round(mi, 6) AS mi, round(emi, 6) AS emi, round((mi - emi) / (h - emi), 6) + 0.0 AS ami FROM mi, em, h""")
def ami(spark, root):
    t = G.adjusted_information(table(spark, root, "orders", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")
    return t.select(*[r6(c).alias(c) for c in t.columns])


@query("j35_kde", """
WITH g AS (SELECT -0.3 + ix * 0.6 / 9 AS gx, -0.3 + iy * 0.6 / 9 AS gy FROM range(0, 10) a(ix), range(0, 10) b(iy)),
p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT round(gx::DOUBLE, 6) + 0.0 AS gx, round(gy::DOUBLE, 6) + 0.0 AS gy, round(avg(exp(-0.5 * (((gx - x) / 0.1)*((gx - x) / 0.1) + ((gy - y) / 0.1)*((gy - y) / 0.1)))) / (2 * pi() * 0.01), 6) AS density FROM g, p GROUP BY gx, gy""")
def kde(spark, root):
    p = embedded(spark, root).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    t = LA.kernel_density(p, grid(spark, (-0.3, 0.3), (-0.3, 0.3), 10, 10), "x", "y", 0.1, 0.1)
    return t.select(r6("gx").alias("gx"), r6("gy").alias("gy"), r6("density").alias("density"))


@query("j8_whitening")
def whitening(spark, root):
    c = table(spark, root, "customer", "c_custkey", "c_acctbal", "c_nationkey").withColumn("n", F.col("c_nationkey").cast("double"))
    w = LA.plain_whitening(c, "c_acctbal", "n")
    return w.select(F.col("c_custkey").alias("id"), r6("u1").alias("u1"), r6("u2").alias("u2"))


@query("j8_robust_centre")
def robust_centre(spark, root):
    c = table(spark, root, "customer", "c_acctbal", "c_nationkey").withColumn("n", F.col("c_nationkey").cast("double"))
    centre, cov = LA.robust_whitening(c, "c_acctbal", "n")
    rows = [("c_acctbal", float(centre[0]), float(cov[0, 0]), float(cov[0, 1])), ("c_nationkey", float(centre[1]), float(cov[1, 1]), float(cov[0, 1]))]
    return spark.createDataFrame(rows, "item string, centre double, var double, cov double")


@query("b23_convex_hull")
def hull(spark, root):
    return convex_hull(table(spark, root, "customer", "c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey").select("pos", "x", "y")


@query("j11_ols_oof", """
WITH d AS (SELECT doc_id AS id, quality::DOUBLE AS y, ln(n_chars::DOUBLE + 1) AS x, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM labels JOIN documents USING (doc_id)),
f AS (SELECT h.fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM (SELECT DISTINCT fold FROM d) h JOIN d ON d.fold <> h.fold GROUP BY h.fold)
SELECT id, round(y - i - s * x, 6) + 0.0 AS residual FROM d JOIN f USING (fold)""")
def ols_oof(spark, root):
    d = table(spark, root, "labels", "doc_id", "quality").join(table(spark, root, "documents", "doc_id", "n_chars"), "doc_id")
    d = d.select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.ln(F.col("n_chars").cast("double") + 1).alias("x"), fold_of("doc_id", 5).alias("fold"))
    return Md.ols_out_of_fold(d).select("id", r6("residual").alias("residual"))


@query("h11_r2_two_regressors", """
WITH c AS (SELECT c_acctbal AS y, c_nationkey::DOUBLE AS a, length(c_mktsegment)::DOUBLE AS b FROM customer), k AS (SELECT corr(y, a) AS ra, corr(y, b) AS rb, corr(a, b) AS ab FROM c)
SELECT round((ra*ra + rb*rb - 2*ra*rb*ab) / (1 - ab*ab), 6) AS r2 FROM k""")
def r2_two(spark, root):
    c = table(spark, root, "customer", "c_acctbal", "c_nationkey", "c_mktsegment").select(
        F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("a"), F.length("c_mktsegment").cast("double").alias("b"))
    return Md.r2_two(c, "y", "a", "b").select(r6("r2").alias("r2"))


@query("h13_pseudo_f", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS c FROM embeddings), n AS (SELECT count(*) AS n, count(DISTINCT c) AS g FROM e),
p AS (SELECT a.c, b.c AS c2, list_distance(a.v, b.v) * list_distance(a.v, b.v) AS d2 FROM e a JOIN e b ON a.id < b.id), k AS (SELECT c, count(*) AS k FROM e GROUP BY c),
t AS (SELECT sum(d2) / any_value(n) AS total FROM p, n), w AS (SELECT sum(d2 / k) AS within FROM p JOIN k USING (c) WHERE p.c = p.c2)
SELECT round((total - within) / (g - 1) / (within / (n - g)), 6) AS f, round((total - within) / total, 6) AS r2 FROM t, w, n""")
def pseudo_f(spark, root):
    return Rs.permanova(embedded(spark, root)).select(r6("f").alias("f"), r6("r2").alias("r2"))


@query("h13_permanova")
def permanova(spark, root):
    return Rs.permanova(embedded(spark, root), 99)


@query("h11_permuted_r2")
def permuted_r2(spark, root):
    d = customer_rows(spark, root).select("id", "b1", "b2", "fold").withColumn("v", F.col("b1") * F.col("b2") + F.col("b2"))
    return Rs.permuted_r2(d, "v", "b1", "b2", "fold", 99)


@query("h12_fibre_permutation")
def fibre_permutation(spark, root):
    e = embedded(spark, root)
    return Rs.neighbour_mean_r2(N.knn(e, 10), e.select("id", F.col("vec")[0].alias("y")), 99)


@query("h9_bootstrap_metrics")
def bootstrap_metrics(spark, root):
    d = scored_documents(spark, root).withColumn("label", F.lit("quality"))
    draws = cut_lineage(Rs.stratified_bootstrap(cut_lineage(M.score_table(d, by=["label"])), 1000))
    out = None
    for c in ("auc", "auprc", "auprg", "brier", "brier_r2"):
        part = Rs.interval(draws, c, ["label"]).withColumn("metric", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out.select("label", "metric", "lo", "hi")


@query("h10_paired_delta_auc")
def paired_delta(spark, root):
    d = scored_documents(spark, root).withColumn("label", F.lit("quality"))
    other = d.withColumn("s", (F.xxhash64("id") % 1000).cast("double"))
    both = d.withColumn("model", F.lit("length")).unionByName(other.withColumn("model", F.lit("hash")))
    return Rs.paired_delta(cut_lineage(Rs.bootstrap_auc(both, 1000)), "hash", "length")


@query("q3_localisation_p")
def localisation(spark, root):
    g, sets = _profile_sets(spark, root)
    return Rs.shuffled_localisation(g, sets, label_names(spark, root), 199)


@query("i29_communities")
def communities(spark, root):
    return C.louvain(profile_graph(spark, root, 9, "mutual"), 0.75).select("id", "community")


@query("i32_community_nulls")
def community_nulls(spark, root):
    g = cut_lineage(profile_graph(spark, root, 9, "mutual"))
    g0 = g.withColumn("g", F.lit(0).cast("bigint"))
    observed = C.modularity_by_graph(g0, C.louvain(g0)).select("q")
    weights = cut_lineage(Rs.shuffled_weights(g, 50))
    null = cut_lineage(C.modularity_by_graph(weights, C.louvain(weights)).select("q"))
    facts = null.agg(F.avg("q").alias("mu"), F.stddev_samp("q").alias("sd"))
    p = Rs.monte_carlo_p(observed, null, "q")
    return p.select("q", "p", ((F.col("q") - facts.select("mu").scalar()) / facts.select("sd").scalar()).alias("z"))


@query("h14_degree_null")
def degree_null(spark, root):
    g = cut_lineage(profile_graph(spark, root, 9, "mutual"))
    null = Rs.rewired(g, 10, 6)
    return C.modularity_by_graph(null, C.louvain(null)).select("g", "q")


@query("i51_k_sweep")
def k_sweep(spark, root):
    """Communities of the k x variant grid in one run, against the first cell."""
    cells, edges = [(5, "union"), (5, "mutual"), (9, "union"), (9, "mutual")], None
    for i, (k, mode) in enumerate(cells):
        part = profile_graph(spark, root, k, mode).withColumn("g", F.lit(i).cast("bigint"))
        edges = part if edges is None else edges.unionByName(part)
    edges = cut_lineage(edges)
    m = cut_lineage(C.louvain(edges))
    q = C.modularity_by_graph(edges, m)
    n = m.groupBy("g").agg(F.countDistinct("community").alias("n_communities"))
    names = F.element_at(F.array(*[F.lit(f"{k}-{mode}") for k, mode in cells]), F.col("g").cast("int") + 1)
    return q.join(n, "g").select(names.alias("cell"), "q", "n_communities")


@query("j2_label_fields")
def label_fields(spark, root):
    rows = cut_lineage(customer_rows(spark, root))
    return Md.field(rows, grid(spark, (-1, 1), (-1, 1), 40, 40, 0.05), STATES, 30)


@query("h16_max_z_threshold")
def max_z(spark, root):
    rows = cut_lineage(customer_rows(spark, root))
    return Md.max_z_threshold(rows, STATES, grid(spark, (-1, 1), (-1, 1), 12, 12), 50, 30)


@query("j10_foldsafe_residuals")
def foldsafe_residuals(spark, root):
    e = embedded(spark, root).select("id", F.slice("vec", 1, 2).alias("x"), fold_of("id", 5).cast("int").alias("fold"), F.slice("vec", 3, 4).alias("y"))
    e = cut_lineage(e)
    return Md.residuals(e, ["v3", "v4", "v5", "v6"], Md.additive_basis(e, 2, 6)).select("id", "label", r6("e").alias("e"))


@query("j17_ridge_oof_auc")
def ridge_auc(spark, root):
    rows = cut_lineage(customer_rows(spark, root))
    oof, _ = Md.ridge_logistic(rows, STATES, 2)
    t = cut_lineage(M.score_table(oof.withColumn("s", F.col("p")), by=["label"]))
    return M.auc(t, ["label"]).select("label", r6("auc").alias("auc"))


@query("j19_stacked_oof")
def stacked_oof(spark, root):
    e = embedded(spark, root)
    rows = cut_lineage(e.select("id", F.slice("vec", 1, 6).alias("x"), fold_of("id", 5).cast("int").alias("fold"),
                                F.array((F.col("cluster") < 5).cast("double"), (F.col("vec")[7] > 0).cast("double")).alias("y")))
    return Md.stacked(rows, ["low_label", "sign"], 2)


@query("j20_additive_vs_surface")
def additive_vs_surface(spark, root):
    rows = cut_lineage(customer_rows(spark, root))
    add = Md.out_of_fold(rows, STATES, Md.additive_basis(rows, 2, 8)).select("label", "id", "y", F.col("p").alias("pa"))
    full = Md.out_of_fold(rows, STATES, Md.surface_basis(rows, 30)).select("label", "id", F.col("p").alias("pf"))
    t = add.join(full, ["label", "id"])
    gap = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    null = F.avg("y") * (1 - F.avg("y"))
    return t.groupBy("label").agg((1 - gap("pa") / null).alias("r2_add"), (1 - gap("pf") / null).alias("r2_full"))


@query("j30_item_interaction")
def item_interaction(spark, root):
    """Held-out squared error of an added item against an item whose effect varies over the plane."""
    e = embedded(spark, root)
    out = None
    for item in (3, 4):
        rows = cut_lineage(e.select("id", F.array(F.col("vec")[0], F.col("vec")[1], F.col("vec")[item]).alias("x"), fold_of("id", 5).cast("int").alias("fold"),
                                    F.array((F.col("cluster") < 5).cast("double")).alias("y")))
        a = Md.out_of_fold(rows, ["low_label"], Md.surface_basis(rows, 16, "added")).select("id", "label", "y", F.col("p").alias("pa"))
        v = Md.out_of_fold(rows, ["low_label"], Md.surface_basis(rows, 16, "varying")).select("id", "label", F.col("p").alias("pv"))
        t = cut_lineage(a.join(v, ["id", "label"]).withColumn("d", F.pow(F.col("pa") - F.col("y"), 2) - F.pow(F.col("pv") - F.col("y"), 2)))
        z = M.signed_rank(t).select("z").scalar()
        null = F.var_pop("y")
        row = t.agg((1 - F.avg(F.pow(F.col("pa") - F.col("y"), 2)) / null).alias("r2_add"), (1 - F.avg(F.pow(F.col("pv") - F.col("y"), 2)) / null).alias("r2_int"))
        from tessera.functions import exact

        row = row.select(F.lit(f"v{item}").alias("item"), F.lit("low_label").alias("label"), "r2_add", "r2_int", z.alias("z")).withColumn("p", exact.normal_cdf(-F.col("z")))
        out = row if out is None else out.unionByName(row)
    return O.benjamini_hochberg(out, "p", "q", ["label"])


@query("i39_soft_memberships")
def soft_memberships(spark, root):
    from tessera.operators import soft_clusters as S

    rows = cut_lineage(customer_rows(spark, root))
    fit = Md.fit(rows, STATES, Md.surface_basis(rows, 16))
    p = Md.predict(rows, fit).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda e: e["p"]).alias("p"))
    p = cut_lineage(p)
    edges = cut_lineage(G.knn_graph(N.knn(rows.select("id", F.col("x").alias("vec")), 15), floor=1e-10))
    _, best = S.sweep(p, edges, [2, 3, 4], [0.0, 0.05, 0.1, 0.2, 0.4, 0.8], 2, starts=3, n_iter=700)
    return best.select("id", F.posexplode("u").alias("cluster", "share"))


@query("i5_weight_optimiser")
def weight_optimiser(spark, root):
    from tessera.operators import encoding as E
    from tessera.operators import weights as W

    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    items = ["p_size", "p_retailprice", "p_brand", "p_type"]
    pts, _ = E.gower_points(p, "p_partkey", items[:2], items[2:])
    w, _ = W.optimise(cut_lineage(pts), 2, items)
    return spark.createDataFrame([(k, float(v)) for k, v in w.items()], "item string, weight double")
