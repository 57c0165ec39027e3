"""Results that combine several operators: majors, absorption, ablation, summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import exact
from tessera.functions.scalar import fold_of, r6
from tessera.operators import absorption as Ab
from tessera.operators import association as A
from tessera.operators import communities as C
from tessera.operators import encoding as E
from tessera.operators import graph as G
from tessera.operators import intrinsic as I
from tessera.operators import labels as L
from tessera.operators import linalg as LA
from tessera.operators import models as Md
from tessera.operators import neighbours as N
from tessera.operators import ordered as O
from tessera.operators import resample as Rs
from tessera.plans import registry as R
from tessera.plans.model_queries import STATES, customer_rows
from tessera.plans.neighbour_queries import _profile_sets, embedded_graph, label_names, order_profiles, weighted_auc
from tessera.plans.registry import query
from tessera.plans.stand_ins import assigned_orders, embedded, order_labels
from tessera.session import cut_lineage
from tessera.sources.tables import table

_UNIT = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("q5_majors", f"""
WITH {R.cells('p_brand')},
t AS (SELECT *, a::DOUBLE / n_in AS prev_in, CASE WHEN b > 0 AND c > 0 THEN (a::DOUBLE * d) / (b::DOUBLE * c) END AS orr,
  {R.fisher_greater()} AS p FROM cell WHERE a + b >= 10 AND a >= 5 AND b >= 5),
u AS (SELECT *, {R.raw_bh('p', 'cluster')} AS raw FROM t),
w AS (SELECT *, {R.bh('p', 'cluster')} AS q FROM u),
a AS (SELECT DISTINCT label FROM w WHERE q <= 0.05 AND prev_in >= 0.10 AND orr >= 2),
g AS (SELECT label FROM lb, tot WHERE n_pos::DOUBLE / n >= 0.03 OR n_pos >= 5)
SELECT label FROM a JOIN g USING (label)""")
def majors(spark, root):
    """Labels enriched in a cluster after false-discovery control, with prevalence and odds limits, inside the gate."""
    t = A.enrichment(A.cells(assigned_orders(spark, root, "p_brand")))
    gate = (F.col("prev_all") >= 0.03) | (F.col("a") + F.col("b") >= 5)
    return t.where((F.col("major") == 1) & gate).select("label").distinct()


@query("q5_majors_three_pillars")
def majors_three(spark, root):
    """Union of enrichment, localisation and neighbour-AUC labels inside the prevalence gate."""
    a = A.enrichment(A.cells(assigned_orders(spark, root))).where("major = 1").select("label")
    g, sets = _profile_sets(spark, root)
    local = Rs.shuffled_localisation(g, sets, label_names(spark, root), 99).where("p <= 0.05").select("label")
    pr = cut_lineage(L.profiles(order_labels(spark, root), "id"))
    pred = weighted_auc(pr, label_names(spark, root)).where("auc >= 0.70").select("label")
    counts = L.label_counts(order_labels(spark, root)).where("prev >= 0.03 or n1 >= 5").select("label")
    return a.union(local).union(pred).distinct().join(counts, "label", "left_semi")


@query("q12_summary", f"""
WITH {R.profiles()}, t AS (SELECT (SELECT count(*) FROM sets) AS n_subjects, count(*) AS n_profiles, max(mult) AS top_mult, (SELECT count(DISTINCT label) FROM sub) AS n_labels FROM pr)
SELECT n_subjects, n_profiles, n_labels, top_mult, round(n_profiles::DOUBLE / n_subjects, 6) AS ratio FROM t""")
def run_summary(spark, root):
    pr = cut_lineage(L.profiles(order_labels(spark, root), "id"))
    n_labels = pr.select(F.explode("labels").alias("l")).distinct().agg(F.count(F.lit(1))).scalar()
    t = pr.agg(F.sum("mult").alias("n_subjects"), F.count(F.lit(1)).alias("n_profiles"), F.max("mult").alias("top_mult"))
    return t.select("n_subjects", "n_profiles", n_labels.alias("n_labels"), "top_mult", r6(F.col("n_profiles") / F.col("n_subjects")).alias("ratio"))


@query("q11_selection_frequency")
def selection_frequency(spark, root):
    """How often each label is a major one in bootstrap draws of subjects, with a binomial interval.

    A draw gives every (cluster, profile) group a Poisson weight in total: the
    sum of its subjects' Poisson(1) weights.  Inside a draw majors are chosen as
    in `q5_majors`; a draw counts as a trial of the labels it could have chosen.
    """
    reps = 200
    a = assigned_orders(spark, root, "p_brand").select("id", "cluster", "labels")
    flat = cut_lineage(Rs.poisson_counts(a, ["cluster", "labels"], reps).where("w > 0"))
    size = flat.groupBy("rep", "cluster").agg(F.sum("w").cast("bigint").alias("n_in"))
    pos = flat.select("rep", "cluster", "w", F.explode("labels").alias("label")).groupBy("rep", "cluster", "label").agg(F.sum("w").cast("bigint").alias("a"))
    tot = pos.groupBy("rep", "label").agg(F.sum("a").alias("n_pos"))
    n = size.groupBy("rep").agg(F.sum("n_in").alias("n"))
    t = pos.join(size, ["rep", "cluster"]).join(tot, ["rep", "label"]).join(n, "rep").select(
        "rep", "cluster", "label", "a", (F.col("n_pos") - F.col("a")).alias("b"), (F.col("n_in") - F.col("a")).alias("c"),
        (F.col("n") - F.col("n_in") - F.col("n_pos") + F.col("a")).alias("d"), "n_in", "n")
    t = A.enrichment(t, within=("rep", "cluster"))
    gate = (F.col("prev_all") >= 0.03) | (F.col("a") + F.col("b") >= 5)
    picked = t.where(gate).groupBy("rep", "label").agg(F.max("major").alias("major")).groupBy("label").agg(
        F.sum("major").alias("count"), F.count(F.lit(1)).alias("trials"))
    freq = picked.withColumn("freq", F.col("count") / F.col("trials"))
    q = lambda u: exact.binomial_quantile(F.lit(u), "trials", "freq") / F.col("trials")
    return freq.select("label", "count", "trials", "freq", q(0.025).alias("lo"), q(0.975).alias("hi"))


@query("i33_absorb_support", f"""
WITH {R.embedded_nn(10)}, {R.graph('union', 2.0)}, bi AS (SELECT src, dst, w, d FROM ed UNION ALL SELECT dst, src, w, d FROM ed),
m AS (SELECT id, CASE WHEN cluster < 3 THEN 0 ELSE 1 + cluster % 2 END AS c FROM e),
v AS (SELECT src AS id, b.c AS cluster, sum(w) AS s, count(*) AS k, median(d) AS med FROM bi JOIN m a ON a.id = src AND a.c = 0 JOIN m b ON b.id = dst AND b.c <> 0 GROUP BY 1, 2),
t AS (SELECT id, sum(s) AS tot, sum(k) AS k, max(s) AS top FROM v GROUP BY id)
SELECT id, cluster::BIGINT AS cluster, round(top / tot, 6) AS purity, round(med, 6) AS med_d FROM t JOIN v USING (id) WHERE v.s = t.top AND t.k >= 3 AND top >= 0.7 * tot""")
def absorb(spark, root):
    e = embedded(spark, root)
    m = e.select("id", F.when(F.col("cluster") < 3, 0).otherwise(1 + F.col("cluster") % 2).cast("bigint").alias("cluster")).withColumn("mult", F.lit(1))
    return G.absorb_support(embedded_graph(spark, root), m).select("id", "cluster", r6("purity").alias("purity"), r6("med_d").alias("med_d"))


def _absorption_input(spark, root):
    """Graph, memberships (labels under 3 are leftovers), points, and the coordinates over 0.2 as labels."""
    e = cut_lineage(embedded(spark, root))
    m = e.select("id", F.when(F.col("cluster") < 3, 0).otherwise(1 + F.col("cluster") % 2).cast("bigint").alias("cluster"), F.lit(1).alias("mult"))
    high = F.filter(F.transform("vec", lambda x, j: F.when(x > 0.2, j + 1)), lambda j: j.isNotNull())
    return cut_lineage(embedded_graph(spark, root)), m, e.select("id", "vec"), e.select("id", high.alias("labels"))


@query("i33_absorb_candidates", f"""
WITH {R.embedded_nn(10)}, {R.graph('union', 2.0)}, bi AS (SELECT src, dst, w, d FROM ed UNION ALL SELECT dst, src, w, d FROM ed),
m AS (SELECT id, v AS x, CASE WHEN cluster < 3 THEN 0 ELSE 1 + cluster % 2 END AS c FROM e),
near AS (SELECT src, dst, b.c, d, w FROM bi JOIN m a ON a.id = src AND a.c = 0 JOIN m b ON b.id = dst AND b.c <> 0),
votes AS (SELECT src, c, sum(w) AS s, count(*) AS k, median(d) AS med FROM near GROUP BY 1, 2),
t AS (SELECT src, sum(s) AS tot, sum(k) AS k, max(s) AS top FROM votes GROUP BY 1),
best AS (SELECT src, min(c) AS c FROM votes JOIN t USING (src) WHERE s = top AND t.k >= 3 AND top >= 0.7 * tot GROUP BY 1),
reach AS (SELECT a.c, quantile_cont(list_distance(a.x, b.x), 0.75) AS q FROM m a JOIN m b ON a.c = b.c AND a.id < b.id WHERE a.c <> 0 GROUP BY 1),
lab AS (SELECT id, unnest(list_filter(range(1, 65), lambda j: x[j] > 0.2)) AS label FROM m),
sh AS (SELECT src, count(DISTINCT l.label) AS shared FROM best JOIN near USING (src, c) JOIN lab l ON l.id = dst JOIN lab o ON o.id = src AND o.label = l.label GROUP BY 1)
SELECT src AS id, c::BIGINT AS cluster, round(top / tot, 6) AS purity, round(med, 6) AS med_d, round(q, 6) AS q, shared
FROM best JOIN votes USING (src, c) JOIN t USING (src) JOIN reach USING (c) JOIN sh USING (src) WHERE med <= q""")
def absorb_candidates(spark, root):
    """Leftovers that meet the fixed conditions: support, neighbours, distance, a shared label."""
    t = Ab.candidates(*_absorption_input(spark, root))
    return t.select("id", "cluster", *[r6(c).alias(c) for c in ("purity", "med_d", "q")], "shared")


@query("i33_absorbed")
def absorbed(spark, root):
    """The same with p from 200 shuffles, FDR over all candidates, and the decision."""
    return Ab.absorb(*_absorption_input(spark, root)).select("id", "cluster", "p", "fdr", "absorbed")


@query("i36_bootstrap_ari")
def bootstrap_ari(spark, root):
    """Agreement of communities of bootstrap graphs with the full graph's, draws in one run."""
    pr, pts, metric = order_profiles(spark, root)
    base = N.knn(pts, 9, metric)
    full = cut_lineage(C.louvain(G.knn_graph(base, "union")).select("id", F.col("community").alias("ref")))
    reps, edges = 5, None
    for r in range(reps):
        # A profile stays in a draw if any of its subjects is drawn.
        u = F.pmod(F.xxhash64("first_id", F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
        kept = pr.where(u >= F.exp(-F.col("mult").cast("double"))).select(F.col("first_id").alias("id"))
        part = G.knn_graph(N.knn(pts.join(kept, "id"), 9, metric), "union").withColumn("g", F.lit(r).cast("bigint"))
        edges = part if edges is None else edges.unionByName(part)
    m = cut_lineage(C.louvain(cut_lineage(edges)).join(full, "id"))
    out = None
    for r in range(reps):
        part = G.partition_agreement(m.where(F.col("g") == r), "community", "ref").withColumn("rep", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out.select("rep", "n", "ari")


@query("i49_noise_stability")
def noise_stability(spark, root):
    """Mean neighbour overlap after Gaussian noise; noise is a hash of (id, axis, draw)."""
    e = cut_lineage(embedded(spark, root).select("id", F.slice("vec", 1, 2).alias("vec")))
    nn, out = N.knn(e, 20), None
    for sigma in (0.01, 0.05):
        noisy = e.select("id", F.array(*[F.col("vec")[j] + F.lit(sigma) * Rs.hashed_normal("id", j) for j in range(2)]).alias("vec"))
        moved = N.knn(noisy, 20)
        for k in (10, 20):
            part = I.neighbour_overlap(nn.where(F.col("rank") <= k), moved.where(F.col("rank") <= k)).agg(F.avg("jaccard").alias("mean_jaccard"))
            part = part.select(F.lit(sigma).alias("sigma"), F.lit(k).alias("k"), "mean_jaccard")
            out = part if out is None else out.unionByName(part)
    return out


@query("i52_label_ablation")
def label_ablation(spark, root):
    """Loss of modularity when one label is dropped before profiles and graph are rebuilt."""
    sets = cut_lineage(order_labels(spark, root))
    names = label_names(spark, root)
    edges = None
    for i, gone in enumerate([None, *names]):
        cut = sets if gone is None else sets.withColumn("labels", F.array_remove("labels", gone)).where(F.size("labels") > 0)
        pr = cut_lineage(L.profiles(cut, "id"))
        pts, metric = E.label_points(pr, names)
        part = G.knn_graph(N.knn(pts, 5, metric), "union", 2.0, pr.select(F.col("first_id").alias("id"), "mult"))
        part = part.withColumn("g", F.lit(i).cast("bigint"))
        edges = part if edges is None else edges.unionByName(part)
    edges = cut_lineage(edges)
    q = cut_lineage(C.modularity_by_graph(edges, C.louvain(edges)))
    base = q.where("g = 0").select("q").scalar()
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("g").cast("int"))
    return q.withColumn("dq", base - F.col("q")).where("g > 0").select(label.alias("label"), "q", "dq")


@query("j13_axis_correlations", f"""
{_UNIT}, p AS (SELECT v[1] AS b1, v[2] AS b2, v[3] AS x3, v[4] AS x4, v[5] AS x5 FROM e)
SELECT 'v3' AS item, round(corr(x3, b1), 6) + 0.0 AS r1, round(corr(x3, b2), 6) + 0.0 AS r2 FROM p UNION ALL SELECT 'v4', round(corr(x4, b1), 6) + 0.0, round(corr(x4, b2), 6) + 0.0 FROM p
UNION ALL SELECT 'v5', round(corr(x5, b1), 6) + 0.0, round(corr(x5, b2), 6) + 0.0 FROM p""")
def axis_correlations(spark, root):
    e = embedded(spark, root)
    wide = e.agg(*[F.corr(F.col("vec")[j], F.col("vec")[a]).alias(f"c{j}_{a}") for j in (2, 3, 4) for a in (0, 1)])
    rows = F.array(*[F.struct(F.lit(f"v{j + 1}").alias("item"), r6(f"c{j}_0").alias("r1"), r6(f"c{j}_1").alias("r2")) for j in (2, 3, 4)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


@query("j14_item_roles")
def item_roles(spark, root):
    """Base and fibre scores of items (coordinates 3 to 5) with permutation FDR and roles."""
    e = cut_lineage(embedded(spark, root).withColumn("fold", fold_of("id", 5).cast("int")))
    base = e.select("id", F.slice("vec", 1, 2).alias("vec"))
    nn = N.knn(base, 10)
    rows = e.select("id", F.slice("vec", 1, 2).alias("x"), "fold", F.slice("vec", 3, 3).alias("y"))
    items = ["v3", "v4", "v5"]
    res = cut_lineage(Md.residuals(rows, items, Md.additive_basis(rows, 2, 6)))
    out = None
    for j, item in enumerate(items):
        d = e.select("id", F.col("vec")[j + 2].alias("v"), F.col("vec")[0].alias("b1"), F.col("vec")[1].alias("b2"), "fold")
        b = Rs.permuted_r2(d, "v", "b1", "b2", "fold", 49).select(F.col("r2").alias("r2_base"), F.col("p").alias("p_base"))
        f = Rs.neighbour_mean_r2(nn, res.where(F.col("label") == item).select("id", F.col("e").alias("y")), 49)
        row = b.withColumn("item", F.lit(item)).join(f.select(F.col("r2").alias("r2_fibre"), F.col("p").alias("p_fibre"), F.lit(item).alias("item")), "item")
        out = row if out is None else out.unionByName(row)
    out = cut_lineage(out)
    out = O.benjamini_hochberg(O.benjamini_hochberg(out, "p_base", "q_base"), "p_fibre", "q_fibre")
    return Md.item_roles(out)


@query("j15_axis_contributions")
def axis_contributions(spark, root):
    e = embedded(spark, root)
    _, axes, shares = LA.principal_axes(e, 2)
    parts = LA.contributions(axes, shares, [f"v{j + 1}" for j in range(axes.shape[0])])
    return spark.createDataFrame([(k, v) for k, v in parts.items()], "item string, share double")


@query("i6_weight_survivors", """
WITH w AS (SELECT p_brand AS item, count(*)::DOUBLE AS k FROM part GROUP BY 1), y AS (SELECT item, k / (SELECT max(k) FROM w) AS w FROM w),
o AS (SELECT item, w, row_number() OVER (ORDER BY w DESC) AS x, count(*) OVER () AS n FROM y WHERE w < 1 - 1e-4),
l AS (SELECT any_value(n) AS n, max(w) AS y1, min(w) AS yn FROM o),
d AS (SELECT w, abs((yn - y1) * x - (l.n - 1) * w + l.n * y1 - yn) AS d FROM o, l), t AS (SELECT max(w) AS thr FROM d WHERE d = (SELECT max(d) FROM d))
SELECT item, round(w, 6) AS weight FROM y, t WHERE w >= thr OR w >= 1 - 1e-4""")
def weight_survivors(spark, root):
    """Knee rule on a weight per item; items are columns, so the list is short by nature."""
    from tessera.operators.weights import survivors

    k = table(spark, root, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).cast("double").alias("k"))
    top = k.agg(F.max("k")).scalar()
    w = {r["p_brand"]: r["w"] for r in k.select("p_brand", (F.col("k") / top).alias("w")).collect()}
    keep = survivors(w, k_min=1)
    return spark.createDataFrame([(i, float(round(w[i], 6))) for i in keep], "item string, weight double")


@query("j4_surface_r2")
def surface_r2(spark, root):
    """Held-out R2 of smooth surfaces for the first coordinates on the first two principal axes."""
    e = embedded(spark, root)
    mean, axes, _ = LA.principal_axes(e, 2)
    z = LA.project(e, mean, axes).select("id", F.col("score").alias("x"), fold_of("id", 5).cast("int").alias("fold"), F.slice("vec", 1, 3).alias("y"))
    z = cut_lineage(z)
    t = Md.out_of_fold(z, ["v1", "v2", "v3"], Md.surface_basis(z, 25), "gaussian")
    return t.groupBy("label").agg((1 - F.avg(F.pow(F.col("y") - F.col("p"), 2)) / F.var_pop("y")).alias("r2_cv"))


@query("j6_cluster_fields")
def cluster_fields(spark, root):
    """Fields of cluster membership over the base plane."""
    from tessera.operators.geometry import grid

    seg = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    c = table(spark, root, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    y = F.array(*[(F.col("c_mktsegment") == s).cast("double") for s in seg])
    rows = cut_lineage(customer_rows(spark, root).drop("y").join(c, "id").select("id", "x", "fold", y.alias("y")))
    return Md.field(rows, grid(spark, (-1, 1), (-1, 1), 25, 25, 0.05), seg, 30)


@query("h15_column_shuffle")
def column_shuffle(spark, root):
    """Modularity when every label column is dealt out anew over the subjects, draws in one run."""
    sets = cut_lineage(order_labels(spark, root))
    long = sets.select("id", F.explode("labels").alias("label"))
    names = label_names(spark, root)
    edges = None
    for draw in range(2):
        fake = L.label_sets(Rs.shuffled_columns(long, sets, draw), "id", "label")
        pr = cut_lineage(L.profiles(fake, "id"))
        pts, metric = E.label_points(pr, names)
        part = G.knn_graph(N.knn(pts, 9, metric), "mutual", 2.0, pr.select(F.col("first_id").alias("id"), "mult"))
        part = part.withColumn("g", F.lit(draw).cast("bigint"))
        edges = part if edges is None else edges.unionByName(part)
    edges = cut_lineage(edges)
    return C.modularity_by_graph(edges, C.louvain(edges)).select("g", "q")


@query("j29_delta_auc_table")
def delta_auc_table(spark, root):
    """Paired contrasts of base, fibre and stacked models with FDR inside each contrast."""
    e = embedded(spark, root)
    rows = cut_lineage(e.select("id", F.slice("vec", 1, 6).alias("x"), fold_of("id", 5).cast("int").alias("fold"),
                                F.array((F.col("cluster") < 5).cast("double"), (F.col("vec")[7] > 0).cast("double")).alias("y")))
    oof = cut_lineage(Md.stacked(rows, ["low_label", "sign"], 2))
    scores = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("s")) for m in ("base", "fibre", "stack")])
    long = oof.select("id", "label", "y", F.explode(scores).alias("m")).select("id", "label", "y", "m.model", "m.s")
    draws = cut_lineage(Rs.bootstrap_auc(long, 1000))
    out = None
    for a, b in (("base", "stack"), ("fibre", "stack"), ("base", "fibre")):
        part = Rs.paired_delta(draws, a, b).withColumn("contrast", F.lit(f"{b} - {a}"))
        out = part if out is None else out.unionByName(part)
    return O.benjamini_hochberg(cut_lineage(out), "p", "q", ["contrast"])


@query("q4_neighbour_auc_labels")
def neighbour_auc_labels(spark, root):
    pr = cut_lineage(L.profiles(order_labels(spark, root), "id"))
    return weighted_auc(pr, label_names(spark, root)).select("label", r6("auc").alias("auc"), (F.col("auc") >= 0.70).cast("bigint").alias("kept"))
