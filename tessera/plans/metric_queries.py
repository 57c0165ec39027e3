"""Ranking and calibration metrics of labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import r6
from tessera.operators import metrics as M
from tessera.operators import ordered as O
from tessera.plans.registry import query
from tessera.plans.stand_ins import scored_documents
from tessera.session import cut_lineage
from tessera.sources.tables import table

_DOC = """doc AS (SELECT doc_id AS id, quality::BIGINT AS y, toxic::BIGINT AS y2, round(ln(n_chars::DOUBLE + 1) / (ln(n_chars::DOUBLE + 1) + 4), 9) AS s
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
st AS (SELECT s, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y > 0 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM doc GROUP BY s),
tt AS (SELECT sum(pos) AS p, sum(neg) AS n FROM st)"""


def _table(spark, root):
    return cut_lineage(M.score_table(scored_documents(spark, root)))


@query("h5_u_statistic", f"""
WITH {_DOC}, c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM st)
SELECT round(sum(pos * (below + neg / 2)), 6) AS u, round(sum(pos * (below + neg / 2)) / any_value(p * n), 6) AS auc FROM c, tt""")
def u_statistic(spark, root):
    return M.auc(_table(spark, root)).select(r6("u").alias("u"), r6("auc").alias("auc"))


@query("h5_rank_sum", f"""
WITH {_DOC}, c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM st),
f AS (SELECT sum(pos * (below + neg / 2)) AS u, any_value(p) AS m, any_value(n) AS k, sum((pos+neg)*((pos+neg)*(pos+neg)-1)) AS ties FROM c, tt),
g AS (SELECT *, (u - m*k/2 - 0.5) / sqrt(m*k/12 * (m+k+1 - ties / ((m+k)*(m+k-1)))) AS z FROM f),
h AS (SELECT *, {__import__('tessera.plans.registry', fromlist=['x']).two_sided_normal('z')} AS p2 FROM g)
SELECT round(z, 6) AS z, round(CASE WHEN z >= 0 THEN p2 / 2 ELSE 1 - p2 / 2 END, 6) AS p FROM h""")
def rank_sum(spark, root):
    from tessera.functions import exact

    t = _table(spark, root)
    m = F.col("pos") + F.col("neg")
    facts = t.agg(F.sum("pos").alias("m"), F.sum("neg").alias("k"), F.sum((m * (m * m - 1)).cast("double")).alias("ties"))
    u = M.auc(t).select("u").scalar()
    f = facts.withColumn("u", u)
    n = F.col("m") + F.col("k")
    sd = F.sqrt(F.col("m") * F.col("k") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return f.select(r6((F.col("u") - F.col("m") * F.col("k") / 2 - 0.5) / sd).alias("z"), r6(exact.rank_sum_greater("u", "m", "k", "ties")).alias("p"))


@query("h6_signed_rank", f"""
WITH {_DOC}, f AS (SELECT avg(y) AS m FROM doc),
e AS (SELECT round((m - y)*(m - y) - (s - y)*(s - y), 9) AS d FROM doc, f), nz AS (SELECT d, abs(d) AS a FROM e WHERE d <> 0),
r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rk FROM nz),
t AS (SELECT sum(c * (c*c - 1)) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM nz GROUP BY a)),
g AS (SELECT sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS v, count(*)::DOUBLE AS n FROM r)
SELECT v, n::BIGINT AS n, round((v - n*(n+1)/4 - 0.5) / sqrt(n*(n+1)*(2*n+1)/24 - ties/48), 6) AS z FROM g, t""")
def signed_rank(spark, root):
    d = scored_documents(spark, root)
    mean = d.agg(F.avg("y")).scalar()
    d = d.withColumn("m", mean)
    gain = F.round(F.pow(F.col("m") - F.col("y"), 2) - F.pow(F.col("s") - F.col("y"), 2), 9)
    return M.signed_rank(d.select(gain.alias("d"))).select("v", "n", r6("z").alias("z"))


@query("j21_auc", f"""
WITH {_DOC}, l AS (SELECT 'quality' AS label, s, y FROM doc UNION ALL SELECT 'toxic', s, y2 FROM doc),
st2 AS (SELECT label, s, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y > 0 THEN 0 ELSE 1 END)::DOUBLE AS neg FROM l GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY label ORDER BY s) - neg AS below FROM st2),
a AS (SELECT label, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY label)
SELECT label, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_oriented FROM a""")
def auc(spark, root):
    long = _two_labels(spark, root)
    return M.auc(cut_lineage(M.score_table(long, by=["label"])), ["label"]).select("label", r6("auc").alias("auc"), r6("auc_oriented").alias("auc_oriented"))


def _two_labels(spark, root):
    d = scored_documents(spark, root).join(table(spark, root, "labels", "doc_id", "toxic").withColumnRenamed("doc_id", "id"), "id")
    return d.select("id", "s", F.explode(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("y").alias("y")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("bigint").alias("y")))).alias("e")).select("id", "s", "e.label", "e.y")


_DESC = _DOC + """,
cd AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM st),
gc AS (SELECT tp / p AS r, tp / (tp + fp) AS pr, p / (p + n) AS pi FROM cd, tt WHERE pos > 0),
gg AS (SELECT r, (r - pi) / ((1 - pi) * r) AS rg, (pr - pi) / ((1 - pi) * pr) AS pg FROM gc)"""


@query("j22_auprc", f"""
WITH {_DESC} SELECT round(sum(tp / (tp + fp) * pos) / any_value(p), 6) AS auprc,
  round(least(greatest((sum(tp / (tp + fp) * pos) / any_value(p) - any_value(p / (p + n))) / (1 - any_value(p / (p + n))), 0), 1), 6) AS auprc_norm FROM cd, tt""")
def auprc(spark, root):
    return M.auprc(_table(spark, root)).select(r6("auprc").alias("auprc"), r6("auprc_norm").alias("auprc_norm"))


@query("j23_gain_curve", f"""
WITH {_DESC} SELECT round(r, 6) AS recall, round(rg, 6) + 0.0 AS rec_gain, round(pg, 6) + 0.0 AS prec_gain FROM gg""")
def gain_curve(spark, root):
    c = M.gain_curve(_table(spark, root))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@query("j23_auprg", f"""
WITH {_DESC}, pts AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS h UNION ALL SELECT least(greatest(rg, 0), 1), least(greatest(pg, 0), 1) FROM gg),
l AS (SELECT x, h, lag(x) OVER (ORDER BY x, h) AS px, lag(h) OVER (ORDER BY x, h) AS ph FROM pts)
SELECT round(sum((x - px) * (h + ph) / 2), 6) AS auprg FROM l""")
def auprg(spark, root):
    return M.auprg(_table(spark, root)).select(r6("auprg").alias("auprg"))


_SHIFT = _DOC + """,
lp AS (SELECT ln(least(greatest(s, 1e-6), 1 - 1e-6)::DOUBLE / (1 - least(greatest(s, 1e-6), 1 - 1e-6)::DOUBLE)) AS l, pos, neg FROM st),
ad AS (SELECT ln((sum(pos) / sum(pos + neg)) / (1 - sum(pos) / sum(pos + neg))) - sum(l * (pos + neg)) / sum(pos + neg) AS a FROM lp),
sh AS (SELECT 1 / (1 + exp(-(l + a))) AS s, pos, neg, pos + neg AS m FROM lp, ad)"""
_BINS = _SHIFT + """,
cu AS (SELECT *, sum(m) OVER (ORDER BY s) - m AS bf, sum(m) OVER (ORDER BY s) AS ut, sum(m) OVER () AS n FROM sh),
kk AS (SELECT *, greatest(2, least(8, floor(n / 10))) AS k FROM cu),
bb AS (SELECT kk.*, b, greatest(bf, CASE WHEN b > 1 THEN floor((n-1)*(b-1)/k) + 1 ELSE 0 END) AS f, least(ut - 1, floor((n-1)*b/k)) AS t FROM kk, range(1, 9) r(b) WHERE b <= k),
bn AS (SELECT b AS bin, sum(t - f + 1) AS n, sum((t - f + 1) * pos / m) / sum(t - f + 1) AS ybar, sum((t - f + 1) * s) / sum(t - f + 1) AS phat FROM bb WHERE t >= f GROUP BY b)"""


@query("d13_equal_count_bins", f"WITH {_BINS} SELECT bin, n, round(ybar, 6) AS ybar, round(phat, 6) AS phat FROM bn")
def equal_count_bins(spark, root):
    return M.equal_count_bins(M.shifted(_table(spark, root))).select("bin", "n", r6("ybar").alias("ybar"), r6("phat").alias("phat"))


@query("j24_aece", f"WITH {_BINS} SELECT round(sum(n * abs(phat - ybar)) / sum(n), 6) AS aece, count(*) AS n_bins FROM bn")
def adaptive_ece(spark, root):
    return M.adaptive_ece(_table(spark, root)).select(r6("aece").alias("aece"), "n_bins")


@query("j25_brier_r2", f"""
WITH {_DOC} SELECT count(*) AS n, round(avg(y), 6) AS prevalence, round(avg((s - y) * (s - y)), 6) AS brier,
  round(1 - avg((s - y) * (s - y)) / (avg(y) * (1 - avg(y))), 6) AS brier_r2 FROM doc""")
def brier(spark, root):
    return M.brier(_table(spark, root)).select("n", r6("prevalence").alias("prevalence"), r6("brier").alias("brier"), r6("brier_r2").alias("brier_r2"))


@query("j26_isotonic", f"""
WITH {_SHIFT}, o AS (SELECT *, row_number() OVER (ORDER BY s) AS r, sum(m) OVER (ORDER BY s) AS cm, sum(pos) OVER (ORDER BY s) AS cp FROM sh),
seg AS (SELECT lo.r AS a, hi.r AS b, (hi.cp - lo.cp + lo.pos) / (hi.cm - lo.cm + lo.m) AS v FROM o lo JOIN o hi ON lo.r <= hi.r),
mx AS (SELECT b, max(v) AS v FROM (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v, a AS aa FROM seg) WHERE aa <= b GROUP BY b)
SELECT round(s, 6) AS p, round(v, 6) + 0.0 AS fit FROM o JOIN mx ON b = r""")
def isotonic(spark, root):
    c = M.calibration_curve(_table(spark, root))
    return c.select(r6("p").alias("p"), r6("fit").alias("fit"))


@query("j28_metric_table", f"""
WITH {_BINS}, cd AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(neg) OVER (ORDER BY s) - neg AS below FROM st)
SELECT 'quality' AS label, round(sum(pos * (below + neg / 2)) / any_value(p * n), 6) AS auc, round(sum(tp / (tp + fp) * pos) / any_value(p), 6) AS auprc,
  round(sum(pos * (s - 1) * (s - 1) + neg * s * s) / any_value(p + n), 6) AS brier, (SELECT round(sum(n * abs(phat - ybar)) / sum(n), 6) FROM bn) AS aece FROM cd, tt""")
def metric_table(spark, root):
    long = scored_documents(spark, root).withColumn("label", F.lit("quality"))
    t = cut_lineage(M.score_table(long, by=["label"]))
    by = ["label"]
    out = M.auc(t, by).select("label", "auc").join(M.auprc(t, by).select("label", "auprc"), "label").join(
        M.brier(t, by).select("label", "brier"), "label").join(M.adaptive_ece(t, by).select("label", "aece"), "label")
    return out.select("label", *[r6(c).alias(c) for c in ("auc", "auprc", "brier", "aece")])


@query("j16_spearman_screen", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b,
  rank() OVER (ORDER BY p_partkey) AS c FROM part)
SELECT 'p_size' AS item, round(corr(a, c), 6) + 0.0 AS rho FROM r UNION ALL SELECT 'p_retailprice', round(corr(b, c), 6) + 0.0 FROM r""")
def spearman_screen(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_size", "p_retailprice")
    r = O.average_rank(p, "p_size", "ra")
    r = O.average_rank(r, "p_retailprice", "rb")
    r = O.average_rank(r, "p_partkey", "rc").agg(F.corr("ra", "rc").alias("x"), F.corr("rb", "rc").alias("y"))
    return r.select(F.explode(F.array(F.struct(F.lit("p_size").alias("item"), r6("x").alias("rho")),
                                      F.struct(F.lit("p_retailprice").alias("item"), r6("y").alias("rho")))).alias("e")).select("e.*")
