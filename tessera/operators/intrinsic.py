"""Intrinsic dimension and embedding quality from neighbour tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbours import Metric, closer_counts, knn
from tessera.operators.ordered import quantiles, running_totals, value_counts


def two_ratios(nn: DataFrame, eps: float = 0.0) -> DataFrame:
    """(i, mu): second over first neighbour distance."""
    per = nn.where("rank <= 2").groupBy("i").agg(
        F.max(F.when(F.col("rank") == 1, F.col("d"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("d"))).alias("d2"))
    d1 = F.greatest("d1", F.lit(eps))
    d2 = F.greatest(F.col("d2"), d1 + eps)
    return per.select("i", F.when(d1 > 0, d2 / d1).alias("mu"))


def two_nn(nn: DataFrame) -> DataFrame:
    """(n, dim): one over the mean log ratio of the first two distances."""
    return two_ratios(nn).where("mu is not null and mu > 0").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.lit(1.0), F.avg(F.ln("mu"))).alias("dim"))


def two_nn_local(nn: DataFrame, membership: DataFrame, k: int) -> DataFrame:
    """(cluster, n, dim): k-th over first distance, per community."""
    per = nn.where(F.col("rank").isin(1, k)).groupBy("i").agg(F.min("d").alias("d1"), F.max("d").alias("dk"))
    own = membership.select(F.col("id").alias("i"), "cluster")
    return per.where("d1 > 0").join(own, "i").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.lit(1.0), F.avg(F.ln(F.col("dk") / F.col("d1")))).alias("dim"))


def two_nn_trimmed(nn: DataFrame, eps: float = 1e-8, trim: float = 0.02) -> DataFrame:
    """(n, dim) after dropping the same share of extreme ratios at both ends."""
    logs = two_ratios(nn, eps).where("mu > 1").select(F.ln("mu").alias("x"))
    scan = running_totals(value_counts(logs, "x"), "x", ["n"])
    k = F.floor(F.lit(trim) * F.col("total_n"))
    k = F.when(2 * k < F.col("total_n"), k).otherwise(F.lit(0))
    # Overlap of this value's ranks with the kept middle.
    kept = F.greatest(F.lit(0), F.least("upto_n", F.col("total_n") - k) - F.greatest("before_n", k))
    return scan.withColumn("kept", kept).agg(
        F.sum("kept").cast("bigint").alias("n"), F.try_divide(F.sum("kept").cast("double"), F.sum(F.col("kept") * F.col("x"))).alias("dim"))


def levina_bickel(nn: DataFrame, k_lo: int = 5, k_hi: int = 15) -> DataFrame:
    """(k, dim): mean over points of the inverse mean log ratio to the k-th distance.

    Distances of a point fold into one sorted array, so every k reads it once.
    """
    rows = nn.where(F.col("rank") <= k_hi).groupBy("i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"]).alias("ds"))
    per_k = rows.select("ds", F.explode(F.sequence(F.lit(k_lo), F.least(F.lit(k_hi), F.size("ds")))).alias("k"))
    logs = F.expr("aggregate(slice(ds, 1, k - 1), 0D, (s, d) -> s + ln(ds[k - 1] / d)) / (k - 1)")
    return per_k.withColumn("v", logs).where("v > 0").groupBy("k").agg(
        F.avg(1 / F.col("v")).alias("dim")).select(F.col("k").cast("bigint").alias("k"), "dim")


def core_band(nn: DataFrame, k: int = 10, band: tuple = (0.15, 0.85)) -> DataFrame:
    """Points whose k-th distance lies inside a quantile band."""
    rk = nn.where(F.col("rank") <= k).groupBy("i").agg(F.max("d").alias("rk"))
    q = quantiles(rk, "rk", {"lo": band[0], "hi": band[1]})
    lo, hi = q.select("lo").scalar(), q.select("hi").scalar()
    return rk.withColumn("_lo", lo).withColumn("_hi", hi).where("rk between _lo and _hi").select("i", "rk")


def core_by_slope(nn: DataFrame, min_frac: float = 0.30, width: int = 20, slope_tol: float = 0.08,
                  rmse_tol: float = 0.10) -> DataFrame:
    """(k_star, n): longest prefix with a stable slope of ln(1-u) on ln(mu).

    Prefix fits come from running sums; the plateau test is a row window over
    the ranks, cut into overlapping spans so that no task sees all of them.
    """
    mu = two_ratios(nn, 2.220446049250313e-16).select("i", F.ln(F.greatest("mu", F.lit(1 + 1e-12))).alias("x"))
    ranked = running_totals(mu.withColumn("one", F.lit(1)), "x", ["one"], tie="i")
    m = F.col("total_one")
    u = (F.col("upto_one") - 0.5) / (m + 1)
    pts = ranked.select("i", "x", F.col("upto_one").alias("k"), m.alias("m"), F.ln(1 - u).alias("y"))
    pts = pts.withColumn("xx", F.col("x") * F.col("x")).withColumn("xy", F.col("x") * F.col("y")).withColumn(
        "yy", F.col("y") * F.col("y"))
    run = running_totals(pts, "x", ["x", "y", "xx", "xy", "yy"], tie="i")
    k = F.col("k")
    sxx = F.col("upto_xx") - F.col("upto_x") * F.col("upto_x") / k
    sxy = F.col("upto_xy") - F.col("upto_x") * F.col("upto_y") / k
    syy = F.col("upto_yy") - F.col("upto_y") * F.col("upto_y") / k
    k0 = F.greatest(F.lit(20), F.floor(F.lit(min_frac) * F.col("m")))
    fits = run.where((k >= k0) & (k <= F.col("m") - 2)).select(
        "k", "m", k0.alias("k0"), (sxy / sxx).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), (syy - sxy * sxy / sxx) / k)).alias("rmse"))
    # The window [max(k0, k-width+1), k] as a bounded self-expansion: each fit
    # serves the next `width` ranks.
    spread = fits.select("slope", F.explode(F.sequence(k, k + F.lit(width - 1))).alias("k"))
    span = spread.groupBy("k").agg((F.max("slope") - F.min("slope")).alias("span"))
    ok = fits.join(span, "k").where((F.col("span") <= slope_tol) & (F.col("rmse") <= rmse_tol))
    total = mu.agg(F.count(F.lit(1)).alias("n"))
    best = ok.agg(F.max("k")).scalar()
    k_star = F.coalesce(best, F.floor(0.6 * F.col("n")))
    return total.select(F.greatest(F.lit(3), F.least(k_star, F.col("n") - 2)).cast("bigint").alias("k_star"), "n")


def trust_continuity(high: DataFrame, low: DataFrame, ks: Sequence[int], metric: Metric = Metric()) -> DataFrame:
    """(k, trust, continuity) of an embedding; both sides hold (id, vec).

    Only neighbours that one space names and the other does not are ranked, by
    counting closer points block by block.
    """
    k_max = max(ks)
    n = high.count()
    nh, nl = knn(high, k_max, metric, total=n), knn(low, k_max, metric, total=n)
    only = lambda a, b: a.join(b.select("i", "j", F.col("rank").alias("other")), ["i", "j"], "left")
    sides = []
    for name, named, truth, space in (("trust", nl, nh, high), ("cont", nh, nl, low)):
        pairs = only(named, truth)
        # Beyond k_max the rank is unknown and has to be counted.
        missing = pairs.where("other is null").select("i", "j")
        counted = closer_counts(missing, space, metric).withColumnRenamed("rank", "counted")
        ranked = pairs.join(counted, ["i", "j"], "left").select(
            "rank", F.coalesce("other", "counted").cast("double").alias("true_rank"))
        per_k = ranked.select(F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"), "rank", "true_rank")
        sides.append(per_k.where("rank <= k and true_rank > k").groupBy("k").agg(
            F.sum(F.col("true_rank") - F.col("k")).alias(name)))
    base = high.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    joined = base.join(sides[0], "k", "left").join(sides[1], "k", "left")
    den = F.lit(float(n)) * F.col("k") * (2.0 * n - 3 * F.col("k") - 1)
    score = lambda c: 1 - 2 / den * F.coalesce(c, F.lit(0.0))
    return joined.select(F.col("k").cast("bigint").alias("k"), score("trust").alias("trust"), score("cont").alias("continuity"))


def density_risk(nn: DataFrame, k: int, dims: int) -> DataFrame:
    """(id, density, z, score01): 1/r^d, robust z clipped at 6, min-max rescaled."""
    r = nn.where(F.col("rank") <= k).groupBy("i").agg(F.max("d").alias("r"))
    dens = r.select(F.col("i").alias("id"), F.pow(F.greatest("r", F.lit(1e-12)), F.lit(-float(dims))).alias("density"))
    med = quantiles(dens, "density", {"m": 0.5}).select("m").scalar()
    dev = dens.withColumn("dev", F.abs(F.col("density") - med))
    mad = quantiles(dev, "dev", {"m": 0.5}).select("m").scalar()
    z = dens.withColumn("z", F.least(F.greatest(F.try_divide(F.col("density") - med, 1.4826 * mad), F.lit(-6.0)), F.lit(6.0)))
    lo, hi = z.agg(F.min("z")).scalar(), z.agg(F.max("z")).scalar()
    return z.withColumn("score01", F.try_divide(F.col("z") - lo, hi - lo))


def neighbour_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mean, n) Jaccard overlap of two neighbour tables of the same points."""
    hit = a.select("i", "j").join(b.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count(F.lit(1)).alias("both"))
    size = lambda t, c: t.groupBy("i").agg(F.count(F.lit(1)).alias(c))
    per = size(a, "na").join(size(b, "nb"), "i").join(hit, "i", "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return per.select("i", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def neighbour_r2(nn: DataFrame, values: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, r2) of predicting a value by neighbours outside the own fold.

    `values` holds (id, y, fold).  A point without such neighbours gets the mean
    of the other folds.
    """
    a = values.select(F.col("id").alias("i"), F.col("y").alias("yi"), F.col("fold").alias("fi"))
    b = values.select(F.col("id").alias("j"), F.col("y").alias("yj"), F.col("fold").alias("fj"))
    folds = values.groupBy(F.col("fold").alias("fi")).agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    s_all, c_all = values.agg(F.sum("y")).scalar(), values.agg(F.count("y")).scalar()
    folds = folds.select("fi", ((s_all - F.col("s")) / (c_all - F.col("c"))).alias("m"))
    pairs = nn.join(b, "j").join(a, "i").select("i", "yi", "fi", "rank", F.when(F.col("fi") != F.col("fj"), F.col("yj")).alias("yj"))
    per = pairs.groupBy("i", "yi", "fi").agg(*[F.avg(F.when(F.col("rank") <= k, F.col("yj"))).alias(f"p{k}") for k in ks])
    per = per.join(folds, "fi")
    gap = lambda k: F.avg(F.pow(F.col("yi") - F.coalesce(F.col(f"p{k}"), F.col("m")), 2))
    wide = per.agg(F.var_samp("yi").alias("v"), *[gap(k).alias(f"e{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.greatest(F.lit(0.0), 1 - F.col(f"e{k}") / F.col("v")).alias("r2")) for k in ks])
    return wide.select(F.explode(rows).alias("r")).select("r.k", "r.r2")


def spread_start(points: DataFrame, k: int, metric: Metric) -> list[tuple[int, list[float]]]:
    """k points far from each other: each next one is farthest from those taken."""
    import numpy as np

    from tessera.operators.neighbours import _matrix

    first = points.orderBy(F.md5(F.col("id").cast("string"))).select("id", "vec").first()
    taken = [(first["id"], list(first["vec"]))]
    while len(taken) < k:
        nodes = np.array([v for _, v in taken], dtype=float)

        def far(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(d=metric.between(_matrix(pdf["vec"]), nodes).min(1))

        t = points.select("id", "vec").mapInPandas(far, "id bigint, vec array<double>, d double")
        r = t.orderBy(F.desc("d"), "id").select("id", "vec").first()
        taken.append((r["id"], list(r["vec"])))
    return sorted(taken)
