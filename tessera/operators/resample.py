"""Bootstrap and permutation inference, seeded by hashes of ids.

A draw depends on (seed, id, replicate) only, so it is the same on every retry
and for every model that shares the ids.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import BUCKET, quantiles, ranges_for, running_totals, with_ranges

# Cumulative Poisson(1) probabilities P(X <= k), k = 0..9.
POISSON_CDF = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def _uniform(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms from a 64-bit mixing function of (id, replicate, seed)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (
            reps.astype(np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def poisson_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Bootstrap multiplicities of rows, independent of how rows are partitioned."""
    return np.searchsorted(POISSON_CDF, _uniform(ids, reps, seed)).astype(float)


def bootstrap_auc(df: DataFrame, reps: int = 1000, seed: int = 42, by: Sequence[str] = ("label", "model"),
                  chunk: int = 100) -> DataFrame:
    """(by, rep, auc) of Poisson bootstrap draws of rows (id, y, s, by...).

    Rows of all models draw the same weights.  Each value range yields its
    weighted totals and inner concordance; ranges then combine by running sums.
    """
    by = list(by)
    rows = df.select(*by, "id", "y", F.col("s").cast("double").alias("s"))
    ranged = with_ranges(rows, "s", ranges_for(rows), tie="id")
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*by).dtypes)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, y, ids = pdf["s"].to_numpy(), pdf["y"].to_numpy() > 0, pdf["id"].to_numpy()
        starts = np.concatenate(([0], np.nonzero(np.diff(s))[0] + 1))
        out = []
        for lo in range(0, reps, chunk):
            r = np.arange(lo, min(reps, lo + chunk))
            w = poisson_weights(ids, r, seed)
            pos = np.add.reduceat(w * y[:, None], starts, axis=0)
            neg = np.add.reduceat(w * ~y[:, None], starts, axis=0)
            below = np.cumsum(neg, axis=0) - neg
            out.append(pd.DataFrame({"rep": r, "pos": pos.sum(0), "neg": neg.sum(0), "u": (pos * (below + neg / 2)).sum(0)}))
        res = pd.concat(out)
        for c in by:
            res[c] = pdf[c].iloc[0]
        res["range"], res["single"] = pdf[BUCKET].iloc[0], len(starts) == 1
        return res[[*by, "rep", "range", "single", "pos", "neg", "u"]]

    parts = ranged.groupBy(*by, BUCKET).applyInPandas(
        partial, f"{schema}, rep int, range double, single boolean, pos double, neg double, u double")
    # Sub-ranges of one heavy value: all their pairs are ties.
    whole = parts.groupBy(*by, "rep", F.floor("range").alias("range")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.when(F.count(F.lit(1)) > 1, F.sum("pos") * F.sum("neg") / 2).otherwise(F.sum("u")).alias("u"))
    lower = Window.partitionBy(*by, "rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    u = F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    return whole.select(*by, "rep", "pos", "neg", u.alias("u")).groupBy(*by, "rep").agg(
        F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def interval(draws: DataFrame, value: str, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """(by, lo, hi): percentile interval of finite draws."""
    tail = (1 - level) / 2
    return quantiles(draws.where(F.col(value).isNotNull()), value, {"lo": tail, "hi": 1 - tail}, by).select(*by, "lo", "hi")


def paired_delta(draws: DataFrame, a: str, b: str, by: Sequence[str] = ("label",)) -> DataFrame:
    """(by, delta_mean, p, win, lo, hi) of auc(b) - auc(a) on the same draws."""
    by = list(by)
    wide = draws.where(F.col("model").isin(a, b)).groupBy(*by, "rep").agg(
        (F.max(F.when(F.col("model") == b, F.col("auc"))) - F.max(F.when(F.col("model") == a, F.col("auc")))).alias("delta"))
    wide = wide.where("delta is not null")
    share = lambda c: F.avg(c.cast("double"))
    facts = wide.groupBy(*by).agg(
        F.avg("delta").alias("delta_mean"), share(F.col("delta") >= 0).alias("_ge"), share(F.col("delta") <= 0).alias("_le"),
        share(F.col("delta") > 0).alias("win"), F.max(F.abs("delta")).alias("_top"))
    flat = F.col("_top") == 0
    facts = facts.withColumn("p", F.when(flat, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least("_ge", "_le")))).withColumn(
        "win", F.when(flat, 0.5).otherwise(F.col("win")))
    return facts.join(interval(wide, "delta", by), by).select(*by, "delta_mean", "p", "win", "lo", "hi")


def stratified_bootstrap(table: DataFrame, reps: int = 1000, seed: int = 42) -> DataFrame:
    """(label, rep, auc, auprc, auprg, brier, brier_r2): resampling within class.

    `table` holds (label, s, pos, neg).  A multinomial draw splits exactly: class
    totals go to value ranges first (every task repeats that small draw from the
    same seed), then to the scores inside a range.  Rows are never replicated.
    """
    ranged = with_ranges(table, "s", ranges_for(table))
    totals = ranged.groupBy("label", BUCKET).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    layout = totals.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.col(BUCKET).alias("r"), "p", "n"))).alias("layout"))
    plan = totals.select(F.col("label").alias("l"), F.col(BUCKET).alias("r")).join(
        layout.select(F.col("label").alias("l"), "layout"), "l")

    def draw(pdf: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s", ascending=False)
        label, mine = pdf["label"].iloc[0], pdf[BUCKET].iloc[0]
        layout = plan["layout"].iloc[0]
        rng_of = [e["r"] for e in layout]
        p_all = np.array([e["p"] for e in layout], dtype=float)
        n_all = np.array([e["n"] for e in layout], dtype=float)
        here = rng_of.index(mine)
        tag = abs(hash_text(label)) % (1 << 31)
        s = np.clip(pdf["s"].to_numpy(), 1e-6, 1 - 1e-6)
        cp, cn = pdf["pos"].to_numpy(dtype=float), pdf["neg"].to_numpy(dtype=float)
        big_p, big_n = p_all.sum(), n_all.sum()
        prev = big_p / (big_p + big_n)
        out = []
        for rep in range(reps):
            shared = np.random.default_rng([seed, tag, rep])
            tp = shared.multinomial(int(big_p), p_all / big_p)
            tn = shared.multinomial(int(big_n), n_all / big_n)
            own = np.random.default_rng([seed, tag, rep, here + 1])
            dp = own.multinomial(tp[here], cp / cp.sum()) if tp[here] else np.zeros(len(cp))
            dn = own.multinomial(tn[here], cn / cn.sum()) if tn[here] else np.zeros(len(cn))
            above_p, above_n = tp[here + 1:].sum(), tn[here + 1:].sum()
            below_n = tn[:here].sum()
            cum_p, cum_n = above_p + np.cumsum(dp), above_n + np.cumsum(dn)
            neg_under = below_n + dn.sum() - np.cumsum(dn)
            u = float((dp * (neg_under + dn / 2)).sum())
            hit = dp > 0
            prec = cum_p[hit] / (cum_p[hit] + cum_n[hit])
            ap = float((prec * dp[hit]).sum())
            rec = cum_p[hit] / big_p
            x = np.clip((rec - prev) / ((1 - prev) * rec), 0, 1)
            h = np.clip((prec - prev) / ((1 - prev) * prec), 0, 1)
            flat, up = x <= 0, x > 0
            xs, hs = x[up], h[up]
            area = float((np.diff(xs) * (hs[1:] + hs[:-1]) / 2).sum())
            ends = (xs[0], hs[0], xs[-1], hs[-1]) if len(xs) else (np.nan,) * 4
            brier = float((dp * (1 - s) ** 2 + dn * s**2).sum())
            out.append((label, rep, -here, u, ap, brier, area, *ends, h[flat].max() if flat.any() else 0.0, big_p, big_n))
        return pd.DataFrame(out, columns=["label", "rep", "pos", "u", "ap", "b", "area", "x0", "h0", "x1", "h1", "top", "p", "n"])

    parts = ranged.groupBy("label", BUCKET).cogroup(plan.groupBy("l", "r")).applyInPandas(
        draw, "label string, rep int, pos int, u double, ap double, b double, area double, x0 double, h0 double, "
        "x1 double, h1 double, top double, p double, n double")
    group = Window.partitionBy("label", "rep")
    top = F.max("top").over(group)
    # A range whose draw has no point right of the origin sends no ends.
    drawn = F.col("x0").isNotNull() & ~F.isnan("x0")
    earlier = group.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(drawn, F.struct("x1", "h1")), ignorenulls=True).over(earlier)
    bridge = parts.withColumn("_last", last).withColumn("_top", top)
    px, ph = F.coalesce("_last.x1", F.lit(0.0)), F.coalesce("_last.h1", "_top")
    gap = F.when(drawn, (F.col("x0") - px) * (F.col("h0") + ph) / 2).otherwise(0.0)
    p, n = F.max("p"), F.max("n")
    prev = p / (p + n)
    bs = F.sum("b") / (p + n)
    return bridge.withColumn("_gap", gap).groupBy("label", "rep").agg(
        (F.sum("u") / (p * n)).alias("auc"), (F.sum("ap") / p).alias("auprc"),
        (F.sum("area") + F.sum("_gap")).alias("auprg"), bs.alias("brier"), (1 - bs / (prev * (1 - prev))).alias("brier_r2"))


def hash_text(text: str) -> int:
    """A stable integer for a label; Python's own hash changes between processes."""
    value = 1469598103934665603
    for byte in str(text).encode():
        value = ((value ^ byte) * 1099511628211) % (1 << 64)
    return value


def replicated(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def permutation(ids: DataFrame, reps: int, seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """(rep, id, source): within each stratum, `source` is a random rearrangement of `id`.

    Ranks by id meet ranks by hash; both come from range-split scans, so a
    stratum that holds most rows is still spread over tasks.
    """
    strata = list(strata)
    base = ids.select("id", *strata).withColumn("v", F.col("id").cast("double")).withColumn("one", F.lit(1))
    fixed = running_totals(base, "v", ["one"], strata, tie="id").select(*strata, F.col("upto_one").alias("k"), "id")
    drawn = replicated(ids.select(F.col("id").alias("source"), *strata), reps).withColumn(
        "h", F.xxhash64("source", "rep", F.lit(seed)).cast("double")).withColumn("one", F.lit(1))
    random = running_totals(drawn, "h", ["one"], ["rep", *strata], tie="source").select(
        "rep", *strata, F.col("upto_one").alias("k"), "source")
    return random.join(fixed, [*strata, "k"]).select("rep", "id", "source")


def monte_carlo_p(observed: DataFrame, null: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, observed value, p): (1 + draws at least as large) / (1 + draws)."""
    by = list(by)
    n = null.where(F.col(value).isNotNull()).withColumnRenamed(value, "_null")
    if by:
        joined = n.join(observed.select(*by, value), by)
    else:
        joined = n.withColumn(value, observed.select(value).scalar())
    return joined.groupBy(*by, value).agg(
        ((F.sum((F.col("_null") >= F.col(value)).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def permanova(points: DataFrame, reps: int = 0, seed: int = 42) -> DataFrame:
    """(f, r2[, p]) of groups in Euclidean space: points (id, vec, cluster).

    Sums of squared distances inside groups follow from group sums of the
    coordinates, so no pair is formed and every draw is linear in the rows.
    """
    def fit(rows, keys):
        """Within and total sums of squares per replicate."""
        long = rows.select(*keys, "cluster", F.posexplode("vec").alias("c", "x"))
        per = long.groupBy(*keys, "cluster", "c").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
        spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
        groups = per.groupBy(*keys, "cluster").agg(F.sum(spread).alias("within"), F.max("n").alias("n")).select(
            *keys, "within", "n", F.lit(1).alias("g"), F.lit(0.0).alias("total"))
        axes = per.groupBy(*keys, "c").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).select(
            *keys, F.lit(0.0).alias("within"), F.lit(0).alias("n"), F.lit(0).alias("g"), spread.alias("total"))
        both = groups.unionByName(axes).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("within", "n", "g", "total")])
        between = F.col("total") - F.col("within")
        return both.select(*keys, (between / (F.col("g") - 1) / (F.col("within") / (F.col("n") - F.col("g")))).alias("f"),
                           (between / F.col("total")).alias("r2"))

    observed = fit(points.withColumn("rep", F.lit(-1)), ["rep"]).drop("rep")
    if not reps:
        return observed
    moves = permutation(points.select("id"), reps, seed)
    labels = points.select(F.col("id").alias("source"), "cluster")
    shuffled = moves.join(labels, "source").join(points.select("id", "vec"), "id")
    null = fit(shuffled, ["rep"]).select("f")
    return observed.join(monte_carlo_p(observed, null, "f"), "f")


def permuted_r2(df: DataFrame, y: str, a: str, b: str, stratum: str, reps: int, seed: int = 42) -> DataFrame:
    """(r2, p): two-regressor R2 against shuffles of y inside strata."""
    from tessera.operators.models import r2_two

    observed = r2_two(df, y, a, b)
    moves = permutation(df.select("id", stratum), reps, seed, [stratum])
    ys = df.select(F.col("id").alias("source"), F.col(y).alias("_y"))
    null = r2_two(moves.join(ys, "source").join(df.select("id", a, b), "id"), "_y", a, b, ["rep"]).select("r2")
    return monte_carlo_p(observed, null, "r2")


def neighbour_mean_r2(nn: DataFrame, values: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """(r2, p): value against its neighbours' mean, with neighbour rows shuffled among points."""
    pred = nn.join(values.select(F.col("id").alias("j"), "y"), "j").groupBy(F.col("i").alias("id")).agg(F.avg("y").alias("m"))
    both = values.select("id", "y").join(pred, "id")
    fit = lambda t, *by: t.groupBy(*by).agg(F.greatest(F.lit(0.0), 1 - F.try_divide(F.avg(F.pow(F.col("y") - F.col("m"), 2)), F.var_samp("y"))).alias("r2"))
    moves = permutation(both.select("id"), reps, seed)
    shuffled = moves.join(both.select("id", "y"), "id").join(both.select(F.col("id").alias("source"), "m"), "source")
    return monte_carlo_p(fit(both), fit(shuffled, "rep").select("r2"), "r2")


def shuffled_localisation(edges: DataFrame, sets: DataFrame, labels: Sequence[str], reps: int, seed: int = 42) -> DataFrame:
    """(label, r, p): assortativity against shuffles of each label over the vertices.

    A permuted position at or below the label's count stands for a positive, so
    one permutation per draw serves all labels.
    """
    from tessera.operators.graph import assortativity

    counts = sets.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n1"))
    observed = assortativity(edges, sets)
    spots = permutation(sets.select("id"), reps, seed)
    order = running_totals(sets.select("id").withColumn("v", F.col("id").cast("double")).withColumn("one", F.lit(1)), "v", ["one"], tie="id")
    place = spots.join(order.select(F.col("id").alias("source"), F.col("upto_one").alias("k")), "source").select("rep", "id", "k")
    ends = edges.select("src", "dst").join(place.select("rep", F.col("id").alias("src"), F.col("k").alias("ks")), "src").join(
        place.select("rep", F.col("id").alias("dst"), F.col("k").alias("kd")), ["rep", "dst"])
    known = {r["label"]: r["n1"] for r in counts.collect()}
    both = [F.sum((F.greatest("ks", "kd") <= known.get(c, 0)).cast("int")).alias(f"b{i}") for i, c in enumerate(labels)]
    some = [F.sum((F.least("ks", "kd") <= known.get(c, 0)).cast("int")).alias(f"s{i}") for i, c in enumerate(labels)]
    wide = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("e"), *both, *some)
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"b{i}").alias("n11"), F.col(f"s{i}").alias("any")) for i, c in enumerate(labels)])
    long = wide.select("e", F.explode(rows).alias("x")).select("e", "x.*")
    e11, e10 = F.col("n11") / F.col("e"), (F.col("any") - F.col("n11")) / (2 * F.col("e"))
    e00 = 1 - F.col("any") / F.col("e")
    ab = (e11 + e10) ** 2 + (e00 + e10) ** 2
    null = long.select("label", F.when(F.abs(1 - ab) > 1e-12, (e11 + e00 - ab) / (1 - ab)).alias("r"))
    return monte_carlo_p(observed, null, "r", ["label"])


def shuffled_weights(edges: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """(g, src, dst, w): each draw deals the edge weights out anew over the same edges."""
    keyed = edges.select(F.xxhash64("src", "dst").alias("id"), "src", "dst", "w")
    moves = permutation(keyed.select("id"), reps, seed)
    return moves.join(keyed.select("id", "src", "dst"), "id").join(keyed.select(F.col("id").alias("source"), "w"), "source").select(
        F.col("rep").cast("bigint").alias("g"), "src", "dst", "w")


def rewired(edges: DataFrame, reps: int, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(g, src, dst, w): degree-preserving double-edge swaps, many per round.

    Each round pairs edges at random and swaps partners where that makes neither
    a loop nor an edge that exists or that another swap of the round also wants.
    Weights are drawn from the observed ones.
    """
    from tessera.session import cut_lineage

    state = cut_lineage(replicated(edges.select("src", "dst", "w"), reps))
    for turn in range(rounds):
        keyed = state.withColumn("h", F.xxhash64("rep", "src", "dst", F.lit(seed + turn)))
        scan = running_totals(keyed.withColumn("v", F.col("h").cast("double")).withColumn("one", F.lit(1)), "v", ["one"], ["rep"], tie="h")
        numbered = scan.select("rep", "src", "dst", "w", F.col("h"), F.floor((F.col("upto_one") - 1) / 2).alias("pair"), (F.col("upto_one") % 2).alias("odd"))
        sides = numbered.groupBy("rep", "pair").agg(
            F.max(F.when(F.col("odd") == 1, F.struct("src", "dst", "w", "h"))).alias("a"), F.max(F.when(F.col("odd") == 0, F.struct("src", "dst", "w", "h"))).alias("b"))
        cross = F.pmod(F.xxhash64("a.h", "b.h"), F.lit(2)) == 0
        c, d = F.when(cross, F.col("b.src")).otherwise(F.col("b.dst")), F.when(cross, F.col("b.dst")).otherwise(F.col("b.src"))
        want = sides.withColumn("c", c).withColumn("d", d)
        edge = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
        want = want.withColumn("new", F.array(edge(F.col("a.src"), F.col("d")), edge(F.col("c"), F.col("a.dst"))))
        valid = want.where("a is not null and b is not null").where((F.col("a.src") != F.col("d")) & (F.col("c") != F.col("a.dst")))
        flat = valid.select("rep", "pair", F.explode("new").alias("n")).select("rep", "pair", "n.src", "n.dst")
        taken = flat.join(state.select("rep", "src", "dst"), ["rep", "src", "dst"], "left_semi").select("rep", "pair")
        clash = flat.groupBy("rep", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.collect_set("pair").alias("pairs")).where("n > 1").select(
            "rep", F.explode("pairs").alias("pair"))
        bad = taken.unionByName(clash).distinct()
        good = valid.select("rep", "pair").join(bad, ["rep", "pair"], "left_anti").withColumn("swap", F.lit(True))
        decided = want.join(good, ["rep", "pair"], "left")
        old = F.array_compact(F.array(F.when(F.col("a").isNotNull(), F.struct(F.col("a.src").alias("src"), F.col("a.dst").alias("dst"), F.col("a.w").alias("w"))),
                                      F.when(F.col("b").isNotNull(), F.struct(F.col("b.src").alias("src"), F.col("b.dst").alias("dst"), F.col("b.w").alias("w")))))
        fresh = F.array(F.struct(F.col("new")[0]["src"].alias("src"), F.col("new")[0]["dst"].alias("dst"), F.col("a.w").alias("w")),
                        F.struct(F.col("new")[1]["src"].alias("src"), F.col("new")[1]["dst"].alias("dst"), F.col("b.w").alias("w")))
        state = cut_lineage(decided.select("rep", F.explode(F.when(F.col("swap"), fresh).otherwise(old)).alias("e")).select("rep", "e.src", "e.dst", "e.w"))
    return state.select(F.col("rep").cast("bigint").alias("g"), "src", "dst", "w")


def shuffled_columns(long: DataFrame, ids: DataFrame, rep: int, seed: int = 42) -> DataFrame:
    """(id, label): every label column dealt out anew over all subjects.

    A label with n1 positives goes to n1 subjects drawn without replacement, by
    their permuted position under a hash of (label, draw).
    """
    counts = long.groupBy("label").agg(F.countDistinct("id").alias("n1"))
    n = ids.select("id").distinct().count()
    # Position of a subject under a label is the rank of its hash; a hash
    # threshold near n1/n keeps the candidates few before they are ranked.
    u = (F.xxhash64("id", "label", F.lit(seed + rep)).cast("double") / 2.0**64) + 0.5
    width = F.least(F.lit(1.0), F.col("n1") / n + 6 * F.sqrt(F.col("n1") / F.lit(float(n) ** 2)) + 40.0 / n)
    cand = ids.select("id").withColumn("label", F.explode(counts.agg(F.collect_list("label")).scalar())).join(counts, "label")
    cand = cand.withColumn("u", u).where(F.col("u") <= width).withColumn("one", F.lit(1))
    ranked = running_totals(cand, "u", ["one"], ["label"], tie="id")
    return ranked.where("upto_one <= n1").select("id", "label")


def hashed_normal(id_col: str, key: int):
    """A standard normal from two hashes of the id: the same on every retry."""
    u = lambda k: (F.pmod(F.xxhash64(id_col, F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.ln(u(2 * key + 1001))) * F.cos(2 * np.pi * u(2 * key + 1002))


def poisson_counts(df: DataFrame, keys: Sequence[str], reps: int, seed: int = 42) -> DataFrame:
    """(keys, rep, w): bootstrap weight of each group of rows, summed over its ids.

    Groups are told by a hash inside the tasks, which send one vector of draws
    per group they meet, not one row per draw.
    """
    tagged = df.select(F.col("id").cast("bigint").alias("id"), F.xxhash64(*keys).alias("key"))

    def fold(batches):
        acc: dict = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 20000):
                part = pdf.iloc[lo:lo + 20000]
                w = poisson_weights(part["id"].to_numpy(), np.arange(reps), seed)
                codes, names = pd.factorize(part["key"])
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(names)))
                for name, row in zip(names, np.add.reduceat(w[order], starts, axis=0)):
                    acc[name] = acc.get(name, 0) + row
                if len(acc) > 50000:
                    yield pd.DataFrame({"key": list(acc), "w": list(acc.values())})
                    acc = {}
        if acc:
            yield pd.DataFrame({"key": list(acc), "w": list(acc.values())})

    sums = tagged.mapInPandas(fold, "key bigint, w array<double>").select("key", F.posexplode("w").alias("rep", "w"))
    sums = sums.groupBy("key", "rep").agg(F.sum("w").cast("bigint").alias("w"))
    names = df.select(*keys).distinct().withColumn("key", F.xxhash64(*keys))
    return sums.join(names, "key").select(*keys, "rep", "w")
