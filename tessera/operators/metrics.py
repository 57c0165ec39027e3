"""Ranking and calibration metrics from one table of distinct scores.

All of them start from (group, score, pos, neg): rows collapse map-side, so a
score shared by a third of the rows is one row before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, inverse_logit, logit
from tessera.operators.ordered import BUCKET, ranges_for, running_totals, with_previous, with_ranges


def score_table(df: DataFrame, y: str = "y", s: str = "s", by: Sequence[str] = (), w: str | None = None) -> DataFrame:
    """(by, s, pos, neg); rows with a missing score or class drop out."""
    weight = F.col(w).cast("double") if w else F.lit(1)
    score = F.col(s).cast("double")
    hit = F.col(y) > 0
    rows = df.where(score.isNotNull() & ~F.isnan(score) & F.col(y).isNotNull())
    zero = F.lit(0.0) if w else F.lit(0)
    return rows.groupBy(*by, score.alias("s")).agg(
        F.sum(F.when(hit, weight).otherwise(zero)).alias("pos"),
        F.sum(F.when(~hit, weight).otherwise(zero)).alias("neg"))


def auc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, auc, auc_oriented): ties count half; one-class groups give NULL."""
    scan = running_totals(table, "s", ["pos", "neg"], by)
    u = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    den = F.max("total_pos") * F.max("total_neg")
    out = scan.groupBy(*by).agg(u.alias("u"), den.cast("double").alias("_den"))
    a = F.when(F.col("_den") > 0, F.col("u") / F.col("_den"))
    return out.select(*by, "u", a.alias("auc"), F.greatest(a, 1 - a).alias("auc_oriented"))


def _descending(table: DataFrame, by: Sequence[str]) -> DataFrame:
    flipped = table.withColumn("t", -F.col("s"))
    return running_totals(flipped, "t", ["pos", "neg"], by)


def auprc(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step area: sum of precision times recall gained, thresholds descending."""
    scan = _descending(table, by)
    precision = F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))
    out = scan.groupBy(*by).agg(
        F.sum(precision * F.col("pos")).alias("_a"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"))
    ap = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_a") / F.col("_p"))
    prev = F.col("_p") / (F.col("_p") + F.col("_n"))
    norm = clip((ap - prev) / (1 - prev), 0.0, 1.0)
    return out.select(*by, ap.alias("auprc"), F.when(ap.isNotNull(), norm).alias("auprc_norm"))


def gain_curve(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, recall, rec_gain, prec_gain), one row per recall reached.

    A threshold that adds no positive repeats a recall at lower precision, so
    only thresholds with positives stay.
    """
    scan = _descending(table, by).where("pos > 0 and total_neg > 0")
    prev = F.col("total_pos") / (F.col("total_pos") + F.col("total_neg"))
    r = F.col("upto_pos") / F.col("total_pos")
    p = F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))
    return scan.select(
        *by, r.alias("recall"), ((r - prev) / ((1 - prev) * r)).alias("rec_gain"),
        ((p - prev) / ((1 - prev) * p)).alias("prec_gain"))


def auprg(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area in gain space, clipped to the unit square."""
    by = list(by)
    curve = gain_curve(table, by).select(
        *by, "recall", clip("rec_gain", 0.0, 1.0).alias("x"), clip("prec_gain", 0.0, 1.0).alias("h"))
    # Everything left of the origin collapses onto x = 0; the highest point leads on.
    start = curve.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("x") <= 0, F.col("h"))), F.lit(0.0)).alias("_h0"))
    steps = with_previous(curve.where("x > 0"), "recall", ["x", "h"], by)
    steps = steps.join(start, by) if by else steps.withColumn("_h0", start.select("_h0").scalar())
    left_h = F.coalesce("prev_h", "_h0")
    area = (F.col("x") - F.coalesce("prev_x", F.lit(0.0))) * (F.col("h") + left_h) / 2
    return steps.groupBy(*by).agg(F.sum(area).alias("auprg"))


def brier(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, prevalence, brier, brier_r2) of clipped probabilities."""
    p = clip("s", 1e-6, 1 - 1e-6)
    out = table.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("_p"),
        F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p).alias("_b"))
    prev = F.col("_p") / F.col("n")
    bs = F.col("_b") / F.col("n")
    null = prev * (1 - prev)
    return out.select(*by, "n", prev.alias("prevalence"), bs.alias("brier"),
                      F.when(null > 0, 1 - bs / null).alias("brier_r2"))


def shifted(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores moved on the logit scale so that their mean logit meets the prevalence."""
    by = list(by)
    lp = logit(clip("s", 1e-6, 1 - 1e-6))
    n = F.col("pos") + F.col("neg")
    facts = table.groupBy(*by).agg((F.sum(lp * n) / F.sum(n)).alias("_m"), (F.sum("pos") / F.sum(n)).alias("_prev"))
    facts = facts.where("_prev > 0 and _prev < 1").withColumn("_adj", logit("_prev") - F.col("_m")).select(*by, "_adj")
    if by:
        joined = table.join(facts, by)
    else:
        joined = table.withColumn("_adj", facts.select("_adj").scalar())
    return joined.select(*by, inverse_logit(lp + F.col("_adj")).alias("s"), "pos", "neg").groupBy(*by, "s").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def equal_count_bins(table: DataFrame, max_bins: int = 8, min_bin: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, ybar, phat): quantile bins, right-closed.

    Row r (from 0) of n lies in bin ceil(r k / (n - 1)).  Rows that share a
    score are spread over the bins their ranks cover, in equal proportions.
    """
    by = list(by)
    t = table.withColumn("n", F.col("pos") + F.col("neg"))
    scan = running_totals(t, "s", ["n"], by)
    total = F.col("total_n")
    k = F.greatest(F.lit(2), F.least(F.lit(max_bins), F.floor(total / min_bin)))
    last = lambda b: F.floor((total - 1) * b / F.col("k"))  # last row of bin b
    spread = scan.withColumn("k", k.cast("bigint")).withColumn(
        "bin", F.explode(F.sequence(
            F.greatest(F.lit(1), F.ceil(F.col("before_n") * F.col("k") / (total - 1))).cast("bigint"),
            F.greatest(F.lit(1), F.ceil((F.col("upto_n") - 1) * F.col("k") / (total - 1))).cast("bigint"))))
    first_row = F.greatest("before_n", F.when(F.col("bin") > 1, last(F.col("bin") - 1) + 1).otherwise(0))
    last_row = F.least(F.col("upto_n") - 1, last(F.col("bin")))
    spread = spread.withColumn("m", (last_row - first_row + 1).cast("double"))
    return spread.where("m > 0").groupBy(*by, "bin").agg(
        F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("pos") / F.col("n")) / F.sum("m")).alias("ybar"),
        (F.sum(F.col("m") * F.col("s")) / F.sum("m")).alias("phat"))


def adaptive_ece(table: DataFrame, by: Sequence[str] = (), max_bins: int = 8, min_bin: int = 10) -> DataFrame:
    bins = equal_count_bins(shifted(table, by), max_bins, min_bin, by)
    gap = F.sum(F.col("n") * F.abs(F.col("phat") - F.col("ybar"))) / F.sum("n")
    return bins.groupBy(*by).agg(gap.alias("aece"), F.count(F.lit(1)).alias("n_bins"))


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge adjacent violators inside one range of blocks."""
    pdf = pdf.sort_values("lo")
    out: list[list] = []
    for lo, hi, w, m, slot in zip(pdf["lo"], pdf["hi"], pdf["w"], pdf["m"], pdf["slot"]):
        out.append([lo, hi, w, m, slot])
        while len(out) > 1 and out[-2][3] >= out[-1][3]:
            last, into = out.pop(), out[-1]
            total = into[2] + last[2]
            into[3] = (into[3] * into[2] + last[3] * last[2]) / total
            into[1], into[2] = last[1], total
    return pd.DataFrame(out, columns=["lo", "hi", "w", "m", "slot"])


def isotonic_blocks(table: DataFrame) -> DataFrame:
    """(lo, hi, w, m): the monotone fit as constant blocks of scores.

    Each round pools violators inside ranges; the ranges shift by half between
    rounds.  When two rounds in a row merge nothing, no neighbours violate the
    order, which is the (unique) isotonic solution.
    """
    from tessera.session import cut_lineage

    w = (F.col("pos") + F.col("neg")).cast("double")
    ranged = with_ranges(table, "s", ranges_for(table))
    blocks = ranged.select(F.col("s").alias("lo"), F.col("s").alias("hi"), w.alias("w"),
                           (F.col("pos") / w).alias("m"), F.col(BUCKET).cast("int").alias("slot"))
    schema = "lo double, hi double, w double, m double, slot int"
    def held() -> dict[int, int]:
        """Blocks per slot; there are at most as many slots as ranges."""
        return {r["slot"]: r["count"] for r in blocks.groupBy("slot").count().collect()}

    before, calm, shift = None, 0, 0
    sizes = held()
    while calm < 2:
        # Slots lose their last block now and then: number them anew, without holes.
        dense = F.array_position(F.array(*[F.lit(v) for v in sorted(sizes)]), F.col("slot")).cast("int")
        pair = F.floor((dense + shift) / 2)
        blocks = cut_lineage(blocks.groupBy(pair.alias("_pair")).applyInPandas(_pool, schema))
        sizes = held()
        now = sum(sizes.values())
        calm = calm + 1 if now == before else 0
        before, shift = now, 1 - shift
        if len(sizes) == 1:
            break
    return blocks.drop("slot")


def calibration_curve(table: DataFrame) -> DataFrame:
    """(p, fit): isotonic calibration of shifted scores at each distinct score."""
    t = shifted(table)
    blocks = isotonic_blocks(t).select("lo", "m")
    # Each score takes the last block that starts at or below it: a running
    # count of block starts numbers the blocks in order.
    marked = t.join(blocks.select(F.col("lo").alias("s"), F.lit(1).alias("start")), "s", "left").select(
        "s", F.coalesce("start", F.lit(0)).alias("start"))
    numbered = running_totals(marked, "s", ["start"]).select("s", F.col("upto_start").alias("k"))
    order = running_totals(blocks.withColumn("one", F.lit(1)), "lo", ["one"]).select(F.col("upto_one").alias("k"), "m")
    return numbered.join(order, "k").select(F.col("s").alias("p"), F.col("m").alias("fit"))


def signed_rank(diffs: DataFrame, d: str = "d") -> DataFrame:
    """(v, n, z): signed-rank sum of positive differences, zeros dropped.

    Ranks come from distinct absolute values with counts per sign.
    """
    t = diffs.where(F.col(d) != 0).groupBy(F.abs(F.col(d)).alias("a")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(d) > 0).cast("bigint")).alias("up"))
    scan = running_totals(t, "a", ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    c = F.col("n").cast("double")
    out = scan.agg(F.sum(F.col("up") * rank).cast("double").alias("v"), F.sum("n").alias("n"), F.sum(c * (c * c - 1)).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select("v", "n", ((F.col("v") - n * (n + 1) / 4 - 0.5) / sd).alias("z"))
