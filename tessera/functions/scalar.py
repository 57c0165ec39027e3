"""Column expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Six decimals, without negative zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def logit(p) -> Column:
    return F.ln(col(p) / (F.lit(1.0) - col(p)))


def inverse_logit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def choose2(n) -> Column:
    n = col(n).cast("double")
    return n * (n - 1) / 2


def ratio(num, den) -> Column:
    """NULL instead of a division by zero."""
    return F.when(col(den) != 0, col(num).cast("double") / col(den))


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return (
        F.when(ok, F.greatest(F.lit(0.0), centre - half)),
        F.when(ok, F.least(F.lit(1.0), centre + half)),
    )


def stars(q, one: float = 0.05, two: float = 0.01, ns: str = "ns") -> Column:
    return F.when(col(q).isNull(), "").when(col(q) < two, "**").when(col(q) < one, "*").otherwise(ns)


def safe_name(c) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9_.-]+", "_")


def count_of(c, needle: str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(needle), F.lit("")))


def estimate_text(est, lo, hi) -> Column:
    """`0.123 [0.100, 0.200]`, rounded from the binary value as C does."""
    num = lambda c: F.replace(F.format_number(col(c), 3), F.lit(","), F.lit(""))
    return F.concat(num(est), F.lit(" ["), num(lo), F.lit(", "), num(hi), F.lit("]"))


def fold_of(id_col, k: int) -> Column:
    """Reproducible fold from a hash of the id; no shuffle, no state."""
    head = F.substring(F.md5(col(id_col).cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(k)
