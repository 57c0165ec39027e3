"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in shuffled order, up to `max_copies`
times over.  A document's virtual finish time is the words its source has sent
by its end, divided by the weight of the source.  All copies are sorted by
finish time over the whole table, in ranges, and taken while the running total
of words stays within the budget.  A source that runs out leaves the rest of the
budget to the others by their weights, as the queueing does by itself.

The order of documents is by a hash of seed and id: reruns agree.  Running sums
are taken in sorted ranges (`scans`), so a source may hold any share of rows.

Defined cases: null and empty texts have size 0 and are taken at most once; a
null source is a source, the last; rows that share an id count as rows of their
own, and are ordered by their sizes; ties in finish time go by the order of the
sources, then copies; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.rows import cut_lineage, cut_small, unique
from tessera.llm.scans import running_sum

SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return: their first characters are counted."""
    rest = F.regexp_replace(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", "")
    return F.coalesce((F.char_length(text) - F.char_length(rest)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sources: DataFrame, budget: Column, max_copies: int, rows: int) -> DataFrame:
    """Add `target` to (source_size, weight, rank): shares by weight, at most max_copies times the size.

    Sources are met in the order in which a growing share per weight fills them;
    those whose fill level the budget reaches are full.
    """
    cap = (F.lit(max_copies) * F.col("source_size")).cast("double")
    known = sources.withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    order = [F.col("level"), F.col("rank")]
    known = running_sum(known, [], order, "source_size", "upto_size", rows)
    known = running_sum(known, [], order, "weight_units", "upto_units", rows)
    known = cut_small(known.withColumn("budget", budget), rows)
    all_units = F.lit(known.agg(F.sum("weight_units")).first()[0])
    full = (F.lit(max_copies) * (F.col("upto_size") - F.col("source_size"))
            + F.col("level") * (all_units - F.col("upto_units") + F.col("weight_units"))) <= F.col("budget")
    marked = known.withColumn("full", full)
    used, units = marked.agg(F.sum(F.when(F.col("full"), F.lit(max_copies) * F.col("source_size"))),
                             F.sum(F.when(~F.col("full"), F.col("weight_units")))).first()
    each = (F.col("budget") - F.lit(used or 0)).cast("double") / F.lit(units or 1).cast("double")
    return marked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * each))


def mixed_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, budget: int | None = None,
                 seed: str = SEED) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies) of every document.

    Sources by code point, null last, weigh `weights` in turn; the budget is all
    words unless given.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    base = base.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))))
    base = cut_lineage(base.withColumn("one", F.lit(1)))
    rows = base.count()
    base = running_sum(base, [], [F.col("draw"), F.col("id"), F.col("size"), F.col("source").asc_nulls_last()], "one", "row", rows)
    base = cut_small(base, rows)
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    sources = cut_small(sources, rows)
    n_sources = sources.count()
    sources = running_sum(sources, [], [F.col("source").asc_nulls_last()], "one", "rank", n_sources)
    units = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight_units", units.cast("bigint")).withColumn("weight", units.cast("double"))
    total = F.lit(int(budget)) if budget is not None else F.lit(base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    sources = cut_small(targets(sources, total, max_copies, n_sources).select(
        F.col("source").alias("s"), "source_size", "weight", "rank", "target"), n_sources)
    known = running_sum(base, ["source"], [F.col("row")], "size", "sent", rows)
    known = known.join(sources, F.col("source").eqNullSafe(F.col("s")))
    known = cut_small(known.select("row", "id", "source", "size", "sent", "source_size", "weight", "rank", "target"), rows)
    copies = known.select("row", "size", "rank", "weight", "sent", "source_size", F.explode(
        F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(max_copies - 1)).otherwise(F.lit(0)))).alias("copy"))
    copies = copies.select("row", "size", "rank", "copy", (
        (F.col("copy") * F.col("source_size") + F.col("sent")).cast("double") / F.col("weight")).alias("finish"))
    queue = running_sum(copies, [], [F.col("finish"), F.col("rank"), F.col("copy"), F.col("row")], "size", "total", max_copies * rows)
    taken = queue.where(F.col("total") <= total).groupBy("row").agg(
        F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0).cast("bigint")
    return known.join(taken, "row", "left").select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
        F.coalesce("taken", zero).alias("taken"), F.coalesce("copies", zero).alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `docs` that the mix takes, each as many times as it takes it, with all their columns."""
    counts = mixed_counts(docs, id_col, text_col, source_col, **how)
    takes = counts.select(F.col(id_col).alias("id"), "size", F.col(source_col).alias("source"), "copies")
    own = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("id"))
    if unique(docs, id_col):
        joined = own.join(takes.where("copies > 0").select("id", "copies"), "id")
    else:  # rows of one id, size and source can stand for each other
        alike = ["id", "size", "source"]
        takes = takes.withColumn("k", F.row_number().over(Window.partitionBy(*alike).orderBy("copies"))).where("copies > 0")
        own = own.withColumn("size", n_words(F.col("whole")[text_col])).withColumn("source", F.col("whole")[source_col])
        own = own.withColumn("n", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64(F.col("whole")[text_col]))))
        same = [own[c].eqNullSafe(takes[c]) for c in alike] + [own["n"] == takes["k"]]
        joined = own.join(takes, same).select("whole", "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("whole.*")
