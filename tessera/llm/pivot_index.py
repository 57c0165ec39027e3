"""Pairs of near vectors by a pivot-permutation index.

Pivots are well-separated vectors of a bounded sample.  Every vector is
described by its nearest pivots in order of nearness, and entered in the
inverted lists of pivots.  Two vectors that share enough pivots are candidates;
candidates are verified by their cosine in double precision.

A pair that shares `shared` of `nearest` pivots has its first common pivot, in
one order of all pivots, among the first `nearest - shared + 1` of both: only
those lists hold a vector, and the pair is judged in the list of that first
pivot alone.  Lists are cut in blocks by a hash of the vector, and blocks meet
two by two, so that a list of any length spreads over tasks.  From a meeting come
one row per linked vector (how many links, and one vector of its group), never
pairs.

Exact copies are one class from the start and count as often as they stand.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; shorter vectors count as padded with zeros;
repeated and null ids are rows of their own, in the order of id and vector, and
the id of the first names the component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import bounded_batches, cut_lineage, keyed, with_id
from tessera.operators.graph import components

NEAREST, SHARED = 8, 2
PER_PIVOT = 24         # classes for one pivot, as long as their number allows
MOST_PIVOTS = 2048
PIVOT_BYTES = 32 << 20  # and their matrix is no larger than this
SAMPLED = 8            # sample rows for one pivot
BLOCK = 4096           # vectors of one list in a block
EARLIER = 1 << 20      # what a common pivot before the list's own adds to a count


def units(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one from lists of numbers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def separated(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """The first rows of the sample of which no two have the cosine."""
    kept = np.zeros((most, sample.shape[1]))
    n = 0
    for v in sample:
        if n < most and not (n and (kept[:n] @ v).max() >= cosine):
            kept[n] = v
            n += 1
    return kept[:n]


def permutations(v: np.ndarray, pivots: np.ndarray, nearest: int, rows: int = 512) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties by number; some rows at a time."""
    if len(v) > rows:
        return np.concatenate([permutations(v[a:a + rows], pivots, nearest) for a in range(0, len(v), rows)])
    near = v @ pivots.T
    if nearest < len(pivots):
        some = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    else:
        some = np.tile(np.arange(len(pivots)), (len(v), 1))
    some = np.sort(some, axis=1)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def _describe(batches, pivots, nearest, width):
    matrix = pivots.value
    for batch in batches:
        if len(batch):
            near = permutations(units(batch.column(2), width), matrix, nearest).astype(np.int32)
            listed = pa.ListArray.from_arrays(np.arange(0, near.size + 1, nearest, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], ["cid", "copies", "v", "near"])


class Groups:
    """Sets of rows that links join."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]


def _linked(q: np.ndarray, e: np.ndarray, cosine: float) -> np.ndarray:
    near = q @ e.T
    edge = np.argwhere(np.abs(near - cosine) < 1e-12)  # decided the same way whatever the blocks
    for i, j in edge:
        near[i, j] = np.sum(q[i] * e[j])
    return near >= cosine


def meet(v: np.ndarray, near: np.ndarray, copies: np.ndarray, n_query: int, own: int, shared: int, cosine: float):
    """Links of one list between its first `n_query` rows and the others (all with all if there are no others).

    `near` holds places of pivots in their common order, ascending per row.
    Gives how many rows each is linked with, counted with copies, and group labels."""
    n = len(v)
    first, lo = (np.arange(n_query), n_query) if n_query < n else (np.arange(n), 0)
    inside = near[lo:]
    flat = inside.ravel()
    order = np.argsort(flat, kind="stable")
    holder = order // near.shape[1]
    starts = np.searchsorted(flat[order], np.arange(near.max() + 2))
    links, groups = np.zeros(n, np.int64), Groups(n)
    size = n - lo
    step = max(1, (1 << 21) // size)
    for a in range(0, len(first), step):
        rows = first[a:a + step]
        wanted = near[rows].ravel()
        length = starts[wanted + 1] - starts[wanted]
        total = np.cumsum(length)
        place = np.arange(total[-1]) - np.repeat(total - length, length) + np.repeat(starts[wanted], length)
        query = np.repeat(np.arange(len(wanted)) // near.shape[1], length)
        weight = np.where(np.repeat(wanted, length) < own, EARLIER, 1)
        counts = np.bincount(query * size + holder[place], weight, len(rows) * size).reshape(len(rows), size)
        found = (counts >= shared) & (counts < EARLIER)
        if lo == 0:
            found[np.arange(len(rows)), rows] = False
        some = np.flatnonzero(found.any(axis=1))
        if not len(some):
            continue
        hit = found[some] & _linked(v[rows[some]], v[lo:], cosine)
        links[rows[some]] += hit @ copies[lo:]
        if lo:
            links[lo:] += copies[rows[some]] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            groups.join(np.r_[rows[some[i]], lo + np.flatnonzero(hit[i])])
    return links, groups.label


def _meeting(key, table, place, shared, cosine, width):
    own, low, high = (int(k.as_py()) for k in key)
    block = table.column("block").to_numpy()
    order = np.lexsort((table.column("cid").to_numpy(), block != low))
    cids, copies = (table.column(c).to_numpy()[order] for c in ("cid", "copies"))
    v = units(table.column("v"), width)[order]
    near = table.column("near").combine_chunks()
    near = place[near.flatten().to_numpy().reshape(len(near), -1)[order]]
    n_query = int((block == low).sum()) if low != high else len(v)
    if low != high and n_query in (0, len(v)):
        return _LINKS.empty_table()
    links, label = meet(v, np.sort(near, axis=1), copies, n_query, int(place[own]), shared, cosine)
    some = np.flatnonzero(links)
    return pa.table([cids[some], links[some], cids[label[some]]], schema=_LINKS)


_LINKS = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _usable(column: str):
    """Whether a vector can have a cosine."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(column, finite) & F.exists(column, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
                 nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): rows with a cosine of at least `cosine` that share pivots are linked."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, plain = keyed(vectors, id_col, vector_col)
    rows = rows.withColumnRenamed("text", "v")
    usable = rows.where(_usable("v"))
    classes = cut_lineage(usable.groupBy("v").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("copies")).select("cid", "copies", "v"))
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    alone = F.lit(0).cast("bigint").alias("n_links"), F.col("rid").alias("component")
    if not n:
        return _named(rows.select("rid", *alone), rows, plain, id_col)
    linked = cut_lineage(_links(classes, n, width, cosine, nearest, shared, block))
    edges = linked.where("cid <> other").select(F.col("cid").alias("src"), F.col("other").alias("dst"))
    per = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    per = per.join(components(edges).withColumnRenamed("id", "cid"), "cid", "left")
    classed = classes.join(per, "cid", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    few = classed.where("n_links > 0")  # most vectors have no link and need no partner here
    out = rows.join(few, "v", "left").select(
        "rid", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rid").alias("component"))
    return _named(out, rows, plain, id_col)


def _links(classes: DataFrame, n: int, width: int, cosine: float, nearest: int, shared: int,
           block: int) -> DataFrame:
    spark = classes.sparkSession
    most = int(max(64, min(MOST_PIVOTS, n // PER_PIVOT, PIVOT_BYTES // (8 * width))))
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLED * most).select("v").toArrow()
    sample = units(drawn.column("v"), width)
    pivots = separated(sample, most, cosine)
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    # Pivots that few of the sample name come first: their lists are short.
    named = np.bincount(permutations(sample, pivots, nearest).ravel(), minlength=len(pivots))
    place = np.empty(len(pivots), np.int32)
    place[np.lexsort((np.arange(len(pivots)), named))] = np.arange(len(pivots))
    kind = classes.schema["v"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(pivots)
    index = cut_lineage(classes.mapInArrow(partial(_describe, pivots=shipped, nearest=nearest, width=width),
                                           f"cid bigint, copies bigint, v {kind}, near array<int>"))
    order = F.array(*[F.lit(int(p)) for p in place])
    by_place = F.array_sort(F.transform("near", lambda p: F.struct(F.get(order, p).alias("place"), p.alias("pivot"))))
    lists = index.withColumn("pivot", F.explode(F.slice(by_place, 1, nearest - shared + 1))).withColumn("pivot", F.col("pivot.pivot"))
    blocks = lists.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    cut = lists.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("cid"), "n_blocks").cast("int"))
    met = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("pivot", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
                     "block", "cid", "copies", "v", "near")
    return met.groupBy("pivot", "low", "high").applyInArrow(
        partial(_meeting, place=place, shared=shared, cosine=cosine, width=width), "cid bigint, links bigint, other bigint")


def _named(out: DataFrame, rows: DataFrame, plain: bool, id_col: str) -> DataFrame:
    """With the caller's ids, and whether a row is the first of its component."""
    out = out.withColumn("kept", F.col("rid") == F.col("component"))
    if plain:
        return out.select(F.col("rid").alias(id_col), "n_links", F.col("component").alias("component_id"), "kept")
    names = rows.select(F.col("rid").alias("component"), F.col("_id").alias("component_id"))
    out = out.join(names, "component")
    return with_id(out, rows, plain, id_col).select(id_col, "n_links", "component_id", "kept")
