"""Substring deduplication on word windows with a count-min prefilter.

1. Every task keeps a count-min sketch of the hashes of its word windows; the
   sketches are merged.  Estimates never fall below true counts.
2. A second pass takes only windows that the merged sketch calls repeated, and
   groups them exactly by 96 bits of hash.  A task first groups its own windows,
   so that a window reaches its hash bucket once per task however many copies
   there are; buckets then find which task holds the first occurrence.
3. Marks return to the documents by blocks of ids, and covered words go.

Defined cases: null and empty texts have no words and keep the empty text; texts
shorter than a window lose nothing; of equal texts the one with the smallest id
stays whole; rows that share an id, or have none, count as rows of their own in
the order of their texts; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.rows import brought_together, buckets_for, keyed, runs_of, text_bytes, with_id
from tessera.llm.sketch import Sketch, count_repeats

BLOCK = 1_000_000  # candidate windows a task groups at a time
PER_BUCKET = 500_000
TEXT_BLOCK = 8 << 20  # bytes of text handled together in the last step
_KIND = (np.uint64, np.uint32, np.int64, np.int32)
_PACKED = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_FIRST, _SECOND = A.Alphabet(seed=11), A.Alphabet(seed=12)


def _windows(buf, offs, window, alphabet=_FIRST):
    start, _, first = A.word_bounds(buf, offs, alphabet)
    h = A.rolling(A.word_hashes(buf, start, alphabet), window)
    at = A.whole_windows(first, window)
    return h[at], at, first, start


def window_keys(buf, offs, window):
    return _windows(buf, offs, window)[0]


def _later(h, check, rid, pos):
    """Order by content and occurrence, and which entries follow an equal one."""
    order = np.lexsort((pos, rid, check, h))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])]
    return order, same


def _candidates(batches, shared, window, buckets, blocks):
    sketch, held, n = Sketch(*shared.value), [], 0

    def flush():
        h, check, rid, pos = (np.concatenate(c) for c in zip(*held))
        order, same = _later(h, check, rid, pos)
        late, lead = order[same], order[~same]
        for b, part in A.cut_by(rid[late] % blocks):
            part = late[part]
            yield buckets + b, A.pack(rid[part], pos[part])
        lead = np.sort(lead)
        for b, part in A.cut_by((h[lead] % A.U(buckets)).astype(np.int64)):
            part = lead[part]
            yield b, A.pack(h[part], check[part], rid[part], pos[part])

    def out():
        rows = list(flush())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    for ids, buf, offs in A.text_pieces(batches):
        h, at, first, start = _windows(buf, offs, window)
        keep = sketch.repeated(h)
        if keep.any():
            check = A.rolling(A.word_hashes(buf, start, _SECOND), window, 2)
            at = at[keep]
            text = np.searchsorted(first, at, "right") - 1
            held.append((h[keep], (check[at] >> A.U(32)).astype(np.uint32), ids[text].astype(np.int64),
                         (at - first[text]).astype(np.int32)))
            n += len(at)
            if n >= BLOCK:
                yield out()
                n = 0
    if held:
        yield out()


def _resolve(batches, buckets, blocks):
    def fold(key, rows):
        bucket = key[0]
        if bucket >= buckets:  # settled in a task already
            for (blob,) in rows:
                yield bucket - buckets, blob
            return
        h, check, rid, pos = A.unpack_all((r[0] for r in rows), *_KIND)
        order, same = _later(h, check, rid, pos)
        late = order[same]
        for b, part in A.cut_by(rid[late] % blocks):
            yield b, A.pack(rid[late[part]], pos[late[part]])

    for b, blob in runs_of(batches, 1, fold):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=_PACKED)


def _cut(docs: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    rid, pos = A.unpack_all(marks.column("packed").to_pylist(), np.int64, np.int32)
    order = np.argsort(rid, kind="stable")
    rid, pos = rid[order], pos[order]
    ids = docs.column("rid").to_numpy()
    lo, hi = np.searchsorted(rid, ids), np.searchsorted(rid, ids, "right")
    total, gone, kept = [], [], []
    for i, text in enumerate(docs.column("text").cast(pa.large_binary())):
        words = (text.as_py() or b"").split()
        total.append(len(words))
        if lo[i] < hi[i]:
            at = pos[lo[i]:hi[i]].astype(np.int64)
            hit = A.covered(len(words), at, at + window)
            gone.append(int(hit.sum()))
            words = compress(words, ~hit)
        else:
            gone.append(0)
        kept.append(b" ".join(words))
    return pa.table({"rid": docs.column("rid"), "n_words": pa.array(total, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text): words of windows that also start earlier are removed.

    Earlier: a smaller id, or the same text further left.  Windows are judged on
    the input.  Words are runs of anything but space and tab to carriage return.
    """
    spark = docs.sparkSession
    rows, plain = keyed(docs, id_col, text_col)
    size = text_bytes(rows)
    expected = size / 6
    shared = count_repeats(rows, partial(window_keys, window=window), expected)
    buckets = buckets_for(spark, 0.4 * expected, PER_BUCKET)
    blocks = buckets_for(spark, size, TEXT_BLOCK)
    found = rows.select("rid", "text").mapInArrow(
        partial(_candidates, shared=shared, window=window, buckets=buckets, blocks=blocks), "bucket int, packed binary")
    marks = brought_together(found, "bucket").mapInArrow(
        partial(_resolve, buckets=buckets, blocks=blocks), "block int, packed binary")
    texts = rows.select("rid", "text", F.pmod("rid", F.lit(blocks)).cast("int").alias("block"))
    out = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        partial(_cut, window=window), "rid bigint, n_words bigint, n_removed bigint, kept_text string")
    return with_id(out, rows, plain, id_col)


__all__ = ["drop_repeated_windows"]
