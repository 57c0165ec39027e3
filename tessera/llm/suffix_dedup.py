"""Suffix-array deduplication: bytes covered by a long string that occurs twice.

A string of `length` bytes at place p is represented by one suffix: the one that
starts at its canonical anchor, the leftmost place inside the string whose short
gram hashes lowest.  The anchor depends on the string alone, so two equal
strings have the same anchor at the same distance, and one suffix in about
length / 2 bytes stands for all places.

1. A count-min sketch of probe strings (half the length, at sampled places that
   depend on content alone) rules out strings that hold a probe occurring once.
2. The suffixes of the remaining strings, each with the bytes its strings span,
   are range-partitioned by their leading bytes at sampled splitters.  Equal
   suffixes of one task travel once.
3. Buckets sort the suffixes, and the reversed bytes before the anchors, by
   multikey quicksort on 8-byte characters.  Two strings are equal when their
   suffixes and their reversed prefixes are: neighbours in either order are
   compared by common prefix lengths, over the borders of the pieces a bucket
   is handled in.  Splitters fall between leading bytes, so that no pair of
   equal strings lies on two sides of one.

Comparison is exact on bytes; hashes only choose anchors and filter.

Defined cases: null is the empty text; texts shorter than `length` lose nothing;
all copies of a repeated string go, also the first; rows that share an id, or
have none, count as rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.rows import brought_together, buckets_for, keyed, runs_of, sizes, with_id
from tessera.llm.sketch import Sketch, count_repeats

SEGMENT = 4 << 20  # bytes of a very long text handled at a time
BLOCK = 32 << 20  # bytes of suffixes a task collects before it sends them
PER_BUCKET = 12 << 20
TEXT_BLOCK = 8 << 20
SORTED_AT_ONCE = 16_000
SAMPLE_DOCS = 2_000  # texts looked at for the splitters, which only balance the work
SAMPLE_LEADS = 128  # leading bytes taken from each
_BYTES = A.Alphabet(b"", seed=21)
_PACKED = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])


class Shape:
    """Lengths that follow from the length of the strings sought."""

    def __init__(self, length: int):
        if length < 32:
            raise ValueError("strings of at least 32 bytes are sought")
        self.length = length
        self.gram = min(16, length // 4)
        self.winnow = min(32, length // 8)
        self.probe = length // 2
        self.first = self.winnow - 1
        self.last = min(length - self.probe, length - self.winnow - self.gram + 1)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each window."""
    if len(v) < width:
        return np.zeros(0, np.int32)
    at, w = np.arange(len(v), dtype=np.int32), 1
    while True:
        step = min(w, width - w)
        if step == 0:
            return at
        n = len(v) - step
        right = v[step:] < v[:n]
        at = np.where(right, at[step:], at[:n])
        v = np.where(right, v[step:], v[:n])
        w += step


def _segments(batches, shape: Shape) -> Iterator[tuple]:
    """(ids, bytes, offsets, base, owned): long texts in overlapping parts, of which `owned` places count."""
    over = 2 * shape.length
    for ids, buf, offs in A.text_pieces(batches):
        if len(ids) == 1 and len(buf) > SEGMENT + over:
            for base in range(0, len(buf), SEGMENT):
                part = buf[base:base + SEGMENT + over]
                yield ids, part, np.array([0, len(part)]), base, SEGMENT
        else:
            yield ids, buf, offs, 0, len(buf)


def _grams(buf, shape):
    return A.rolling(_BYTES.value[buf], shape.gram)


def _probes(buf, offs, grams, shape):
    """Places of anchors that have a whole probe, and the hashes of the probes."""
    least = sliding_argmin((grams >> A.U(32)).astype(np.uint32), shape.winnow)
    starts = A.whole_windows(offs, shape.winnow + shape.gram - 1)
    anchors = least[starts]
    anchors = anchors[np.r_[True, anchors[1:] != anchors[:-1]]] if len(anchors) else anchors
    flag = np.zeros(len(buf), bool)
    flag[anchors] = True
    whole = np.zeros(len(buf), bool)
    whole[A.whole_windows(offs, shape.probe)] = True
    at = np.flatnonzero(flag & whole)
    return at, A.rolling(_BYTES.value[buf], shape.probe, 3)[at] if len(at) else np.zeros(0, A.U)


def probe_keys(buf, offs, length):
    shape, out = Shape(length), []
    if len(offs) == 2 and len(buf) > SEGMENT:
        over = 2 * length
        parts = [buf[b:b + SEGMENT + over] for b in range(0, len(buf), SEGMENT)]
    else:
        parts = [buf]
    for part in parts:
        bounds = offs if len(parts) == 1 else np.array([0, len(part)])
        out.append(_probes(part, bounds, _grams(part, shape), shape)[1])
    return np.concatenate(out)


def _leads(batches, length):
    """The leading bytes of some anchors of each text."""
    shape = Shape(length)
    for _, buf, offs in A.text_pieces(batches):
        found = []
        for a, b in zip(offs[:-1], offs[1:]):
            text = buf[a:min(b, a + SEGMENT)]
            anchors = np.unique(sliding_argmin((_grams(text, shape) >> A.U(32)).astype(np.uint32), length - shape.gram + 1))
            some = anchors[np.linspace(0, len(anchors) - 1, min(len(anchors), SAMPLE_LEADS)).astype(int)] if len(anchors) else []
            found += [int.from_bytes(text[x:x + 8].tobytes().ljust(8, b"\0"), "big") - (1 << 63) for x in some]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["lead"])


def _suffixes(batches, shared, length, splitters, blocks):
    shape, sketch = Shape(length), Sketch(*shared.value)
    buckets = len(splitters) + 1
    held, marks, size = {}, [], 0

    def flush():
        if marks:
            rid, lo, hi = np.array(marks, np.int64).T
            for b, part in A.cut_by(rid % blocks):
                yield buckets + b, A.pack(rid[part], lo[part], hi[part])
        if held:
            keys = list(held)
            lead = np.array([int.from_bytes(c[o:o + 8].ljust(8, b"\0"), "big") for c, o in keys], np.uint64)
            for b, part in A.cut_by(np.searchsorted(splitters, lead, "right")):
                some = [keys[i] for i in part]
                got = [held[k] for k in some]
                text = b"".join(k[0] for k in some)
                numbers = A.pack(np.array([len(k[0]) for k in some], np.int32), np.array([k[1] for k in some], np.int32),
                                 np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64),
                                 np.array([g[2] for g in got], np.uint8))
                yield b, len(numbers).to_bytes(8, "little") + numbers + A.pack(np.frombuffer(text, np.uint8))

    def out():
        rows = list(flush())
        held.clear()
        marks.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED)

    for ids, buf, offs, base, owned in _segments(batches, shape):
        live = A.whole_windows(offs, length)
        if not len(live):
            continue
        grams = _grams(buf, shape)
        at, keys = _probes(buf, offs, grams, shape)
        bad = at[~sketch.repeated(keys)]
        head = offs[np.searchsorted(offs, bad, "right") - 1]
        dead = A.covered(len(buf), np.maximum(bad - shape.last, head), np.maximum(bad - shape.first + 1, head))
        live = live[~dead[live]]
        live = live[live < owned]
        if not len(live):
            continue
        value = (grams >> A.U(32)).astype(np.uint32)
        for run in np.split(live, np.flatnonzero(np.diff(live) != 1) + 1):
            s, e = int(run[0]), int(run[-1]) + 1
            anchor = sliding_argmin(value[s:e - 1 + length - shape.gram + 1], length - shape.gram + 1)
            text = int(np.searchsorted(offs, s, "right")) - 1
            rid, shift = int(ids[text]), base - int(offs[text]) + s
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            region = buf[s:e - 1 + length].tobytes()
            for lo, hi, a in zip([0, *cuts.tolist()], [*cuts.tolist(), e - s], anchor[np.r_[0, cuts]].tolist()):
                key = (region[lo:hi - 1 + length], a - lo)
                known = held.get(key)
                if known is None:
                    held[key] = [rid, shift + lo, 0]
                    size += hi - lo + length
                else:
                    marks.append((rid, shift + lo, shift + hi - 1 + length))
                    if not known[2]:
                        known[2] = 1
                        marks.append((known[0], known[1], known[1] + hi - lo - 1 + length))
        if size >= BLOCK or len(marks) > 1_000_000:
            yield out()
            size = 0
    if held or marks:
        yield out()


def multikey_sort(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte characters, and bytes each shares with the row before.

    Runs equal so far are partitioned on the next character, all runs of a depth
    in one pass; rows that stand alone are done.
    """
    n, width = chars.shape
    order, shared = np.arange(n), np.zeros(n, np.int32)
    places, run = np.arange(n), np.zeros(n, np.int64)
    for depth in range(width):
        if not len(places):
            break
        key = chars[order[places], depth]
        into = np.lexsort((key, run))
        order[places] = order[places][into]
        key, run = key[into], run[into]
        same_run = np.r_[False, run[1:] == run[:-1]]
        differ = np.r_[A.U(0), key[1:] ^ key[:-1]]
        split = same_run & (differ != 0)
        common = np.zeros(len(places), np.int32)
        for b in range(1, 8):
            common += differ < (A.U(1) << A.U(64 - 8 * b))
        shared[places[split]] = depth * 8 + common[split]
        fresh = ~same_run | split
        run = np.cumsum(fresh)
        alone = fresh & np.r_[fresh[1:], True]
        places, run = places[~alone], run[~alone]
    if len(places):
        shared[places[np.r_[False, run[1:] == run[:-1]]]] = width * 8
    return order, shared


def _chars(strings: list[bytes]) -> np.ndarray:
    width = -(-max(map(len, strings), default=0) // 8) * 8 or 8
    joined = b"".join(s.ljust(width, b"\0") for s in strings)
    return np.frombuffer(joined, ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def repeated_strings(texts: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """Flags (suffix, place): which of the strings each text spans equals one of another suffix."""
    n = len(texts)
    places = np.array([len(t) for t in texts]) - length + 1
    right, right_common = multikey_sort(_chars([t[a:] for t, a in zip(texts, anchor)]))
    left, left_common = multikey_sort(_chars([t[:a][::-1] for t, a in zip(texts, anchor)]))
    hit = np.zeros((n, int(places.max())), bool)
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for before in range(int((anchor - places + 1).min()), int(anchor.max()) + 1):
        some = np.flatnonzero((before > anchor - places) & (before <= anchor))
        if len(some) < 2:
            continue
        right_class[right] = np.cumsum(right_common < length - before)
        left_class[left] = np.cumsum(left_common < before) if before else 0
        key = right_class[some] * (n + 1) + left_class[some]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        many = some[order[np.r_[False, same] | np.r_[same, False]]]
        hit[many, anchor[many] - before] = True
    return hit


def _resolve(batches, length, buckets, blocks):
    def fold(key, rows):
        if key[0] >= buckets:
            for (blob,) in rows:
                yield key[0] - buckets, blob
            return
        texts, numbers = [], []
        for (blob,) in rows:
            size = int.from_bytes(blob[:8], "little")
            own = A.unpack(blob[8:8 + size], np.int32, np.int32, np.int64, np.int64, np.uint8)
            joined, ends = A.unpack(blob[8 + size:], np.uint8)[0].tobytes(), np.cumsum(own[0])
            texts += [joined[e - n:e] for n, e in zip(own[0].tolist(), ends.tolist())]
            numbers.append(own)
        _, anchor, rid, lo, done = (np.concatenate(c) for c in zip(*numbers))
        lead = np.array([int.from_bytes(t[a:a + 8].ljust(8, b"\0"), "big") for t, a in zip(texts, anchor.tolist())], np.uint64)
        order = np.argsort(lead, kind="stable")
        heads = np.flatnonzero(np.r_[True, lead[order][1:] != lead[order][:-1]])
        counts = np.diff(np.r_[heads, len(order)])
        group, room = [], 0
        for head, count in zip(heads.tolist(), counts.tolist()):
            if count == 1:
                continue
            if room and room + count > SORTED_AT_ONCE:
                yield from spans(texts, anchor, rid, lo, done, np.concatenate(group))
                group, room = [], 0
            group.append(order[head:head + count])
            room += count
        if room:
            yield from spans(texts, anchor, rid, lo, done, np.concatenate(group))

    def spans(texts, anchor, rid, lo, done, some):
        hit = repeated_strings([texts[i] for i in some], anchor[some], length)
        hit[done[some] == 1] = False
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        ids, base = rid[some][row], lo[some][row]
        for b, part in A.cut_by(ids % blocks):
            yield b, A.pack(ids[part], base[part] + start[part], base[part] + end[part] - 1 + length)

    for b, blob in runs_of(batches, 1, fold):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=_PACKED)


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    rid, lo, hi = A.unpack_all(marks.column("packed").to_pylist(), np.int64, np.int64, np.int64)
    order = np.argsort(rid, kind="stable")
    rid, lo, hi = rid[order], lo[order], hi[order]
    ids = docs.column("rid").to_numpy()
    a, b = np.searchsorted(rid, ids), np.searchsorted(rid, ids, "right")
    total, gone, runs, kept = [], [], [], []
    for i, text in enumerate(docs.column("text").cast(pa.large_binary())):
        text = text.as_py() or b""
        total.append(len(text))
        if a[i] < b[i]:
            hit = A.covered(len(text), lo[a[i]:b[i]], hi[a[i]:b[i]])
            gone.append(int(hit.sum()))
            runs.append(int(np.count_nonzero(np.diff(np.r_[0, hit.astype(np.int8)]) == 1)))
            text = np.frombuffer(text, np.uint8)[~hit].tobytes()
        else:
            gone.append(0)
            runs.append(0)
        kept.append(text)
    return pa.table({"rid": docs.column("rid"), "n_bytes": pa.array(total, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
                     "kept": pa.array(kept, pa.binary())})


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): bytes of strings of `length` that occur elsewhere go.

    Elsewhere: in another row or at another place of the same text.  Strings are
    judged on the input; n_spans counts maximal removed runs.
    """
    spark = docs.sparkSession
    Shape(length)
    rows, plain = keyed(docs, id_col, text_col)
    count, size = sizes(rows)
    shared = count_repeats(rows, partial(probe_keys, length=length), size / 16)
    wanted = buckets_for(spark, size, PER_BUCKET)
    blocks = buckets_for(spark, size, TEXT_BLOCK)
    sample = rows.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, count // SAMPLE_DOCS))) == 0).select("rid", "text")
    leads = np.sort([r.lead for r in sample.mapInArrow(partial(_leads, length=length), "lead bigint").collect()])
    leads = leads.astype(np.int64).view(np.uint64) ^ A.U(1 << 63)
    splitters = np.unique(leads[(np.arange(1, wanted) * len(leads)) // wanted]) if len(leads) else np.zeros(0, np.uint64)
    buckets = len(splitters) + 1
    found = rows.select("rid", "text").mapInArrow(
        partial(_suffixes, shared=shared, length=length, splitters=splitters, blocks=blocks), "bucket int, packed binary")
    marks = brought_together(found, "bucket").mapInArrow(
        partial(_resolve, length=length, buckets=buckets, blocks=blocks), "block int, packed binary")
    texts = rows.select("rid", "text", F.pmod("rid", F.lit(blocks)).cast("int").alias("block"))
    out = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        _cut, "rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return with_id(out, rows, plain, id_col)
