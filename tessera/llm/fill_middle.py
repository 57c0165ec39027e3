"""Fill-in-the-middle rearrangement by a Roaring-style set of token boundaries.

A text is cut into runs of ASCII letters and single other code points.  The
byte offsets where these tokens start are kept in a `BoundarySet`; two selects
give the cuts between prefix, middle and suffix.  Which cuts, and which form, is
drawn from a hash of the id, so reruns agree.

Forms: `plain` (the text), `psm` (<P>prefix<S>suffix<M>middle) and `spm`
(<S>suffix<P>prefix<M>middle).  Texts that are empty or hold a marker stay
plain.  No marker can arise at a seam: each starts with the only `<` it has.

Defined cases: a null text counts as empty; a null id is drawn as the empty
string; rows that share an id are cut by the same draws, each in its own text;
very long texts take one container of at most 12 KB per 64 KB; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.boundary_set import SPAN, BoundarySet
from tessera.llm.rows import bounded_batches

MARKERS = (b"<P>", b"<S>", b"<M>")
_CODES = np.arange(256)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))
_LEADS = (_CODES & 0xC0) != 0x80  # bytes that begin a code point


def _starts(buf: np.ndarray):
    """Per container, the offsets at which a token starts."""
    for at in range(0, len(buf), SPAN):
        part = buf[at:at + SPAN]
        letter = _LETTER[part]
        follows = np.empty_like(letter)
        follows[1:] = letter[:-1]
        follows[0] = at > 0 and _LETTER[buf[at - 1]]
        yield at // SPAN, np.flatnonzero(_LEADS[part] & ~(letter & follows))


def draws(seed: int, rid: int | None) -> tuple[int, int, int, int]:
    """Four numbers under 2^32 from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if rid is None else rid}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def rearranged(raw: bytes, rid: int | None, seed: int, plain_from: int, spm_under: int) -> tuple:
    """(n, form, code points of prefix and middle, output) of one UTF-8 text."""
    buf = np.frombuffer(raw, np.uint8)
    bounds = BoundarySet(_starts(buf))
    n = len(bounds)
    h1, h2, h3, h4 = draws(seed, rid)
    if not raw or any(m in raw for m in MARKERS) or h3 % 100 >= plain_from:
        return n, "plain", None, None, raw
    a, b = (len(raw) if k == n else bounds.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    spm = h4 % 100 < spm_under
    out = b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle) if spm else
                   (b"<P>", prefix, b"<S>", suffix, b"<M>", middle))
    chars = [int(np.count_nonzero(_LEADS[buf[i:j]])) for i, j in ((0, a), (a, b))]
    return n, "spm" if spm else "psm", *chars, out


def _rearrange(batches, seed, plain_from, spm_under):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows, at = [], 0
        for _, buf, offs in A.pieces([batch]):
            for i in range(len(offs) - 1):
                raw = buf[offs[i]:offs[i + 1]].tobytes()
                rows.append((ids[at], *rearranged(raw, ids[at], seed, plain_from, spm_under)))
                at += 1
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
             pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
             pa.array(columns[5], pa.binary()).cast(pa.string())],
            ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   rate: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): `rate` percent of the texts are rearranged, `spm`
    percent of these with the suffix first.  n counts tokens; the two lengths are null where a text stays plain."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_rearrange, seed=seed, plain_from=rate, spm_under=spm),
                          f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that was rearranged, from form and output alone."""
    p, s, m = (F.instr(output, x) for x in ("<P>", "<S>", "<M>"))
    between = lambda a, b: F.substr(output, a + 3, b - a - 3)
    last = F.substr(output, m + 3)
    return (F.when(form == "psm", F.concat(between(p, s), last, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output))
