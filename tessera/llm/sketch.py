"""Count-min sketches of what a table's texts contain, merged from partitions.

Counters stop at two: what a filter asks is only whether a key may occur twice.
An estimate is the least counter over the rows of the sketch, so it never falls
below the true (stopped) count: a key that does occur twice always says so.
Each counter is a bit in a plane "seen" and a bit in a plane "seen again".
Two sketches merge exactly: seen = a | b, again = a' | b' | (a & b).

The number of counters follows the number of keys up to `MAX_CELLS`; only the
"again" planes, DEPTH * MAX_CELLS / 8 bytes (64 MB) at most, reach the driver
and are broadcast.  Past that size more keys pass the filter; none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.arrays import U, mix, text_pieces
from tessera.llm.rows import brought_together, few_files, gathered

DEPTH = 2
MAX_CELLS = 1 << 28
MIN_CELLS = 1 << 16
CHUNK = 1 << 17  # bytes of a plane per exchanged row
_ODD = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def cells_for(keys: float, each: float = 1.75) -> int:
    """About `each` counters a key, in a power of two."""
    cells = MIN_CELLS
    while cells < each * keys and cells < MAX_CELLS:
        cells *= 2
    return cells


def _cell(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((keys * U(_ODD[row])) >> U(65 - cells.bit_length())).astype(np.uint32)


class Planes:
    """The counters of one task."""

    def __init__(self, cells: int, depth: int = DEPTH):
        self.cells = cells
        self.seen = [np.zeros(cells // 8, np.uint8) for _ in range(depth)]
        self.again = [np.zeros(cells // 8, np.uint8) for _ in range(depth)]

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        for row, (seen, again) in enumerate(zip(self.seen, self.again)):
            cell = np.sort(_cell(keys, row, self.cells))
            place = cell >> np.uint32(3)
            bit = np.left_shift(np.uint8(1), (cell & np.uint32(7)).astype(np.uint8))
            twice = np.zeros(len(cell), np.uint8)
            twice[1:] = np.where(cell[1:] == cell[:-1], bit[1:], 0)
            runs = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            at = place[runs]
            new = np.bitwise_or.reduceat(bit, runs)
            again[at] |= (seen[at] & new) | np.bitwise_or.reduceat(twice, runs)
            seen[at] |= new

    def rows(self) -> Iterator[tuple]:
        squeeze = zstandard.ZstdCompressor(level=1)
        size = min(CHUNK, self.cells // 8)
        for row, (seen, again) in enumerate(zip(self.seen, self.again)):
            for chunk in range(self.cells // 8 // size):
                part = slice(chunk * size, (chunk + 1) * size)
                if seen[part].any():
                    yield row, chunk, squeeze.compress(seen[part].tobytes()), squeeze.compress(again[part].tobytes())


class Sketch:
    """The merged sketch as a task sees it."""

    def __init__(self, cells: int, chunks: list[tuple[int, int, bytes]], depth: int = DEPTH):
        self.cells = cells
        self.again = [np.zeros(cells // 8, np.uint8) for _ in range(depth)]
        size = min(CHUNK, cells // 8)
        for row, chunk, blob in chunks:
            self.again[row][chunk * size:(chunk + 1) * size] = np.frombuffer(
                zstandard.ZstdDecompressor().decompress(blob), np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that occur once."""
        out = np.ones(len(keys), bool)
        for row, again in enumerate(self.again):
            cell = _cell(keys, row, self.cells)
            out &= (again[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


_PARTIAL = "row int, chunk int, seen binary, again binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grow, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)

    def plane(blob):
        return np.frombuffer(grow.decompress(blob), np.uint8)

    now, seen, again = None, None, None

    def out():
        return pa.RecordBatch.from_pylist([{"row": now[0], "chunk": now[1], "again": squeeze.compress(again.tobytes())}],
                                          pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("again", pa.binary())]))

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["row"], row["chunk"])
            s, a = plane(row["seen"]), plane(row["again"])
            if key != now:
                if now is not None:
                    yield out()
                now, seen, again = key, s.copy(), a.copy()
            else:
                again |= a | (seen & s)
                seen |= s
    if now is not None:
        yield out()


_ROWS = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])


def _collected(parts: DataFrame, cells: int):
    merged = brought_together(parts, "row", "chunk").mapInArrow(_merge, "row int, chunk int, again binary")
    chunks = [(r.row, r.chunk, bytes(r.again)) for r in merged.collect()]
    return parts.sparkSession.sparkContext.broadcast((cells, chunks))


def count_repeats(rows: DataFrame, keys: Callable, expected: float, each: float = 1.75):
    """A broadcast (cells, chunks) for `Sketch(*it.value)`; `keys(buf, offs)` gives the keys of some texts."""
    cells = cells_for(expected, each)

    def partial(batches):
        planes = Planes(cells)
        for _, buf, offs in text_pieces(batches):
            planes.add(keys(buf, offs))
        for row in planes.rows():
            yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, row))], _ROWS)

    return _collected(gathered(rows.select("rid", "text")).mapInArrow(partial, _PARTIAL), cells)


def among(rows: DataFrame, wanted: DataFrame, expected: int, id_col: str = "rid") -> DataFrame:
    """The rows whose id is in `wanted`, and a few others: spares a join the wide rows that it would drop.

    The filter takes about 8 bits an id and 8 MB at most; fuller, it lets more rows pass.
    """
    cells = min(1 << 26, cells_for(expected, 8))

    def partial(batches):
        planes = Planes(cells)
        for batch in batches:
            planes.add(np.repeat(mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)), 2))
        for row in planes.rows():
            yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, row))], _ROWS)

    shared = _collected(few_files(wanted.select(id_col)).mapInArrow(partial, _PARTIAL), cells)

    def keep(batches):
        sketch = Sketch(*shared.value)
        for batch in batches:
            keys = mix(batch.column(id_col).to_numpy().astype(np.int64).view(np.uint64))
            yield batch.filter(pa.array(sketch.repeated(keys)))

    return rows.mapInArrow(keep, rows.schema)
