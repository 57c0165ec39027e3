"""Text as numpy arrays inside a task: words, rolling hashes, packed columns.

Arrow batches are read without copying or decoding.  All hashes are fixed
functions of the bytes, equal in every process.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
PIECE = 1 << 20
#: The separators of the word contracts: space and tab to carriage return.
BLANKS = bytes([32, *range(9, 14)])
_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out = []
    for i in range(1, n + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, U)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Alphabet:
    """Which bytes make words, which count as equal, and random values for them."""

    def __init__(self, blanks: bytes = BLANKS, fold: bool = False, seed: int = 1):
        self.word = np.ones(256, bool)
        self.word[list(blanks)] = False
        code = np.arange(256)
        if fold:
            code[65:91] += 32
        self.seed = seed
        self.value = _splitmix(seed, 256)[code]
        self.value[~self.word] = 0
        self.base = int(_splitmix(seed + 7777, 1)[0]) | 5
        self._powers = self._inverse = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            size = max(n, PIECE)
            self._powers = np.cumprod(np.r_[U(1), np.full(size, self.base, U)])
            self._inverse = np.cumprod(np.r_[U(1), np.full(size, pow(self.base, -1, 1 << 64), U)])
        return self._powers, self._inverse


def hand_back() -> None:
    """Give memory that arrays of this process no longer hold back to the system, as workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(stream: Callable) -> Callable:
    """A task's function that hands memory back where it begins and ends."""
    @wraps(stream)
    def run(batches, *args, **how):
        hand_back()
        yield from stream(batches, *args, **how)
        hand_back()

    return run


def text_pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE) -> Iterator[tuple]:
    """(ids, bytes, offsets) of a few texts at a time; first column id, second text; null text is empty."""
    hand_back()
    yield from pieces(batches, limit)
    hand_back()


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE) -> Iterator[tuple]:
    """The same in the midst of a task."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        column = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield ids[lo:hi], data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def word_bounds(buf: np.ndarray, offs: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word."""
    inside = alphabet.word[buf]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    fresh[heads] = inside[heads]
    last[tails] = inside[tails]
    start = np.flatnonzero(fresh)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    if len(buf) > 4 * PIECE and len(start) > 1:  # a very long text, in parts that begin with a word
        cuts = np.searchsorted(start, np.arange(0, len(buf), 2 * PIECE))
        cuts = np.unique(np.r_[0, cuts, len(start)])
        ends = np.r_[start[1:], len(buf)]
        return np.concatenate([word_hashes(buf[start[a]:ends[b - 1]], start[a:b] - start[a], alphabet)
                               if b - a < len(start) else _word_hashes(buf, start, alphabet)
                               for a, b in zip(cuts[:-1], cuts[1:])])
    return _word_hashes(buf, start, alphabet)


def _word_hashes(buf: np.ndarray, start: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    powers, inverse = alphabet.powers(len(buf))
    weighed = alphabet.value[buf]
    weighed *= powers[:len(buf)]
    return mix(np.add.reduceat(weighed, start) * inverse[start])


def rolling(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k consecutive values, by doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    base = int(_splitmix(seed + 4242, 1)[0]) | 5
    done, size, part, width = None, 0, h, 1
    while True:
        if k & width:
            if done is None:
                done, size = part, width
            else:  # the part first, then what is done
                n = len(h) - (size + width) + 1
                done = part[:n] * U(pow(base, size, 1 << 64)) + done[width:width + n]
                size += width
        if size == k:
            return mix(done)
        n = len(part) - width
        part = part[:n] * U(pow(base, width, 1 << 64)) + part[width:]
        width *= 2


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the index of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of words where k words of the same text start."""
    first = np.asarray(first)
    return np.flatnonzero(~covered(int(first[-1]), np.maximum(first[1:] - (k - 1), first[:-1]), first[1:]))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each as byte planes, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def unpack_all(blobs: Iterable[bytes], *kinds) -> list[np.ndarray]:
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def remembered(key: str, make: Callable):
    """What `make` gives, once per worker process; functions themselves travel to every task anew.

    What is kept under a key with another first word goes: its operator has ended.
    """
    memory = sys.modules.setdefault("tessera_worker_memory", types.ModuleType("tessera_worker_memory")).__dict__
    if key not in memory:
        for other in [k for k in memory if not k.startswith("__") and k.split()[0] != key.split()[0]]:
            del memory[other]
        memory[key] = make()
    return memory[key]


def cut_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indices) of each distinct value of an integer key, indices in their order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        yield int(key[part[0]]), part


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the places that a span [start, end) covers."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
