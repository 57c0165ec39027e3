"""A set of offsets in the manner of Roaring: containers of 2^16 offsets each.

The high bits of an offset name its container.  A container is an array of the
low 16 bits, a bitmap, or a list of runs, whichever takes the fewest bytes.
Cumulative cardinalities lead from a rank to its container by binary search; a
local select gives the offset inside.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SPAN = 1 << 16


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(count: int, runs: int) -> int:
        return 2 * count

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        flags = np.zeros(SPAN, np.uint8)
        flags[low] = 1
        self.bytes = np.packbits(flags, bitorder="little")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.bytes.view(np.uint64)), dtype=np.int32)]

    @staticmethod
    def size(count: int, runs: int) -> int:
        return SPAN // 8 + 4 * (SPAN // 64 + 1)  # the words, and how many offsets come before each

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.bytes[8 * word:8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    def __init__(self, low: np.ndarray):
        heads = np.flatnonzero(np.r_[True, np.diff(low) != 1])
        self.start = low[heads].astype(np.uint16)
        self.before = np.r_[heads, len(low)].astype(np.int32)

    @staticmethod
    def size(count: int, runs: int) -> int:
        return 6 * runs + 4

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


KINDS = (ArrayContainer, BitmapContainer, RunContainer)


def container(low: np.ndarray):
    """The smallest container for ascending offsets under 2^16, of which there is at least one."""
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    return min(KINDS, key=lambda kind: kind.size(len(low), runs))(low)


class BoundarySet:
    """Ascending offsets, taken container by container, so that no list of all of them is ever held."""

    def __init__(self, parts: Iterable[tuple[int, np.ndarray]]):
        """parts: (number of the container, its low bits ascending)."""
        self.high, self.containers, counts = [], [], []
        for high, low in parts:
            if len(low):
                self.high.append(high)
                self.containers.append(container(low))
                counts.append(len(low))
        self.before = np.r_[0, np.cumsum(counts, dtype=np.int64)].astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return SPAN * self.high[at] + self.containers[at].select(k - int(self.before[at]))
