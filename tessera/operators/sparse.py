"""Products of a large sparse matrix with a few columns.

Rows and columns fall into few, large parts.  The entries between two parts are one
row of packed arrays, and so are the numbers of the vertices of a part: a product
sends each vertex' numbers to its part once, and one row of sums for each vertex
and part it has entries in, instead of a row for each entry.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.neighbours import _matrix
from tessera.session import cut_lineage

#: Vertices of a part.
PART = 262_144
#: Entries that are multiplied at a time.
CHUNK = 1 << 18


@dataclass(frozen=True)
class SparseParts:
    """places (id, part, pos) and entries (a, b, at, first, col, w): rows `at` of part a, the first of their columns in part b, and all weights."""

    places: DataFrame
    entries: DataFrame
    sizes: tuple[int, ...]

    def packed(self, table: DataFrame) -> DataFrame:
        """(part, v) of (id, v)."""

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            v = _matrix(pdf.sort_values("pos")["v"])
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "v": [v.tobytes()]})

        return self.places.join(table, "id").select("part", "pos", "v").groupBy("part").applyInPandas(pack, "part int, v binary")

    def unpacked(self, state: DataFrame, m: int) -> DataFrame:
        """(id, v) of (part, v)."""

        def rows(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    v = np.frombuffer(r.v).reshape(-1, m)
                    for lo in range(0, len(v), 8192):
                        some = v[lo:lo + 8192]
                        yield pd.DataFrame({"part": r.part, "pos": np.arange(lo, lo + len(some)), "v": list(some)})

        return state.select("part", "v").mapInPandas(rows, "part int, pos int, v array<double>").join(self.places, ["part", "pos"]).select("id", "v")

    def stepped(self, state: DataFrame, m: int, change) -> DataFrame:
        """(part, v, prev): change(v, product with v, prev) and v; `state` is (part, v, prev), written."""
        sizes = self.sizes

        def multiplied(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    v, col, w = np.frombuffer(r.v).reshape(-1, m), np.frombuffer(r.col, "int32"), np.frombuffer(r.w)
                    first = np.frombuffer(r.first, "int64")
                    ends = np.append(first[1:], len(col))
                    sums, lo = np.empty((len(first), m)), 0
                    while lo < len(first):
                        # Whole rows, one at least.
                        hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + CHUNK, "right")))
                        own = slice(first[lo], ends[hi - 1])
                        sums[lo:hi] = np.add.reduceat(w[own, None] * v[col[own]], first[lo:hi] - first[lo])
                        lo = hi
                    yield pd.DataFrame({"part": [r.a], "at": [r.at], "s": [sums.tobytes()]})

        def joined(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            r = own.iloc[0]
            v = np.frombuffer(r["v"]).reshape(-1, m)
            prev = np.frombuffer(r["prev"]).reshape(-1, m) if r["prev"] else None
            s = np.zeros((sizes[int(r["part"])], m))
            for at, x in sorted(zip(parts["at"], parts["s"])):
                s[np.frombuffer(at, "int32")] += np.frombuffer(x).reshape(-1, m)
            return pd.DataFrame({"part": own["part"].iloc[:1], "v": [change(v, s, prev).tobytes()], "prev": [r["v"]]})

        sums = self.entries.join(state.select(F.col("part").alias("b"), "v"), "b").mapInPandas(multiplied, "part int, at binary, s binary")
        return cut_lineage(state.groupBy("part").cogroup(sums.groupBy("part")).applyInPandas(joined, "part int, v binary, prev binary"))


def in_parts(rows: DataFrame, ids: DataFrame, part: int = PART) -> SparseParts:
    """The matrix with the sums of w over the rows (src, dst, w); `ids` (id) holds all vertices once."""
    cut = F.pmod(F.xxhash64("id", F.lit(19)), F.lit(max(1, math.ceil(ids.count() / part)))).cast("int")
    rn = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    places = cut_lineage(ids.select("id", cut.alias("part")).withColumn("pos", rn.cast("int")))
    found = {r["part"]: r["n"] for r in places.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    end = lambda name, p, q: places.select(F.col("id").alias(name), F.col("part").alias(p), F.col("pos").alias(q))
    cells = rows.join(end("src", "a", "p"), "src").join(end("dst", "b", "q"), "dst").select("a", "b", "p", "q", "w")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "q"])
        at, first = np.unique(pdf["p"].to_numpy("int32"), return_index=True)
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "at": [at.tobytes()], "first": [first.astype("int64").tobytes()],
                             "col": [pdf["q"].to_numpy("int32").tobytes()], "w": [pdf["w"].to_numpy(float).tobytes()]})

    entries = cells.groupBy("a", "b").applyInPandas(pack, "a int, b int, at binary, first binary, col binary, w binary")
    return SparseParts(places, cut_lineage(entries), tuple(found.get(b, 0) for b in range(max(found, default=-1) + 1)))
