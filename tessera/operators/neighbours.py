"""Exact nearest neighbours and other all-pairs reductions.

Points are never paired as rows.  They are grouped into bounded blocks, a block
meets a block inside one Arrow batch, and only the reduction leaves the task:
the k best per query, a sum per cluster, a count.

`knn` prunes block pairs with pivots and the triangle inequality, or with boxes
(`operators/boxes.py`) where the distance is a weighted mean over items.  Every point
joins the cell of its nearest pivot; cells above the block size are split, so a
dense cell never becomes one large group.  A first pass inside the own block
bounds each query's k-th distance, and only cells the bound cannot rule out are
visited in the second pass.  A query that too many blocks remain open to is not
copied to each of them: such queries and all points meet in a grid of few, large
parts.  Pruning changes the cost, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, parallelism

SMALLEST, LARGEST = 1024, 8192
MAX_PIVOTS = 256
# Relative slack for bounds computed from distances kept to 40 bits.
SLACK = 2.0**-36
# Parts of each side where all points meet, and the rows a part may have before there are more.
GRID, LARGEST_PART = 8, 131_072
# Blocks a query is copied to at most; beyond it goes through the grid.
MAX_VISITS = 8
# Rows that wait in a task to be added up.
MOST_ROWS = 2_000_000
# Rows of two parts that one matrix of distances covers; larger ones leave the processor's cache.
TALL, BROAD = 512, 4096


def _to_40_bits(d: np.ndarray) -> np.ndarray:
    """Distances rounded to 40 significant bits, half to even."""
    bits = np.ascontiguousarray(d, dtype=float).view(np.int64)
    bits = bits + (0xFFF + ((bits >> 13) & 1))
    bits &= ~0x1FFF
    return bits.view(float)


def _set_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is set, in order; little is expected, and eight cells are looked at together."""
    flat = mask.ravel()
    whole = flat.size // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (8 * words[:, None] + np.arange(8))[flat[:whole].reshape(-1, 8)[words]]
    return np.divmod(np.concatenate([at, whole + np.flatnonzero(flat[whole:])]), mask.shape[1])


def _within(value: np.ndarray, limit: np.ndarray, slack: np.ndarray, k: int, hidden) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of values up to a row's limit and to its k-th smallest, known to half a slack."""
    value[hidden] = np.nan
    near = value <= limit[:, None]
    found = _set_cells(near) if np.count_nonzero(near) <= near.size // 16 else None
    many = np.flatnonzero((near.sum(1) if found is None else np.bincount(found[0], minlength=len(value))) > 2 * k)
    if len(many) and k < value.shape[1]:
        some = value[many]
        kth = np.partition(some, k - 1, axis=1)[:, k - 1].astype(float)
        near[many] &= ~(some > (kth + 2.0 * slack[many])[:, None])
        found = None
    return found or np.divmod(np.flatnonzero(near), near.shape[1])


class _Side:
    """Vectors as one side of a product, and what does not depend on the other side."""

    def __init__(self, x: np.ndarray, middle: np.ndarray | None = None):
        self.x, self.kind = x, np.float64 if middle is None else np.float32
        x = x if middle is None else x - middle
        self.size = (x * x).sum(1)
        with np.errstate(over="ignore"):  # such sides are not multiplied
            self.left = np.column_stack([-2.0 * x, np.ones(len(x))]).astype(self.kind)
            self.right = np.column_stack([x, self.size]).astype(self.kind).T
        self.longest = self.size.max(initial=0.0)
        self.bound = self.size.max(initial=0.0, where=np.isfinite(self.size))


@dataclass(frozen=True)
class Metric:
    """A distance on coded vectors that obeys the triangle inequality.

    euclid   plain L2
    gower    weighted mean over items: numeric items (scaled to range 1) first,
             then nominal codes; `weights` has one entry per item.  With `gaps`
             an item that either side lacks (NULL) leaves the mean; without any
             item in common the distance is infinite.  Gaps void the triangle
             inequality, so that no cell is ruled out.
    jaccard  on 0/1 vectors; two empty vectors are at distance 0
    """

    kind: str = "euclid"
    n_numeric: int = 0
    weights: tuple = field(default=())
    gaps: bool = False
    all_bits: bool = False

    @property
    def boxed(self) -> bool:
        """Whether boxes bound the distance."""
        return self.kind == "gower" and not self.gaps and min(self.weights, default=0.0) >= 0 and sum(self.weights) > 0

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All distances, kept to 40 bits (unless `all_bits`) so that equal distances
        compare equal however the sums behind them were ordered."""
        return self._raw(a, b) if self.all_bits else _to_40_bits(self._raw(a, b))

    def strips(self, x: np.ndarray, rows: int, middle: np.ndarray) -> list:
        """Parts of a side for `nearest`, made once for all their pairs; the sides of a pair have one middle."""
        parts = [x[lo:lo + rows] for lo in range(0, len(x), rows)]
        return [_Side(part, middle) for part in parts] if self.kind == "euclid" else parts

    def nearest(self, a, b, k: int, reach: np.ndarray, hidden: tuple[np.ndarray, np.ndarray]):
        """(row, column, distance) of the pairs of two strips within each row's reach that may be among its k nearest."""
        if self.kind == "euclid":
            # Single precision first: what is near enough is computed again directly.
            near = self._near(a, b, k, reach, hidden)
            if near is None:
                near = self._near(_Side(a.x), _Side(b.x), k, reach, hidden)
            (i, j), a, b = near, a.x, b.x
            d = np.empty(len(i))
            for lo in range(0, len(i), 65536):
                gap = a[i[lo:lo + 65536]] - b[j[lo:lo + 65536]]
                d[lo:lo + 65536] = np.sqrt((gap * gap).sum(1))
            d = _to_40_bits(d)
        else:
            value = self.between(a, b)
            i, j = _within(value, reach, np.zeros(len(a)), k, hidden)
            d = value[i, j]
        keep = np.isfinite(d) & (d <= reach[i])
        return i[keep], j[keep], d[keep]

    def _near(self, a: _Side, b: _Side, k: int, reach: np.ndarray, hidden) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs that may be within reach and nearest, in one product; None if the sides are too coarse to tell."""
        single = a.kind is np.float32
        if single and not max(a.longest, b.longest) < 1e30:
            return None
        # Squared distance less that of a from the middle.
        value = a.left @ b.right
        slack = 8.0 * (a.x.shape[1] + 4) * np.finfo(a.kind).eps * (a.size + b.bound)
        limit = reach * reach * (1.0 + 4.0 * SLACK) + slack - a.size
        if single:
            limit = np.nextafter(limit.astype(a.kind), a.kind(np.inf))
        near = _within(value, limit, slack, k, hidden)
        return None if single and len(near[0]) > value.size // 64 + 4 * k * len(a.x) else near

    def _raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "euclid":
            sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
            # The expansion cancels for close pairs: recompute those directly.
            scale = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
            close = np.argwhere(sq < 1e-4 * scale)
            for lo in range(0, len(close), 65536):
                part = close[lo:lo + 65536]
                gap = a[part[:, 0]] - b[part[:, 1]]
                sq[part[:, 0], part[:, 1]] = (gap * gap).sum(1)
            return np.sqrt(np.maximum(sq, 0.0))
        if self.kind == "jaccard":
            both = a @ b.T
            either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
            return np.where(either > 0, 1.0 - both / np.where(either > 0, either, 1.0), 0.0)
        w = np.asarray(self.weights, dtype=float)
        out = np.zeros((len(a), len(b)))
        if self.gaps:
            shared = np.zeros((len(a), len(b)))
            for j in range(a.shape[1]):
                x, y = a[:, j][:, None], b[:, j][None, :]
                both = ~np.isnan(x) & ~np.isnan(y)
                apart = np.abs(np.where(both, x - y, 0.0)) if j < self.n_numeric else both & (x != y)
                out += w[j] * apart
                shared += w[j] * both
            return np.where(shared > 0, out / np.where(shared > 0, shared, 1.0), np.inf)
        for j in range(a.shape[1]):
            if j < self.n_numeric:
                out += w[j] * np.abs(a[:, j][:, None] - b[:, j][None, :])
            else:
                out += w[j] * (a[:, j][:, None] != b[:, j][None, :])
        return out / w.sum()


def block_size(points: DataFrame, total: int) -> int:
    """Large blocks move less data; small tables still want one per core."""
    return min(LARGEST, max(SMALLEST, total // (4 * parallelism(points.sparkSession))))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def _best(query_ids, point_ids, x, px, metric, k, same, reach):
    """The k nearest per row and within its reach, ties by id; `same` hides a point from itself."""
    middle = px.mean(0)
    (one,) = metric.strips(x, max(1, len(x)), middle)
    return _best_of_strips(query_ids, point_ids, one, metric.strips(px, BROAD, middle), metric, k, same, reach)


def _best_of_strips(query_ids, point_ids, x, strips, metric, k, same, reach):
    """Points come some at a time, and what is found shortens the reach for the next."""
    reach = reach.copy()
    qi, d, pid = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
    for at, strip in enumerate(strips):
        ids = point_ids[at * BROAD:(at + 1) * BROAD]
        hidden = _same_ids(query_ids, ids) if same else (np.zeros(0, "int64"), np.zeros(0, "int64"))
        i, j, dist = metric.nearest(x, strip, k, reach, hidden)
        if not len(i):
            continue
        qi, d, pid = np.concatenate([qi, i]), np.concatenate([d, dist]), np.concatenate([pid, ids[j]])
        order = np.lexsort((pid, d, qi))
        qi, d, pid = qi[order], d[order], pid[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, np.arange(len(query_ids)))[qi]
        reach[qi[place == k - 1]] = d[place == k - 1]
        qi, d, pid = qi[place < k], d[place < k], pid[place < k]
    return pd.DataFrame({"i": query_ids[qi], "j": pid, "d": d})


def _same_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with equal ids."""
    order = np.argsort(b, kind="stable")
    first, last = (np.searchsorted(b, a, side, sorter=order) for side in ("left", "right"))
    n = last - first
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.repeat(np.arange(len(a)), n), order[at]


class _Cells:
    """Pivots plus what is known of each cell; small by construction."""

    most_visits = MAX_VISITS

    def __init__(self, pivots: np.ndarray, metric: Metric):
        self.pivots, self.metric = pivots, metric
        self.counts = np.zeros(len(pivots), dtype=np.int64)
        self.far = np.zeros(len(pivots))
        self.near = np.full(len(pivots), np.inf)
        self.parts = np.ones(len(pivots), dtype=np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return self.metric.between(x, self.pivots)

    def metric_of(self, cell: int) -> Metric:
        return self.metric

    def placed(self, pdf: pd.DataFrame):
        d = self.distances(_matrix(pdf["vec"]))
        cell = d.argmin(1)
        yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(d)), cell])

    def measure(self, placed: DataFrame, block: int) -> None:
        for row in placed.groupBy("cell").agg(F.count("id").alias("n"), F.max("r").alias("hi"), F.min("r").alias("lo")).collect():
            c = row["cell"]
            self.counts[c], self.far[c], self.near[c] = row["n"], row["hi"], row["lo"]
            self.parts[c] = math.ceil(row["n"] / block)

    def open(self, pdf: pd.DataFrame) -> np.ndarray:
        """Which cells the bound of each query leaves open."""
        d = self.distances(_matrix(pdf["vec"]))
        mine = d[np.arange(len(d)), pdf["cell"].to_numpy()]
        low = np.maximum(d - self.far[None, :], self.near[None, :] - d)
        # Points of another cell lie beyond the bisector of the two pivots.
        low = np.maximum(low, (d - mine[:, None]) / 2)
        theta = pdf["theta"].to_numpy()[:, None]
        slack = SLACK * (d + mine[:, None] + self.far[None, :])
        within = np.ones(d.shape, bool) if self.metric.gaps else low <= theta * (1 + SLACK) + slack
        return within & (self.counts > 0)[None, :]


def _choose_pivots(points: DataFrame, total: int, block: int) -> np.ndarray:
    wanted = max(1, min(MAX_PIVOTS, total // max(1, block // 4)))
    rows = points.select("vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    return np.unique(np.array([r["vec"] for r in rows], dtype=float), axis=0)


def _place(cells):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield from cells.placed(pdf)

    return run


def knn(points: DataFrame, k: int, metric: Metric = Metric(), queries: DataFrame | None = None,
        block: int | None = None, total: int | None = None) -> DataFrame:
    """(i, rank, j, d): the k nearest points of each query, ties by id.

    `points` and `queries` hold (id BIGINT, vec ARRAY<DOUBLE>).  Without
    `queries` the points search among themselves and never find themselves.
    `total`, when the caller knows it, saves a count.  The result (points x k
    rows) is written once: it is far cheaper to read again than to find again.
    """
    same = queries is None
    points = points.select(F.col("id").cast("bigint").alias("id"), "vec")
    if same and total is None:
        seen = points.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("vec")).alias("distinct")).first()
        total = seen["n"]
        if 2 * seen["distinct"] < total and points.select("id").distinct().count() == total:
            return _knn_of_copies(points, k, metric, block)
    asked = points if same else queries.select(F.col("id").cast("bigint").alias("id"), "vec")
    total = points.count() if total is None else total
    block = block or block_size(points, total)
    return _found(points, None if same else asked, _cells(points, total, block, metric), k, block, total)


def _cells(points: DataFrame, total: int, block: int, metric: Metric):
    from tessera.operators.boxes import boxes

    return boxes(points, total, block, [metric]) if metric.boxed else _Cells(_choose_pivots(points, total, block), metric)


def nearest_under(points: DataFrame, k: int, metrics: list[Metric]) -> DataFrame:
    """(g, id, rank, d): distances of the k nearest under each of several mixed-type metrics that boxes bound.

    All metrics search in one run.  Rows with one id count as one point, as in
    `knn`; no id is null.
    """
    from tessera.operators.boxes import ROW_BITS, boxes

    names = cut_lineage(points.select("id").distinct().withColumn("row", F.monotonically_increasing_id()))
    pts = cut_lineage(points.join(names, "id").select(F.col("row").alias("id"), "vec"))
    total = pts.count()
    block = block_size(pts, total)
    found = _found(pts, None, boxes(pts, total, block, metrics, ties=False), k, block, total)
    row = F.col("i").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    found = found.select(F.shiftright("i", ROW_BITS).alias("g"), row.alias("row"), "rank", "d")
    return found.join(names, "row").select("g", "id", "rank", "d")


def _found(points: DataFrame, asked: DataFrame | None, cells, k: int, block: int, total: int) -> DataFrame:
    """(i, rank, j, d): the search of `knn` in the given cells; without `asked` the points ask."""
    same, spark = asked is None, points.sparkSession
    placed = points.mapInPandas(_place(cells), "id bigint, vec array<double>, cell int" + (", r double" if isinstance(cells, _Cells) else ""))
    cells.measure(placed, block)
    part_table = F.array(*[F.lit(int(p)) for p in cells.parts])
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.element_at(part_table, F.col("cell") + 1)).cast("int")
    located = placed.select("id", "vec", "cell").withColumn("part", part)
    asked_at = located if same else asked.mapInPandas(_place(cells), placed.schema).select("id", "vec", "cell").withColumn("part", part)
    if not same:
        # A query may fall in a cell that holds no points.
        asked_at = asked_at.withColumn("part", F.coalesce("part", F.lit(0)))
    # Queries of a hot cell are split too: each slice meets a copy of the block.
    slice_of = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)).cast("int")
    sizes = None
    if not same:
        sizes = {(r["cell"], r["part"]): r["n"] for r in
                 asked_at.groupBy("cell", "part").agg(F.count("id").alias("n")).collect()}
    home = _meet(asked_at.withColumn("slot", slice_of).withColumn("theta", F.lit(float("inf"))), located, sizes, cells, k, same, block)
    # Read by the bound, the visits and the merge: written once.
    home = cut_lineage(home)
    if int(cells.parts.sum()) == 1:
        return _rank(home, k)
    bound = home.groupBy("i").agg(
        F.when(F.count("d") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("theta"))
    reach = asked_at.select("id", "vec", "cell", "part").join(
        bound, F.col("id") == F.col("i"), "left").drop("i").withColumn(
        "theta", F.coalesce("theta", F.lit(float("inf"))))
    columns = "id bigint, vec array<double>, cell int, part int, theta double"
    reach = cut_lineage(reach.mapInPandas(_open_blocks(cells), columns + ", n int"))
    # One open block is the own one.
    visits = reach.where((F.col("n") > 1) & (F.col("n") <= cells.most_visits)).drop("n").mapInPandas(_visits(cells), columns)
    visits = visits.withColumn("slot", slice_of)
    loads = {(r["cell"], r["part"]): r["n"] for r in
             visits.groupBy("cell", "part").agg(F.count("id").alias("n")).collect()}
    away = _meet(visits, located, loads, cells, k, same, block)
    wide = reach.where(F.col("n") > cells.most_visits).select("id", "vec", "theta")
    n_wide = wide.count()
    if not n_wide:
        return cut_lineage(_rank(home.unionByName(away), k))
    # The grid meets the own block again: what was found there for these queries is not needed.
    home = home.join(wide.select(F.col("id").alias("i")).distinct(), "i", "left_anti")
    metric = cells.metric_of(0)

    def best(q: pd.DataFrame, p: pd.DataFrame):
        return _nearest_of(q, p, k, metric, same)

    everywhere = _grid(wide, points, n_wide, total, block, best, "i bigint, j bigint, d double")
    return cut_lineage(_rank(home.unionByName(away).unionByName(everywhere), k))


def pairs_within(points: DataFrame, eps: float, metric: Metric) -> DataFrame:
    """(i, j, d): all pairs of different ids up to a distance that boxes bound, both ways."""
    from tessera.operators.boxes import boxes, within

    total = points.count()
    block = block_size(points, total)
    cells = boxes(points, total, block, [metric])
    placed = cut_lineage(points.mapInPandas(_place(cells), "id bigint, vec array<double>, cell int"))
    cells.measure(placed, block)
    part = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.element_at(F.array(*[F.lit(int(p)) for p in cells.parts]), F.col("cell") + 1)).cast("int")
    points = placed.withColumn("part", part(7))
    # A block that is asked by others too is asked in slices of its own size at most; -1 takes the own block along.
    asked = placed.withColumn("part", F.lit(-1)).withColumn("theta", F.lit(float(eps)))
    columns = "id bigint, vec array<double>, cell int, part int, theta double"
    visits = cut_lineage(asked.mapInPandas(_visits(cells), columns))
    loads = {(r["cell"], r["part"]): r["n"] for r in visits.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def found(q, p, metric):
        return within(q["id"].to_numpy(), _matrix(q["vec"]), p["id"].to_numpy(), _matrix(p["vec"]), eps, metric)

    slice_of = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)).cast("int")
    return _meet(visits.withColumn("slot", slice_of), points, loads, cells, 0, False, block, found)


def _knn_of_copies(points: DataFrame, k: int, metric: Metric, block: int | None) -> DataFrame:
    """knn where most points have copies: one of each vector searches, and stands for its ids.

    Of equal points only the k + 1 smallest ids can be found; they are taken in
    slices first, so that no group of copies is ordered in one task.
    """
    from pyspark.sql import Window

    def smallest(df, *by):
        rn = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        return df.withColumn("_n", rn).where(F.col("_n") <= k + 1).drop("_n")

    def own(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                x = _matrix(part["vec"])
                yield pd.DataFrame({"rep": part["rep"], "other": part["rep"], "d": metric.between(x, x).diagonal()})

    sliced = points.withColumn("_s", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(64)))
    few = smallest(smallest(sliced, "vec", "_s"), "vec").drop("_s")
    kept = cut_lineage(few.groupBy("vec").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")))
    stand_ins = kept.select(F.col("rep").alias("id"), "vec")
    near = knn(stand_ins, k, metric, block=block, total=kept.count()).select(F.col("i").alias("rep"), F.col("j").alias("other"), "d")
    itself = kept.select("rep", "vec").mapInPandas(own, "rep bigint, other bigint, d double").where(F.col("d") < float("inf"))
    ids = kept.select(F.col("rep").alias("other"), F.explode("ids").alias("j"))
    rn = F.row_number().over(Window.partitionBy("rep").orderBy("d", "j"))
    found = near.unionByName(itself).join(ids, "other").withColumn("_n", rn).where(F.col("_n") <= k + 1)
    found = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("found"))
    lists = kept.join(found, "rep").select("vec", "found")
    others = F.slice(F.filter("found", lambda f: f["j"] != F.col("id")), 1, k)
    return cut_lineage(points.join(lists, points["vec"].eqNullSafe(lists["vec"])).select(F.col("id").alias("i"), F.posexplode(others).alias("rank", "f")).select(
        "i", (F.col("rank") + 1).alias("rank"), F.col("f.j").alias("j"), F.col("f.d").alias("d")))


def _nearest_of(q: pd.DataFrame, p: pd.DataFrame, k: int, metric: Metric, same: bool) -> pd.DataFrame:
    if not len(q) or not len(p):
        return pd.DataFrame({"i": np.array([], "int64"), "j": np.array([], "int64"), "d": np.array([], float)})
    qid, pid, theta = q["id"].to_numpy(), p["id"].to_numpy(), q["theta"].to_numpy(dtype=float)
    px = _matrix(p["vec"])
    if metric.boxed:
        from tessera.operators.boxes import nearest

        return nearest(qid, _matrix(q["vec"]), theta, pid, px, k, metric, same)
    middle = px.mean(0)
    tall, broad = metric.strips(_matrix(q["vec"]), TALL, middle), metric.strips(px, BROAD, middle)
    cuts = [slice(lo, lo + TALL) for lo in range(0, len(qid), TALL)]
    return pd.concat([_best_of_strips(qid[c], pid, x, broad, metric, k, same, theta[c]) for c, x in zip(cuts, tall)])


def _open_blocks(cells):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(n=(cells.open(pdf).astype(float) @ cells.parts.astype(float)).astype("int32"))

    return run


def _visits(cells):
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            own, open_ = pdf["cell"].to_numpy(), cells.open(pdf)
            qi, cj = np.nonzero(open_)
            reps = cells.parts[cj]
            qi, cj = np.repeat(qi, reps), np.repeat(cj, reps)
            starts = np.cumsum(reps) - reps
            pj = np.arange(len(qi)) - np.repeat(starts, reps)
            other = ~((cj == own[qi]) & (pj == pdf["part"].to_numpy()[qi]))
            qi, cj, pj = qi[other], cj[other], pj[other]
            for lo in range(0, len(qi), 20000):
                q = qi[lo:lo + 20000]
                yield pd.DataFrame({
                    "id": pdf["id"].to_numpy()[q], "vec": pdf["vec"].to_numpy()[q],
                    "cell": cj[lo:lo + 20000].astype("int32"), "part": pj[lo:lo + 20000].astype("int32"),
                    "theta": pdf["theta"].to_numpy()[q]})

    return run


def _meet(asked, located, loads, cells, k, same, block, run=None) -> DataFrame:
    """Query slices against point blocks, the k best of each meeting, or what `run(queries, points, metric)` gives."""
    slices = [[1] * int(p) for p in cells.parts]
    if loads:
        for (c, p), n in loads.items():
            slices[c][p] = max(1, math.ceil(n / block))
    table = F.array(*[F.array(*[F.lit(int(s)) for s in row]) for row in slices])
    n_slices = F.element_at(F.element_at(table, F.col("cell") + 1), F.col("part") + 1)
    asked = asked.withColumn("slot", F.pmod("slot", n_slices).cast("int")).select(
        "id", "vec", "cell", "part", "slot", "theta")
    copies = located.withColumn("slot", F.explode(F.sequence(F.lit(0), n_slices - 1))).select(
        F.col("id").alias("pid"), F.col("vec").alias("pvec"), F.col("cell").alias("pcell"),
        F.col("part").alias("ppart"), F.col("slot").cast("int").alias("pslot"))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"i": np.array([], "int64"), "j": np.array([], "int64"), "d": np.array([], float)})
        metric, p = cells.metric_of(q["cell"].iloc[0]), p.rename(columns={"pid": "id", "pvec": "vec"})
        return run(q, p, metric) if run else _nearest_of(q, p, k, metric, same)

    return asked.groupBy("cell", "part", "slot").cogroup(
        copies.groupBy("pcell", "ppart", "pslot")).applyInPandas(best, "i bigint, j bigint, d double")


def _rank(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("rank", rn).where(F.col("rank") <= k).select("i", "rank", "j", "d")


def _grid(left: DataFrame, right: DataFrame, n_left: int, n_right: int, block: int, run, schema: str) -> DataFrame:
    """`run(left_part, right_part)` over all pairs of parts cut by a hash of the ids.

    The number of parts does not grow with the rows until a part would be too
    large for a task, so that the copies that move grow with the rows alone.
    """
    nl, nr = (max(1, min(GRID, math.ceil(n / block)), math.ceil(n / LARGEST_PART)) for n in (n_left, n_right))
    cut = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = left.withColumn("_a", cut(nl)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    b = right.withColumn("_d", cut(nr)).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))))
    # Fresh names: both sides may come from one plan.
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    # A number of partitions of its own: small pairs of parts are long work, and are not put together.
    a, b = a.repartition(2 * nl * nr, "_a", "_b"), b.repartition(2 * nl * nr, "_c", "_d")
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_c", "_d")).applyInPandas(run, schema)


def _added_up(t: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """One row for each key; all other columns are numbers or arrays, and are summed."""
    code = t.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    out = t.drop_duplicates(keys)[keys].reset_index(drop=True)
    for c in t.columns.difference(keys):
        v = np.vstack(t[c].to_numpy()) if t[c].dtype == object else t[c].to_numpy()
        total = np.zeros((len(out), *v.shape[1:]), v.dtype)
        np.add.at(total, code, v)
        out[c] = list(total) if v.ndim > 1 else total
    return out[list(t.columns)]


def all_pairs_reduce(left: DataFrame, right: DataFrame, reducer, schema: str, block: int | None = None,
                     keys: list[str] | None = None, merge=None) -> DataFrame:
    """Run `reducer(left_block, right_block) -> rows` over all block pairs.

    Both sides are cut by hash into few parts, and a task cuts its two parts into
    blocks of bounded size; the caller aggregates the partial rows.  With `keys`
    the task adds up what its blocks give for a key, with `merge` it shortens the
    rows of several blocks by that function of them.  Work is quadratic, as the
    measure demands, but data moved is parts x rows and nothing is emitted per pair.
    """
    sizes = left.count(), right.count()
    block = block or block_size(left, max(sizes))
    names = [c.split()[0] for c in schema.split(", ")]
    tall, broad = min(block, TALL), min(block, BROAD // 2)
    merge = merge or (keys and (lambda t: _added_up(t, keys)))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo in range(0, len(x), tall):
            part = x.iloc[lo:lo + tall].reset_index(drop=True)
            rows = [reducer(part, y.iloc[at:at + broad].reset_index(drop=True)) for at in range(0, len(y), broad)]
            rows = [r for r in rows if len(r)]
            if rows:
                rows = pd.concat(rows, ignore_index=True)
                out.append(merge(rows) if merge else rows)
            if merge and sum(map(len, out)) > MOST_ROWS:
                out = [merge(pd.concat(out, ignore_index=True))]
        if merge and len(out) > 1:
            out = [merge(pd.concat(out, ignore_index=True))]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    return _grid(left, right, *sizes, block, run, schema)


def cluster_distances(points: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """(id, cluster, other, s, n): distance sums from each point to each cluster."""

    def sums(x, y):
        d = metric.between(_matrix(x["vec"]), _matrix(y["vec"]))
        codes, names = pd.factorize(y["cluster"])
        hot = np.zeros((len(y), len(names)))
        hot[np.arange(len(y)), codes] = 1.0
        s = d @ hot
        q, c = np.indices(s.shape)
        return pd.DataFrame({
            "id": x["id"].to_numpy()[q.ravel()], "cluster": x["cluster"].to_numpy()[q.ravel()],
            "other": names.to_numpy()[c.ravel()], "s": s.ravel(), "n": hot.sum(0).astype("int64")[c.ravel()]})

    pts = points.select("id", "vec", "cluster")
    partial = all_pairs_reduce(pts, pts, sums, "id bigint, cluster bigint, other bigint, s double, n bigint", keys=["id", "cluster", "other"])
    return partial.groupBy("id", "cluster", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def silhouettes(points: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """(id, cluster, width); singletons have width 0."""
    sums = cluster_distances(points, metric)
    own = F.col("cluster") == F.col("other")
    per = sums.groupBy("id", "cluster").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    width = F.when(F.col("a").isNull(), 0.0).when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return per.select("id", "cluster", width.alias("width"))


def mean_silhouettes(points: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """(run, width): the mean silhouette of several partitions (run, id, vec, cluster) of the same points.

    Distances are shared by all partitions, and equal vectors meet the others
    once, with the numbers of their members in each cluster.  A partition of one
    cluster has no width.
    """
    cells = [tuple(r) for r in points.groupBy("run", "cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("run", "cluster").collect()]
    sizes = np.array([n for _, _, n in cells], dtype=float)
    groups = {run: np.array([i for i, c in enumerate(cells) if c[0] == run]) for run in sorted({c[0] for c in cells})}
    member = lambda run, cluster: (F.col("run") == run) & (F.col("cluster") == cluster)
    held = cut_lineage(points.groupBy("vec").agg(
        F.min("id").alias("id"), F.array(*[F.sum(member(run, c).cast("double")) for run, c, _ in cells]).alias("held")))

    def sums(x, y):
        s = metric.between(_matrix(x["vec"]), _matrix(y["vec"])) @ _matrix(y["held"])
        return pd.DataFrame({"id": x["id"].to_numpy(), "s": list(s)})

    partial = all_pairs_reduce(held, held, sums, "id bigint, s array<double>", keys=["id"])
    total = partial.groupBy("id").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(len(cells))]).alias("s"))

    def widths(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            s, n = _matrix(pdf["s"]), _matrix(pdf["held"])
            for run, at in groups.items():
                if len(at) < 2:
                    continue
                width = 0.0
                for i in at:
                    if sizes[i] > 1:
                        a, b = s[:, i] / (sizes[i] - 1), (s[:, at[at != i]] / sizes[at[at != i]]).min(1)
                        top = np.maximum(a, b)
                        width += float((n[:, i] * np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)).sum())
                yield pd.DataFrame({"run": [run], "width": [width]})

    found = total.hint("merge").join(held.select("id", "held"), "id").mapInPandas(widths, "run int, width double")
    n = F.coalesce(*[F.when(F.col("run") == run, F.lit(float(sizes[at].sum()))) for run, at in groups.items()], F.lit(1.0))
    return found.groupBy("run").agg(F.sum("width").alias("width")).select("run", (F.col("width") / n).alias("width"))


def closer_counts(pairs: DataFrame, points: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """Rank of j among the neighbours of i: one plus the points before it.

    `pairs` holds (i, j) with a bounded number of j per i; ties go by id.
    """
    targets = pairs.join(points.select(F.col("id").alias("j"), F.col("vec").alias("vj")), "j").join(
        points.select(F.col("id").alias("i"), F.col("vec").alias("vi")), "i")
    left = targets.groupBy("i").agg(
        F.first("vi").alias("vec"), F.collect_list("j").alias("js"), F.collect_list("vj").alias("vjs")
    ).withColumnRenamed("i", "id")

    def measured(batches):
        for pdf in batches:
            own = zip(pdf["vec"], pdf["vjs"])
            yield pdf[["id", "vec", "js"]].assign(ds=[metric.between(np.array([v], dtype=float), np.vstack(vs))[0] for v, vs in own])

    # Vectors of the targets stay behind: only their distances move with the grid.
    kind = dict(left.dtypes)
    left = cut_lineage(left.mapInPandas(measured, f"id {kind['id']}, vec array<double>, js {kind['js']}, ds array<double>"))

    def count(x, y):
        d = metric.between(_matrix(x["vec"]), _matrix(y["vec"]))
        pid, own = y["id"].to_numpy(), x["id"].to_numpy()
        by_id = np.argsort(pid, kind="stable")
        d, pid = d[:, by_id], pid[by_id]
        many = x["js"].map(len).to_numpy()
        row, js, dj = np.repeat(np.arange(len(x)), many), np.concatenate(x["js"].to_list()), np.concatenate(x["ds"].to_list()).astype(float)
        # The last of equal ids, as before.
        at = np.searchsorted(pid, js, "right") - 1
        inside = np.flatnonzero((at >= 0) & (pid[at] == js))
        dj[inside] = d[row[inside], at[inside]]
        hidden = _same_ids(own, pid)
        d[hidden] = np.nan
        # Equal to one part in 10^12 counts as a tie and is settled by id.
        tie = 1e-12 * np.maximum(1.0, dj)
        lo, hi = dj - tie, dj + tie
        ordered, first = np.sort(d, axis=1), np.cumsum(many) - many
        n = np.empty(len(row), "int64")
        for r in np.flatnonzero(many):
            own_rows = slice(first[r], first[r] + many[r])
            before = np.searchsorted(ordered[r], lo[own_rows], "left")
            tied = np.searchsorted(ordered[r], hi[own_rows], "right") - before
            n[own_rows] = before
            for t in first[r] + np.flatnonzero(tied):
                upto = d[r, :np.searchsorted(pid, js[t])]
                n[t] += np.count_nonzero((upto >= lo[t]) & (upto <= hi[t]))
        return pd.DataFrame({"i": own[row], "j": js, "n": n})

    partial = all_pairs_reduce(left, points.select("id", "vec"), count, "i bigint, j bigint, n bigint", keys=["i", "j"])
    return partial.groupBy("i", "j").agg((F.sum("n") + 1).alias("rank"))


def medoid_clusters(points: DataFrame, k: int, metric: Metric = Metric(), max_swaps: int = 1_000) -> DataFrame:
    """(id, vec, cluster): k medoids by greedy choice, then swaps until none lowers the summed distance.

    The change that every (medoid, candidate) swap makes is one sum over all
    points, from their distances to the nearest and second nearest medoid: blocks
    of candidates meet blocks of points and give k numbers a candidate.  Ties go
    to the smallest id.  Medoids, k rows, travel with the tasks.
    """
    pts = cut_lineage(points.select("id", "vec"))
    k = min(k, pts.count())
    taken: list[tuple[int, list[float]]] = []

    def located() -> DataFrame:
        nodes = np.array([v for _, v in taken], dtype=float)

        def nearest(batches):
            for pdf in batches:
                if len(pdf):
                    d = metric.between(_matrix(pdf["vec"]), nodes)
                    own = d.argmin(1)
                    first = d[np.arange(len(d)), own]
                    d[np.arange(len(d)), own] = np.inf
                    yield pdf.assign(own=own.astype("int64"), d1=first, d2=d.min(1))

        return cut_lineage(pts.mapInPandas(nearest, "id bigint, vec array<double>, own bigint, d1 double, d2 double"))

    def gains(x, y):
        d = metric.between(_matrix(x["vec"]), _matrix(y["vec"]))
        first, second, own = y["d1"].to_numpy(), y["d2"].to_numpy(), y["own"].to_numpy()
        closer = np.minimum(d - first, 0)
        left = np.minimum(d, second) - first - closer  # what more a point pays whose medoid goes
        change = np.stack([left[:, own == m].sum(1) for m in range(len(taken))], 1) + closer.sum(1)[:, None]
        return pd.DataFrame({"id": x["id"].to_numpy(), "s": list(change), "more": closer.sum(1)})

    def total(x, y):
        return pd.DataFrame({"id": x["id"].to_numpy(), "s": metric.between(_matrix(x["vec"]), _matrix(y["vec"])).sum(1)})

    def row(i: int) -> tuple[int, list[float]]:
        return i, list(pts.where(F.col("id") == i).first()["vec"])

    def candidates() -> DataFrame:
        return pts.where(~F.col("id").isin([i for i, _ in taken]))

    while len(taken) < k:
        if not taken:
            sums = all_pairs_reduce(pts, pts, total, "id bigint, s double", keys=["id"]).groupBy("id").agg(F.sum("s").alias("s"))
        else:
            sums = all_pairs_reduce(candidates(), located(), gains, "id bigint, s array<double>, more double", keys=["id"]).groupBy("id").agg(F.sum("more").alias("s"))
        taken = sorted([*taken, row(sums.orderBy(F.round("s", 9), "id").first()["id"])])
    for _ in range(max_swaps):
        placed = located()
        if k == placed.count():
            return placed.select("id", "vec", F.col("own").alias("cluster"))
        parts = all_pairs_reduce(candidates(), placed, gains, "id bigint, s array<double>, more double", keys=["id"])
        sums = parts.groupBy("id").agg(F.array(*[F.sum(F.col("s")[m]) for m in range(k)]).alias("s"))
        best = sums.select("id", F.posexplode("s").alias("m", "change")).orderBy(F.round("change", 9), "id", "m").first()
        if best["change"] > -1e-9:
            return placed.select("id", "vec", F.col("own").alias("cluster"))
        taken = sorted([*[t for m, t in enumerate(taken) if m != best["m"]], row(best["id"])])
    raise RuntimeError(f"swaps still lower the distance after {max_swaps}")
