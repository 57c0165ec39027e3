"""Principal axes, spectral coordinates and scaling with rows that stay in Spark.

Only matrices whose size is the number of columns (or of kept dimensions) reach
the driver; anything as long as the table is a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways, degrees
from tessera.operators.neighbours import Metric, _matrix, all_pairs_reduce
from tessera.operators.paths import SIDE, PathBlocks, held, in_blocks, path_blocks
from tessera.operators.scaling import SPARE, TOLERANCE, distance_product, leading_axes
from tessera.operators.sparse import in_parts
from tessera.session import cut_lineage


def covariance(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, cov): sample covariance of the entries of an array column, i <= j.

    Tasks fold their batches around a common shift; partial sums add up by cell.
    """
    first = df.select(vec).where(F.col(vec).isNotNull()).first()
    shift = np.array(first[vec], dtype=float)
    d = len(shift)
    upper = np.triu_indices(d)

    def partial(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf[vec]) - shift
                n += len(x)
                s += x.sum(0)
                g += x.T @ x
        if n:
            i, j = upper
            yield pd.DataFrame({"i": i.astype("int64"), "j": j.astype("int64"), "g": g[upper], "si": s[i], "sj": s[j], "n": n})

    sums = df.select(vec).mapInPandas(partial, "i bigint, j bigint, g double, si double, sj double, n bigint")
    t = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("g", "si", "sj", "n")])
    return t.select("i", "j", F.try_divide(F.col("g") - F.col("si") * F.col("sj") / F.col("n"), F.col("n") - 1.0).alias("cov"))


def principal_axes(df: DataFrame, rank: int, vec: str = "vec", scale: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as columns, variance shares); signs make the largest entry positive."""
    rows = covariance(df, vec).collect()
    d = max(r["j"] for r in rows) + 1
    cov = np.zeros((d, d))
    for r in rows:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
    mean = np.array(df.agg(F.array(*[F.avg(F.col(vec)[i]) for i in range(d)])).first()[0])
    sd = np.sqrt(np.diag(cov)) if scale else np.ones(d)
    sd = np.where(sd > 1e-12, sd, 1.0)
    val, ax = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(val)[::-1][:rank]
    val, ax, total = val[order], ax[:, order], max(1e-300, val.sum())
    ax = ax * np.sign(ax[np.abs(ax).argmax(0), np.arange(ax.shape[1])])
    return mean, ax / sd[:, None], val / total


def project(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vec: str = "vec", out: str = "score") -> DataFrame:
    """Coordinates on the axes, as an array column."""
    d, k = axes.shape

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        return pd.Series(list((_matrix(v) - mean) @ axes)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, scores(F.col(vec)))


def axis_variances(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vec: str = "vec") -> np.ndarray:
    """Variance of the scores on each axis."""
    k = axes.shape[1]
    scored = project(df, mean, axes, vec)
    return np.array(scored.agg(F.array(*[F.var_samp(F.col("score")[j]) for j in range(k)])).first()[0], dtype=float)


def contributions(axes: np.ndarray, shares: np.ndarray, items: Sequence[str]) -> dict[str, float]:
    """Share of kept variance per source item: squared loadings times variance share."""
    part = (axes**2 / (axes**2).sum(0)) @ shares
    out: dict[str, float] = {}
    for name, v in zip(items, part):
        out[name] = out.get(name, 0.0) + float(v)
    return out


def plain_whitening(df: DataFrame, x: str, y: str, cover: float = 0.995) -> DataFrame:
    """Adds u1, u2: Mahalanobis coordinates scaled so that `cover` of rows fall in the unit disk."""
    from tessera.operators.ordered import quantiles

    facts = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c")).first()
    cov = np.array([[facts["vx"], facts["c"]], [facts["c"], facts["vy"]]])
    val, ax = np.linalg.eigh(cov)
    w = ax @ np.diag(1 / np.sqrt(np.maximum(val, 1e-12))) @ ax.T
    dx, dy = F.col(x) - facts["mx"], F.col(y) - facts["my"]
    white = df.withColumn("u1", F.lit(float(w[0, 0])) * dx + F.lit(float(w[0, 1])) * dy).withColumn(
        "u2", F.lit(float(w[1, 0])) * dx + F.lit(float(w[1, 1])) * dy)
    r = white.withColumn("_r", F.sqrt(F.col("u1") ** 2 + F.col("u2") ** 2))
    q = quantiles(r, "_r", {"q": cover}).select("q").scalar()
    return r.withColumn("_q", q).withColumn("u1", F.col("u1") / F.col("_q")).withColumn("u2", F.col("u2") / F.col("_q")).drop("_r", "_q")


def robust_whitening(df: DataFrame, x: str, y: str, keep: float = 0.80, shrink: float = 0.15, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(centre, scatter) by concentration steps: refit on the central share until it settles.

    Each step is one aggregate; the cut is an exact quantile of squared distances.
    """
    from tessera.operators.ordered import quantiles

    part, last = df.select(F.col(x).alias("x"), F.col(y).alias("y")), None
    inside = part
    for _ in range(rounds):
        f = inside.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c")).first()
        cov = np.array([[f["vx"], f["c"]], [f["c"], f["vy"]]])
        state = (f["mx"], f["my"], *cov.ravel())
        if last is not None and np.allclose(state, last, rtol=1e-9):
            break
        last = state
        inv = np.linalg.inv(cov)
        dx, dy = F.col("x") - f["mx"], F.col("y") - f["my"]
        far = part.withColumn("m", float(inv[0, 0]) * dx * dx + 2 * float(inv[0, 1]) * dx * dy + float(inv[1, 1]) * dy * dy)
        cut = quantiles(far, "m", {"q": keep}).first()["q"]
        inside = far.where(F.col("m") <= cut).select("x", "y")
    cov = (1 - shrink) * cov + shrink * np.trace(cov) / 2 * np.eye(2)
    return np.array([last[0], last[1]]), cov


def _orthonormal(table: DataFrame, m: int) -> DataFrame:
    """Orthonormalise the columns of the array `v` through their Gram matrix (m x m)."""
    cells = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(m) for j in range(i, m)]
    g = np.zeros((m, m))
    flat = iter(table.agg(F.array(*cells)).first()[0])
    for i in range(m):
        for j in range(i, m):
            g[i, j] = g[j, i] = next(flat)
    val, vec = np.linalg.eigh(g)
    root = vec / np.sqrt(np.maximum(val, 1e-14 * val.max()))
    return table.withColumn("v", _combine("v", root))


def _combine(col: str, matrix: np.ndarray):
    """Array column times a small matrix, inside codegen."""
    rows, cols = matrix.shape
    return F.array(*[sum((F.col(col)[i] * F.lit(float(matrix[i, j])) for i in range(rows)), F.lit(0.0)) for j in range(cols)])


def _rayleigh(v: DataFrame, av: DataFrame, m: int) -> np.ndarray:
    """V'AV of two tables (id, v) and (id, a)."""
    cells = [F.sum(F.col("v")[i] * F.col("a")[j]) for i in range(m) for j in range(m)]
    return np.array(v.join(av, "id").agg(F.array(*cells)).first()[0]).reshape(m, m)


def _signed(table: DataFrame, keep: int) -> DataFrame:
    """Flip each column so that its largest entry in size is positive."""
    flip = table.agg(*[F.max_by(F.signum(F.col("v")[j]), F.struct(F.abs(F.col("v")[j]), -F.col("id"))).alias(f"s{j}") for j in range(keep)]).first()
    return table.withColumn("v", F.array(*[F.col("v")[j] * F.lit(float(flip[f"s{j}"] or 1.0)) for j in range(keep)]))


def _seeded(ids: DataFrame, m: int, extra=()) -> DataFrame:
    noise = [F.xxhash64("id", F.lit(j)).cast("double") / 2.0**63 for j in range(m - len(extra))]
    return ids.select("id", F.array(*extra, *noise).alias("v"))


def laplacian_eigenmaps(edges: DataFrame, dims: int = 3, rounds: int = 6, degree: int = 20, tol: float = 1e-3,
                        spare: int = 4) -> DataFrame:
    """(id, v): smallest non-trivial eigenvectors of the normalised Laplacian.

    Subspace iteration with a Chebyshev filter: a polynomial in the Laplacian
    that is small on the unwanted part of the spectrum, whose edge the last Ritz
    values give.  A product with the matrix sends sums for vertices and parts, not for edges.
    """
    deg = cut_lineage(degrees(edges).select("id", "strength"))
    a = deg.select(F.col("id").alias("src"), F.col("strength").alias("ks"))
    b = deg.select(F.col("id").alias("dst"), F.col("strength").alias("kd"))
    adj = cut_lineage(both_ways(edges, "w").join(a, "src").join(b, "dst").select(
        "src", "dst", (F.col("w") / F.sqrt(F.col("ks") * F.col("kd"))).alias("w")))
    m = dims + 1 + spare

    matrix = in_parts(adj, deg.select("id"))

    def started(v: DataFrame) -> DataFrame:
        return cut_lineage(matrix.packed(v).withColumn("prev", F.lit(None).cast("binary")))

    def images(v: DataFrame) -> DataFrame:
        """(id, a) of the normalised Laplacian times v."""
        return matrix.unpacked(matrix.stepped(started(v), m, lambda x, y, _: x - y), m).select("id", F.col("v").alias("a"))

    def filtered(v: DataFrame, edge: float) -> DataFrame:
        centre, half = (edge + 2.0) / 2, (2.0 - edge) / 2
        t = matrix.stepped(started(v), m, lambda x, y, _: ((1 - centre) * x - y) / half)
        for _ in range(1, degree):
            t = matrix.stepped(t, m, lambda x, y, prev: 2 * ((1 - centre) * x - y) / half - prev)
        return matrix.unpacked(t, m)

    v, last = cut_lineage(_orthonormal(_seeded(deg, m, [F.sqrt("strength")]), m)), None
    for turn in range(rounds + 1):
        lv = cut_lineage(images(v))
        h = _rayleigh(v, lv, m)
        val, vec = np.linalg.eigh((h + h.T) / 2)
        v = v.withColumn("v", _combine("v", vec))
        settled = last is not None and np.max(np.abs(val[: dims + 1] - last[: dims + 1])) <= tol * max(val[m - 1], 1e-12)
        if settled or turn == rounds:
            break
        last = val
        v = cut_lineage(_orthonormal(cut_lineage(filtered(v, float(min(val[m - 1], 1.9)))), m))
    # The first vector is the trivial one.
    return _signed(v.select("id", F.slice("v", 2, dims).alias("v")), dims)


def classical_scaling(points: DataFrame, dims: int, metric: Metric = Metric(), tol: float = TOLERANCE, spare: int = SPARE) -> DataFrame:
    """(id, v): coordinates whose distances approximate the metric; n x n never exists."""
    pts = cut_lineage(points.select("id", "vec", F.lit(-1).alias("held")))
    axes, val = leading_axes(pts, distance_product(pts, metric, 1, dims + spare), dims, 1, spare, tol)
    return _scaled(axes, val[0], dims)


def _scaled(axes: DataFrame, values: np.ndarray, dims: int) -> DataFrame:
    """(id, v): axes times the roots of their values, none below zero."""
    scale = np.diag(np.sqrt(np.maximum(values, 0.0)))
    return _signed(axes.select("id", _combine("w", scale).alias("v")), dims)


#: Distances rank by their leading bits: a range spans a 2^-20 part of its values at most.
RANGE_SHIFT = 32
#: Up to this many pairs all bits that distances keep count, so that only equal ones tie.
EXACT_PAIRS, EXACT_SHIFT = 4_000_000, 13


def _ranges(x: np.ndarray, shift: int = RANGE_SHIFT) -> np.ndarray:
    """The range of each positive number, ascending with it."""
    return np.ascontiguousarray(x, np.float64).view(np.int64) >> shift


def pair_agreement(points: DataFrame, coords: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """(n, pearson, spearman, stress1): correlations and Kruskal stress of two distances over all pairs.

    Block pairs return moments and counts only, and no table of pairs exists.
    The first pass counts the distances in narrow ranges; the counts, as many as
    there are ranges in use (1,048,576 for each doubling of the distance at most),
    give a mean rank for each range, and a second pass sums products of ranks.
    Distances in one range count as ties, which moves the correlation by less
    than 1e-9 where no range holds more than a thousandth of the pairs; tables of
    few pairs rank by all bits.
    """
    both = cut_lineage(points.select("id", "vec").join(coords.select("id", F.col("v").alias("low")), "id"))
    spark = both.sparkSession
    shift = EXACT_SHIFT if both.count() ** 2 <= 2 * EXACT_PAIRS else RANGE_SHIFT

    def distances(x, y):
        a = metric.between(_matrix(x["vec"]), _matrix(y["vec"]))
        b = Metric().between(_matrix(x["low"]), _matrix(y["low"]))
        use = (x["id"].to_numpy()[:, None] < y["id"].to_numpy()[None, :]) & (a > 0) & (b > 0)
        return a[use], b[use]

    def moments(x, y):
        a, b = distances(x, y)
        names = ["n", "ma", "mb", "vaa", "vbb", "vab", "gap", "saa"]
        if not len(a):
            return pd.DataFrame(columns=names)
        da, db = a - a.mean(), b - b.mean()
        return pd.DataFrame([(len(a), a.mean(), b.mean(), da @ da, db @ db, da @ db, ((a - b) ** 2).sum(), a @ a)], columns=names)

    def held(x, y):
        out = []
        for side, values in enumerate(distances(x, y), 1):
            ranges, count = np.unique(_ranges(values, shift), return_counts=True)
            out.append(pd.DataFrame({"side": side, "range": ranges, "n": count}).astype({"side": "int32"}))
        return pd.concat(out)

    parts = cut_lineage(all_pairs_reduce(both, both, moments, "n bigint, ma double, mb double, vaa double, vbb double, vab double, gap double, saa double"))
    # A task gives one row for each range it meets, and the driver gets columns rather than rows.
    ranges = all_pairs_reduce(both, both, held, "side int, range bigint, n bigint", keys=["side", "range"])
    counts = ranges.groupBy("side", "range").agg(F.sum("n").alias("n")).toArrow().to_pandas().sort_values(["side", "range"])
    tables = []
    for side in (1, 2):
        own = counts[counts["side"] == side]
        n = own["n"].to_numpy()
        tables.append((own["range"].to_numpy(), np.cumsum(n) - n / 2 - n.sum() / 2))  # mean ranks, their centre at 0
    shared = spark.sparkContext.broadcast(tables)

    def ranked(x, y):
        (ka, ra), (kb, rb) = shared.value
        a, b = distances(x, y)
        a, b = ra[np.searchsorted(ka, _ranges(a, shift))], rb[np.searchsorted(kb, _ranges(b, shift))]
        return pd.DataFrame({"raa": [a @ a], "rbb": [b @ b], "rab": [a @ b]})

    second = all_pairs_reduce(both, both, ranked, "raa double, rbb double, rab double").agg(*[F.sum(c).alias(c) for c in ("raa", "rbb", "rab")])
    centre = parts.agg(F.sum(F.col("n") * F.col("ma")) / F.sum("n"), F.sum(F.col("n") * F.col("mb")) / F.sum("n")).first()
    da, db, n = F.col("ma") - F.lit(centre[0]), F.col("mb") - F.lit(centre[1]), F.col("n")
    f = parts.agg(F.sum("n").alias("n"), F.sum(F.col("vaa") + n * da * da).alias("vaa"), F.sum(F.col("vbb") + n * db * db).alias("vbb"),
                  F.sum(F.col("vab") + n * da * db).alias("vab"), F.sum("gap").alias("gap"), F.sum("saa").alias("saa"))
    ratio = lambda xy, xx, yy: F.when((F.col(xx) > 0) & (F.col(yy) > 0), F.col(xy) / F.sqrt(F.col(xx) * F.col(yy)))
    ranks = second.first()
    f = f.withColumns({c: F.lit(ranks[c]).cast("double") for c in ("raa", "rbb", "rab")})
    return f.select(F.coalesce("n", F.lit(0)).alias("n"), ratio("vab", "vaa", "vbb").alias("pearson"), ratio("rab", "raa", "rbb").alias("spearman"),
                    F.when(F.col("saa") > 0, F.sqrt(F.col("gap") / F.col("saa"))).alias("stress1"))


def shortest_paths(edges: DataFrame, sources: DataFrame, length: str = "d", max_rounds: int = 500) -> DataFrame:
    """(source, id, d) from a bounded set of sources, by rounds of relaxation until nothing falls.

    Only vertices whose distance fell in the last round send messages.
    """
    ways = cut_lineage(both_ways(edges, length).withColumnRenamed(length, "len"))
    known = cut_lineage(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("d")).withColumn("fresh", F.lit(True)))
    for _ in range(max_rounds):
        sent = known.where("fresh").join(ways, known.id == ways.src).select(
            "source", F.col("dst").alias("id"), (F.col("d") + F.col("len")).alias("d"), F.lit(True).alias("fresh"))
        pool = known.withColumn("fresh", F.lit(False)).unionByName(sent)
        best = pool.groupBy("source", "id").agg(F.min(F.struct("d", "fresh")).alias("b")).select("source", "id", "b.d", "b.fresh")
        known = cut_lineage(best)
        if known.where("fresh").isEmpty():
            return known.select("source", "id", "d")
    raise RuntimeError(f"paths still shorten after {max_rounds} rounds")


def geodesics(edges: DataFrame, ids: DataFrame, length: str = "d", batch: int = SIDE) -> DataFrame:
    """(source, id, d) from every vertex in `ids` to all it reaches; `batch` vertices are a block of the matrix."""
    asked = ids.select(F.col("id").alias("source")).distinct()
    found = path_blocks(edges, ids, length, batch).rows()
    lone = asked.where("source is null").select("source", F.col("source").cast(dict(found.dtypes)["id"]).alias("id"), F.lit(0.0).alias("d"))
    return found.join(asked, "source", "left_semi").unionByName(lone)


def _as_blocks(paths: DataFrame | PathBlocks, ids: DataFrame) -> PathBlocks:
    if isinstance(paths, PathBlocks):
        return paths
    return in_blocks(paths.select(F.col("source").alias("src"), F.col("id").alias("dst"), F.col("d").alias("len")), ids.select("id").distinct())


def _longest(paths: PathBlocks) -> float:
    """The longest path, zero if there is none."""
    def most(batches):
        for pdf in batches:
            for d in pdf["d"]:
                x = np.frombuffer(d) if d else np.zeros(0)
                yield pd.DataFrame({"d": [x.max(initial=0.0, where=np.isfinite(x))]})

    return paths.blocks.select("d").mapInPandas(most, "d double").agg(F.max("d")).first()[0] or 0.0


def geodesic_scaling(paths: DataFrame | PathBlocks, ids: DataFrame, dims: int, tol: float = TOLERANCE, spare: int = SPARE) -> DataFrame:
    """(id, v): classical scaling of the path lengths between all vertices.

    Vertices without a path are ten times the longest path apart.  `paths` is the
    matrix in blocks or a table (source, id, d); in a product each block meets the
    vectors of its two sides.
    """
    m = dims + spare
    paths = _as_blocks(paths, ids)
    sizes, apart = paths.sizes, 100.0 * _longest(paths) ** 2

    def apply(v: DataFrame) -> DataFrame:
        # As the columns sum to nothing, a constant for all pairs adds nothing: only its lack on paths does.
        def products(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    d = held(sizes, r.i, r.j, r.d)
                    weight = np.where(np.isfinite(d), d * d - apart, 0.0)
                    yield pd.DataFrame({"block": [r.i], "s": [(weight @ np.frombuffer(r.y).reshape(-1, m)).tobytes()]})
                    if r.i != r.j:
                        yield pd.DataFrame({"block": [r.j], "s": [(weight.T @ np.frombuffer(r.x).reshape(-1, m)).tobytes()]})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            s = np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0).reshape(-1, m)
            return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "pos": np.arange(len(s), dtype="int32"), "s": list(s)})

        parts = paths.with_vectors(v, m).mapInPandas(products, "block int, s binary")
        sums = cut_lineage(parts.groupBy("block").applyInPandas(added, "block int, pos int, s array<double>").join(paths.places, ["block", "pos"]).select("id", "s"))
        centre = sums.agg(F.array(*[F.avg(F.col("s")[j]) for j in range(m)])).first()[0]
        return sums.select("id", F.array(*[-0.5 * (F.col("s")[j] - F.lit(float(centre[j]))) for j in range(m)]).alias("image"))

    axes, val = leading_axes(ids.select("id", F.lit(-1).alias("held")), apply, dims, 1, spare, tol)
    return _scaled(axes, val[0], dims)


def _of_copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and number of the rows that were added up; the number is the last column."""
    n = x[:, -1]
    return x[:, :-1] / np.maximum(n, 1.0)[:, None], n


def isomap_residual(paths: DataFrame | PathBlocks, coords: DataFrame, dims: Sequence[int]) -> DataFrame:
    """(m, resvar): 1 - corr^2 of path lengths and distances in the first m coordinates, over all ordered pairs.

    Vertices without a path count as in `geodesic_scaling`, a vertex and itself as zero.
    """
    spark = coords.sparkSession
    paths = _as_blocks(paths, coords)
    sizes, apart, wide = paths.sizes, 10.0 * _longest(paths), max(dims)

    def moments(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                d = held(sizes, r.i, r.j, r.d)
                d = np.where(np.isfinite(d), d, apart)
                (a, u), (b, v) = (_of_copies(np.frombuffer(x).reshape(-1, wide + 1)) for x in (r.x, r.y))
                gaps = [Metric().between(a[:, :m], b[:, :m]) for m in dims]
                sums = [u.sum() * v.sum(), *[u @ t @ v for t in (d, d * d, *[t for g in gaps for t in (g, g * g, d * g)])]]
                yield pd.DataFrame({"s": [np.array(sums) * (1.0 if r.i == r.j else 2.0)]})

    # Rows with one id count each: their number stands behind the sum of their coordinates.
    low = coords.select("id", F.concat(F.slice("v", 1, wide), F.array(F.lit(1.0))).alias("v"))
    parts = paths.with_vectors(low, wide + 1).mapInPandas(moments, "s array<double>")
    total = parts.agg(F.array(*[F.sum(F.col("s")[c]) for c in range(3 + 3 * len(dims))])).first()[0]
    n, sd, sdd = (x or 0.0 for x in total[:3])
    out = []
    for at, m in enumerate(dims):
        g, gg, dg = (x or 0.0 for x in total[3 + 3 * at:6 + 3 * at])
        spread = (n * sdd - sd * sd) * (n * gg - g * g)
        out.append((int(m), float(1 - (n * dg - sd * g) ** 2 / spread) if spread > 0 else None))
    return spark.createDataFrame(out, "m int, resvar double")


def kernel_density(points: DataFrame, grid: DataFrame, x: str, y: str, hx: float, hy: float) -> DataFrame:
    """(gx, gy, density): Gaussian kernel density on a small lattice.

    The lattice travels with the tasks; each folds its rows into one vector.
    """
    nodes = np.array([(r["gx"], r["gy"]) for r in grid.select("gx", "gy").collect()])

    def partial(batches):
        n, s = 0, np.zeros(len(nodes))
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                p = pdf.iloc[lo:lo + 4096]
                zx = (nodes[:, 0][:, None] - p[x].to_numpy()[None, :]) / hx
                zy = (nodes[:, 1][:, None] - p[y].to_numpy()[None, :]) / hy
                s += np.exp(-0.5 * (zx * zx + zy * zy)).sum(1)
                n += len(p)
        if n:
            yield pd.DataFrame({"gx": nodes[:, 0], "gy": nodes[:, 1], "s": s, "n": n})

    t = points.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).mapInPandas(partial, "gx double, gy double, s double, n bigint")
    return t.groupBy("gx", "gy").agg((F.sum("s") / F.sum("n") / (2 * np.pi * hx * hy)).alias("density"))
