"""Ordinal cumulative-link regression on graded ratings.

Each document has hashed text features x; all thresholds share their weights:

    P(grade <= j) = sigmoid(threshold_j - w.x),  threshold_1 < threshold_2 < ...

Thresholds are kept in order by writing them as a first one and exponentials of
gaps.  The likelihood with an L2 penalty is maximised by limited-memory
quasi-Newton steps; each evaluation is one job, in which tasks add up gradients
of their rows, so that one vector per task reaches the driver.

Features are hashed words and beginnings of words, by presence, and hashed word
shapes (runs of letters, digits and marks collapsed, case kept) and repeats of
the word before, by their share of the words.  Features in fewer than
`least_docs` rated rows are left out of the fit.

The fit uses at most `max_rows` rated rows, chosen by a hash of their ids; all
documents are scored.

Defined cases: null and empty texts have no features and get the grade of the
thresholds alone; rows that share an id are scored each, ratings that share an id
count as their lowest grade; without rated documents every grade is taken to be
the highest; an empty table gives no rows; other columns are ignored or, in
`accepted`, kept.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.rows import bounded_batches, cut_lineage

DIMS = 1 << 17
MAX_ROWS = 20_000  # rated rows the fit uses at most
ROUNDS, PENALTY = 40, 1e-3
LEAST_DOCS = 10  # rated rows a feature must occur in
PREFIX = 5
_WORDS = A.Alphabet(fold=True, seed=51)
_CLASS = np.array([ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c
                   for c in range(256)], np.uint8)
_SHAPES = A.Alphabet(seed=52)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def features(buf: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, value, bounds): sparse features of some texts."""
    start, end, first = A.word_bounds(buf, offs, _WORDS)
    text = A.owners(first)
    words = A.word_hashes(buf, start, _WORDS)
    kind = _CLASS[buf]
    edge = np.ones(len(buf), bool)  # runs of one class count once
    edge[1:] = kind[1:] != kind[:-1]
    edge[start] = True
    inside = _WORDS.word[buf] & edge
    at = np.flatnonzero(inside)
    shapes = np.zeros(len(start), A.U)
    if len(start):
        base = np.searchsorted(at, start)
        flat = kind[at]
        powers, inverse = _SHAPES.powers(len(flat))
        shapes = A.mix(np.add.reduceat(_SHAPES.value[flat] * powers[:len(flat)], base) * inverse[base])
    heads = np.zeros(len(start), A.U)
    if len(start):  # the first bytes of each word
        reach = np.minimum(end, start + PREFIX)
        powers, inverse = _WORDS.powers(len(buf))
        total = np.r_[A.U(0), np.cumsum(_WORDS.value[buf] * powers[:len(buf)])]
        heads = A.mix((total[reach] - total[start]) * inverse[start])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    out_place, out_value, out_text = [], [], []
    for salt, keys, own, counted in ((1, words, text, False), (4, heads, text, False), (2, shapes, text, True),
                                     (3, np.full(int(same.sum()), A.U(99)), text[same], True)):
        place = (A.mix(keys + A.U(salt * 0x9E37)) % A.U(dims)).astype(np.int64)
        pair, count = np.unique(own * dims + place, return_counts=True)
        own, place = pair // dims, pair % dims
        if counted:  # the share of the words
            value = count / np.maximum(np.diff(first)[own], 1)
        else:
            value = np.ones(len(own))
        out_place.append(place)
        out_value.append(value)
        out_text.append(own)
    place, value, own = map(np.concatenate, (out_place, out_value, out_text))
    order = np.argsort(own, kind="stable")
    return place[order], value[order].astype(np.float32), np.searchsorted(own[order], np.arange(len(offs)))


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=float)]
    return total[bounds[1:]] - total[bounds[:-1]]


def _thresholds(raw: np.ndarray) -> np.ndarray:
    return np.r_[raw[0], raw[0] + np.cumsum(np.exp(raw[1:]))] if len(raw) else raw


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_likelihood(score: np.ndarray, grade: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the log-probability of its grade, its slope in the score, and (rows, raw thresholds) slopes."""
    cut = np.r_[-np.inf, _thresholds(raw), np.inf]
    upper, lower = _sigmoid(cut[grade + 1] - score), _sigmoid(cut[grade] - score)
    upper[grade == len(raw)] = 1.0
    lower[grade == 0] = 0.0
    p = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = np.zeros((len(score), len(raw)))
    for j in range(len(raw)):
        by_cut[:, j] = np.where(grade == j, up, 0) - np.where(grade == j + 1, low, 0)
    slope = np.cumsum(by_cut[:, ::-1], axis=1)[:, ::-1]  # a raw value moves its threshold and all after it
    slope[:, 1:] *= np.exp(raw[1:])
    return np.log(p), low - up, slope


def _examples(batches, dims):
    for batch in batches:
        grades, at = batch.column("grade").to_numpy(), 0
        for ids, buf, offs in A.text_pieces([batch]):
            place, value, bounds = features(buf, offs, dims)
            rows = [A.pack(place[a:b].astype(np.int32), value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(grades[at:at + len(ids)], pa.int32()), pa.array(rows, pa.binary())],
                                             ["grade", "features"])
            at += len(ids)


@A.trimmed
def _occurrences(batches, dims):
    counts = np.zeros(dims, np.int32)
    for batch in batches:
        for blob in batch.column("features").to_pylist():
            counts[A.unpack(blob, np.int32, np.float32)[0]] += 1  # a row names a place once per kind
    yield pa.RecordBatch.from_arrays([pa.array([A.pack(counts)], pa.binary())], ["counts"])


@A.trimmed
def _gradient(batches, state, dims, least):
    weights, raw = state.value
    known = least.value
    total, cuts, loss, n = np.zeros(dims), np.zeros(len(raw)), 0.0, 0
    for batch in batches:
        parts = [A.unpack(b, np.int32, np.float32) for b in batch.column("features").to_pylist()]
        grade = batch.column("grade").to_numpy()
        bounds = np.r_[0, np.cumsum([len(p[0]) for p in parts])].astype(int)
        place, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        value = np.where(known[place], value, 0)
        own, slope, by_raw = log_likelihood(_row_sums(weights[place] * value, bounds), grade, raw)
        total += np.bincount(place, value * np.repeat(slope, np.diff(bounds)), dims)
        cuts += by_raw.sum(0)
        loss -= own.sum()
        n += len(grade)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary()),
                                          pa.array([cuts.tobytes()], pa.binary())], ["n", "loss", "weights", "cuts"])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", max_rows: int = MAX_ROWS, dims: int = DIMS, rounds: int = ROUNDS,
        penalty: float = PENALTY, least_docs: int = LEAST_DOCS) -> Model:
    """Fit on documents with ratings 0 .. grades - 1."""
    spark = docs.sparkSession
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("rated_id")).agg(
        F.min(grade_col).cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("text")).join(rated, "rated_id").select(
        "rated_id", "text", "grade")
    tasks = max(2, min(32, spark.sparkContext.defaultParallelism))
    examples = cut_lineage(rows.repartition(tasks, "rated_id").mapInArrow(partial(_examples, dims=dims), "grade int, features binary"))
    held = {r.grade: r["count"] for r in examples.groupBy("grade").count().collect()}
    n = sum(held.values())
    if not n:
        return Model(np.zeros(dims, np.float32), np.full(grades - 1, -40.0))
    below = np.cumsum([held.get(g, 0) for g in range(grades)])[:-1]
    share = np.clip(below / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    raw = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    examples = examples.coalesce(tasks)
    often = examples.mapInArrow(partial(_occurrences, dims=dims), "counts binary").collect()
    least = spark.sparkContext.broadcast(sum(A.unpack(r.counts, np.int32)[0] for r in often) >= least_docs)  # a byte a feature

    def evaluate(x):
        state = spark.sparkContext.broadcast((x[:dims], x[dims:]))
        parts = examples.mapInArrow(partial(_gradient, state=state, dims=dims, least=least),
                                    "n bigint, loss double, weights binary, cuts binary").collect()
        state.unpersist()
        slope = np.r_[sum(np.frombuffer(p.weights) for p in parts), sum(np.frombuffer(p.cuts) for p in parts)] / -n
        slope[:dims] += penalty * x[:dims]
        return sum(p.loss for p in parts) / n + penalty / 2 * float(x[:dims] @ x[:dims]), slope

    x = minimised(evaluate, np.r_[np.zeros(dims), raw], rounds)
    return Model(x[:dims].astype(np.float32), _thresholds(x[dims:]))


def minimised(evaluate, x: np.ndarray, rounds: int, memory: int = 8, close: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; `evaluate` gives value and slope."""
    value, slope = evaluate(x)
    past = []
    for _ in range(rounds):
        step = -slope
        kept = []
        for dx, dg in reversed(past):
            a = (dx @ step) / (dx @ dg)
            step = step - a * dg
            kept.append(a)
        if past:
            dx, dg = past[-1]
            step = step * ((dx @ dg) / (dg @ dg))
        for (dx, dg), a in zip(past, reversed(kept)):
            step = step + dx * (a - (dg @ step) / (dx @ dg))
        size, drop = 1.0, slope @ step
        if not past:
            size = 1 / max(1.0, float(np.abs(step).sum()))
        while True:
            to = x + size * step
            new, new_slope = evaluate(to)
            if new <= value + 1e-4 * size * drop or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:
            break
        dx, dg = to - x, new_slope - slope
        if dx @ dg > 1e-12:
            past = [*past[1 - memory:], (dx, dg)]
        settled = value - new < close * max(abs(value), 1e-6)
        x, value, slope = to, new, new_slope
        if settled:
            break
    return x


def _score(batches, shared, dims):
    weights, cuts = shared.value
    for batch in batches:
        at = 0
        for ids, buf, offs in A.text_pieces([batch]):
            place, value, bounds = features(buf, offs, dims)
            score = _row_sums(weights[place] * value, bounds)
            above = 1 - _sigmoid(cuts[None, :] - score[:, None])  # P(grade > j)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(score), pa.array(above.sum(1)),
                                              pa.array(list(above), pa.list_(pa.float64()))], ["id", "score", "expected_grade", "tails"])
            at += n


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, expected_grade, tails): tails[j] is the probability of a grade above j."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 4 bytes per feature
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_score, shared=shared, dims=len(model.weights)),
                          f"id {kind}, score double, expected_grade double, tails array<double>")
    return out.withColumnRenamed("id", id_col)


def _accept(batches, shared, id_col, text_col, above, least):
    weights, cuts = shared.value
    for batch in batches:
        some = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col)], ["id", "text"])
        keep = []
        for _, buf, offs in A.text_pieces([some]):
            place, value, bounds = features(buf, offs, len(weights))
            keep.append(1 - _sigmoid(cuts[above] - _row_sums(weights[place] * value, bounds)) >= least)
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", above: int = 1,
             least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose probability of a grade over `above` is at least `least`."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    return docs.mapInArrow(partial(_accept, shared=shared, id_col=id_col, text_col=text_col, above=above, least=least), docs.schema)


def quality_grade(quality: Column, toxic: Column) -> Column:
    """Grades from the two labels: 0 toxic, 1 poor, 2 good; null without both."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2).cast("int")
