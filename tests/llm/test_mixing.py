"""Weighted fair queueing: targets, totals, ties and awkward rows."""

import random
from collections import defaultdict

import pytest
from fixtures import by_id, documents, enumerated

from tessera.llm.mixing import mixed, mixed_counts


def water(sizes, weights, budget, most=3):
    target, open_ = {}, set(sizes)
    while True:
        left = budget - sum(target.values())
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > most * sizes[s]} if total else set()
        if not full:
            return target | {s: left * weights[s] / total for s in open_}
        target |= {s: most * sizes[s] for s in full}
        open_ -= full


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, one int, row string")


def test_targets(spark):
    rnd = random.Random(1)
    rows = []
    for s, n in (("a", 300), ("b", 200), ("c", 10), ("é", 150), (None, 120)):
        rows += [(len(rows) + i, "w " * rnd.randint(0, 40), s, 1, "x") for i in range(n)]
    got = mixed_counts(table(spark, rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0
    assert {r.source: r.source_size for r in got} == dict(sizes)
    order = ["a", "b", "c", "é", None]
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values()))
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 3 * 40, s
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(got) == sorted(mixed_counts(table(spark, rows)).collect())


def test_awkward(spark):
    rows = [(1, None, "a", 1, "x"), (1, "", "a", 1, "x"), (2, "p q", "a", 1, "x"), (2, "p q", "a", 1, "x"), (None, "z", None, 1, "x")]
    got = mixed_counts(table(spark, rows)).collect()
    assert len(got) == 5 and all(r.copies <= 1 for r in got if r["size"] == 0)
    assert mixed_counts(table(spark, [])).count() == 0
    assert mixed(table(spark, [])).count() == 0
    alone = by_id(mixed_counts(table(spark, [(7, "a b", "s", 1, "x")])))
    assert (alone[7]["taken"], alone[7]["target"]) == (2, 2.0)
    blank = by_id(mixed_counts(table(spark, [(7, " ", "s", 1, "x")])))
    assert (blank[7]["taken"], blank[7]["target"]) == (0, 0.0)


def test_rows_are_repeated(spark):
    docs = enumerated(spark, [f"{'w ' * (i % 7)}" for i in range(90)])
    counts = by_id(mixed_counts(docs))
    rows = mixed(docs)
    assert rows.columns == docs.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r.doc_id] += 1
    assert all(got[i] == counts[i]["copies"] for i in range(90))
