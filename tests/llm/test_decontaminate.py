"""Benchmark windows in documents against brute force, and texts without them."""

import random
import re

import pytest
from fixtures import WORDS, by_id, documents, enumerated, texts

from tessera.llm.decontaminate import Automaton, benchmark_matches, decontaminated, normalised


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w, hit, found = words_of(text), set(), set()
    for name, t in items:
        own = words_of(t)
        k = min(window, len(own))
        grams = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i:i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choices(WORDS[:12], k=rnd.randint(1, 30)))) for i in range(25)]
    items += [(100, items[3][1]), (101, None), (102, ""), (103, "w1 W2"), (104, "w2"), (None, "w1 w2 w3")]
    values = texts(8)
    for i in range(25):
        own = items[i][1].split()
        cut = rnd.randint(0, len(own) - 1)
        values.append(" ".join([*rnd.choices(WORDS[:12], k=20), *own[cut:], "," + rnd.choice(WORDS), *rnd.choices(WORDS[:12], k=20)]).upper())
    return values, items


@pytest.mark.parametrize("window", [3, 10])
def test_brute_force(spark, case, window):
    values, items = case
    table = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id bigint, text string, doc_id string")
    got = by_id(benchmark_matches(enumerated(spark, values), table, window=window))
    named = [(i, t) for i, t in items if i is not None]
    for i, t in enumerate(values):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute(t, named, window), t


def test_several_passes(spark, case, monkeypatch):
    from tessera.llm import decontaminate

    values, items = case
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 60)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(benchmark_matches(enumerated(spark, values), table, window=4, per_pass=3))
    named = [(i, t) for i, t in items if i is not None]
    assert all((got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute(t, named, 4) for i, t in enumerate(values))


def test_cut(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "short item")], "item_id bigint, text string")
    rows = [(1, "Keep this. A, b c d e-f g H i j! and that, too and more words to stay here."), (2, "a b c d e f g h i j"),
            (3, "clean"), (4, None), (4, "say: Short\nITEM; yes it is")]
    got = {(r.doc_id, r.text) for r in decontaminated(documents(spark, rows), items).collect()}
    assert got == {(1, "Keep this. ! and that, too and more words to stay here."), (3, "clean"), (4, None), (4, "say: ; yes it is")}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = by_id(benchmark_matches(enumerated(spark, ["a b", None]), none))
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in (0, 1)] == [(2, 0, []), (0, 0, [])]
    assert benchmark_matches(enumerated(spark, []), none).count() == 0


def test_automaton_accepts_runs_of_items_only():
    made = Automaton([("x", [b"a", b"b", b"c"]), ("y", [b"b", b"c", b"d"])], 3)
    assert made.scan([b"a", b"b", b"c", b"d"]) == ([(0, 3), (1, 4)], {0, 1})
    assert made.scan([b"a", b"b", b"d"]) == ([], set())
    assert normalised(b"A-b C9\xc3\xa9!") == [b"a", b"b", b"c9\xc3\xa9"]


@pytest.mark.parametrize("shard_words", [400_000, 2])
def test_items_without_id(spark, monkeypatch, tmp_path, shard_words):
    import duckdb

    from tessera.llm import decontaminate, oracles
    from tessera.llm.queries import QUERIES

    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    items = [(None, "n1 n2 n3"), (None, "n4 n5"), (None, None), (7, "n4 n5"), (8, "n6"), (None, "n6")]
    values = ["x n1 N2, n3 y", "n4 n5 n1 n2 n3", "n6 z", "clean n1", None]
    for name, table in ("documents", enumerated(spark, values)), ("benchmark", spark.createDataFrame(items, "item_id bigint, text string")):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(duck.execute(oracles.OP3).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_decontaminate"](spark, str(tmp_path)).collect())
    assert got == want
    assert [r[2:4] for r in got] == [(3, 1), (5, 2), (1, 2), (0, 0), (0, 0)]
    cut = by_id(decontaminated(enumerated(spark, ["a b c d n1 n2 n3 e", *values]), spark.createDataFrame(items, "item_id bigint, text string")))
    assert {i: r["text"] for i, r in cut.items()} == {0: "a b c d  e", 3: " z", 4: "clean n1", 5: None}
