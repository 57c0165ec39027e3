"""The pipeline stage by stage on a small folder of tables."""

from collections import Counter

import pytest
from fixtures import documents
from test_decontaminate import words_of

import corpus_pipeline as P

GOOD = ["the river runs past the old mill and turns to the sea near the long bridge where boats wait for the tide number {}",
        "a teacher explains the lesson with care and the class writes every word down before the bell of hour {} rings loud"]
LEAK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, " ".join(GOOD[i % 2].format(f"{i}{w}") for w in "abcdefg"[:2 + i % 5])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, f"you vile scum {i} " * 4 + rows[i][1]) for i in range(30)]
    rows += [(300 + i, rows[i][1].replace("the", f"x{i}") + ". " + LEAK + "! and what follows stays " + "ok " * 30) for i in range(3)]
    rows += [(400, LEAK), (401, None), (402, ""), (403, "word")]
    documents(spark, rows).drop("bucket", "rid").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(200 + i, 1, 1) for i in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.asDict() for r in docs.collect()]
    ids = {k: {r["doc_id"] for r in v} for k, v in kept.items()}
    rated = ids["quality_classifier"]
    assert not rated & set(range(200, 230)) and set(range(60)) <= rated and set(range(300, 303)) <= rated
    single = ids["jaccard_join"]
    assert not single & set(range(100, 105)) and set(range(5)) <= single
    clean = {r["doc_id"]: r for r in kept["benchmark_decontamination"]}
    assert 400 not in clean and set(range(300, 303)) <= set(clean)
    for r in clean.values():
        assert LEAK not in " ".join(words_of(r["text"])) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert "and what follows stays" in clean[300]["text"]
    counts = Counter(r["doc_id"] for r in kept["source_mixing"])
    assert set(counts) <= set(clean) and max(counts.values()) <= 3
    last = P.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in last) == counts
    place = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens


def test_run_and_empty(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
