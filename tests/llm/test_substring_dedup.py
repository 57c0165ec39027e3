"""Window deduplication against brute force; the filter never loses a repeat."""

import numpy as np
import pytest
from fixtures import by_id, documents, enumerated, texts

from tessera.llm import sketch
from tessera.llm.substring_dedup import drop_repeated_windows


def brute(values, window):
    words = [(t or "").encode().split() for t in values]
    seen = set()
    for w in words:
        hit = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in seen:
                hit[p:p + window] = [True] * window
            seen.add(key)
        yield len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode()


@pytest.mark.parametrize("window,seed", [(3, 1), (5, 2), (20, 3)])
def test_brute_force(spark, window, seed):
    values = texts(seed)
    got = by_id(drop_repeated_windows(enumerated(spark, values), window=window))
    for i, want in enumerate(brute(values, window)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want, (i, values[i])
    assert len(got) == len(values)


def test_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sketch, "MIN_CELLS", 64)
    monkeypatch.setattr(sketch, "MAX_CELLS", 64)
    values = texts(5)
    got = by_id(drop_repeated_windows(enumerated(spark, values), window=4))
    assert all((got[i]["n_removed"], got[i]["kept_text"]) == w[1:] for i, w in enumerate(brute(values, 4)))


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = drop_repeated_windows(documents(spark, [(7, text), (7, text), (None, text), (9, None)])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [
        ("7", 30, 30), ("7", 30, 30), ("9", 0, 0), ("None", 30, 0)]


def test_empty_table(spark):
    assert drop_repeated_windows(enumerated(spark, [])).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3000, 1000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
    whole = sketch.Planes(1 << 16)
    for p in parts:
        whole.add(p)
    merged = sketch.Sketch(1 << 16, [(r, c, a) for r, c, _, a in whole.rows()])
    keys, count = np.unique(np.concatenate(parts), return_counts=True)
    assert merged.repeated(keys[count > 1]).all()
    assert merged.repeated(keys[count == 1]).mean() < 0.1
