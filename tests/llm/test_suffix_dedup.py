"""Byte deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import by_id, documents, enumerated, texts

from tessera.llm.suffix_dedup import drop_repeated_bytes, multikey_sort


def brute(blobs, length):
    seen = Counter(b[p:p + length] for b in blobs for p in range(len(b) - length + 1))
    for b in blobs:
        hit = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                hit[p:p + length] = [True] * length
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        yield len(b), sum(hit), runs, bytes(c for c, h in zip(b, hit) if not h)


@pytest.mark.parametrize("length,seed", [(40, 1), (64, 2), (151, 3), (400, 4)])
def test_brute_force(spark, length, seed):
    values = texts(seed)
    got = by_id(drop_repeated_bytes(enumerated(spark, values), length=length))
    want = list(brute([(t or "").encode() for t in values], length))
    assert len(got) == len(values)
    for i, (n, removed, runs, kept) in enumerate(want):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, kept), (i, values[i])


@pytest.mark.parametrize("size", [399, 400])
def test_query_judges_passages_by_bytes_not_words(spark, tmp_path, size):
    """A passage of 56 words goes from every document, first one included, if it has 400 bytes; n_bytes is the text's own length."""
    from tessera.llm.queries import QUERIES

    rng = np.random.default_rng(size)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))

    passage = " " + words(56)  # 392 bytes
    passage += "z" * (size - 1 - len(passage)) + " "
    assert len(passage) == size and len(passage.split()) == 56
    values = [words(40) + "A" + passage + "B" + words(30), words(80) + "ß" + passage + "ü" + words(5), words(300)]
    rest = [t.replace(passage, "") if size == 400 else t for t in values]
    documents(spark, list(enumerate(values))).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op7_suffix_dedup"](spark, str(tmp_path)))
    gone = [size == 400, size == 400, False]
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(3)] == [
        (len(t.encode()), 400 * g, int(g), hashlib.sha256(r.encode()).hexdigest()) for t, r, g in zip(values, rest, gone)]


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(90)) + "".join(chr(65 + i * i % 26) for i in range(60))
    rows = drop_repeated_bytes(documents(spark, [(1, text), (1, text), (None, "q" + text), (2, "z")]), length=64).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in rows) == [
        ("1", 150, 150), ("1", 150, 150), ("2", 1, 0), ("None", 151, 150)]


def test_empty_table(spark):
    assert drop_repeated_bytes(enumerated(spark, []), length=64).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64) << np.uint64(17)
    order, shared = multikey_sort(rows)
    strings = [b"".join(int(x).to_bytes(8, "big") for x in rows[i]) for i in order]
    assert strings == sorted(strings)
    for i in range(1, 500):
        common = next((k for k in range(32) if strings[i][k] != strings[i - 1][k]), 32)
        assert shared[i] == common
