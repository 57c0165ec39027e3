"""Boundary sets against sorted lists; rearranged texts against a plain-Python version."""

import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import by_id, documents, enumerated, texts
from pyspark.sql import functions as F

from tessera.llm.boundary_set import SPAN, ArrayContainer, BitmapContainer, BoundarySet, RunContainer, container
from tessera.llm.fill_middle import fill_in_middle, restored


@pytest.mark.parametrize("low,kind", [
    (np.arange(0, SPAN, 700), ArrayContainer), (np.arange(0, SPAN, 3), BitmapContainer), (np.arange(9, SPAN), RunContainer),
    (np.array([0]), ArrayContainer), (np.array([SPAN - 1]), ArrayContainer), (np.r_[np.arange(500), np.arange(900, 9000)], RunContainer)])
def test_containers(low, kind):
    got = container(low)
    assert isinstance(got, kind)
    assert [got.select(k) for k in range(len(low))] == low.tolist()


def test_all_kinds_agree():
    rng = np.random.default_rng(0)
    for share in (.001, .1, .5, .99):
        low = np.flatnonzero(rng.random(SPAN) < share)
        for kind in (ArrayContainer, BitmapContainer, RunContainer):
            c = kind(low)
            for k in [0, len(low) - 1, *rng.integers(0, len(low), 50)]:
                assert c.select(int(k)) == low[k]


def test_many_containers():
    rng = np.random.default_rng(1)
    want, parts = [], []
    for high in (0, 1, 4, 9):
        low = np.flatnonzero(rng.random(SPAN) < [.5, 0, .01, 1][high % 4])
        parts.append((high, low))
        want += (high * SPAN + low).tolist()
    s = BoundarySet(parts)
    assert len(s) == len(want)
    for k in [0, len(want) - 1, *rng.integers(0, len(want), 300)]:
        assert s.select(int(k)) == want[k]
    for k in (-1, len(want)):
        with pytest.raises(IndexError):
            s.select(k)
    assert len(BoundarySet([])) == 0


def plainly(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def values():
    rnd = random.Random(5)
    long = ["".join(rnd.choices("abcXYZ é🙂\n.", k=200_000)), "a" * 300_000 + ".", "." * 200_000 + "b", "é" * 100_000, "w " * 90_000]
    seams = ["<", "<<P", "P><S", "x<P>y", "<S>", "a<M>", "<M", "S>" * 40, "<P<S<M" * 20, "\x00a\x00", "a\r\nb"]
    return texts(6) + long + seams + [s * 5 for s in seams if not re.search("<[PSM]>", s * 5)]


def test_rows(spark):
    rows = values()
    out = fill_in_middle(enumerated(spark, rows)).withColumn("back", restored(F.col("form"), F.col("output")))
    got = by_id(out)
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(i, t)
        assert r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(None, "one two three"), (7, "x y"), (7, "x y"), (7, "z"), (None, None)]
    out = fill_in_middle(documents(spark, rows)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted(
        ((i, *plainly(i, t)) for i, t in rows), key=key)
    assert fill_in_middle(enumerated(spark, [])).count() == 0
