"""Token counts against the library, and the token file round trip."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import by_id, documents, enumerated, texts
from tokenizers import Tokenizer

from tessera.llm import token_planes
from tessera.llm.rows import keyed
from tessera.llm.token_counts import Counter, token_counts
from tessera.llm.token_planes import (
    crc32_join, from_planes, read_token_pieces, to_planes, token_file_digest, write_token_planes)

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["It's I'LL we'd O'RE", "<|startoftext|>hi<|endoftext|><|endoftext|>", "<|startoftext", "ΑΣ Σ ὈΔΥΣΣΕΎΣ", "İstanbul ǅ ﬁ",
           "é ́x", "a b c　d\x1ce\x85f", "123 ½ ² ٣ 一二三", "🙂👍🏽 e⃝", "\x00\x01", "ab​cd﻿", "____--''''s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts(spark, library):
    rnd = random.Random(3)
    pool = [chr(c) for c in [*range(32, 127), *range(0xa0, 0x250), *range(0x370, 0x400), 0x301, 0x2028, 0x3000, 0x1f600]]
    values = texts(1) + AWKWARD + ["".join(rnd.choices(pool, k=rnd.randint(1, 60))) for _ in range(400)]
    got = by_id(token_counts(enumerated(spark, values), PATH, limit=50))
    for i, t in enumerate(values):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 50), t


def test_every_character(library):
    counts = Counter(PATH)
    known = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xd800 <= ord(c) < 0xe000 and not c.isspace()
             and __import__("unicodedata").category(c) not in ("Cn", "Co")][::7]
    bad = [c for c in known if counts[f"a{c}B".encode()] != len(library.encode(f"a{c}B", add_special_tokens=False).ids)]
    assert not bad, (len(bad), [hex(ord(c)) for c in bad[:20]])


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes(plane):
    rng = np.random.default_rng(0)
    for top in (1, 2, 255, 256, 49_408, 2 ** 32 - 1):
        ids = rng.integers(0, top, 1000).astype(np.uint32)
        assert (from_planes(to_planes(ids, plane), 1000, plane) == ids).all()
    assert len(from_planes(to_planes(np.zeros(0, np.uint32), plane), 0, plane)) == 0


def test_crc_join():
    a, b = b"some bytes", b"more of them" * 9
    assert crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_round_trip(spark, library, tmp_path, plane):
    values = texts(2) + AWKWARD
    rows, _ = keyed(enumerated(spark, values), "doc_id", "text")
    write_token_planes(rows, str(tmp_path / "f"), PATH, end=2, block=64, plane=plane)
    back = {}
    for r in read_token_pieces(spark, str(tmp_path / "f")).collect():
        back.setdefault(r.rid, []).append((r["from"], r.start, r.ids))
    start = 0
    for i, t in enumerate(values):
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(back[i])
        assert [x for p in pieces for x in p[2]] == want, t
        assert pieces[0][1] == start
        start += len(want)


def test_digest(spark, library, tmp_path):
    values = texts(4)
    got = by_id(token_file_digest(enumerated(spark, values), str(tmp_path / "g"), PATH))
    start = 0
    for i, t in enumerate(values):
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_words_that_share_a_hash(library, monkeypatch):
    """Few values of the first hash: only the second tells words apart."""
    whole = token_planes.A.word_hashes

    def poor(buf, start, alphabet):
        h = whole(buf, start, alphabet)
        return h % 7 if alphabet is token_planes._HASHES[0] else h

    monkeypatch.setattr(token_planes.A, "word_hashes", poor)
    monkeypatch.setattr(token_planes, "REMEMBERED", 50)
    encoder = token_planes.WordIds(PATH)
    for t in [*texts(7), *AWKWARD] * 2:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids, counts = encoder(raw, np.array([0, len(raw)]), 2)
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids + [2] and counts.tolist() == [len(ids)]


def test_repeated_ids_and_empty(spark, tmp_path):
    rows = token_file_digest(documents(spark, [(1, "b"), (1, "a"), (None, "c")]), str(tmp_path / "h"), PATH).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens) for r in rows) == [("1", 2, 2), ("1", 4, 2), ("None", 0, 2)]
    assert token_file_digest(enumerated(spark, []), str(tmp_path / "i"), PATH).count() == 0
    assert token_counts(enumerated(spark, []), PATH).count() == 0
