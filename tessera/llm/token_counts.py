"""Token counts by heap-and-linked-list byte-pair merging; no token ids are made.

A pretoken starts as a linked list of symbols.  A heap holds its adjacent pairs
by merge rank and place; the lowest is popped, merged, and the two new pairs
enter the heap, until no pair has a rank.  A pretoken counts as many tokens as
it had symbols, minus the merges.

The vocabulary file says what comes before the merges: normalisers, the split
pattern, byte symbols, the word-end suffix, and added tokens, which count one
wherever their strings occur.  Kinds of steps that a file may hold and this
module does not know raise an error.

Defined cases: null and empty texts have no tokens; repeated rows and ids are
counted each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import remembered
from tessera.llm.rows import bounded_batches

#: Words and pretokens a worker remembers; beyond it starts afresh.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """The merges of a vocabulary on symbol numbers."""

    def __init__(self, model: dict):
        self.number: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        for key in ("dropout", "unk_token", "continuing_subword_prefix"):
            if model.get(key):
                raise ValueError(f"{key} is not supported")
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.number[a], self.number[b]] = rank, self.number[a + b]

    def count(self, symbols: list[int]) -> int:
        n = left = len(symbols)
        if n < 2:
            return n
        rank = self.rank
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            known = rank.get((symbols[i], symbols[i + 1]))
            if known:
                heap.append((known[0], i, known[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # one of the two has merged since
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                known = rank.get((made, symbols[k]))
                if known:
                    heapq.heappush(heap, (known[0], i, known[1], made, symbols[k]))
            h = before[i]
            if h >= 0:
                known = rank.get((symbols[h], made))
                if known:
                    heapq.heappush(heap, (known[0], h, known[1], symbols[h], made))
        return left


def _normaliser(spec: dict | None):
    if spec is None:
        return lambda s: s
    kind = spec["type"]
    if kind == "Sequence":
        steps = [_normaliser(x) for x in spec["normalizers"]]

        def chain(s):
            for step in steps:
                s = step(s)
            return s

        return chain
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return partial(unicodedata.normalize, kind)
    if kind == "Lowercase":  # character by character: no final sigma
        return lambda s: s.lower() if "Σ" not in s else s.replace("Σ", "σ").lower()
    if kind == "Replace" and "Regex" in spec["pattern"]:
        found, put = _pattern(spec["pattern"]["Regex"]), spec["content"]
        return lambda s: found.sub(lambda _: put, s)
    raise ValueError(f"normaliser {kind} is not supported")


def _pattern(text: str):
    """White space in the sense of the Unicode property."""
    return regex.compile(text.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))


def _splitter(spec: dict):
    steps = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    split, level = steps[0], steps[-1]
    if len(steps) != 2 or split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" \
            or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
        raise ValueError("this pretokeniser is not supported")
    return _pattern(split["pattern"]["Regex"]).findall


class Counter(dict):
    """Token counts by word (bytes without white space), worked out when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Merger(spec["model"])
        self.normal, self.split = _normaliser(spec["normalizer"]), _splitter(spec["pre_tokenizer"])
        table = byte_symbols()
        self.inner = [self.merger.number.get(c) for c in table]
        self.final = [self.merger.number.get(c + self.merger.suffix) for c in table]
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with rules of their own are not supported")
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n, text = 0, word.decode("utf-8", "replace")
        parts = [text]
        if self.added:
            parts = self.added.split(text)
            n = len(parts) - 1
        for part in parts:
            for piece in self.split(self.normal(part)):
                known = self.pieces.get(piece)
                if known is None:
                    raw = piece.encode()
                    symbols = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
                    known = self.merger.count([s for s in symbols if s is not None])
                    if len(self.pieces) >= REMEMBERED:
                        self.pieces.clear()
                    self.pieces[piece] = known
                n += known
        self[word] = n
        return n


def _count(batches, path):
    counts = remembered(f"counts {path}", lambda: Counter(path))
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        n = np.fromiter((sum(map(counts.__getitem__, (t.as_py() or b"").split())) for t in texts), np.int64, len(texts))
        size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n)], ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) by the vocabulary file at `path`, which every executor has."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_count, path=path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
