"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items are built into one automaton that
accepts every run of words of any item; runs never cross from one item to the
next.  Training words stream through it: each step keeps the longest run that
ends here and is also in an item.  Where that run is at least a window long (a
shorter item is one window as a whole), its words are hit, and the state tells
which items hold the window.

Items are split into shards of bounded size by a hash of their text; each shard
has an automaton of its own, made in one task and broadcast, at most
`SHARD_WORDS` words each, and the documents stream through a few shards per pass.

Defined cases: null and empty documents and items have no words; items that share
an id count as one, and so do items without an id, whose name is null; rows of
documents that share an id, or have none, count as rows of their own; with no
items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import Alphabet, trimmed, word_bounds
from tessera.llm.rows import cut_lineage, keyed, numbered, spare, unique, with_id

SHARD_WORDS = 400_000  # words of items in one automaton, about 250 MB in a task
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORDS = Alphabet(bytes(c for c in range(256) if _FOLD[c] == 32))


def normalised(text: bytes) -> list[bytes]:
    """Words of lower-cased letters and digits and of everything outside ASCII."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = []
        for _, words in items:
            last, seen = 0, []
            for w in words:
                c = self.code.setdefault(w, len(self.code))
                last = self._extend(last, c)
                seen.append(c)
            coded.append(seen)
        self._owners(coded)

    @classmethod
    def from_state(cls, state: dict) -> Automaton:
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.next) - 1

    def _split(self, state: int, target: int, c: int) -> int:
        """The state of the run that `c` makes after `state`'s longest, split off `target` if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return self._split(last, known, c)
        state, fresh = last, self._state(self.length[last] + 1, 0, {})
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self._split(state, self.next[state][c], c)
        return fresh

    def _owners(self, coded: list[list[int]]) -> None:
        """For the state of each window, the items that hold it; whole short items under their own state."""
        self.holders: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, seen in enumerate(coded):
            if not seen:
                continue
            state, long = 0, len(seen) >= self.window
            for i, c in enumerate(seen):
                state = self.next[state][c]
                if long and i + 1 >= self.window:
                    owner = self._window_state(state)
                    held = self.holders.setdefault(owner, [])
                    if not held or held[-1] != item:
                        held.append(item)
            if not long:
                self.short.setdefault(state, []).append((len(seen), item))
        # The nearest whole short item that ends where a state ends: itself or along its links.
        self.nearest = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words, in order and possibly overlapping, and the items whose windows occur."""
        code, moves, link, length = self.code.get, self.next, self.link, self.length
        window, nearest, spans, items = self.window, self.nearest, [], set()
        state = matched = 0
        for i, w in enumerate(words):
            c = code(w)
            if c is None:
                state = matched = 0
                continue
            to = moves[state].get(c)
            if to is None:
                state = link[state]
                while state >= 0:
                    to = moves[state].get(c)
                    if to is not None:
                        break
                    state = link[state]
                else:
                    state = matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched >= window:
                spans.append((i + 1 - matched, i + 1))
                items.update(self.holders.get(self._window_state(state), ()))
            short = nearest[state]
            while short > 0:
                for n, item in self.short[short]:
                    if n <= matched:
                        spans.append((i + 1 - n, i + 1))
                        items.add(item)
                short = nearest[link[short]]
        return spans, items


def _pack_items(batches):
    for batch in batches:
        held: dict[int, list] = {}
        for shard, name, text in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(shard, []).append((name, text))
        yield pa.RecordBatch.from_pylist([{"shard": s, "rows": pickle.dumps(r)} for s, r in held.items()],
                                         pa.schema([("shard", pa.int32()), ("rows", pa.binary())]))


def _null_last(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def _make(table, window):
    rows = sorted(((n, t) for b in table.column("rows").to_pylist() for n, t in pickle.loads(b)),
                  key=lambda r: (_null_last(r[0]), r[1]))
    made = Automaton([(n, normalised((t or "").encode())) for n, t in rows], window)
    return pa.table({"automaton": pa.array([pickle.dumps(vars(made), 5)], pa.binary())})


def automata(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(automaton) one row per shard of items."""
    rows = items.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text")).where(
        "text IS NOT NULL")
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-words // (3 * SHARD_WORDS)))
    placed = rows.select(F.pmod(F.xxhash64("name", "text"), F.lit(shards)).cast("int").alias("shard"), "name", "text")
    packed = placed.mapInArrow(_pack_items, "shard int, rows binary")
    return packed.groupBy("shard").applyInArrow(lambda table: _make(table, window), "automaton binary")


@trimmed
def _scan(batches, shared):
    machines = [Automaton.from_state(pickle.loads(b)) for b in shared.value]
    for batch in batches:
        out = []
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.large_binary())):
            words = normalised(text.as_py() or b"")
            spans, items = [], set()
            for machine in machines:
                some, own = machine.scan(words)
                spans += some
                items.update(machine.names[i] for i in own)
            out.append({"rid": rid, "n_words": len(words), "spans": merged(spans), "items": sorted(items, key=_null_last)})
        yield pa.RecordBatch.from_pylist(out, _FOUND)


_FOUND = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]


_JOINED = "rid bigint, n_words bigint, items array<string>, spans array<struct<from: bigint, to: bigint>>"


@trimmed
def _join_passes(batches):
    for batch in batches:
        out = [{"rid": r["rid"], "n_words": r["n_words"], "items": sorted(set(r["items"]), key=_null_last),
                "spans": merged([(s["from"], s["to"]) for s in r["spans"]])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, _FOUND)


def _matches(rows: DataFrame, items: DataFrame, item_col: str, item_text: str, window: int, per_pass: int) -> DataFrame:
    spark = rows.sparkSession
    built = cut_lineage(automata(items, item_col, item_text, window).withColumn("n", F.monotonically_increasing_id()))
    shards = sorted(r.n for r in built.select("n").collect())
    passes = []
    for i in range(0, max(1, len(shards)), per_pass):
        machines = [bytes(r.automaton) for r in built.where(F.col("n").isin(shards[i:i + per_pass])).collect()]
        shared = spark.sparkContext.broadcast(machines)
        passes.append(rows.select("rid", "text").mapInArrow(partial(_scan, shared=shared), _JOINED))
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    return every.groupBy("rid").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_join_passes, _JOINED)


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", window: int = 10,
                      per_pass: int = 2) -> DataFrame:
    """(id, n_words, n_hit, items, spans): words of documents inside windows of test items.

    spans [from, to) count words; items are ids as strings, sorted, and a null last
    for items without an id.  `per_pass` automata are held by a task at a time.
    """
    rows, plain = keyed(docs, id_col, text_col)
    found = _matches(rows, items, item_col, item_text, window, per_pass)
    return with_id(found.select("rid", "n_words", _n_hit().alias("n_hit"), "items", "spans"), rows, plain, id_col)


@trimmed
def _without(batches, text_at, names):
    """Cut the spans in the last column out of the text in column `text_at`."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(text_at).cast(pa.large_binary()), batch.column(len(names)).to_pylist()):
            text = text.as_py()
            if spans:
                raw = np.frombuffer(text, np.uint8)
                start, end, _ = word_bounds(raw, np.array([0, len(raw)]), _WORDS)
                keep, at = [], 0
                for s in spans:
                    keep.append(text[at:start[s["from"]]])
                    at = int(end[s["to"] - 1])
                text = b"".join([*keep, text[at:]])
            out.append(text)
        cut = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([cut if i == text_at else batch.column(i) for i in range(len(names))], names)


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", window: int = 10, max_share: float = 0.5,
                   per_pass: int = 2) -> DataFrame:
    """The rows of `docs`, all columns, without the spans of their texts that tests hold.

    A span is at least `window` words, or a whole shorter item; what stands around
    it stays as it is.  Texts hit over `max_share` of their words go altogether.
    """
    key = id_col
    names = docs.columns
    if not unique(docs, id_col):
        key = spare("_row", names)
        docs = numbered(docs, id_col, text_col, key)
    rows = docs.select(F.col(key).cast("bigint").alias("rid"), F.col(text_col).alias("text"))
    rid, cuts, over = (spare(c, docs.columns) for c in ("_rid", "_spans", "_over"))
    found = cut_lineage(_matches(rows, items, item_col, item_text, window, per_pass).where(F.size("spans") > 0).select(
        F.col("rid").alias(rid), F.col("spans").alias(cuts),
        (_n_hit() > F.lit(max_share) * F.col("n_words")).alias(over)))
    joined = docs.join(found, F.col(key) == F.col(rid), "left").where(F.col(over).isNull() | ~F.col(over))
    schema = docs.select(*names).schema
    return joined.select(*names, cuts).mapInArrow(partial(_without, text_at=names.index(text_col), names=names), schema)
