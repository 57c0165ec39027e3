"""Quality rules on word statistics and tokeniser fertility.

Public vocabularies cut the words of a text into tokens.  Three measures per
vocabulary and text:

- characters per token, low where the text is not what the vocabulary knows;
- byte-fallback share: tokens that stand for single bytes of a character;
- token entropy in bits, of the text's own token counts, relative to the highest
  entropy that many tokens can have; low for monotonous, high for listed tokens.

Bands of what is usual are taken per language (for a null language, per script)
and length class (doublings of the token count) over all documents: the median,
less and plus `width` times its distance to the quartiles, at least a floor.  A
text below its band of characters per token, above that of byte shares, or
outside that of entropy is rejected.  A length class with fewer than `least_docs`
texts is joined with its neighbours in the same language until there are enough,
measures moved along the usual change per doubling of the length; languages with
fewer texts in all use the classes of all languages, joined the same way.  Bands
are wider for texts with fewer than `least_tokens` tokens, by what a few tokens
change in so short a text; texts without tokens have no verdict.

Base rules: fewer than 10 words, or more than a fifth of the words in repeated
5-word windows.

Defined cases: null and empty texts have no words and fail the base rules; ties
and repeated rows are measured each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import os
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.rows import bounded_batches
from tessera.session import cut_lineage

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
REMEMBERED = 250_000  # words whose tokens a worker remembers, per vocabulary
WIDTH, LEAST_DOCS, LEAST_TOKENS = 6.0, 50, 40
#: Least half-widths of the bands: characters per token, byte share, relative entropy.
FLOORS = (0.1, 0.05, 0.05)
#: How much wider the least half-widths of short texts are: times the root of 1 / tokens for characters per token,
#: times 1 / tokens for the others (two characters in bytes, some repeated tokens), less the same at LEAST_TOKENS.
SHORT = (12.0, 8.0, 2.0)
REPEAT_WINDOW = 5
MEASURES = ("chars_per_token", "byte_share", "entropy")
_ALPHABET = A.Alphabet(seed=31)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Scripts by the first code point of their main blocks.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "southeast"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
           (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))


def script_of(text: str) -> str:
    """The script of most letters."""
    codes = np.array([ord(c) for c in text if c.isalpha()], np.int64)
    if not len(codes):
        return "none"
    starts = np.array([s for s, _ in SCRIPTS])
    names, counts = np.unique([SCRIPTS[i][1] for i in np.searchsorted(starts, codes, "right") - 1], return_counts=True)
    return str(names[np.argmax(counts)])


class Vocabulary:
    """Token ids by word, and which tokens are single bytes; words are cut once."""

    def __init__(self, name: str):
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut = lambda words: model.encode(words, num_threads=1)
            self.single = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.cut = lambda words: [model.encode_ordinary(" " + w) for w in words]
            self.single = np.zeros(max(ranks.values()) + 1, bool)
            self.single[[i for b, i in ranks.items() if len(b) == 1 and b[0] >= 128]] = True
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1, np.int64), 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """Indices of words, after cutting those not known yet."""
        some = set(words)
        fresh = [w for w in some if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self._clear()
            fresh = list(some)
        if fresh:
            ids = self.cut([w.decode("utf-8", "replace") for w in fresh])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            new = np.fromiter((x for i in ids for x in i), np.uint32, int(lengths.sum()))
            if self.used + len(new) > len(self.flat):
                self.flat = np.r_[self.flat[:self.used], np.zeros(max(len(new), len(self.flat)), np.uint32)]
            self.flat[self.used:self.used + len(new)] = new
            self.start = np.r_[self.start[:len(self.known) + 1], self.used + np.cumsum(lengths)]
            self.used += len(new)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def measure(self, words: list[bytes], first: np.ndarray, chars: np.ndarray) -> list[np.ndarray]:
        """The tokens of some texts, given as their words one after the other, and the three measures."""
        word = self.number(words)
        length = self.start[word + 1] - self.start[word]
        total = np.r_[0, np.cumsum(length)]
        ids = self.flat[np.repeat(self.start[word] - total[:-1], length) + np.arange(total[-1])]
        bounds = total[first]
        n = np.diff(bounds)
        safe = np.maximum(n, 1)
        text = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        singles = np.bincount(text.astype(np.int64), self.single[ids], len(n)) if len(ids) else np.zeros(len(n))
        key = np.sort((text << A.U(32)) | ids)
        runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        count = np.diff(np.r_[runs, len(key)]).astype(float)
        inner = np.bincount((key[runs] >> A.U(32)).astype(np.int64), count * np.log2(np.maximum(count, 1)), len(n))
        entropy = np.log2(safe) - inner / safe
        return [n, chars / safe, singles / safe, entropy / np.maximum(np.log2(safe), 1)]


def base_counts(buf: np.ndarray, offs: np.ndarray) -> tuple:
    """(starts, ends, first, columns): words of some texts and their plain statistics."""
    start, end, first = A.word_bounds(buf, offs, _ALPHABET)
    n = np.diff(first)
    lead = np.r_[0, np.cumsum(((buf & 0xC0) != 0x80) & _ALPHABET.word[buf])]
    chars = lead[offs[1:]] - lead[offs[:-1]]
    marks = np.r_[0, np.cumsum(_SYMBOLS[buf])]
    symbols = marks[offs[1:]] - marks[offs[:-1]]
    at = A.whole_windows(first, REPEAT_WINDOW)
    window = A.rolling(A.word_hashes(buf, start, _ALPHABET), REPEAT_WINDOW)[at] if len(at) else np.zeros(0, A.U)
    text = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((window, text))
    same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = at[order[np.r_[same, False] | np.r_[False, same]]] if len(at) else at
    hit = np.r_[0, np.cumsum(A.covered(len(start), many, many + REPEAT_WINDOW))]
    repeat = hit[first[1:]] - hit[first[:-1]]
    lines = []
    raw = buf.tobytes()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        seen, twice = set(), 0
        for line in raw[a:b].split(b"\n"):
            if line in seen:
                twice += 1
            elif line.strip(A.BLANKS):
                seen.add(line)
        lines.append(twice)
    return start, end, first, [n, chars, symbols, np.array(lines, np.int64), repeat]


def _measure(batches, names):
    tools = [A.remembered(f"vocabulary {n}", partial(Vocabulary, n)) for n in names]
    kinds = [("rid_", None), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    for batch in batches:
        at = 0
        langs = batch.column(2)
        for ids, buf, offs in A.text_pieces([batch]):
            start, end, first, base = base_counts(buf, offs)
            words = buf.tobytes().split() if len(ids) == 1 else [
                w for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for w in buf[a:b].tobytes().split()]
            out = [batch.column(0).slice(at, len(ids)), *[pa.array(c, pa.int64()) for c in base]]
            for tool in tools:
                n, *measures = tool.measure(words, first, base[1])
                out += [pa.array(n, pa.int64()), *[pa.array(m, pa.float64()) for m in measures]]
            group = [x if x is not None else f"script:{script_of(buf[offs[i]:offs[i + 1]].tobytes().decode('utf-8', 'replace'))}"
                     for i, x in enumerate(langs.slice(at, len(ids)).to_pylist())]
            out.append(pa.array(group, pa.string()))
            at += len(ids)
            yield pa.RecordBatch.from_arrays(out, [k for k, _ in kinds] + [
                f"{c}_{v}" for v in range(len(tools)) for c in ("n_tokens", *MEASURES)] + ["band_group"])


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, vocabularies=VOCABULARIES) -> DataFrame:
    """(rid_, base counts, per vocabulary v: n_tokens_v and the measures, band_group)."""
    bounded_batches(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("rid_"), F.col(text_col).alias("text"), lang.alias("lang_"))
    kind = rows.schema["rid_"].dataType.simpleString()
    own = ", ".join(f"n_tokens_{v} bigint, " + ", ".join(f"{m}_{v} double" for m in MEASURES) for v in range(len(vocabularies)))
    return rows.mapInArrow(partial(_measure, names=vocabularies),
                           f"rid_ {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                           f"n_repeat_words bigint, {own}, band_group string")


def _size_class():
    return F.floor(F.log2(F.greatest("n_tokens_0", F.lit(1)))).cast("int")


def length_runs(counts: list[tuple[int, int]], least: int) -> list[tuple[int, list[int], list[int]]]:
    """(key, classes judged, classes pooled) of one language, from its (length class, texts) pairs.

    A class with `least` texts stands alone; smaller ones that follow each other are joined until they have as
    many.  What is left over is pooled with the nearest of these.  Nothing where all texts are fewer.
    """
    full, rest, held, n = [], [], [], 0
    for size, texts in sorted(counts):
        if texts >= least:
            if held:
                rest.append(held)
            full.append([size])
            held, n = [], 0
            continue
        held, n = [*held, size], n + texts
        if n >= least:
            full.append(held)
            held, n = [], 0
    if held:
        rest.append(held)
    if not full:
        return []
    near = [min(full, key=lambda f: min(abs(a - b) for a in f for b in r)) for r in rest]
    return [(f[0], f, f) for f in full] + [(r[0], r, sorted(r + f)) for r, f in zip(rest, near)]


def _runs(table, least, whole):
    counts = list(zip(table.column("size_class").to_pylist(), table.column("n").to_pylist()))
    runs = length_runs(counts, least)
    if whole and not runs:
        every = [s for s, _ in counts]
        runs = [(min(every), every, every)]
    group = table.column("scope")[0].as_py()
    return pa.Table.from_pylist([{"scope": group, "run": k, "judged": j, "pooled": p} for k, j, p in runs], _RUNS)


_RUNS = pa.schema([("scope", pa.string()), ("run", pa.int32()), ("judged", pa.list_(pa.int32())), ("pooled", pa.list_(pa.int32()))])


def bands(found: DataFrame, vocabularies: int, width: float, least_docs: int) -> DataFrame:
    """(band_group, size_class, slope, lo, mid and hi of each measure): a row per language and length class.

    Where classes are pooled, lo, mid and hi are of measures less their slope times the logarithm of the length.
    """
    some = found.where("n_tokens_0 > 0").withColumn("size_class", _size_class())
    columns = [f"{m}_{v}" for v in range(vocabularies) for m in MEASURES]
    clean, spots = ~base_failed(), F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])
    classes = cut_lineage(some.groupBy("band_group", "size_class").agg(
        F.count_if(clean).alias("n"), *[F.percentile_approx(F.when(clean, F.col(c)), spots, 2000).alias(c) for c in columns]))
    slopes = _slopes(classes.where(F.col("n") >= least_docs), columns)
    runs = "scope string, run int, judged array<int>, pooled array<int>"
    own = classes.select(F.col("band_group").alias("scope"), "size_class", "n").groupBy("scope").applyInArrow(
        lambda table: _runs(table, least_docs, False), runs)
    # The classes of all languages together have the null scope.
    common = classes.groupBy("size_class").agg(F.sum("n").alias("n")).withColumn("scope", F.lit(None).cast("string")).groupBy(
        "scope").applyInArrow(lambda table: _runs(table, least_docs, True), runs)
    keys = ["band_group", "size_class"]
    owned = own.select(F.col("scope").alias("band_group"), F.explode("judged").alias("size_class"), "scope", "run", "pooled")
    shared = common.select(F.explode("judged").alias("size_class"), "scope", "run", "pooled")
    lone = classes.select(*keys).join(owned, keys, "left_anti").join(shared, "size_class").select(
        *keys, "scope", "run", "pooled")
    # One row per language and class: whose run judges it.
    taken = cut_lineage(owned.unionByName(lone))
    alone = F.col("scope").isNotNull() & (F.size("pooled") == 1)
    pools = taken.where(~alone).select("scope", "run", F.explode("pooled").alias("size_class")).distinct()
    members = classes.select(*keys).join(pools.where("scope IS NOT NULL").withColumnRenamed("scope", "band_group"), keys).select(
        *keys, F.col("band_group").alias("scope"), "run").unionByName(
        classes.select(*keys).join(pools.where("scope IS NULL"), "size_class").select(*keys, "scope", "run"))
    # A text is in at most three pools of its language and three of all languages.
    moved = [(F.col(c) - F.lit(slopes[c]) * _log_size()).alias(c) for c in columns]
    pooled = some.where(clean).select(*keys, *moved).join(members, keys).groupBy("scope", "run").agg(
        *[F.percentile_approx(c, spots, 2000).alias(c) for c in columns])
    out = taken.where(alone).select(*keys).join(classes, keys).select(*keys, F.lit(False).alias("moved"), *columns).unionByName(
        taken.where(~alone).withColumnRenamed("scope", "of").withColumnRenamed("run", "at").join(
            pooled, F.col("of").eqNullSafe(F.col("scope")) & (F.col("at") == F.col("run"))).select(
            *keys, F.lit(True).alias("moved"), *columns))
    for c in columns:
        floor = F.lit(FLOORS[MEASURES.index(c.rsplit("_", 1)[0])])
        lo, mid, hi = (F.element_at(c, i) for i in (1, 2, 3))
        out = out.withColumn(f"lo_{c}", mid - F.greatest(floor, F.lit(width) * (mid - lo))).withColumn(
            f"hi_{c}", mid + F.greatest(floor, F.lit(width) * (hi - mid))).withColumn(f"mid_{c}", mid).withColumn(
            f"slope_{c}", F.when(F.col("moved"), F.lit(slopes[c])).otherwise(F.lit(0.0)))
    return out.select(*keys, *[f"{e}_{c}" for c in columns for e in ("lo", "mid", "hi", "slope")])


def _log_size():
    return F.log2(F.greatest("n_tokens_0", F.lit(1)))


def _least_half(column: str, least_tokens: int):
    """The least half-width of a band for a text of its length."""
    measure, v = column.rsplit("_", 1)
    i = MEASURES.index(measure)
    power = 0.5 if measure == "chars_per_token" else 1.0
    n = F.least(F.greatest(f"n_tokens_{v}", F.lit(1)), F.lit(max(least_tokens, 1)))
    return F.lit(FLOORS[i]) + F.lit(SHORT[i]) * (F.pow(n, F.lit(-power)) - F.lit(max(least_tokens, 1) ** -power))


def _slopes(classes: DataFrame, columns: list[str]) -> dict[str, float]:
    """The usual change of each measure per doubling: medians over neighbouring classes of the same language."""
    order = Window.partitionBy("band_group").orderBy("size_class")
    steps = classes.select(
        F.least("n", F.lead("n").over(order)).alias("w"),
        *[((F.element_at(F.lead(c).over(order), 2) - F.element_at(c, 2))
           / (F.lead("size_class").over(order) - F.col("size_class"))).alias(c) for c in columns]).where("w IS NOT NULL")
    row = steps.agg(*[F.expr(f"percentile({c}, 0.5D, w)").alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fertility_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                    vocabularies=VOCABULARIES, width: float = WIDTH, least_docs: int = LEAST_DOCS,
                    least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(id, base counts, base_failed, kept, rejected_by, measures): one row per document."""
    found = cut_lineage(measured(docs, id_col, text_col, lang_col, vocabularies))
    limits = cut_lineage(bands(found, len(vocabularies), width, least_docs))
    columns = [f"{m}_{v}" for v in range(len(vocabularies)) for m in MEASURES]
    # A few rows per language: Catalyst broadcasts them.
    joined = found.withColumn("size_class", _size_class()).join(limits, ["band_group", "size_class"], "left")
    place = {c: F.col(c) - F.col(f"slope_{c}") * _log_size() for c in columns}
    judged = F.col("n_tokens_0") > 0
    half = {c: _least_half(c, least_tokens) for c in columns}
    low = [F.when(place[c] < F.least(f"lo_{c}", F.col(f"mid_{c}") - half[c]), F.lit(c)) for c in columns if not c.startswith("byte_share")]
    high = [F.when(place[c] > F.greatest(f"hi_{c}", F.col(f"mid_{c}") + half[c]), F.lit(c)) for c in columns if not c.startswith("chars_per_token")]
    outside = F.array_compact(F.array(*low, *high))
    rejected = F.when(judged, outside).otherwise(F.array().cast("array<string>"))
    return joined.select(
        F.col("rid_").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size(rejected) == 0)).alias("kept"),
        rejected.alias("rejected_by"), "band_group", *[c for v in range(len(vocabularies)) for c in (
            f"n_tokens_{v}", *[f"{m}_{v}" for m in MEASURES])])
