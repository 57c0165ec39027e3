"""Token ids in binary form: bit-plane shuffling with a chunk index.

Ids of all documents, in the order of their ids and each followed by an end id,
are cut into blocks of fixed size.  A block is transposed into bit or byte
planes (plane k holds bit or byte k of every id), planes are compressed with
zstandard one by one, and planes above the highest id of a block are left out.

On disk it is one table of blocks with its chunk index beside the planes: shard,
block number, place of its first id in the shard, number of ids, checksum, and
which documents it holds where.  Shards are ranges of document ids; a shard's
place among all ids follows from the totals of the shards before it.  Blocks are
written and read by Spark tasks, each block by itself.

Defined cases: null and empty texts hold the end id alone; rows that share an
id, or have none, count as rows of their own in the order of their texts; an
empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.rows import keyed, parallelism, with_id

BLOCK = 1 << 16  # ids in a block
REMEMBERED = 1_000_000  # words whose ids a worker remembers
TOGETHER = 32  # new words encoded as one text
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_LETTER = (_CODES >= 97) & (_CODES <= 122)
_WHITE = np.isin(_CODES, list(A.BLANKS))
_STOP = np.isin(_CODES, list(b".,"))
_HASHES = A.Alphabet(seed=101), A.Alphabet(seed=202)
_FILE = ("shard int, block int, first bigint, n_ids int, plane string, crc bigint, planes array<binary>, "
         "docs array<struct<rid: bigint, at: int, n: int, from: bigint>>")


def to_planes(ids: np.ndarray, plane: str = "byte") -> list[bytes]:
    """Compressed planes of a block, the lowest first."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    squeeze = zstandard.ZstdCompressor(level=3)
    rows = ids.view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [squeeze.compress(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range(-(-top // 8))]
    if plane == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :top].T
        return [squeeze.compress(np.packbits(b, bitorder="little").tobytes()) for b in np.ascontiguousarray(bits)]
    raise ValueError("planes are of bits or bytes")


def from_planes(planes: list[bytes], n: int, plane: str = "byte") -> np.ndarray:
    grow = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(grow.decompress(p), np.uint8) for p in planes]
    if plane == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(raw):
            rows[:, k] = p
        return rows.view("<u4").ravel()
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(raw):
        bits[:, k] = np.unpackbits(p, count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class WordIds:
    """Ids of texts by a tokenizers file that lower-cases and treats words between white space apart.

    Each word is encoded once per worker, and found again by a hash of 64 bits,
    a second of which must agree; a word that shares only the first is encoded
    each time.  So that there are fewer words, ASCII is lower-cased beforehand and
    a full stop or comma after a letter is a word of its own, which such a file
    cuts there anyway.  Texts that may hold special tokens are taken as they are.
    A word takes some 50 bytes here; when there are too many, all are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch
        one = lambda text: self.encode([text], add_special_tokens=False)[0].ids
        for whole, parts in (("Ab", ["ab"]), ("ab  c\n\td ", ["ab", "c", "d"]), ("ab. c", ["ab", ".", "c"]), ("ab, c", ["ab", ",", "c"])):
            if one(whole) != [i for p in parts for i in one(p)]:
                raise ValueError(f"{path} does not lower-case and encode words one by one")
        self._clear()

    def _clear(self):
        #: Of the known words in the order of their hash: hash, second hash, number.
        self.hash, self.second, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.start, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1, np.int64), 0

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """The numbers under which the ids of new words stand."""
        found = self.encode([" ".join(fresh[i:i + TOGETHER]) for i in range(0, len(fresh), TOGETHER)], add_special_tokens=False)
        ids = [e.ids for e in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        # Where each id begins in its text, and so the word that it is of.
        begins = np.fromiter((at for e in found for at, _ in e.offsets), np.int64, len(new))
        ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)
        begins += np.repeat(np.r_[0, ends[TOGETHER - 1::TOGETHER]][:len(ids)], sizes)
        lengths = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(fresh))
        if len(new) and new.max() > np.iinfo(self.flat.dtype).max:
            self.flat = self.flat.astype(np.uint32)
        if self.used + len(new) > len(self.flat):
            self.flat = np.r_[self.flat[:self.used], np.zeros(max(len(new), len(self.flat) // 2), self.flat.dtype)]
        self.flat[self.used:self.used + len(new)] = new
        at = len(self.start) - 1 + np.arange(len(fresh))
        self.start = np.r_[self.start, self.used + np.cumsum(lengths)]
        self.used += len(new)
        return at

    def _numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number of each word, after encoding those not known."""
        one, two = (A.word_hashes(buf, start, alphabet) for alphabet in _HASHES)
        distinct, first, which = np.unique(one, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        new = np.flatnonzero(self.hash[np.minimum(place, len(self.hash) - 1)] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(self.hash) and len(self.start) + len(new) > REMEMBERED:
            self._clear()
            return self._numbers(buf, start, end)
        raw = buf.tobytes()
        learned = lambda at: self._learn([raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())])
        if len(new):
            numbers = learned(first[new])
            self.hash = np.insert(self.hash, place[new], distinct[new])
            self.second = np.insert(self.second, place[new], two[first[new]])
            self.number = np.insert(self.number, place[new], numbers)
            place = np.searchsorted(self.hash, distinct)
        out, other = self.number[place][which], np.flatnonzero(self.second[place][which] != two)
        if len(other):
            out[other] = learned(other)
        return out

    def __call__(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after the other, and how many each has, with the end id."""
        if b"<|" not in buf.tobytes():
            buf = _LOWER[buf]
            white = np.r_[_WHITE[buf[1:]], True] if len(buf) else np.zeros(0, bool)
            white[offs[1:][offs[1:] > 0] - 1] = True
            letter = np.r_[False, _LETTER[buf[:-1]]] if len(buf) else white
            stops = np.flatnonzero(_STOP[buf] & letter & white)
            buf, offs = np.insert(buf, stops, np.uint8(32)), offs + np.searchsorted(stops, offs)
        start, stop, first = A.word_bounds(buf, offs, _HASHES[0])
        word = self._numbers(buf, start, stop) if len(start) else np.zeros(0, np.int64)
        length = self.start[word + 1] - self.start[word]
        total = np.r_[0, np.cumsum(length)]
        ids = self.flat[np.repeat(self.start[word] - total[:-1], length) + np.arange(total[-1])].astype(np.uint32)
        ends = total[first[1:]]
        return np.insert(ids, ends, np.uint32(end)), np.diff(np.r_[0, ends]) + 1


def _encode(batches, path, end, block, plane):
    encoder = A.remembered(f"ids {path}", lambda: WordIds(path))
    shard, number, first = None, 0, 0
    held, docs, room = [], [], 0  # ids not written yet, and what they are
    A.hand_back()

    def write(n):
        nonlocal held, docs, room, number, first
        ids = np.concatenate(held)
        now, rest = ids[:n], ids[n:]
        inside, later, at = [], [], 0
        for rid, size, done in docs:
            take = min(size, n - at)
            if take > 0:
                inside.append({"rid": rid, "at": at, "n": take, "from": done})
            if take < size:
                later.append((rid, size - max(take, 0), done + max(take, 0)))
            at += size
        row = {"shard": shard, "block": number, "first": first, "n_ids": n, "plane": plane,
               "crc": zlib.crc32(now.astype("<u4").tobytes()), "planes": to_planes(now, plane), "docs": inside}
        held, docs, room, number, first = [rest], later, room - n, number + 1, first + n
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    for batch in batches:
        shards = batch.column(2).to_numpy()
        if len(shards) and shard not in (None, shards[0]):
            raise ValueError("a task writes one shard")
        for rids, buf, offs in A.pieces([batch], A.PIECE):
            shard = int(shards[0])
            ids, counts = encoder(buf, offs, end)
            held.append(ids)
            docs += zip(rids.tolist(), counts.tolist(), repeat(0))
            room += len(ids)
            while room >= block:
                yield write(block)
    if room:
        yield write(room)
    A.hand_back()


_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("plane", pa.string()),
    ("crc", pa.int64()), ("planes", pa.list_(pa.binary())),
    ("docs", pa.list_(pa.struct([("rid", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("from", pa.int64())])))])


def write_token_planes(rows: DataFrame, path: str, vocabulary: str, end: int = 2, block: int = BLOCK,
                       plane: str = "byte") -> None:
    """Encode (rid, text) in the order of rid and write the blocks under `path`, a place all executors share."""
    placed = rows.select("rid", "text").repartitionByRange(parallelism(rows.sparkSession), "rid")
    placed = placed.sortWithinPartitions("rid").withColumn("shard", F.spark_partition_id())
    placed.mapInArrow(partial(_encode, path=vocabulary, end=end, block=block, plane=plane), _FILE).write.option(
        "compression", "uncompressed").parquet(path)


def _decode(batches, digest):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n_ids"], row["plane"])
            raw = ids.tobytes()
            if zlib.crc32(raw) != row["crc"]:
                raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
            for d in row["docs"]:
                a, b = d["at"], d["at"] + d["n"]
                out.append({"rid": d["rid"], "shard": row["shard"], "place": row["first"] + a, "from": d["from"], "n": d["n"]}
                           | ({"crc": zlib.crc32(raw[4 * a:4 * b])} if digest else {"ids": ids[a:b].tolist()}))
        fields = [("rid", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("from", pa.int64()), ("n", pa.int64())]
        yield pa.RecordBatch.from_pylist(out, pa.schema([*fields, ("crc", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))]))


def read_token_pieces(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(rid, start, from, n, ids) per document and block: `start` counts all ids before the piece in the file,
    `from` those of the same document.  With `digest`, crc of the piece in place of its ids."""
    stored = spark.read.schema(_FILE).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offset = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # one row per shard
    kind = "crc bigint" if digest else "ids array<bigint>"
    pieces = stored.mapInArrow(partial(_decode, digest=digest),
                               f"rid bigint, shard int, place bigint, from bigint, n bigint, {kind}")
    return pieces.join(offset, "shard").select(
        "rid", (F.col("offset") + F.col("place")).alias("start"), "from", "n", kind.split()[0])


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings joined, from theirs and the length of the second (linear over bits)."""
    power = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        power = [_times(power, row) for row in power]  # one zero byte
    while length:
        if length & 1:
            first = _times(power, first)
        power = [_times(power, row) for row in power]
        length >>= 1
    return first ^ second


def _join(batches):
    for batch in batches:
        crc = []
        for pieces in batch.column("pieces").to_pylist():
            total = pieces[0]["crc"]
            for p in pieces[1:]:
                total = crc32_join(total, p["crc"], 4 * p["n"])
            crc.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("start"), batch.column("n_tokens"),
                                          pa.array(crc, pa.int64())], ["rid", "start", "n_tokens", "ids_crc32"])


def token_file_digest(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      end: int = 2, plane: str = "byte") -> DataFrame:
    """Write the file and report (id, start, n_tokens, ids_crc32) as read back from it."""
    rows, plain = keyed(docs, id_col, text_col)
    write_token_planes(rows, path, vocabulary, end, plane=plane)
    pieces = read_token_pieces(docs.sparkSession, path, digest=True)
    docs_back = pieces.groupBy("rid").agg(
        F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("from", "n", "crc"))).alias("pieces"))
    out = docs_back.mapInArrow(_join, "rid bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return with_id(out, rows, plain, id_col)
