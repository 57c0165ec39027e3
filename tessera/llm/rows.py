"""Row ids, sizing, and folds over sorted partitions, shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, parallelism, shared_folder


#: What Spark gives for the batch limit where a session does not say: 64 MB.
NOT_SAID = "67108864b"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Have Arrow batches bounded by bytes, not only by rows, unless the session says how."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == NOT_SAID:
        spark.conf.set(name, size)


def unique(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers, all different, and never null."""
    ids = docs.select(F.col(id_col).alias("rid"))
    return dict(ids.dtypes)["rid"] in ("bigint", "int", "smallint", "tinyint") and ids.groupBy("rid").count().where(
        "rid IS NULL OR count > 1").isEmpty()


def numbered(docs: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """Add `out`: a number of its own for each row, ascending in the id (null first), then in a hash of the text."""
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    placed = docs.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order, F.col(text_col))
    return cut_lineage(placed.withColumn(out, F.monotonically_increasing_id()))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid long, text) and whether rid is the id itself.

    Ids that are whole numbers, unique and not null are used as they are.
    Otherwise rid numbers the rows in the order of id and text hash, so that
    repeated and null ids still are rows of their own.
    """
    bounded_batches(docs.sparkSession)
    if unique(docs, id_col):
        return docs.select(F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).alias("text")), True
    return numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text", "rid"), False


def with_id(result: DataFrame, rows: DataFrame, plain: bool, id_col: str) -> DataFrame:
    """Put the caller's id back in place of rid."""
    if plain:
        return result.withColumnRenamed("rid", id_col)
    known = rows.select(F.col("rid"), F.col("_id").alias(id_col))
    rest = [c for c in result.columns if c != "rid"]
    return result.join(known, "rid").select(id_col, *rest)


def spare(name: str, taken: list[str]) -> str:
    """The name, or one like it that is no column yet."""
    known = {c.lower() for c in taken}
    while name in known:
        name = "_" + name
    return name


def temporary(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def tasks_for(spark: SparkSession, parts: int | None = None) -> int:
    """About two tasks per core, or one for 32 partitions where there are very many."""
    parts = parallelism(spark) if parts is None else parts
    return max(2 * spark.sparkContext.defaultParallelism, -(-parts // 32))


def gathered(docs: DataFrame) -> DataFrame:
    """The same rows in a few tasks per core, for tasks that carry a state of fixed size."""
    parts = docs.rdd.getNumPartitions()
    return docs.coalesce(max(1, min(parts, tasks_for(docs.sparkSession, parts))))


def cut_small(df: DataFrame, rows: int) -> DataFrame:
    """`cut_lineage` of a table of few columns and about `rows` rows, half a million to a file."""
    return cut_lineage(df.repartition(max(1, rows // 500_000)))


def few_files(df: DataFrame) -> DataFrame:
    """The same rows in a few tasks per core, to be written as so many files."""
    return df.coalesce(tasks_for(df.sparkSession))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return sizes(docs, text_col)[1]


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return n, size or 0


def prime_from(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def buckets_for(spark: SparkSession, amount: float, each: float) -> int:
    """A prime number of buckets of about `each`, not fewer than the session's partitions."""
    return prime_from(max(parallelism(spark), int(amount / each) + 1))


def brought_together(packed: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key in one partition, one key after the other."""
    return packed.repartition(parallelism(packed.sparkSession), *keys).sortWithinPartitions(*keys)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int, fold: Callable) -> Iterator:
    """Call fold(key, rows) for each run of equal leading columns; rows: lists of the other columns' values."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if now is not None and row[:keys] != now:
                yield from fold(now, held)
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if now is not None:
        yield from fold(now, held)


__all__ = ["bounded_batches", "brought_together", "buckets_for", "cut_lineage", "cut_small", "few_files", "gathered", "keyed", "numbered", "parallelism", "prime_from",
           "runs_of", "sizes", "spare", "tasks_for", "temporary", "text_bytes", "unique", "with_id"]
