"""Shared helpers of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Java pattern of one or more of them.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows that go to a Python worker at once; texts are a few KB, so a batch is a few MB.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
#: Rows of a table of keys that any join may broadcast.
FEW = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bound the rows and bytes of an Arrow batch, so a worker's memory follows the texts and not the partition.

    The session keeps the setting: plans read it when they run, which is later than the operator's call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which is removed when the application ends.

    Where that is unset, a local session sets its own; a cluster must name one, since its machines share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = _folder(spark, path)
    folder[0].deleteOnExit(folder[1])
    return path


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's file API."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of :func:`written`, which no later plan may read."""
    fs, at = _folder(df.sparkSession, df._quillspark_path)
    fs.delete(at, True)


def joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` (cheap to read repeatedly) with ``table``, which has one row for each key.

    A table of at most FEW rows is broadcast whole.  Of a larger one, keys with over a fourth of a partition's share of the
    rows are fewer than four times the partitions: their rows of the table are broadcast, and only the others are shuffled,
    so no key fills a task.
    """
    if table.count() <= FEW:
        return rows.join(F.broadcast(table), key, "left")
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__k"))
    hot = rows.count() // (4 * parallelism(rows.sparkSession))
    hot = F.broadcast(written(per_key.filter((F.col("__k") > hot) & F.col(key).isNotNull()).select(key), "hot-keys"))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    return rows.join(hot, key, "left_anti").join(table, key, "left").unionByName(often)


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a lambda, so that ``body`` may use it repeatedly without recomputing it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or blank text."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1)).cast("long")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
