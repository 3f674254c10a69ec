"""Small files of any store that Spark reaches, by Hadoop's file API on the driver: log entries and listings, never rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that no one else has written; False if it is there.

    The text goes to a file of its own name first and is renamed without overwriting, which is atomic wherever the store's rename is
    (Spark's own streaming log asks the same of it); readers never see half an entry.
    """
    fs, target = _at(spark, path)
    if fs.exists(target):
        return False
    folder, name = path.rsplit("/", 1)
    _, draft = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        context.rename(draft, target, options)
        return True
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(target):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    """None if there is no such file."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def data_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path below the folder, bytes, time of change in ms) of the Parquet files at any depth."""
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        return []
    root, out, found = fs.makeQualified(at).toString().rstrip("/") + "/", [], fs.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        path = f.getPath().toString()
        if path.endswith(".parquet"):
            out.append((path.removeprefix(root), f.getLen(), f.getModificationTime()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes that go to a Python worker at once; the session keeps the setting, which plans read when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, removed when the application ends; only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return path
