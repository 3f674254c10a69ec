"""Files and archives as tables, and the heading outline of Markdown."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_BYTES = 10_000, 200 << 20


def listing(spark: SparkSession, folder: str, pattern: str = "*", most: int = 5000) -> tuple[DataFrame, bool]:
    """(path, modified, size) below a folder, up to ``most``, and whether there are more.  Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    first = found.orderBy("path").limit(most + 1)
    return first.limit(most), first.count() > most


def unzipped(files: DataFrame) -> DataFrame:
    """(path, entry, size, content, error) of zip files; names that leave the folder are refused."""

    def open_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    entries = [e for e in z.infolist() if not e.is_dir()]
                    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
                        raise ValueError("the archive is too large")
                    for e in entries:
                        name = posixpath.normpath(e.filename.replace("\\", "/"))
                        bad = name.startswith(("/", "../")) or name == ".." or ":" in name
                        rows.append((path, e.filename, e.file_size, None if bad else z.read(e), "leaves the folder" if bad else None))
                except Exception as e:  # noqa: BLE001
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "entry", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(open_all, "path string, entry string, size long, content binary, error string")


def zipped(files: DataFrame, key: str) -> DataFrame:
    """One zip file per key from (key, entry, content); entries in order of their names."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_ENTRIES or pdf["content"].map(len).sum() > MAX_BYTES:
            raise ValueError("the archive would be too large")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, content in pdf.sort_values("entry")[["entry", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(entry), content)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "archive": [out.getvalue()]})

    return files.select(F.col(key).cast("string").alias("key"), "entry", "content").groupBy("key").applyInPandas(pack, "key string, archive binary")


def headings(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line, level, title) of Markdown headings; fenced code has none."""
    flat = docs.select(key, F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n", -1)).alias("at", "text"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fenced = F.coalesce(F.sum(F.when(F.col("text").rlike(r"^ {0,3}(```|~~~)"), 1).otherwise(0)).over(w), F.lit(0)) % 2 == 1
    found = flat.withColumn("fenced", fenced).filter(~F.col("fenced") & F.col("text").rlike(r"^ {0,3}#{1,6}[ \t]+\S"))
    return found.select(key, (F.col("at") + 1).cast("int").alias("line"), F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace("text", r"^ {0,3}#{1,6}[ \t]+|[ \t]+#*[ \t]*$", "")).alias("title"))


def outline(docs: DataFrame, key: str, text_col: str, most: int = 300) -> DataFrame:
    """Sections with their last lines and text; up to ``most`` a document."""
    from ..operators.conversations import section_ends

    parts = docs.select(F.col(key).alias("doc_id"), F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n", -1).alias("lines"))
    h = headings(docs.withColumnRenamed(key, "doc_id"), "doc_id", text_col)
    h = h.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).filter(F.col("n") <= most).drop("n")
    ends = section_ends(h.select("doc_id", "line", "level"), parts.select("doc_id", F.size("lines").alias("total_lines")))
    full = ends.join(h.select("doc_id", "line", "title"), ["doc_id", "line"]).join(parts, "doc_id")
    return full.select(F.col("doc_id").alias(key), "line", "level", "title", "end_line", F.array_join(F.slice("lines", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n").alias("section"))
