"""The change feed: pages of JSON rows in a folder of any store that Spark reads, as a table or as a stream.

Page files are named by their number, which is the order of changes.  Spark's file source lists, splits and reads
them on the executors and keeps in its checkpoint which ones are done; a run with ``availableNow`` takes up to
``pages_per_batch`` pages a batch.  A row that says ``expired`` makes everything before it void: the reader has to
start again behind that page, with an empty checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "drive_id string, item_id string, name string, parent_path string, web_url string, mime_type string, size long, etag string, ctag string, is_file boolean, is_deleted boolean, expired boolean"


class TokenExpired(Exception):
    """The feed no longer knows the offset: a full walk begins behind ``page``."""

    def __init__(self, page: int):
        super().__init__(f"TokenExpired({page})")
        self.page = page


def decoded(rows: DataFrame) -> DataFrame:
    """Rows with their page's number, and defaults for what is missing."""
    page = F.regexp_extract("_metadata.file_name", "([0-9]+)", 1).cast("int")
    flag = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    flags = {"is_file": True, "is_deleted": False, "expired": False}
    return rows.select(*(flag(c, flags[c]) if c in flags else F.col(c) for c in rows.columns), page.alias("page"))


def feed_table(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """All rows of the pages behind ``after``."""
    return decoded(spark.read.schema(SCHEMA).json(path)).filter(F.col("page") > after)


def feed_stream(spark: SparkSession, path: str, after: int = -1, pages_per_batch: int = 10) -> DataFrame:
    """The same as a stream."""
    return decoded(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", pages_per_batch).json(path)).filter(F.col("page") > after)


def recycle_bin(rows: DataFrame) -> DataFrame:
    """Last row of each id by arrival, newest deletions first, then by name."""
    last = rows.groupBy("item_id").agg(F.max_by(F.struct("name", "deleted_at"), "arrival").alias("r"))
    return last.select("item_id", "r.name", "r.deleted_at").orderBy(F.desc("deleted_at"), "name")
