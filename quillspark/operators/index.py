"""The chunk index: its fields, what a hit shows, attachments, listings and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunking, keys
from . import indexing, retrieval

#: The index has 16 fields (fixed values).
CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("drive_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("web_url", T.StringType()),
    T.StructField("mime_type", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("etag", T.StringType()),
    T.StructField("chunk_number", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_vector", T.ArrayType(T.FloatType())),
    T.StructField("allowed_principals", T.ArrayType(T.StringType())),
    T.StructField("permission_roles", T.ArrayType(T.StringType())),
    T.StructField("has_anonymous_access", T.BooleanType()),
])
#: What a hit shows: neither the vector nor who may see it.
HIT_FIELDS = ("id", "drive_id", "item_id", "name", "path", "web_url", "mime_type", "size", "last_modified", "chunk_number", "content")


def conform(rows: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Rows in the index's fields and types; missing fields are null, and a vector of another width is an error."""
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA]
    out = rows.select(*columns)
    if dimensions is None:
        return out
    width = F.size("content_vector")
    checked = F.when(F.col("content_vector").isNull() | (width == dimensions), F.col("content_vector"))
    wrong = F.raise_error(F.concat(F.lit("a vector has the wrong width: "), width.cast("string")))
    return out.withColumn("content_vector", F.when(F.col("content_vector").isNotNull() & (width != dimensions), wrong.cast(T.ArrayType(T.FloatType()))).otherwise(checked))


def hits(scored: DataFrame) -> DataFrame:
    """The fields of a hit and its score."""
    return scored.select(*HIT_FIELDS, "score")


def optional_equal(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters; a value of None asks for nothing."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == F.lit(value))
    return rows


def merged_pages(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Rows of a provider's pages, each id once, as its first page has it."""
    order = [F.col(page), *(F.col(c) for c in pages.columns if c not in (key, page))]
    return indexing.latest(pages, [key], order)


def order_of(name: str) -> list[Column]:
    """The order of a listing: expressions, descending where they begin with a minus."""
    return [F.expr(x[1:]).desc() if x.startswith("-") else F.expr(x) for x in LISTINGS[name]]


def listing(rows: DataFrame, order: list[Column], skip: int = 0, top: int | None = None, most: int | None = None) -> DataFrame:
    """Rows in order; a page of them if ``top`` is given, clamped to 1 to ``most``."""
    out = rows.orderBy(*order)
    if top is None:
        return out if most is None else out.limit(most)
    return out.offset(max(skip, 0)).limit(min(max(top, 1), most or top))


#: Listings: name to order; the last key makes every order total.
LISTINGS = {
    "agents": ("lower(name)", "id"),
    "drives": ("drive_id",),
    "conversations": ("-updated_at", "conversation_id"),
    "messages": ("sequence", "message_id"),
    "versions": ("-version", "id"),
    "signature_requests": ("-created_at", "id"),
}


def attachment_chunks(files: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """Chunks (id, upload_id, name, mime_type, chunk_number, content) of files (upload_id, name, mime_type, markdown)."""
    cut = chunking.chunk_table(files, ["upload_id", "name", "mime_type"], "markdown", size, overlap)
    return cut.select(keys.chunk_key(F.lit("upload"), F.col("upload_id"), F.col("chunk_number")).alias("id"), *cut.columns)


def begin_indexing(attachments: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Wanted attachments are Indexing and have no error."""
    hit = wanted.select("upload_id").distinct().withColumn("__w", F.lit(True))
    j = attachments.join(hit, "upload_id", "left")
    put = lambda c, v: F.when(F.col("__w"), v).otherwise(F.col(c)).alias(c)
    return j.select(*({"status": put("status", F.lit("Indexing")), "error": put("error", F.lit(None).cast("string")), "updated_at": put("updated_at", now)}.get(c, F.col(c)) for c in attachments.columns))


def finish_indexing(attachments: DataFrame, index: DataFrame, converted: DataFrame, now: Column, size: int = 4000, overlap: int = 400, most_error: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(attachments, index) after conversion: Indexed with their chunk count, or Failed with the reason.

    converted: (upload_id, name, mime_type, markdown, error, tokens) of attachments that are Indexing.  Blank text is a
    failure; a failed attachment keeps the chunks it had; an indexed one's are replaced.  Unknown tokens stay unknown.
    """
    blank = F.length(F.trim(F.coalesce("markdown", F.lit("")))) == 0
    why = F.when(F.col("error").isNotNull(), F.left(F.col("error"), F.lit(most_error))).when(blank, F.concat(F.lit("No readable text was found in "), F.col("name")))
    done = converted.withColumn("__why", why)
    fresh = attachment_chunks(done.filter("__why is null"), size, overlap)
    counts = fresh.groupBy("upload_id").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    outcome = done.select("upload_id", "__why", F.col("tokens").alias("__tokens"), F.lit(True).alias("__d")).join(counts, "upload_id", "left")
    j = attachments.join(outcome, "upload_id", "left")
    hit, ok = F.col("__d") & (F.col("status") == "Indexing"), F.col("__why").isNull()
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c)).alias(c)
    changed = {
        "status": put("status", F.when(ok, "Indexed").otherwise("Failed")),
        "chunk_count": put("chunk_count", F.when(ok, F.coalesce("__n", F.lit(0))).otherwise(0)),
        "tokens": put("tokens", F.when(ok, F.col("__tokens"))),
        "error": put("error", F.col("__why")),
        "updated_at": put("updated_at", now),
        "indexed_at": put("indexed_at", F.when(ok, now)),
    }
    table = j.select(*(changed.get(c, F.col(c)) for c in attachments.columns))
    return table, indexing.replace_items(index, fresh, ["upload_id"])


def search_attachments(index: DataFrame, links: DataFrame, attachments: DataFrame, conversation, query: str, top: int = 5, upload=None) -> DataFrame:
    """(upload_id, name, chunk_number, content, score): hybrid search within one conversation's indexed files.

    links: (conversation_id, upload_id).  The number of hits is clamped to 1 to 10; a blank query finds nothing.  The ids are a
    semi join, so their number has no bound and one ranking covers them all.
    """
    own = optional_equal(links.filter(F.col("conversation_id") == F.lit(conversation)), upload_id=upload).select("upload_id").distinct()
    own = own.join(attachments.filter("status = 'Indexed'").select("upload_id"), "upload_id", "left_semi")
    seen = index.join(own, "upload_id", "left_semi")
    if not (query or "").strip():
        return seen.limit(0).select("upload_id", "name", "chunk_number", "content", F.lit(0.0).alias("score"))
    top = min(max(top, 1), 10)
    found = retrieval.hybrid_search(seen, query, "id", "content", top)
    return seen.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id").select("upload_id", "name", "chunk_number", "content", "score")
