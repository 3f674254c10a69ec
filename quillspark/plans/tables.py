"""The driver's tables in the shapes that the operators take, and the same shapes in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_rows(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row of each key, with the value that stands first in the files: ``dropDuplicates`` keeps whichever its tasks meet first."""
    at = F.col("_metadata.row_index")
    at = at if len(rows.inputFiles()) == 1 else F.struct(F.col("_metadata.file_path"), at)
    return rows.select(*keys, value, at.alias("__at")).groupBy(*keys).agg(F.min_by(value, "__at").alias(value))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a token ledger."""
    e = F.col("event_id")
    known = e % 5 != 0
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("created_at"),
        keys.day_key(F.col("ts")).alias("day"),
        keys.month_key(F.col("ts")).alias("month"),
        F.when(e % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(e % 7 != 0, F.col("event_type")).alias("model_id"),
        F.concat(F.lit("op"), (e % 3).cast("string")).alias("operation"),
        F.floor(e / 4).cast("long").alias("question_id"),
        F.when(known, F.floor("value").cast("long")).alias("input_tokens"),
        F.when(known, e % 97).alias("output_tokens"),
        F.when(known, F.floor("value").cast("long") + e % 97).alias("total_tokens"),
        (e % 13 * 100).alias("audio_bytes"),
        F.when(e % 6 != 0, F.col("value")).alias("duration_seconds"),
    )


LEDGER = """ledger AS (
  SELECT event_id, ts AS created_at, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, CAST(strftime(ts, '%Y%m') AS INTEGER) AS month,
    CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS model_id,
    'op' || CAST(event_id % 3 AS VARCHAR) AS operation, event_id // 4 AS question_id,
    CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS input_tokens,
    CASE WHEN event_id % 5 <> 0 THEN event_id % 97 END AS output_tokens,
    CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) + event_id % 97 END AS total_tokens,
    event_id % 13 * 100 AS audio_bytes, CASE WHEN event_id % 6 <> 0 THEN value END AS duration_seconds
  FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("long")).alias("token_limit"))


USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS name, lower(c_mktsegment) || '.' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS token_limit FROM customer)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracked files."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("drive"), (d % 3).cast("string")).alias("drive_id"),
        d.cast("string").alias("item_id"),
        F.concat(F.lit("file"), d.cast("string"), F.when(d % 4 == 0, ".PDF").when(d % 4 == 1, ".docx").when(d % 4 == 2, ".txt").otherwise(".exe")).alias("name"),
        F.concat(F.lit("/"), "source").alias("parent_path"),
        F.concat(F.lit("https://example.com/"), d.cast("string")).alias("web_url"),
        F.when(d % 10 != 0, F.col("lang")).alias("mime_type"),
        F.col("n_chars").alias("size"),
        F.lit(None).cast("timestamp").alias("last_modified"),
        F.concat(F.lit("e"), d.cast("string")).alias("etag"),
        F.when(d % 5 != 0, F.concat(F.lit("c"), d.cast("string"))).alias("ctag"),
        F.concat(F.lit("h"), (d % 7).cast("string")).alias("permissions_hash"),
        F.when(d % 9 != 0, F.lit("fp1")).otherwise("fp0").alias("index_fingerprint"),
        (F.floor(F.col("n_chars") / 1000)).cast("int").alias("chunk_count"),
        F.concat(F.lit("s"), (d % 2).cast("string")).alias("scan_id"),
        F.when(d % 8 != 0, F.lit("general")).alias("sensitivity_label"),
    )


FILES = """files AS (
  SELECT 'drive' || CAST(doc_id % 3 AS VARCHAR) AS drive_id, CAST(doc_id AS VARCHAR) AS item_id,
    'file' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' ELSE '.exe' END AS name,
    '/' || source AS parent_path, 'https://example.com/' || CAST(doc_id AS VARCHAR) AS web_url, CASE WHEN doc_id % 10 <> 0 THEN lang END AS mime_type,
    n_chars AS size, 'e' || CAST(doc_id AS VARCHAR) AS etag, CASE WHEN doc_id % 5 <> 0 THEN 'c' || CAST(doc_id AS VARCHAR) END AS ctag,
    'h' || CAST(doc_id % 7 AS VARCHAR) AS permissions_hash, CASE WHEN doc_id % 9 <> 0 THEN 'fp1' ELSE 'fp0' END AS index_fingerprint,
    CAST(n_chars // 1000 AS INTEGER) AS chunk_count, 's' || CAST(doc_id % 2 AS VARCHAR) AS scan_id,
    CASE WHEN doc_id % 8 <> 0 THEN 'general' END AS sensitivity_label, doc_id FROM documents)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in which some tags, names, permissions and flags moved, with some files that are new."""
    n = F.col("item_id").cast("long")
    f = files(spark, sf_dir)
    moved = f.withColumns({
        "etag": F.when(n % 6 == 0, F.concat("etag", F.lit("x"))).otherwise(F.col("etag")),
        "parent_path": F.when(n % 11 == 0, F.lit("/moved")).otherwise(F.col("parent_path")),
        "permissions_hash": F.when(n % 13 == 0, F.lit("h9")).otherwise(F.col("permissions_hash")),
        "is_deleted": n % 17 == 0,
        "is_file": n % 19 != 0,
    })
    return moved.withColumn("item_id", F.when(n % 23 == 0, F.concat(F.lit("new"), "item_id")).otherwise(F.col("item_id")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities; every 50th was merged into the one before."""
    p = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("e"), F.lpad(c.cast("string"), 7, "0"))
    return table(spark, sf_dir, "part").select(name(p).alias("entity_id"), F.when(p % 2 == 0, "System").otherwise("Project").alias("entity_type"), F.col("p_name").alias("canonical_name"), F.when((p % 50 == 0) & (p > 0), name(p - 1)).alias("redirect_to"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as assertions between parts."""
    n = F.col("l_orderkey")
    name = lambda c: F.concat(F.lit("e"), F.lpad(c.cast("string"), 7, "0"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").dropDuplicates(["l_orderkey", "l_linenumber"])
    parts = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("m"))
    rows = rows.withColumn("m", F.lit(parts.first()["m"]) + 1)
    return rows.select(
        F.concat(F.lit("a"), F.lpad(n.cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("assertion_id"),
        name(n % F.col("m")).alias("subject_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "INTEGRATES_WITH").when(F.col("l_linenumber") % 3 == 1, "DEPENDS_ON").otherwise("SUPERSEDES").alias("predicate"),
        name((n * 7 + F.col("l_linenumber") * 31) % F.col("m")).alias("object_id"),
        F.when(n % 37 == 0, "Retracted").otherwise("Active").alias("status"),
        F.concat(F.lit("d"), (n % 20).cast("string")).alias("document_id"),
        F.lit("r1").alias("document_version"),
    )


EDGES = """edges AS (
  SELECT DISTINCT 'a' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || CAST(l_linenumber AS VARCHAR) AS assertion_id,
    'e' || lpad(CAST(l_orderkey % m AS VARCHAR), 7, '0') AS subject_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'INTEGRATES_WITH' WHEN 1 THEN 'DEPENDS_ON' ELSE 'SUPERSEDES' END AS predicate,
    'e' || lpad(CAST((l_orderkey * 7 + l_linenumber * 31) % m AS VARCHAR), 7, '0') AS object_id,
    CASE WHEN l_orderkey % 37 = 0 THEN 'Retracted' ELSE 'Active' END AS status,
    'd' || CAST(l_orderkey % 20 AS VARCHAR) AS document_id, 'r1' AS document_version
  FROM lineitem, (SELECT max(p_partkey) + 1 AS m FROM part))"""


def chunks_sql(source: str, size: int, overlap: int) -> str:
    """CTEs that end in chunks (doc_id, chunk_number, content) of ``source`` (doc_id, text), for texts without surrogate pairs."""
    return f"""ck_w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM {source}),
ck_u AS (SELECT doc_id, i, ws[i] AS w, sum(length(ws[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ck_w, unnest(range(1, len(ws) + 1)) t(i)),
ck_p AS (SELECT doc_id, list(w ORDER BY i) AS ws, list(upto - length(w) - 1 ORDER BY i) AS s, list(upto - 1 ORDER BY i) AS e FROM ck_u GROUP BY 1),
ck_r(doc_id, k, first, last) AS (SELECT doc_id, 0, 1, greatest(1, len(list_filter(e, lambda x: x <= s[1] + {size}))) FROM ck_p
  UNION ALL SELECT doc_id, k + 1, f, greatest(f, len(list_filter(e, lambda x: x <= s[f] + {size}))) FROM (
    SELECT r.doc_id, k, s, e, CAST(least(last + 1, 1 + len(list_filter(s, lambda x: x < greatest(s[first] + 1, e[last] - {overlap})))) AS INTEGER) AS f
    FROM ck_r r JOIN ck_p p ON p.doc_id = r.doc_id WHERE last < len(ws)) n),
chunks AS (SELECT r.doc_id, k AS chunk_number, array_to_string(ws[first:last], ' ') AS content FROM ck_r r JOIN ck_p p ON p.doc_id = r.doc_id)"""
