"""Registered queries, named by what they compute, each with SQL for the oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, keys, text
from ..operators import access, conversations, graph, indexing, retrieval, usage
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _hybrid(s, d):
    docs = T.table(s, d, "documents")
    seen = docs.filter(access.permission_filter(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("g"), (F.col("doc_id") % 4).cast("string"))), "u1", ["g1"]))
    chunks = chunking.chunk_table(seen, ["doc_id"], "text", 1000, 100)
    chunks = chunks.select(keys.chunk_key(F.lit("drive"), F.col("doc_id").cast("string"), F.col("chunk_number")).alias("chunk_id"), "content")
    return retrieval.hybrid_search(chunks, "the licensed version of the thing", "chunk_id", "content", 20)


#: The query's terms in order, and the page of the fused list.
_FUSED = f"""
WITH RECURSIVE seen AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 1), {T.chunks_sql('seen', 1000, 100)},
c AS (SELECT translate(rtrim(to_base64(encode('drive:' || CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_number AS VARCHAR))), '='), '+/', '-_') AS chunk_id,
  list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0) AS w FROM chunks),
q AS (SELECT unnest(['the', 'licensed', 'version', 'of', 'the', 'thing']) AS t),
qt AS (SELECT DISTINCT t FROM q),
qs AS (SELECT CAST('0x' || left(md5(t), 4) AS INTEGER) % 64 AS slot, count(*) AS k FROM q GROUP BY 1),
n AS (SELECT count(*) AS total, avg(len(w)) AS a FROM c),
f AS (SELECT chunk_id, len(w) AS n, t, len(list_filter(w, lambda x: x = t)) AS tf FROM c, qt),
df AS (SELECT t, count_if(tf > 0) AS d FROM f GROUP BY 1),
b AS (SELECT chunk_id, round(sum(ln(1 + (total - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * f.n / a))), 9) AS score FROM f JOIN df USING (t), n GROUP BY 1 HAVING sum(tf) > 0),
bt AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM b),
x AS (SELECT chunk_id, slot, count(*) AS k FROM (SELECT chunk_id, CAST('0x' || left(md5(unnest(w)), 4) AS INTEGER) % 64 AS slot FROM c) GROUP BY 1, 2),
v AS (SELECT chunk_id, round(sum(x.k * coalesce(qs.k, 0)) / sqrt(sum(x.k * x.k) * (SELECT sum(k * k) FROM qs)), 9) AS score FROM x LEFT JOIN qs USING (slot) GROUP BY 1),
vs AS (SELECT c.chunk_id, row_number() OVER (ORDER BY coalesce(v.score, 0) DESC, c.chunk_id) AS r FROM c LEFT JOIN v USING (chunk_id))
SELECT chunk_id, round(coalesce(1.0 / (60 + bt.r), 0) + coalesce(1.0 / (60 + vs.r), 0), 9) AS score
FROM (SELECT * FROM bt WHERE r <= 100) bt FULL JOIN (SELECT * FROM vs WHERE r <= 100) vs USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 20"""
query("r03_hybrid_search", _FUSED)(lambda s, d: _hybrid(s, d).select("chunk_id", F.round("score", 9).alias("score")))


@query("r01_full_text", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) AS w FROM documents),
n AS (SELECT count(*) AS total, avg(len(w)) AS a, count_if(list_contains(w, 'licensed')) AS d1, count_if(list_contains(w, 'version')) AS d2 FROM t),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'licensed')) AS f1, len(list_filter(w, lambda x: x = 'version')) AS f2 FROM t)
SELECT doc_id, round(ln(1 + (total - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * f.n / a))
  + ln(1 + (total - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * f.n / a)), 6) AS score
FROM f, n WHERE f1 + f2 > 0""")
def _(s, d):
    return retrieval.bm25(T.table(s, d, "documents"), "Licensed version", "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


@query("r02_vector_topk", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))), 6) AS score
FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def _(s, d):
    e = T.table(s, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return retrieval.vector_search(e, q, "vec_id", "embedding", 10).select("vec_id", F.round("score", 6).alias("score"))


@query("r07_distinct_citations", """
SELECT name, chunk_number, rank FROM (SELECT lang AS name, n_chars % 5 AS chunk_number, doc_id AS rank, row_number() OVER (PARTITION BY lang, n_chars % 5 ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def _(s, d):
    return retrieval.distinct_citations(T.table(s, d, "documents").select(F.col("lang").alias("name"), (F.col("n_chars") % 5).alias("chunk_number"), F.col("doc_id").alias("rank")))


@query("s14_permission_filter", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 1")
def _(s, d):
    allowed = F.array(F.concat(F.lit("g"), (F.col("doc_id") % 4).cast("string")))
    return T.table(s, d, "documents").filter(access.permission_filter(F.col("doc_id") % 3 == 0, allowed, "u1", ["g1"])).select("doc_id")


@query("s04_permission_snapshot", """
SELECT l_orderkey % 50 AS item, array_to_string(list_sort(list_distinct(list('p' || CAST(l_partkey % 20 AS VARCHAR)))), ',') AS principals,
  array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS roles, bool_or(l_linenumber > 6) AS anonymous FROM lineitem GROUP BY 1""")
def _(s, d):
    g = T.table(s, d, "lineitem").select((F.col("l_orderkey") % 50).alias("item"), F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"))).alias("principals"), F.col("l_returnflag").alias("role"), (F.col("l_linenumber") > 6).alias("is_anonymous"))
    return access.permission_snapshots(g, "item").select("item", F.array_join("allowed_principals", ",").alias("principals"), F.array_join("roles", ",").alias("roles"), F.col("has_anonymous_access").alias("anonymous"))


@query("s05_transitive_groups", """
WITH RECURSIVE m AS (SELECT n_nationkey AS member, 100 + n_regionkey AS grp FROM nation UNION ALL SELECT 100 + r_regionkey, 200 + r_regionkey % 2 FROM region),
r(member, grp) AS (SELECT member, grp FROM m UNION SELECT r.member, m.grp FROM r JOIN m ON m.member = r.grp)
SELECT CAST(member AS BIGINT) AS member, CAST(grp AS BIGINT) AS grp FROM r""")
def _(s, d):
    m = T.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("member"), (100 + F.col("n_regionkey")).cast("long").alias("group"))
    m = m.unionByName(T.table(s, d, "region").select((100 + F.col("r_regionkey")).cast("long").alias("member"), (200 + F.col("r_regionkey") % 2).cast("long").alias("group")))
    return access.transitive_groups(m).withColumnRenamed("group", "grp")


@query("p03_change_classification", f"""
WITH {T.FILES}, i AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'new' || item_id ELSE item_id END AS iid, CASE WHEN doc_id % 6 = 0 THEN etag || 'x' ELSE etag END AS e2,
  CASE WHEN doc_id % 11 = 0 THEN '/moved' ELSE parent_path END AS p2, CASE WHEN doc_id % 13 = 0 THEN 'h9' ELSE permissions_hash END AS h2 FROM files),
j AS (SELECT i.*, t.item_id IS NOT NULL AND t.sensitivity_label IS NOT NULL AND i.e2 = t.etag AND t.chunk_count > 0 AND t.index_fingerprint = 'fp1' AS same,
  i.p2 = t.parent_path AND i.h2 = t.permissions_hash AS props FROM i LEFT JOIN files t ON i.iid = t.item_id AND i.drive_id = t.drive_id)
SELECT iid AS item_id, CASE WHEN doc_id % 17 = 0 THEN 'remove' WHEN doc_id % 19 = 0 THEN 'ignore' WHEN doc_id % 4 = 3 THEN 'remove'
  WHEN same AND props THEN 'skip' WHEN same THEN 'merge' ELSE 'reindex' END AS action FROM j""")
def _(s, d):
    return indexing.classify(T.changes(s, d), T.files(s, d), ["pdf", " .docx", "TXT"], "fp1").select("item_id", "action")


@query("p06_contains_search", f"WITH {T.FILES} SELECT item_id FROM files WHERE contains(lower(name), 'e1') OR contains(lower(parent_path), 'e1') OR contains(lower(mime_type), 'e1')")
def _(s, d):
    return T.files(s, d).filter(conversations.contains_any(" E1 ", "name", "parent_path", "mime_type")).select("item_id")


@query("p09_day_range", f"WITH {T.LEDGER} SELECT event_id, day FROM ledger WHERE day BETWEEN 20240105 AND 20240112")
def _(s, d):
    return usage.day_range(T.ledger(s, d), 20240105, 20240112).select("event_id", "day")


@query("p11_user_term", f"WITH {T.LEDGER}, {T.USERS} SELECT event_id FROM ledger WHERE CAST(user_id AS VARCHAR) = '7' OR user_id IN (SELECT user_id FROM users WHERE contains(lower(name), '7') OR contains(lower(email), '7'))")
def _(s, d):
    return usage.user_term(T.ledger(s, d), T.users(s, d), "7").select("event_id")


@query("p13_unknown_model", f"WITH {T.LEDGER} SELECT event_id FROM ledger WHERE model_id IS NULL")
def _(s, d):
    return usage.model_filter(T.ledger(s, d), unknown=True).select("event_id")


@query("p15_storage_safe", "SELECT page_id, length(url) BETWEEN 1 AND 255 AND NOT regexp_matches(url, '[/\\\\?#]') AND NOT regexp_matches(url, '^\\s|\\s$') AS safe FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", keys.storage_safe(F.col("url")).alias("safe"))


@query("p16_ontology_triple", """
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'System' WHEN 1 THEN 'Team' WHEN 2 THEN 'Policy' ELSE 'Contract' END AS a,
  CASE p_size % 4 WHEN 0 THEN 'System' WHEN 1 THEN 'Team' WHEN 2 THEN 'Policy' ELSE 'Contract' END AS b,
  CASE p_partkey % 3 WHEN 0 THEN 'DEPENDS_ON' WHEN 1 THEN 'SUPERSEDES' ELSE 'OWNED_BY' END AS p FROM part)
SELECT p_partkey, CASE p WHEN 'DEPENDS_ON' THEN a = 'System' AND b = 'System' WHEN 'SUPERSEDES' THEN a = b AND a IN ('Policy', 'Contract') ELSE a IN ('System', 'Policy', 'Contract') AND b = 'Team' END AS allowed FROM t""")
def _(s, d):
    kind = lambda c: F.element_at(F.array(*map(F.lit, ("System", "Team", "Policy", "Contract"))), (c % 4 + 1).cast("int"))
    p = F.element_at(F.array(*map(F.lit, ("DEPENDS_ON", "SUPERSEDES", "OWNED_BY"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return T.table(s, d, "part").select("p_partkey", graph.DEFAULT.allows(kind(F.col("p_partkey")), p, kind(F.col("p_size"))).alias("allowed"))


@query("p18_safety_verdict", "SELECT event_id, CASE WHEN event_id % 9 > 7 OR event_id % 5 > 7 THEN NULL WHEN event_id % 9 >= 4 OR event_id % 5 >= 4 THEN 'Blocked' ELSE 'Allowed' END AS verdict FROM events")
def _(s, d):
    e = F.col("event_id")
    return T.table(s, d, "events").select("event_id", usage.safety_verdict([e % 9, e % 5], [F.lit(4), F.lit(4)]).alias("verdict"))


@query("p22_health", """
WITH b AS (SELECT user_id AS worker, max(ts) AS t, arg_max(event_type = 'error', ts) AS failed FROM events GROUP BY 1)
SELECT worker, CASE WHEN t <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 MINUTE THEN 'unhealthy' WHEN failed THEN 'degraded' ELSE 'healthy' END AS status FROM b""")
def _(s, d):
    beats = T.table(s, d, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("beat_at"), (F.col("event_type") == "error").alias("failed"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return usage.health(beats, F.expr("timestamp_ntz'2024-01-31 00:00:00'"))


@query("p23_repair_reason", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'stale' WHEN doc_id % 11 = 0 THEN 'extractionVersion' WHEN doc_id % 13 = 0 THEN 'unsettled' END AS reason FROM documents""")
def _(s, d):
    n = F.col("doc_id")
    reason = indexing.repair_reason(F.when(n % 5 != 0, F.when(n % 7 == 0, "Failed").otherwise("Ready")), F.when(n % 3 == 0, "r0").otherwise("r1"), F.when(n % 11 == 0, "v0").otherwise("v1"), F.lit("r1"), "v1", F.when(n % 13 == 0, "r2"))
    return T.table(s, d, "documents").select("doc_id", reason.alias("reason"))


@query("j01_j02_previous_user_turn", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations""")
def _(s, d):
    return conversations.previous_user_text(T.table(s, d, "conversations")).select("conv_id", "turn", "question")


@query("j03_a03_outside_scan", f"WITH {T.FILES} SELECT drive_id, count(*) AS n FROM files WHERE NOT (drive_id IN ('drive0', 'drive1') AND scan_id = 's1') GROUP BY 1")
def _(s, d):
    state = s.createDataFrame([("drive0", "s1"), ("drive1", "s1")], "drive_id string, scan_id string")
    return indexing.outside_scan(T.files(s, d), state).groupBy("drive_id").agg(F.count(F.lit(1)).alias("n"))


@query("j04_users_with_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(s, d):
    o = T.table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return T.table(s, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j05_user_names", f"WITH {T.LEDGER}, {T.USERS} SELECT l.event_id, coalesce(u.name, 'Unknown user') AS label FROM ledger l LEFT JOIN users u ON l.user_id = u.user_id")
def _(s, d):
    return T.ledger(s, d).join(T.users(s, d).select("user_id", "name"), "user_id", "left").select("event_id", F.coalesce("name", F.lit("Unknown user")).alias("label"))


@query("j07_unique_link", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS link FROM orders GROUP BY 1")
def _(s, d):
    return T.table(s, d, "orders").groupBy("o_custkey").agg(F.when(F.count_distinct("o_orderpriority") == 1, F.min("o_orderpriority")).alias("link"))


@query("j08_full_outer_match", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'remote' WHEN b.k IS NULL THEN 'missing' ELSE 'matched' END AS state
FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 0) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) b ON a.k = b.k""")
def _(s, d):
    x = T.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    a, b = x.filter("k % 3 <> 0").withColumn("x", F.lit(1)), x.filter("k % 2 = 0").withColumn("y", F.lit(1))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("x").isNull(), "remote").when(F.col("y").isNull(), "missing").otherwise("matched").alias("state"))


@query("j10_orphans", "SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s, d):
    return T.table(s, d, "customer").filter("c_nationkey % 2 = 0").join(T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j16_adjacency", f"""
WITH {T.EDGES}, f AS (SELECT 'e0000005' AS id UNION ALL SELECT 'e0000010')
SELECT assertion_id, from_id, other FROM (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY side, from_id) AS n FROM (
  SELECT assertion_id, id AS from_id, object_id AS other, 0 AS side FROM edges JOIN f ON subject_id = id
  UNION ALL SELECT assertion_id, id, subject_id, 1 FROM edges JOIN f ON object_id = id WHERE predicate = 'INTEGRATES_WITH')) WHERE n = 1""")
def _(s, d):
    f = s.createDataFrame([("e0000005", "e0000005"), ("e0000010", "e0000010")], "id string, owner string")
    return graph.adjacent(T.edges(s, d), f, "out", ["INTEGRATES_WITH"]).select("assertion_id", "from_id", "other")


@query("j22_earliest_link", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS BIGINT) END, (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey)) AS link FROM customer")
def _(s, d):
    first = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return T.table(s, d, "customer").join(first, "c_custkey", "left").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey").cast("long")), F.col("first")).alias("link"))


@query("a01_a02_index_summary", f"WITH {T.FILES} SELECT count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, min(size) AS least, max(size) AS most, count(DISTINCT drive_id) AS drives, count(DISTINCT index_fingerprint) AS fingerprints FROM files")
def _(s, d):
    return T.files(s, d).agg(F.count(F.lit(1)).alias("files"), usage.total("chunk_count").alias("chunks"), usage.total("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"), F.count_distinct("drive_id").alias("drives"), F.count_distinct("index_fingerprint").alias("fingerprints"))


@query("a04_top_types", f"WITH {T.FILES} SELECT mime_type, count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 12")
def _(s, d):
    return T.files(s, d).groupBy("mime_type").agg(F.count(F.lit(1)).alias("files"), usage.total("chunk_count").alias("chunks"), usage.total("size").alias("bytes")).orderBy(F.desc("files"), F.asc_nulls_first("mime_type")).limit(12)


_M = "count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(*) - count(total_tokens) AS unknown_calls"


@query("a05_token_summary", f"WITH {T.LEDGER} SELECT count(DISTINCT question_id) AS questions, count(*) AS requests, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN model_id IS NULL THEN question_id END) AS unknown_model_questions FROM ledger")
def _(s, d):
    return usage.token_summary(T.ledger(s, d))


for _name, _key in (("a06_token_daily", "day"), ("a09_embedding_operation", "operation"), ("a11_image_by_model", "model_id")):
    query(_name, f"WITH {T.LEDGER} SELECT {_key}, {_M} FROM ledger GROUP BY 1")(lambda s, d, k=_key: usage.by(T.ledger(s, d), k))

query("a07_token_by_model", f"WITH {T.LEDGER} SELECT model_id, {_M} FROM ledger WHERE model_id IS NOT NULL GROUP BY 1 ORDER BY total_tokens DESC, 1 LIMIT 100")(lambda s, d: usage.top_by(T.ledger(s, d), "model_id", 100, False))
query("a08_t13_top_users", f"WITH {T.LEDGER} SELECT user_id, {_M} FROM ledger WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY total_tokens DESC, 1 LIMIT 100")(lambda s, d: usage.top_by(T.ledger(s, d), "user_id", 100, False))
query("a09_embedding_by_user", f"WITH {T.LEDGER} SELECT user_id, {_M} FROM ledger GROUP BY 1 ORDER BY total_tokens DESC, 1 NULLS FIRST LIMIT 100")(lambda s, d: usage.top_by(T.ledger(s, d), "user_id", 100, True))
query("a12_decision_summary", f"WITH {T.LEDGER} SELECT {_M} FROM ledger WHERE operation = 'op1'")(lambda s, d: T.ledger(s, d).filter("operation = 'op1'").agg(*usage.measures()))


@query("a10_safety_daily", f"WITH {T.LEDGER} SELECT day, count(*) AS n, count_if(model_id = 'error') AS failed, count_if(model_id IN ('view', 'click')) AS allowed, CAST(coalesce(sum(CASE WHEN model_id = 'purchase' THEN total_tokens END), 0) AS BIGINT) AS blocked_records FROM ledger GROUP BY 1")
def _(s, d):
    m = F.col("model_id")
    return T.ledger(s, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(m == "error").alias("failed"), F.count_if(m.isin("view", "click")).alias("allowed"), F.coalesce(F.sum(F.when(m == "purchase", F.col("total_tokens"))), F.lit(0)).cast("long").alias("blocked_records"))


@query("a13_transcription_totals", f"WITH {T.LEDGER} SELECT {_M}, CAST(sum(audio_bytes) AS BIGINT) AS audio_bytes, round(coalesce(sum(duration_seconds), 0), 3) AS seconds FROM ledger WHERE day BETWEEN 20240101 AND 20240115")
def _(s, d):
    return usage.day_range(T.ledger(s, d), 20240101, 20240115).agg(*usage.measures(), usage.total("audio_bytes").alias("audio_bytes"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 3).alias("seconds"))


@query("a14_options", f"WITH {T.LEDGER} SELECT DISTINCT 'model_id' AS name, model_id AS value FROM ledger WHERE model_id IS NOT NULL UNION ALL SELECT DISTINCT 'operation', operation FROM ledger")
def _(s, d):
    return usage.options(T.ledger(s, d), "model_id", "operation")


@query("a15_month_used", f"WITH {T.LEDGER} SELECT CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS used FROM ledger WHERE user_id = 7 AND month = 202401 AND operation IN ('op0', 'op1', 'op2')")
def _(s, d):
    x = T.ledger(s, d)
    return usage.month_used(7, 202401, *(x.filter(F.col("operation") == o) for o in ("op0", "op1", "op2")))


@query("a16_u01_day_model", f"WITH {T.LEDGER} SELECT day, model_id, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM ledger WHERE operation <> 'op2' GROUP BY 1, 2")
def _(s, d):
    x = T.ledger(s, d)
    return usage.combined(x.filter("operation = 'op0'"), x.filter("operation = 'op1'"))


@query("a17_daily_rollup", f"WITH {T.LEDGER} SELECT day, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens FROM ledger GROUP BY 1")
def _(s, d):
    return usage.combined(T.ledger(s, d)).groupBy("day").agg(F.sum("tokens").alias("tokens"))


@query("a18_grouping_sets", f"WITH {T.LEDGER} SELECT day, model_id, CAST(grouping(day, model_id) AS INTEGER) AS level, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM ledger GROUP BY GROUPING SETS ((day), (model_id), (day, model_id))")
def _(s, d):
    return usage.pivots(T.ledger(s, d))


@query("a19_quota", f"WITH {T.LEDGER}, {T.USERS}, u AS (SELECT user_id, sum(total_tokens) AS used FROM ledger GROUP BY 1) SELECT users.user_id, coalesce(token_limit IS NOT NULL AND coalesce(used, 0) >= token_limit, FALSE) AS over FROM users LEFT JOIN u ON users.user_id = u.user_id")
def _(s, d):
    used = T.ledger(s, d).groupBy("user_id").agg(F.sum("total_tokens").alias("used"))
    return T.users(s, d).join(used, "user_id", "left").select("user_id", usage.over_quota(F.coalesce("used", F.lit(0)), F.col("token_limit")).alias("over"))


@query("a20_storage_totals", """
SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN lang = 'en' THEN n_chars END), 0) AS BIGINT) AS shared_bytes,
  CAST(coalesce(sum(CASE WHEN l.doc_id IS NULL THEN n_chars END), 0) AS BIGINT) AS orphan_bytes FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def _(s, d):
    linked = T.table(s, d, "labels").select("doc_id", F.lit(True).alias("linked")).distinct()
    j = T.table(s, d, "documents").select("doc_id", "lang", "n_chars").join(linked, "doc_id", "left")
    z = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_chars"))), F.lit(0)).cast("long")
    return j.agg(F.count(F.lit(1)).alias("files"), usage.total("n_chars").alias("bytes"), z(F.col("lang") == "en").alias("shared_bytes"), z(F.col("linked").isNull()).alias("orphan_bytes"))


@query("a21_storage_admission", """
WITH r AS (SELECT doc_id, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM documents)
SELECT doc_id, used_before, NOT (used_before >= 20000 OR n_chars > 20000 - used_before) AS admitted FROM r""")
def _(s, d):
    return usage.admitted(T.table(s, d, "documents").select("doc_id", "source", "n_chars"), 20000, "source", ["doc_id"], "n_chars").select("doc_id", "used_before", "admitted")


@query("a22_feedback_totals", "SELECT count_if(quality = 1) AS likes, count_if(quality = 0) AS dislikes FROM labels")
def _(s, d):
    return conversations.feedback_totals(T.table(s, d, "labels").select(F.when(F.col("quality") == 1, "like").otherwise("dislike").alias("feedback")))


@query("a23_branch_totals", "SELECT conv_id, turn, count(*) OVER w AS branch_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS branch_total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(s, d):
    m = T.table(s, d, "conversations").withColumn("size", F.length("text").cast("long"))
    return conversations.running_totals(m, "size").select("conv_id", "turn", "branch_messages", "branch_total")


@query("a24_next_sequence", "SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1")
def _(s, d):
    m = T.table(s, d, "conversations")
    return conversations.next_sequence(m, m)


@query("a25_message_counts", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    n = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return T.table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("a26_null_poisoning", f"WITH {T.LEDGER} SELECT question_id, CASE WHEN count(total_tokens) = count(*) THEN CAST(sum(total_tokens) AS BIGINT) END AS tokens FROM ledger GROUP BY 1")
def _(s, d):
    return T.ledger(s, d).groupBy("question_id").agg(usage.null_poisoned("total_tokens").alias("tokens"))


@query("a27_entity_build", """
SELECT p_brand AS entity_id, arg_min(p_type, p_partkey) AS entity_type, arg_min(p_name, p_partkey) AS canonical_name,
  (SELECT string_agg(a, '|' ORDER BY p, a) FROM (SELECT p_name AS a, min(p_partkey) AS p FROM part q WHERE q.p_brand = part.p_brand GROUP BY 1 ORDER BY p, a LIMIT 20)) AS aliases FROM part GROUP BY p_brand""")
def _(s, d):
    c = T.table(s, d, "part").select(F.col("p_brand").alias("entity_id"), F.col("p_partkey").alias("position"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("name"), F.col("p_name").alias("alias"))
    return graph.build_entities(c).select("entity_id", "entity_type", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query("a28_a29_evaluation", """
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
c AS (SELECT list_distinct(w[1:4]) AS want, list_distinct(w[3:6]) AS got, CAST(item_id % 30 * 10 AS DOUBLE) AS ms FROM w),
h AS (SELECT *, len(list_intersect(want, got)) AS hit FROM c),
r AS (SELECT CASE WHEN len(want) = 0 THEN 1.0 ELSE hit / len(want) END AS rc, CASE WHEN len(got) = 0 THEN CASE WHEN len(want) = 0 THEN 1.0 ELSE 0.0 END ELSE hit / len(got) END AS pr, ms FROM h)
SELECT round(avg(rc), 9) AS mean_recall, round(avg(pr), 9) AS mean_precision, round(avg(CAST(rc >= 1 AS INTEGER)), 9) AS full_recall, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM r""")
def _(s, d):
    c = T.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("question"), F.slice(F.split("text", " "), 1, 4).alias("expected"), F.slice(F.split("text", " "), 3, 4).alias("retrieved"), (F.col("item_id") % 30 * 10).cast("double").alias("latency_ms"))
    found = retrieval.evaluation(c.select("question", "expected"), c.select("question", "retrieved", "latency_ms"))
    return found.select(*(F.round(x, 9).alias(x) for x in ("mean_recall", "mean_precision", "full_recall")), "p50", "p95")


@query("a29_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(s, d):
    return T.table(s, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("a31_strategy_overlap", """
WITH h AS (SELECT CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'vector' ELSE 'hybrid' END AS s, user_id AS c, user_id % 10 AS f FROM events),
p AS (SELECT c, f, count(DISTINCT s) AS k FROM h GROUP BY 1, 2) SELECT count(*) AS chunks, count(DISTINCT f) AS files, count_if(k = 3) AS in_all, count_if(k = 1) AS in_one FROM p""")
def _(s, d):
    t = F.col("event_type")
    h = T.table(s, d, "events").select(F.when(t == "click", "text").when(t == "view", "vector").otherwise("hybrid").alias("strategy"), F.col("user_id").alias("chunk_id"), (F.col("user_id") % 10).alias("file_id"))
    return retrieval.strategy_overlap(h, 3)


@query("a33_request_tally", f"WITH {T.LEDGER} SELECT question_id, CASE WHEN bool_or(total_tokens IS NOT NULL) THEN CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) END AS tokens FROM ledger GROUP BY 1")
def _(s, d):
    return T.ledger(s, d).withColumn("known", F.col("total_tokens").isNotNull()).groupBy("question_id").agg(usage.reported("total_tokens", "known").alias("tokens"))


@query("a34_name_list", "SELECT o_custkey, left(string_agg(p, ', ' ORDER BY k), 1000) AS names FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return T.table(s, d, "orders").groupBy("o_custkey").agg(usage.name_list(names).alias("names"))


@query("w02_section_end", """
WITH h AS (SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(1 + (doc_id * 7 + i * i) % 4 AS INTEGER) AS level FROM documents, range(1, 12) t(i) WHERE (doc_id + i) % 3 <> 0)
SELECT doc_id, line, level, CAST(coalesce((SELECT min(g.line) - 1 FROM h g WHERE g.doc_id = h.doc_id AND g.line > h.line AND g.level <= h.level), 20) AS INTEGER) AS end_line FROM h""")
def _(s, d):
    i = F.col("line")
    h = T.table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("line"))
    h = h.filter((F.col("doc_id") + i) % 3 != 0).withColumn("level", (1 + (F.col("doc_id") * 7 + i * i) % 4).cast("int"))
    totals = h.select("doc_id", F.lit(20).alias("total_lines")).distinct()
    return conversations.section_ends(h, totals)


@query("w03_neighbours", "SELECT conv_id, turn AS chunk_number, right(lag(text) OVER w, 600) AS before, left(lead(text) OVER w, 600) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    c = T.table(s, d, "conversations").select("conv_id", F.col("turn").alias("chunk_number"), F.col("text").alias("content"))
    return conversations.neighbours(c, ["conv_id"]).select("conv_id", "chunk_number", "before", "after")


@query("w04_history", """
WITH a AS (SELECT conv_id, max(turn) AS asked FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT c.conv_id, turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS back FROM conversations c JOIN a ON c.conv_id = a.conv_id WHERE turn < asked)
SELECT conv_id, turn, CAST(back AS INTEGER) AS back FROM b WHERE back <= 3""")
def _(s, d):
    return conversations.recent_history(T.table(s, d, "conversations"), 3).select("conv_id", "turn", "back")


@query("w05_first_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(s, d):
    return graph.first_by(T.table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("t01_t02_sorted_page", f"WITH {T.FILES} SELECT item_id, size FROM files ORDER BY size DESC, item_id LIMIT 50 OFFSET 20")
def _(s, d):
    return sorted_page(T.files(s, d), "size", True, 20, 50).select("item_id", "size")


def sorted_page(files: DataFrame, sort: str, descending: bool, skip: int, top: int) -> DataFrame:
    """Whitelisted sort, ties by item id upwards in both directions; limits are clamped."""
    column = F.col(sort if sort in ("name", "size", "chunk_count", "mime_type") else "item_id")
    order = column.desc_nulls_last() if descending else column.asc_nulls_first()
    return files.orderBy(order, F.col("item_id").asc()).offset(max(skip, 0)).limit(min(max(top, 1), 200))


@query("t03_mixed_sort", f"WITH {T.LEDGER} SELECT event_id, day FROM ledger ORDER BY day DESC, question_id DESC, event_id LIMIT 25")
def _(s, d):
    return T.ledger(s, d).orderBy(F.desc("day"), F.desc("question_id"), "event_id").limit(25).select("event_id", "day")


@query("t08_truncation_probe", "SELECT count(*) > 100 AS truncated, least(count(*), 100) AS shown FROM (SELECT 1 FROM pages WHERE contains(url, '/fr/') LIMIT 101)")
def _(s, d):
    probe = T.table(s, d, "pages").filter(F.contains("url", F.lit("/fr/"))).select("page_id").limit(101)
    return probe.agg((F.count(F.lit(1)) > 100).alias("truncated"), F.least(F.count(F.lit(1)), F.lit(100)).alias("shown"))


@query("t15_user_listing", f"WITH {T.USERS} SELECT user_id, email FROM users WHERE contains(lower(name), '9') OR contains(lower(email), '9') ORDER BY email LIMIT 20 OFFSET 5")
def _(s, d):
    return T.users(s, d).filter(conversations.contains_any("9", "name", "email")).orderBy("email").offset(5).limit(20).select("user_id", "email")


@query("u02_linked_ids", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def _(s, d):
    return T.table(s, d, "customer").select(F.col("c_nationkey").alias("id")).union(T.table(s, d, "supplier").select("s_nationkey")).distinct()


@query("u04_superseded", "SELECT DISTINCT l_partkey AS assertion_id FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3)")
def _(s, d):
    x = T.table(s, d, "lineitem").select(F.col("l_partkey").alias("assertion_id"), "l_returnflag", "l_linenumber")
    edges = x.filter("l_returnflag = 'R' and l_linenumber > 3").select("assertion_id", F.lit("Active").alias("status"))
    return graph.apply_snapshot(edges, x.filter("l_returnflag = 'A'"), edges)[1]


@query("u06_role_changes", "SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS added, c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS removed FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    change = access.role_changes(F.array_compact(F.array(F.when(k % 3 == 0, "admin"))), F.array_compact(F.array(F.when(k % 2 == 0, "admin"))))
    return T.table(s, d, "customer").select("c_custkey", change.alias("c")).select("c_custkey", (F.size("c.add") > 0).alias("added"), (F.size("c.remove") > 0).alias("removed"))


@query("c01_chunk_counts", f"WITH RECURSIVE {T.chunks_sql('documents', 4000, 400)} SELECT doc_id, count(*) AS chunks, CAST(max(length(content)) AS INTEGER) AS longest FROM chunks GROUP BY 1")
def _(s, d):
    return chunking.chunk_table(T.table(s, d, "documents"), ["doc_id"], "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("content")).alias("longest"))


@query("c02_chunk_key", "SELECT doc_id, translate(rtrim(to_base64(encode('drive:' || CAST(doc_id AS VARCHAR) || ':0')), '='), '+/', '-_') AS key FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", keys.chunk_key(F.lit("drive"), F.col("doc_id").cast("string"), F.lit(0)).alias("key"))


@query("c03_permissions_hash", "SELECT doc_id, to_base64(unhex(sha256((doc_id % 2) || chr(10) || 'group:' || (doc_id % 5) || chr(10) || 'user:' || doc_id || chr(10) || chr(10) || 'read'))) AS hash FROM documents")
def _(s, d):
    n = F.col("doc_id")
    p = F.array(F.concat(F.lit("user:"), n.cast("string")), F.concat(F.lit("group:"), (n % 5).cast("string")))
    return T.table(s, d, "documents").select("doc_id", keys.permissions_hash(n % 2 == 1, p, F.array(F.lit("read"))).alias("hash"))


@query("c08_entity_id", "SELECT p_partkey, 'system:' || left(sha256('15:graph-entity/v1;2:t1;6:System;' || length(p_name) || ':' || p_name || ';'), 32) AS id FROM part")
def _(s, d):
    return T.table(s, d, "part").select("p_partkey", keys.entity_id_column(F.lit("t1"), F.lit("System"), F.col("p_name")).alias("id"))


@query("c12_content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", keys.content_hash(F.col("text")).alias("hash"))


@query("c15_partition_bucket", """
WITH h AS (SELECT p_partkey, sha256(p_name || p_partkey) AS h FROM part)
SELECT p_partkey, 't1|' || lpad(CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 64 AS VARCHAR), 4, '0') AS bucket FROM h""")
def _(s, d):
    return T.table(s, d, "part").select("p_partkey", keys.partition_bucket(F.lit("t1"), F.concat("p_name", F.col("p_partkey").cast("string")), 64).alias("bucket"))


@query("c19_line_page", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 6), chr(10)) AS text, CAST(len(string_split(text, chr(10))) AS INTEGER) AS total_lines, CAST(CASE WHEN len(string_split(text, chr(10))) > 6 THEN 7 END AS INTEGER) AS next_line FROM documents")
def _(s, d):
    return text.line_page(T.table(s, d, "documents"), ["doc_id"], "text", 2, 6)


@query("c20_line_grep", "SELECT doc_id, CAST(n AS INTEGER) AS line_number, left(l, 500) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE contains(lower(l), 'licensed') ORDER BY doc_id, n LIMIT 1000")
def _(s, d):
    return text.grep(T.table(s, d, "documents"), ["doc_id"], "text", "LICENSED")[0]


@query("c22_replace", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) // 4 AS INTEGER) AS replaced, CASE WHEN contains(text, 'the ') THEN sha256(replace(text, 'the ', 'THE ')) END AS hash FROM documents")
def _(s, d):
    r = text.replace_text(F.col("text"), "the ", "THE ", True)
    return T.table(s, d, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.replaced", F.sha2("r.text", 256).alias("hash"))


@query("c24_c25_day_keys", "SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, strftime(ts, '%Y-%m-%d') AS day_text, CAST(strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y%m') AS INTEGER) AS next_month FROM events")
def _(s, d):
    day = keys.day_key(F.col("ts"))
    return T.table(s, d, "events").select("event_id", day.alias("day"), keys.day_text(day).alias("day_text"), keys.next_month(keys.month_key(F.col("ts"))).alias("next_month"))


@query("c26_c27_safety_windows", "SELECT doc_id, CAST(i AS INTEGER) AS window, sha256(substr(text, i * 1000 + 1, 1000)) AS hash FROM documents, range(0, 1000) t(i) WHERE i * 1000 < length(text)")
def _(s, d):
    return text.safety_windows(T.table(s, d, "documents"), ["doc_id"], "text", 1000).select("doc_id", "window", F.sha2("content", 256).alias("hash"))


@query("c31_principal_tokens", "SELECT c_custkey, 'user:' || c_custkey || '|email:' || lower(c_name) AS tokens FROM customer")
def _(s, d):
    return T.table(s, d, "customer").select("c_custkey", F.array_join(keys.principal_tokens(F.lit("user"), F.col("c_custkey").cast("string"), F.col("c_name")), "|").alias("tokens"))


@query("c33_json_decode", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("c34_blob_segment", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g') AS segment FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", keys.blob_segment(F.col("url")).alias("segment"))


@query("g01_traversal", f"""
WITH {T.EDGES}, live AS (SELECT * FROM edges WHERE status <> 'Retracted' AND predicate IN ('DEPENDS_ON', 'INTEGRATES_WITH') AND document_id <> 'd5'),
mv AS (SELECT 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS f, 'e' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') AS t FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0),
cn AS (SELECT assertion_id, predicate, coalesce(a.t, subject_id) AS s, coalesce(b.t, object_id) AS o FROM live LEFT JOIN mv a ON a.f = subject_id LEFT JOIN mv b ON b.f = object_id),
one AS (SELECT assertion_id, s AS from_id, o AS to_id FROM cn WHERE s = 'e0000005' AND s <> o UNION ALL SELECT assertion_id, o, s FROM cn WHERE o = 'e0000005' AND s <> o AND predicate = 'INTEGRATES_WITH'),
f AS (SELECT DISTINCT to_id AS id FROM one WHERE to_id <> 'e0000005'),
two AS (SELECT assertion_id, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY assertion_id ORDER BY side, from_id) AS n FROM (SELECT assertion_id, s AS from_id, o AS to_id, 0 AS side FROM cn JOIN f ON s = id UNION ALL SELECT assertion_id, o, s, 1 FROM cn JOIN f ON o = id WHERE predicate = 'INTEGRATES_WITH')) WHERE n = 1 AND from_id <> to_id)
SELECT assertion_id, CAST(1 AS BIGINT) AS depth, from_id, to_id FROM one UNION ALL SELECT assertion_id, CAST(2 AS BIGINT), from_id, to_id FROM two WHERE assertion_id NOT IN (SELECT assertion_id FROM one)""")
def _(s, d):
    states = s.createDataFrame([(f"d{i}", "Failed" if i == 5 else "Ready", "r1") for i in range(20)], "document_id string, status string, active_revision string")
    t = graph.traverse(T.edges(s, d), states, T.entities(s, d), ["e0000005"], ["DEPENDS_ON", "INTEGRATES_WITH"], "out", 2, 1000, 5000)
    return s.createDataFrame(t.edges, "assertion_id string, depth long, from_id string, to_id string")


@query("g03_redirects", "SELECT 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS entity_id, 'e' || lpad(CAST(CASE WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 7, '0') AS canonical FROM part")
def _(s, d):
    e = T.entities(s, d)
    return graph.canonical(e.select("entity_id", F.col("entity_id").alias("canonical")), "canonical", e)


@query("g05_serving_edges", f"WITH {T.EDGES} SELECT assertion_id FROM edges WHERE document_id IN ('d0', 'd10')")
def _(s, d):
    states = s.createDataFrame([("d0", "Ready", "r1"), ("d10", "Ready", "r1"), ("d15", "Ready", "r0"), ("d5", "Failed", "r1")], "document_id string, status string, active_revision string")
    return graph.serving(T.edges(s, d), states).select("assertion_id")


@query("g10_entity_linking", "SELECT p_name AS phrase, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS entity_id, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1")
def _(s, d):
    p = T.table(s, d, "part")
    return graph.link_phrases(p.select(F.col("p_name").alias("phrase")).distinct(), p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id")))


@query("g11_entity_resolution", """
WITH k AS (SELECT p_type, p_name, count(DISTINCT p_brand) AS n, min(p_brand) AS e FROM part GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'alias' ELSE 'ambiguous' END AS decision, CASE WHEN n = 1 THEN e END AS entity_id FROM part LEFT JOIN k ON part.p_type = k.p_type AND part.p_name = k.p_name""")
def _(s, d):
    p = T.table(s, d, "part")
    aliases = p.select(F.col("p_type").alias("entity_type"), F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id"))
    m = p.select(F.col("p_partkey").alias("mention_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("alias"), F.lit(None).cast("string").alias("identifier_entity"))
    none = s.createDataFrame([], "entity_id string, redirect_to string")
    return graph.resolve(m, aliases, none).select(F.col("mention_id").alias("p_partkey"), "decision", "entity_id")


@query("g14_contradictions", f"WITH {T.EDGES} SELECT assertion_id, CASE WHEN predicate = 'SUPERSEDES' AND EXISTS (SELECT 1 FROM edges r WHERE r.predicate = 'SUPERSEDES' AND r.subject_id = e.object_id AND r.object_id = e.subject_id) THEN 'Disputed' ELSE status END AS status FROM edges e")
def _(s, d):
    return graph.mark_contradictions(T.edges(s, d)).select("assertion_id", "status")


@query("g23_reconciliation", """
SELECT 'd' || doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'stale' END AS reason FROM documents
WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0 ORDER BY 1 LIMIT 100""")
def _(s, d):
    n = F.col("doc_id")
    f = T.table(s, d, "documents").select(F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.lit("r1").alias("revision"))
    st = T.table(s, d, "documents").filter("doc_id % 5 <> 0").select(F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.when(n % 7 == 0, "Failed").otherwise("Ready").alias("status"), F.when(n % 3 == 0, "r0").otherwise("r1").alias("active_revision"), F.lit("v1").alias("active_version"), F.lit(None).cast("string").alias("pending_revision"))
    return graph.reconcile(f, st, "v1")[0]


@query("st03_sweep", f"WITH {T.FILES} SELECT item_id FROM files WHERE (drive_id = 'drive0' AND scan_id <> 's1')")
def _(s, d):
    state = s.createDataFrame([("drive0", "s1", None, "link"), ("drive1", "s1", "s1", "link"), ("drive2", "s1", None, "")], "drive_id string, scan_id string, swept_scan_id string, delta_link string")
    return indexing.sweep(T.files(s, d), state).select("item_id")


@query("st15_latest_piece", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(s, d):
    return conversations.latest_piece(T.table(s, d, "events"), ["user_id", "event_type"], "event_id", "value")


@query("st17_changed_only", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p")
def _(s, d):
    return conversations.changed_only(T.table(s, d, "events"), ["user_id"], ["event_id"], "event_type").select("event_id")


@query("s08_replace_items", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id % 5 <> 0 OR turn < 2")
def _(s, d):
    c = T.table(s, d, "conversations").select("conv_id", "turn", "role")
    return indexing.replace_items(c, c.filter("conv_id % 5 = 0 and turn < 2").withColumn("role", F.lit("new")), ["conv_id"])


@query("s09_merge_metadata", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def _(s, d):
    c = T.table(s, d, "embeddings").select("vec_id", "label")
    return indexing.merge_metadata(c, c.filter("vec_id % 3 = 0").withColumn("label", F.lit(-1)), "vec_id", ["label"])[0]


@query("s10_delete_items", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 1")
def _(s, d):
    c = T.table(s, d, "conversations").select("conv_id", "turn")
    return indexing.delete_items(c, c.filter("conv_id % 4 = 1"), ["conv_id"])


@query("s11_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN left(c_name, 10) ELSE c_name END AS c_name FROM customer")
def _(s, d):
    c = T.table(s, d, "customer").select("c_custkey", "c_name")
    return indexing.upsert(c, indexing.truncated(c.filter("c_custkey % 2 = 0"), {"c_name": 10}), ["c_custkey"])


@query("s28_append_messages", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user' FROM conversations GROUP BY 1")
def _(s, d):
    m = T.table(s, d, "conversations")
    fresh = m.groupBy("conv_id").agg(F.lit(1).alias("arrival")).select("conv_id", "arrival", F.lit("user").alias("role"), F.lit("more").alias("text"))
    return conversations.append(m, fresh).select("conv_id", "turn", "role")


@query("s29_branch", "SELECT conv_id + 1000000 AS conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn <= 2")
def _(s, d):
    return conversations.branch(T.table(s, d, "conversations"), F.lit(3), 2, F.lit(1_000_003).cast("long")).select("conv_id", "turn", "role")
