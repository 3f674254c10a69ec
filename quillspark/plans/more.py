"""More registered queries: state tables, graph state, listings and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import access, conversations, graph, indexing, retrieval, state, usage
from . import tables as T
from .queries import query


@query("s03_recycle_bin", "SELECT user_id AS item_id, arg_max(event_type, event_id) AS name, max(event_id) AS deleted_at FROM events GROUP BY 1")
def _(s, d):
    from ..sources.feed import recycle_bin

    e = T.table(s, d, "events")
    return recycle_bin(e.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("name"), F.col("event_id").alias("deleted_at"), F.col("event_id").alias("arrival")))


@query("s06_chunks_of_file", "SELECT turn AS chunk_number, role AS content FROM conversations WHERE conv_id = 4 ORDER BY turn")
def _(s, d):
    return T.table(s, d, "conversations").filter("conv_id = 4").orderBy("turn").select(F.col("turn").alias("chunk_number"), F.col("role").alias("content"))


@query("s07_authorized_lookup", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND (label = 0 OR label % 4 = 1)")
def _(s, d):
    ok = access.permission_filter(F.col("label") == 0, F.array(F.concat(F.lit("g"), (F.col("label") % 4).cast("string"))), "u", ["g1"])
    return T.table(s, d, "embeddings").filter(ok).join(T.table(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id")


@query("s12_delta_state", """
WITH old AS (SELECT s_suppkey AS k, 'l1' AS link, 's1' AS scan, CASE WHEN s_suppkey % 2 = 0 THEN 's0' END AS swept FROM supplier),
fresh AS (SELECT s_suppkey * 2 AS k FROM supplier)
SELECT 'd' || coalesce(old.k, fresh.k) AS drive_id, CASE WHEN coalesce(old.k, fresh.k) IN (2, 3) THEN '' WHEN fresh.k IS NOT NULL THEN 'l2' ELSE link END AS delta_link,
  CASE WHEN fresh.k IS NOT NULL THEN 's2' ELSE scan END AS scan_id, CASE WHEN coalesce(old.k, fresh.k) NOT IN (2, 3) THEN swept END AS swept_scan_id FROM old FULL JOIN fresh ON old.k = fresh.k""")
def _(s, d):
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("d"), c.cast("string")).alias("drive_id")
    old = T.table(s, d, "supplier").select(name(k), F.lit("l1").alias("delta_link"), F.lit("s1").alias("scan_id"), F.when(k % 2 == 0, "s0").alias("swept_scan_id"))
    fresh = T.table(s, d, "supplier").select(name(k * 2), F.lit("l2").alias("delta_link"), F.lit("s2").alias("scan_id"))
    return state.reset_delta_state(state.set_delta_state(old, fresh), ["d2", "d3"])


@query("s15_archive_once", "SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'old' ELSE arg_min(o_orderpriority, o_orderkey) END AS v FROM orders GROUP BY 1")
def _(s, d):
    o = T.table(s, d, "orders")
    old = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.lit("old").alias("v")).distinct()
    return state.archive_once(old, o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("arrival")), ["k"])


@query("s16_state_batch", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def _(s, d):
    return T.table(s, d, "supplier").join(F.broadcast(s.createDataFrame([(1,), (3,), (5,)], "s_suppkey long")), "s_suppkey", "left_semi").select("s_suppkey")


@query("s17_edge_copies", f"WITH {T.EDGES} SELECT assertion_id, subject_id AS anchor FROM edges UNION ALL SELECT assertion_id, object_id FROM edges")
def _(s, d):
    return T.edges(s, d).select("assertion_id", F.explode(F.array("subject_id", "object_id")).alias("anchor"))


@query("s18_status_patch", f"WITH {T.EDGES} SELECT assertion_id, CASE WHEN subject_id = 'e0000005' THEN 'Retracted' ELSE status END AS status FROM edges")
def _(s, d):
    e = T.edges(s, d)
    return graph.retract(e, e.filter("subject_id = 'e0000005'")).select("assertion_id", "status")


@query("s19_conditional_write", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS token, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM supplier UNION ALL SELECT -1, 1, 'new'")
def _(s, d):
    t = T.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1).cast("long").alias("token"), F.lit("old").alias("value"))
    w = t.filter("id % 3 = 0").withColumn("value", F.lit("new")).unionByName(t.filter("id % 3 = 1").select("id", F.lit(9).cast("long").alias("token"), F.lit("lost").alias("value")))
    w = w.unionByName(s.createDataFrame([(-1, None, "new"), (-1, None, "second"), (2, None, "lost")], "id long, token long, value string"))
    w = w.unionByName(t.filter("id % 3 = 0").withColumn("value", F.lit("second")))
    return state.conditional_write(t, w, "id")[0]


@query("s20_alias_find", "SELECT p_name AS alias, array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS ids FROM part WHERE p_type = 'ECONOMY' AND p_size < 20 GROUP BY 1")
def _(s, d):
    p = T.table(s, d, "part")
    a = state.upsert_aliases(p.limit(0).select(F.lit("t").alias("tenant"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id")), p.filter("p_size < 20").select(F.lit("t").alias("tenant"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id")))
    return state.find_aliases(a, p.select(F.col("p_name").alias("alias")).distinct(), "t", "ECONOMY").select("alias", F.array_join("entity_ids", "|").alias("ids"))


@query("s22_webhook_signals", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND event_id % 5 <> 0")
def _(s, d):
    from ..streaming.ingest import signals

    n = T.table(s, d, "events").select("event_id", F.col("user_id").alias("subscription_id"), F.when(F.col("event_id") % 5 != 0, "ok").otherwise("bad").alias("client_state"), F.col("event_id").alias("received_at"))
    subs = n.filter("subscription_id % 3 <> 0").select("subscription_id", F.lit("ok").alias("client_state"), F.lit("d").alias("drive_id")).distinct()
    return signals(n, subs)[0].select(F.col("received_at").alias("event_id"))


@query("s24_j07_ledger_append", "SELECT o_orderkey, CASE WHEN k = 1 THEN u END AS user_id FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k, min(l_suppkey) AS u FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(s, d):
    links = T.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count_distinct("l_suppkey") == 1, F.min("l_suppkey")).alias("user_id"))
    return T.table(s, d, "orders").select("o_orderkey").join(links, "o_orderkey", "left")


@query("s30_delete_conversations", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def _(s, d):
    m = T.table(s, d, "conversations")
    return conversations.delete_conversations(m, m.filter("role = 'system'")).select("conv_id", "turn")


@query("s31_ledger_biller", f"WITH {T.LEDGER} SELECT event_id, coalesce(user_id, question_id) AS biller FROM ledger")
def _(s, d):
    from ..streaming.ingest import inherited

    return T.ledger(s, d).select("event_id", inherited(F.col("user_id"), F.col("question_id")).alias("biller"))


@query("p02_allow_list", f"WITH {T.FILES} SELECT item_id FROM files WHERE doc_id % 4 IN (0, 1)")
def _(s, d):
    return T.files(s, d).filter(indexing.extension_allowed(F.col("name"), [" pdf", ".DOCX"])).select("item_id")


@query("p05_same_properties", f"WITH {T.FILES} SELECT count(*) AS n FROM files WHERE doc_id % 11 <> 0")
def _(s, d):
    moved = T.files(s, d).withColumn("parent_path", F.when(F.col("item_id").cast("long") % 11 == 0, F.lit(None)).otherwise(F.col("parent_path")))
    return moved.alias("i").join(T.files(s, d).alias("t"), F.col("i.item_id") == F.col("t.item_id")).filter(indexing.same_properties("i", "t")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_feedback_search", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the')")
def _(s, d):
    return T.table(s, d, "conversations").filter(F.col("role") == "assistant").filter(conversations.contains_any("The", "text")).select("conv_id", "turn")


@query("p10_half_open_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def _(s, d):
    return T.table(s, d, "events").filter("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-07' + INTERVAL 1 DAY").select("event_id")


@query("p12_reference_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'R' OR l_partkey = 7 OR l_suppkey = 7")
def _(s, d):
    return T.table(s, d, "lineitem").filter("l_returnflag = 'R' OR l_linestatus = 'R' OR l_partkey = 7 OR l_suppkey = 7").select("l_orderkey", "l_linenumber")


@query("p14_serving", "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS serving FROM documents")
def _(s, d):
    n = F.col("doc_id")
    return T.table(s, d, "documents").select("doc_id", ((F.when(n % 3 == 0, "Failed").otherwise("Ready") == "Ready") & (F.when(n % 5 == 0, "r0").otherwise("r1") == "r1")).alias("serving"))


@query("p17_edge_filter", f"WITH {T.EDGES} SELECT assertion_id FROM edges WHERE status <> 'Retracted' AND predicate = 'DEPENDS_ON'")
def _(s, d):
    return T.edges(s, d).filter("status <> 'Retracted' AND predicate = 'DEPENDS_ON'").dropDuplicates(["assertion_id"]).select("assertion_id")


@query("j06_usage_user_file", f"WITH {T.LEDGER}, {T.USERS} SELECT event_id, name, lang FROM ledger l LEFT JOIN users u ON l.user_id = u.user_id LEFT JOIN documents ON doc_id = event_id")
def _(s, d):
    docs = T.table(s, d, "documents").select(F.col("doc_id").alias("event_id"), "lang")
    return T.ledger(s, d).select("event_id", "user_id").join(T.users(s, d).select("user_id", "name"), "user_id", "left").join(docs, "event_id", "left").select("event_id", "name", "lang")


@query("j09_linked_attachments", "SELECT DISTINCT c_nationkey, l_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY'")
def _(s, d):
    c = T.table(s, d, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_nationkey")
    o = T.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"))
    return c.join(o, "c_custkey").join(T.table(s, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey").select("c_nationkey", "l_suppkey").distinct()


@query("j11_touched_workspaces", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def _(s, d):
    return T.table(s, d, "nation").join(T.table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select("n_nationkey")


@query("j13_j14_tracked_lookup", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j15_orphan_states", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return T.table(s, d, "labels").join(T.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("j17_g06_evidence", """
SELECT 'a' || doc_id AS assertion_id, CASE WHEN doc_id % 7 = 0 THEN 'tenant' WHEN doc_id % 5 = 0 THEN 'revision' WHEN doc_id % 3 = 0 THEN 'unauthorized' WHEN doc_id % 4 = 1 THEN 'content' END AS reason FROM documents""")
def _(s, d):
    n = F.col("doc_id")
    docs = T.table(s, d, "documents").select("doc_id", "lang")
    e = docs.select(F.concat(F.lit("a"), n.cast("string")).alias("assertion_id"), F.when(n % 7 == 0, "other").otherwise("t").alias("tenant"), F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.when(n % 5 == 0, "r0").otherwise("r1").alias("document_version"), F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"), keys.content_hash(F.when(n % 4 == 1, F.lit("changed")).otherwise(F.col("lang"))).alias("chunk_hash"), n.alias("position"))
    rev = docs.select(F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.lit("r1").alias("revision"))
    chunks = docs.filter("doc_id % 3 <> 0").select(F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"), F.concat(F.lit("d"), n.cast("string")).alias("document_id"), F.col("lang").alias("content"))
    return graph.verify(e, rev, chunks, "t", 2_000_000_000)


@query("j19_manifest_endpoints", f"WITH {T.EDGES} SELECT DISTINCT subject_id AS id FROM edges WHERE document_id IN ('d0', 'd5') UNION SELECT object_id FROM edges WHERE document_id IN ('d0', 'd5')")
def _(s, d):
    e = T.edges(s, d).join(s.createDataFrame([("d0",), ("d5",)], "document_id string"), "document_id", "left_semi")
    return e.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()


@query("j20_relation_refs", f"WITH {T.EDGES} SELECT assertion_id, a.p_brand AS subject, b.p_brand AS object FROM edges JOIN part a ON subject_id = 'e' || lpad(CAST(a.p_partkey AS VARCHAR), 7, '0') JOIN part b ON object_id = 'e' || lpad(CAST(b.p_partkey AS VARCHAR), 7, '0')")
def _(s, d):
    p = T.table(s, d, "part").select(F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"), "p_brand")
    return T.edges(s, d).join(p.select(F.col("id").alias("subject_id"), F.col("p_brand").alias("subject")), "subject_id").join(p.select(F.col("id").alias("object_id"), F.col("p_brand").alias("object")), "object_id").select("assertion_id", "subject", "object")


@query("j23_own_or_workspace", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE n_name END AS binding FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 2 <> 0")
def _(s, d):
    n = T.table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return T.table(s, d, "customer").join(F.broadcast(n), "c_nationkey", "left").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("n_name")).alias("binding"))


@query("j24_children_by_name", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey ORDER BY r_name, n_name")
def _(s, d):
    n = T.table(s, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return T.table(s, d, "region").join(n, "r_regionkey").orderBy("r_name", "n_name").select("r_name", "n_name")


@query("a30_minimum_expiry", "SELECT o_orderstatus, min(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END) AS expiry FROM orders GROUP BY 1")
def _(s, d):
    return T.table(s, d, "orders").groupBy("o_orderstatus").agg(F.min(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))).alias("expiry"))


@query("a32_usage_sum", f"WITH {T.LEDGER} SELECT CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, count(*) AS calls FROM ledger WHERE model_id = 'view'")
def _(s, d):
    return usage.model_filter(T.ledger(s, d), "view").agg(usage.total("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


@query("a35_count_by_type", "SELECT l_returnflag || ': ' || count(*) AS line FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return T.table(s, d, "lineitem").groupBy("l_returnflag").count().select(F.concat_ws(": ", "l_returnflag", F.col("count").cast("string")).alias("line"))


@query("w06_budget", """
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r(conv_id, i, used, k, taken) AS (SELECT conv_id, 0, CAST(0 AS BIGINT), 0, '' FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT o.conv_id, CAST(o.i AS INTEGER), CASE WHEN k < 3 AND used + n <= 2000 THEN used + n ELSE used END, CASE WHEN k < 3 AND used + n <= 2000 THEN k + 1 ELSE k END,
  CASE WHEN k < 3 AND used + n <= 2000 THEN taken || ',' || turn ELSE taken END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1)
SELECT conv_id, ltrim(arg_max(taken, i), ',') AS taken FROM r GROUP BY 1""")
def _(s, d):
    m = T.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("m"))
    taken = retrieval.within_budget(F.transform("m", lambda x: x["turn"]), F.transform("m", lambda x: x["n"]), 3, 2000)
    return m.select("conv_id", F.array_join(F.transform(taken, lambda x: x.cast("string")), ",").alias("taken"))


@query("w07_reading_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 7 <> 0 THEN p_size END ASC NULLS LAST, p_retailprice, p_partkey) AS INTEGER) AS n FROM part")
def _(s, d):
    y = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return T.table(s, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(y.asc_nulls_last(), "p_retailprice", "p_partkey")).alias("n"))


@query("w08_last_heartbeat", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(s, d):
    return T.table(s, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w09_capped_history", "SELECT o_custkey, array_to_string(list_append(list_sort(list(CAST(o_orderkey AS VARCHAR)))[-4:], 'new'), ',') AS history FROM orders GROUP BY 1")
def _(s, d):
    o = T.table(s, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"))
    o = o.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("k")))).filter("n <= 4")  # before anything is gathered
    h = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("k")).alias("h"))
    return h.select("o_custkey", F.array_join(state.capped_history(F.col("h"), F.lit("new"), 5), ",").alias("history"))


@query("t09_folders_first", "SELECT name FROM (SELECT n_name AS name, n_nationkey % 3 = 0 AS folder FROM nation) ORDER BY folder DESC, lower(name)")
def _(s, d):
    return T.table(s, d, "nation").orderBy((F.col("n_nationkey") % 3 == 0).desc(), F.lower("n_name")).select(F.col("n_name").alias("name"))


@query("t11_longest_first", "SELECT p_name, min(p_partkey) AS first_at FROM part GROUP BY 1 ORDER BY length(p_name) DESC, first_at LIMIT 15")
def _(s, d):
    return T.table(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_at")).orderBy(F.length("p_name").desc(), "first_at").limit(15)


@query("t12_subscription_order", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey % 2 = 0 DESC, s_suppkey % 3 = 0 DESC, s_suppkey % 5 = 0 DESC, s_acctbal, s_suppkey LIMIT 12")
def _(s, d):
    k = F.col("s_suppkey")
    rows = T.table(s, d, "supplier").select("s_suppkey", (k % 2 == 0).alias("is_default"), (k % 3 == 0).alias("is_tracked"), (k % 5 == 0).alias("is_managed"), F.col("s_acctbal").alias("expires_at"))
    return state.signal_quality(rows, ["s_suppkey"]).limit(12).select("s_suppkey")


@query("t14_attachment_page", "SELECT page_id FROM pages WHERE contains(lower(url), 'en') ORDER BY page_id DESC LIMIT 10 OFFSET 3")
def _(s, d):
    return T.table(s, d, "pages").filter(conversations.contains_any("EN", "url")).orderBy(F.desc("page_id")).offset(3).limit(10).select("page_id")


@query("u03_manifest_union", "SELECT k, CASE WHEN k % 2 = 0 THEN 'first' ELSE 'second' END AS v FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0)")
def _(s, d):
    k = T.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    both = k.filter("k % 2 = 0").select("k", F.lit("first").alias("v"), F.lit(0).alias("o")).unionByName(k.filter("k % 3 = 0").select("k", F.lit("second").alias("v"), F.lit(1).alias("o")))
    return graph.first_by(both, ["k"], ["o"]).select("k", "v")


@query("u09_not_replayed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 20")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(20)


@query("c10_c11_document_revision", "SELECT doc_id, 'drive:' || doc_id AS document_id, 'rev:' || left(sha256(length('c' || doc_id) || ':c' || doc_id || ';3:fp1;'), 32) AS revision FROM documents")
def _(s, d):
    n = F.col("doc_id").cast("string")
    return T.table(s, d, "documents").select("doc_id", keys.document_id(F.lit("drive"), n).alias("document_id"), keys.revision_id(F.concat(F.lit("c"), n), F.lit(None).cast("string"), F.lit("fp1")).alias("revision"))


@query("c16_c17_grounded_quotes")
def _(s, d):
    """Every whole text, with a quote from its middle; folding is Unicode's, which SQL lacks: tested against plain Python."""
    docs = T.table(s, d, "documents").select("doc_id", F.col("text").alias("t"), F.substr("text", F.floor(F.length("text") / 2).cast("int"), F.lit(40)).alias("q"))
    folded = docs.select("doc_id", keys.fold_text(F.col("t")).alias("t"), keys.fold_text(F.upper("q")).alias("q"))
    return folded.select("doc_id", text.grounded_quote(F.col("t"), F.col("q")).alias("grounded"))


@query("c21_text_window", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS window FROM documents")
def _(s, d):
    return text.line_page(T.table(s, d, "documents"), ["doc_id"], "text", 1, 3).select("doc_id", F.col("text").alias("window"))


@query("c23_headings", "SELECT page_id, regexp_matches(html, '(?m)^ {0,3}#{1,6}[ \\t]+\\S') AS heading FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", text.has_heading(F.col("html")).alias("heading"))


@query("c28_retry_delay", "SELECT n_nationkey, least(1800.0, 15.0 * pow(2, n_nationkey)) AS delay FROM nation")
def _(s, d):
    return T.table(s, d, "nation").select("n_nationkey", text.retry_delay(F.col("n_nationkey") + 1, jitter=F.lit(1.0)).alias("delay"))


@query("c29_head_tail", "SELECT doc_id, left(text, 20) AS head, right(text, 20) AS tail FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", text.head(F.col("text"), 20).alias("head"), text.tail(F.col("text"), 20).alias("tail"))


@query("c35_package_hash", "SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text), chr(10) ORDER BY CAST(turn AS VARCHAR))) AS hash FROM conversations GROUP BY 1")
def _(s, d):
    m = T.table(s, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("path"), F.col("text").alias("content"))
    return state.package_hash(m, "conv_id")


@query("c36_attribute_merge", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END AS a, 'x' AS b FROM part")
def _(s, d):
    old = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.lit("old")))
    merged = state.merge_attributes(old, F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("x")))
    return T.table(s, d, "part").select("p_partkey", merged.alias("m")).select("p_partkey", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


@query("c37_label_catalog", "SELECT lower('N' || n_nationkey) AS label_id, r_name || ' · ' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower('R' || r_regionkey), r_name FROM region")
def _(s, d):
    r = T.table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("position"))
    n = T.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"), F.lit(1).alias("position"))
    return state.flat_catalog(r.unionByName(n))


@query("c39_embedding_sum", f"WITH {T.LEDGER} SELECT question_id, CAST(sum(greatest(coalesce(input_tokens, 0) - 10, 0)) AS BIGINT) AS tokens FROM ledger GROUP BY 1")
def _(s, d):
    x = F.coalesce("input_tokens", F.lit(0)) - 10
    return T.ledger(s, d).groupBy("question_id").agg(F.sum(F.greatest(x, F.lit(0))).cast("long").alias("tokens"))


@query("g07_reachable", """
SELECT 'x' || n_nationkey AS assertion_id, n_regionkey AS depth FROM nation WHERE n_nationkey % 7 <> 0""")
def _(s, d):
    n = T.table(s, d, "nation").filter("n_nationkey % 7 <> 0")
    e = n.select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("assertion_id"), F.col("n_regionkey").alias("depth"), F.col("n_regionkey").cast("string").alias("from_id"), (F.col("n_regionkey") + 1).cast("string").alias("to_id"))
    return graph.reachable(e, s.createDataFrame([("0",)], "id string")).select("assertion_id", "depth")


@query("g15_alias_derivation", "SELECT DISTINCT lower(p_name) AS alias FROM part")
def _(s, d):
    return T.table(s, d, "part").select("p_name").distinct().select(keys.normalize_name(F.col("p_name")).alias("alias")).distinct()


@query("g18_apply_snapshot", f"WITH {T.EDGES} SELECT assertion_id, CASE WHEN document_id = 'd0' AND predicate <> 'DEPENDS_ON' THEN 'Retracted' ELSE status END AS status FROM edges")
def _(s, d):
    e = T.edges(s, d)
    mine = e.filter("document_id = 'd0'")
    return graph.apply_snapshot(e, mine, mine.filter("predicate = 'DEPENDS_ON'"))[0].select("assertion_id", "status")


@query("g20_entity_merge", "SELECT p_brand AS entity_id, min(p_name) AS canonical_name, array_to_string(list_concat(list_sort(list(DISTINCT p_type)), list_filter(list_sort(list(DISTINCT p_name)), lambda x: true))[1:50], '|') AS aliases FROM part GROUP BY 1")
def _(s, d):
    p = T.table(s, d, "part").groupBy(F.col("p_brand").alias("entity_id")).agg(F.min("p_name").alias("canonical_name"), F.array_sort(F.collect_set("p_type")).alias("aliases"))
    names = T.table(s, d, "part").groupBy(F.col("p_brand").alias("entity_id")).agg(F.lit("other").alias("canonical_name"), F.array_sort(F.collect_set("p_name")).alias("aliases"))
    return graph.merge_entity(p, names).select("entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query("st02_scan_rounds", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 's1' END AS scan_id FROM supplier")
def _(s, d):
    t = T.table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, "link").alias("delta_link"), F.lit("s1").alias("scan_id"))
    return state.next_scan(t, F.lit("new")).select("s_suppkey", "scan_id")


@query("st10_retention", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-31' - INTERVAL 30 DAY)")
def _(s, d):
    o = T.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Retracted").otherwise("Active").alias("status"), F.col("o_orderdate").alias("retracted_at"))
    return graph.expired(o, F.expr("timestamp_ntz'1999-01-31 00:00:00'")).select("o_orderkey")


@query("st14_fallback_once", f"WITH {T.LEDGER} SELECT DISTINCT o_orderkey AS question_id FROM orders WHERE o_orderkey NOT IN (SELECT question_id FROM ledger)")
def _(s, d):
    from ..streaming.ingest import once_per_question

    return once_per_question(T.ledger(s, d), T.table(s, d, "orders").select(F.col("o_orderkey").alias("question_id")).distinct())
