"""Registered queries of snapshots, the chunk index, attachments and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import access, index, indexing, retrieval, snapshot, state, usage
from ..operators.graph import adjacency_page, same_types
from . import tables as T
from .queries import query

#: For the SQL side: an entity's id from its name.
_ENTITY = "lower(CASE WHEN p_partkey % 2 = 0 THEN 'System' ELSE 'Project' END) || ':' || p_partkey"


def _snapshots(s, d):
    """Suppliers as documents, their parts as entities, line items as assertions, with one fault in every seventh or so."""
    k, p, n = F.col("s_suppkey"), F.col("p_partkey"), F.col("position")
    doc = lambda c: F.concat(F.lit("drive:"), c.cast("string"))
    head = T.table(s, d, "supplier").select(doc(k).alias("document_id"), F.when(k % 7 == 0, "a/b").otherwise("t").alias("tenant"), F.when(k % 11 == 0, "").otherwise("r1").alias("document_version"), F.when(k % 13 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 17 == 0, "v0").otherwise("v1").alias("ontology_version"), F.lit("x1").alias("extraction_version"))
    suppliers = head.count()
    part = T.table(s, d, "part").select(p, doc(p % suppliers + 1).alias("document_id"), F.floor(p / suppliers).cast("int").alias("position"), F.when(p % 2 == 0, "System").otherwise("Project").alias("kind"), "p_name", "p_type")
    entities = part.select(
        "document_id", n, F.when(p % 19 == 0, "u").otherwise("t").alias("tenant"), F.concat(F.when(p % 23 == 0, "team").otherwise(F.lower("kind")), F.lit(":"), p.cast("string")).alias("entity_id"),
        F.when(p % 29 == 0, "Planet").otherwise(F.col("kind")).alias("entity_type"), F.when(p % 31 == 0, " ").otherwise(F.col("p_name")).alias("canonical_name"),
        F.when(p % 37 == 0, F.lit(None)).when(p % 41 == 0, F.array(F.lit("Same"), F.lit("same"), F.lit(""))).otherwise(F.array("p_type")).alias("aliases"),
        F.when(p % 43 == 0, F.create_map(F.lit("colour"), F.lit("x"))).when((p % 47 == 0) & (p % 2 == 0), F.create_map(F.lit("vendor"), F.lit(" "))).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"),
    )
    return head, entities, part


@query("g16_snapshot_errors", f"""
WITH s AS (SELECT 'drive:' || s_suppkey AS doc, s_suppkey AS k FROM supplier), m AS (SELECT count(*) AS n FROM supplier),
h AS (SELECT doc, CASE WHEN k % 7 = 0 THEN 'a/b' ELSE 't' END AS tenant, k FROM s),
e AS (SELECT h.doc, h.tenant AS ht, p_partkey AS p, 'entities[' || (p_partkey // m.n) || ']' AS path, CASE WHEN p_partkey % 19 = 0 THEN 'u' ELSE 't' END AS tenant FROM part, m JOIN h ON h.doc = 'drive:' || (p_partkey % m.n + 1)),
r AS (SELECT doc, 'identifier.invalid' AS code, 'tenantId' AS path FROM h WHERE k % 7 = 0
  UNION ALL SELECT doc, 'required', 'documentVersion' FROM h WHERE k % 11 = 0 UNION ALL SELECT doc, 'schema.version', 'schemaVersion' FROM h WHERE k % 13 = 0
  UNION ALL SELECT doc, 'ontology.version', 'extraction.ontologyVersion' FROM h WHERE k % 17 = 0
  UNION ALL SELECT doc, 'tenant.mismatch', path || '.tenantId' FROM e WHERE tenant <> ht
  UNION ALL SELECT doc, 'entityType.unknown', path || '.entityType' FROM e WHERE p % 29 = 0
  UNION ALL SELECT doc, 'entity.idType', path || '.entityId' FROM e WHERE p % 23 = 0 AND p % 29 <> 0
  UNION ALL SELECT doc, 'required', path || '.canonicalName' FROM e WHERE p % 31 = 0
  UNION ALL SELECT doc, 'required', path || '.aliases' FROM e WHERE p % 37 = 0
  UNION ALL SELECT doc, 'entity.aliasDuplicate', path || '.aliases[1]' FROM e WHERE p % 41 = 0 AND p % 37 <> 0
  UNION ALL SELECT doc, 'required', path || '.aliases[2]' FROM e WHERE p % 41 = 0 AND p % 37 <> 0
  UNION ALL SELECT doc, 'entity.attribute', path || '.attributes[0]' FROM e WHERE p % 43 = 0 AND p % 29 <> 0
  UNION ALL SELECT doc, 'limit.exceeded', path || '.attributes[0]' FROM e WHERE p % 47 = 0 AND p % 2 = 0 AND p % 43 <> 0 AND p % 29 <> 0)
SELECT doc AS document_id, code, path FROM r""")
def _(s, d):
    head, entities, _ = _snapshots(s, d)
    none = entities.limit(0)
    evidence = "struct<tenant:string,document_id:string,document_version:string,chunk_id:string,chunk_content_hash:string,section:string,page:int,access_scope_ref:string>"
    a = none.select("document_id", "position", "tenant", *(F.lit("").alias(c) for c in ("assertion_id", "subject_id", "predicate", "object_id", "status", "ontology_version", "extraction_version")), F.lit(None).cast(evidence).alias("evidence"))
    r = none.select("document_id", "position", *(F.lit("").alias(c) for c in ("local_ref", "entity_id", "method")), F.lit(None).cast("array<string>").alias("candidates"))
    return snapshot.validate(head, entities, a, r, limits=snapshot.Limits(entities=10**6, errors=10**6)).select("document_id", "code", "path")


@query("g13_assertion_build", f"""
WITH e AS (SELECT p_partkey, {_ENTITY} AS id, CASE WHEN p_partkey % 2 = 0 THEN 'System' ELSE 'Project' END AS t FROM part),
l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS a, (l_partkey * 7 + l_linenumber * 31) % (SELECT count(*) FROM part) AS b, CASE l_linenumber % 2 WHEN 0 THEN 'INTEGRATES_WITH' ELSE 'DEPENDS_ON' END AS p FROM lineitem),
j AS (SELECT l.*, x.id AS x, y.id AS y FROM l JOIN e x ON x.p_partkey = a JOIN e y ON y.p_partkey = b WHERE a <> b AND y.t = 'System' AND (p = 'DEPENDS_ON' OR x.t = 'System'))
SELECT DISTINCT 'drive:' || l_orderkey AS document_id, CASE WHEN p = 'INTEGRATES_WITH' THEN least(x, y) ELSE x END AS subject_id, p AS predicate, CASE WHEN p = 'INTEGRATES_WITH' THEN greatest(x, y) ELSE y END AS object_id, left(sha256('text ' || l_orderkey), 64) AS hash FROM j""")
def _(s, d):
    rows = T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    parts = T.table(s, d, "part")
    n, line, p = parts.count(), F.col("l_linenumber"), F.col("l_partkey")
    ref = lambda c: F.concat(F.lit("r"), c.cast("string"))
    chunk = F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("chunk_id")
    relations = rows.select(chunk, line.alias("position"), ref(p).alias("subject_ref"), F.when(line % 2 == 0, "INTEGRATES_WITH").otherwise("DEPENDS_ON").alias("predicate"), ref((p * 7 + line * 31) % n).alias("object_ref"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "System").otherwise("Project")
    named = parts.select(ref(F.col("p_partkey")).alias("ref"), F.concat(F.lower(kind), F.lit(":"), F.col("p_partkey").cast("string")).alias("entity_id"), kind.alias("entity_type"))
    used = relations.select("chunk_id", F.explode(F.array("subject_ref", "object_ref")).alias("ref"))
    key = F.col("l_orderkey").cast("string")
    chunks = rows.select("l_orderkey").distinct().select(F.concat(F.lit("c"), key).alias("chunk_id"), F.lit(0).alias("chunk_number"), F.lit("t").alias("tenant"), F.concat(F.lit("drive:"), key).alias("document_id"), F.lit("r1").alias("document_version"), F.concat(F.lit("text "), key).alias("content"), F.lit("perm:x").alias("access_scope_ref"))
    built = snapshot.build_assertions(relations, used.join(named, "ref"), chunks)
    return built.select("document_id", "subject_id", "predicate", "object_id", F.substring("evidence.chunk_content_hash", 8, 64).alias("hash"))


@query("g19_retraction", f"""
WITH {T.EDGES} SELECT assertion_id, CASE WHEN document_id IN ('d1', 'd2') THEN 'Retracted' ELSE status END AS status,
  CASE WHEN document_id IN ('d1', 'd2') AND status <> 'Retracted' THEN TIMESTAMP '2024-01-01' END AS retracted_at FROM edges""")
def _(s, d):
    e = T.edges(s, d)
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    states = e.groupBy("document_id").agg(F.array_sort(F.collect_set("assertion_id")).alias("manifest")).select(F.lit("t").alias("tenant"), "document_id", F.lit("Ready").alias("status"), F.lit("r1").alias("active_revision"), F.lit("v1").alias("active_extraction_version"), F.lit(None).cast("string").alias("pending_revision"), "manifest", F.array().cast("array<string>").alias("pending_manifest"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    gone = snapshot.tombstone(states, states.filter("document_id in ('d1', 'd2')"), now)
    return snapshot.settle(e.withColumn("retracted_at", F.lit(None).cast("timestamp_ntz")), gone, now)[0].select("assertion_id", "status", "retracted_at")


@query("g22_adjacency_page", f"""
WITH {T.EDGES} SELECT assertion_id FROM edges WHERE status <> 'Retracted' AND (subject_id = 'e0000003' OR (object_id = 'e0000003' AND predicate = 'INTEGRATES_WITH')) ORDER BY 1 LIMIT 7""")
def _(s, d):
    return adjacency_page(T.edges(s, d), s.createDataFrame([("e0000003",)], "id string"), "out", 7)[0].select("assertion_id")


@query("g17_ontology_errors", """
WITH t AS (SELECT s_nationkey AS o, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, CASE WHEN s_suppkey % 7 = 0 THEN 'bad ' ELSE 'T' END || s_suppkey % 5 AS name FROM supplier),
k AS (SELECT o, list(DISTINCT name) AS known FROM t GROUP BY 1),
r AS (SELECT c_nationkey AS o, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, CASE WHEN c_custkey % 11 = 0 THEN 'lower' ELSE 'P_' || c_custkey % 40 END AS p,
  CASE WHEN c_custkey % 13 = 0 THEN [] ELSE ['T' || c_custkey % 5] END AS s, ['T' || c_custkey % 6, 'T' || c_custkey % 5] AS ob, c_custkey % 3 = 0 AS sy, c_custkey % 9 = 0 AS an, c_custkey % 4 = 0 AS sa FROM customer),
f AS (SELECT *, 'relations[' || pos || ']: ' AS w, row_number() OVER (PARTITION BY o, p ORDER BY pos) AS n FROM r)
SELECT o AS ontology_id, 'types[' || pos || ']: bad name ' || name AS error FROM t WHERE name LIKE 'bad %'
UNION ALL SELECT o, 'types[' || pos || ']: duplicate type ' || name FROM (SELECT *, row_number() OVER (PARTITION BY o, name ORDER BY pos) AS n FROM t) WHERE n > 1
UNION ALL SELECT o, w || 'bad predicate ' || p FROM f WHERE p = 'lower' UNION ALL SELECT o, w || 'duplicate predicate ' || p FROM f WHERE n > 1
UNION ALL SELECT o, w || 'a side without types' FROM f WHERE len(s) = 0
UNION ALL SELECT o, w || 'a symmetric relation has the same types on both sides' FROM f WHERE sy AND list_sort(list_distinct(s)) <> list_sort(list_distinct(ob))
UNION ALL SELECT o, w || 'symmetric and antisymmetric' FROM f WHERE sy AND an
UNION ALL SELECT o, w || 'one type on both ends, but no type is on both' FROM f WHERE sa AND NOT list_has_any(s, ob)
UNION ALL SELECT o, w || 'unknown type ' || x FROM (SELECT f.o, w, coalesce(known, []) AS known, unnest(list_distinct(s)) AS x FROM f LEFT JOIN k ON k.o = f.o) WHERE NOT list_contains(known, x)
UNION ALL SELECT o, w || 'unknown type ' || x FROM (SELECT f.o, w, coalesce(known, []) AS known, unnest(list_distinct(ob)) AS x FROM f LEFT JOIN k ON k.o = f.o) WHERE NOT list_contains(known, x)""")
def _(s, d):
    """Nations as ontologies: suppliers give types, customers relations, some of them faulty."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    place = lambda o, by: (F.row_number().over(Window.partitionBy(o).orderBy(by)) - 1).alias("position")
    name = lambda x, n: F.concat(F.lit("T"), (x % n).cast("string"))
    types = T.table(s, d, "supplier").select(F.col("s_nationkey").alias("ontology_id"), place("s_nationkey", k), F.concat(F.when(k % 7 == 0, "bad ").otherwise("T"), (k % 5).cast("string")).alias("name"))
    relations = T.table(s, d, "customer").select(
        F.col("c_nationkey").alias("ontology_id"), place("c_nationkey", c), F.when(c % 11 == 0, "lower").otherwise(F.concat(F.lit("P_"), (c % 40).cast("string"))).alias("predicate"),
        F.when(c % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(name(c, 5))).alias("subjects"), F.array(name(c, 6), name(c, 5)).alias("objects"),
        (c % 3 == 0).alias("symmetric"), (c % 9 == 0).alias("antisymmetric"), (c % 4 == 0).alias("same_type"),
    )
    return snapshot.ontology_errors(types, relations)


@query("g21_manual_merge", "SELECT 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS entity_id, CASE WHEN p_partkey = 3 THEN 'e0000005' WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN 'e' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') END AS redirect_to FROM part")
def _(s, d):
    return state.merge_entities(T.entities(s, d), ("e0000003", "e0000005"), "someone")[0].select("entity_id", "redirect_to")


@query("st09_consistency_guard", "SELECT 'd' || c_custkey AS document_id, CASE WHEN coalesce(n, 0) <> CASE WHEN c_custkey % 4 = 0 THEN coalesce(n, 0) + 1 ELSE coalesce(n, 0) END THEN 'index.inconsistent' ELSE 'revision.changed' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 4 = 0 OR c_custkey % 9 = 0")
def _(s, d):
    doc = lambda c: F.concat(F.lit("d"), F.col(c).cast("string")).alias("document_id")
    chunks = T.table(s, d, "orders").select(doc("o_custkey"))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    c = T.table(s, d, "customer").select(doc("c_custkey"), k).join(counts, "document_id", "left")
    files = c.select("document_id", F.lit("r1").alias("revision"), (F.coalesce("n", F.lit(0)) + F.when(k % 4 == 0, 1).otherwise(0)).alias("chunk_count"))
    current = c.select("document_id", F.when(k % 9 == 0, "r2").otherwise("r1").alias("revision"))
    return snapshot.consistent(files, chunks, current)[1]


@query("s13_p01_hit_projection", f"WITH {T.FILES} SELECT item_id AS id, drive_id, item_id, name, parent_path AS path, web_url, mime_type, size, CAST(NULL AS TIMESTAMP) AS last_modified, chunk_count AS chunk_number, CAST(NULL AS VARCHAR) AS content, CAST(1.0 AS DOUBLE) AS score FROM files")
def _(s, d):
    rows = T.files(s, d).select(F.col("item_id").alias("id"), "drive_id", "item_id", "name", F.col("parent_path").alias("path"), "web_url", "mime_type", "size", "etag", F.col("chunk_count").alias("chunk_number"), F.lit(False).alias("has_anonymous_access"))
    return index.hits(index.conform(rows, 64).withColumn("score", F.lit(1.0)))


@query("p08_optional_equality", f"WITH {T.FILES} SELECT item_id FROM files WHERE drive_id = 'drive1'")
def _(s, d):
    return index.optional_equal(T.files(s, d), drive_id="drive1", name=None).select("item_id")


@query("u10_merged_pages", "SELECT user_id AS id, min(event_type) AS name FROM events e WHERE event_id // 100 = (SELECT min(event_id // 100) FROM events f WHERE f.user_id = e.user_id) GROUP BY 1")
def _(s, d):
    e = T.table(s, d, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 100).alias("page"), F.col("event_type").alias("name"))
    return index.merged_pages(e, "id", "page").select("id", "name")


@query("u08_alias_union", "SELECT DISTINCT p_type AS entity_type, p_name AS alias, p_brand AS entity_id FROM part UNION SELECT p_type, p_brand, p_brand FROM part")
def _(s, d):
    p = T.table(s, d, "part").select(F.lit("t").alias("tenant"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_id"))
    return state.upsert_aliases(p.distinct(), p.withColumn("alias", F.col("entity_id"))).select("entity_type", "alias", "entity_id")


@query("u07_same_types", "SELECT s_suppkey, s_suppkey % 2 = 0 AS same FROM supplier")
def _(s, d):
    a, b = F.array(F.lit("A"), F.lit("B")), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("B"), F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("A")))
    return T.table(s, d, "supplier").select("s_suppkey", same_types(a, b).alias("same"))


@query("t16_listings", "SELECT s_suppkey FROM supplier ORDER BY lower(s_name), s_suppkey")
def _(s, d):
    return index.listing(T.table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), index.order_of("agents")).select("s_suppkey")


@query("t16_top_requests", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(s, d):
    return index.listing(T.table(s, d, "orders").select(F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id")), index.order_of("signature_requests"), most=100).select(F.col("id").alias("o_orderkey"))


@query("t04_feedback_page", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn LIMIT 100 OFFSET 5")
def _(s, d):
    return index.listing(T.table(s, d, "conversations").filter("role = 'assistant'"), [F.desc("conv_id"), F.col("turn")], skip=5, top=500, most=100).select("conv_id", "turn")


@query("j12_linked_instances", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(s, d):
    wanted = T.table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return access.linked_ids(T.table(s, d, "orders"), wanted, "o_custkey")


@query("s11_upsert_repeated", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE c_name END AS c_name FROM customer")
def _(s, d):
    c = T.table(s, d, "customer").select("c_custkey", "c_name")
    even = c.filter("c_custkey % 2 = 0").select("c_custkey")
    rows = even.select("c_custkey", F.lit("first").alias("c_name"), F.lit(1).alias("arrival")).unionByName(even.select("c_custkey", F.lit("second").alias("c_name"), F.lit(2).alias("arrival")))
    return indexing.upsert(c, rows, ["c_custkey"])


def _attachments(s, d):
    m = T.table(s, d, "conversations")
    uploads = m.groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("markdown"))
    k = F.col("conv_id")
    upload = F.concat(F.lit("u"), k.cast("string")).alias("upload_id")
    table = uploads.select(upload, F.lit("NotStarted").alias("status"), F.lit(0).alias("chunk_count"), F.lit(None).cast("long").alias("tokens"), F.lit("old").alias("error"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"))
    converted = uploads.select(upload, F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit("text/plain").alias("mime_type"), F.when(k % 7 != 0, F.col("markdown")).otherwise(" ").alias("markdown"), F.when(k % 5 == 0, F.repeat(F.lit("x"), 5000)).alias("error"), F.when(k % 3 != 0, k).alias("tokens"))
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    begun = index.begin_indexing(table, table, now)
    empty = index.attachment_chunks(converted.limit(0))
    return index.finish_indexing(begun, empty, converted, now, 200, 20), m.select("conv_id", upload).distinct()


@query("s23_attachment_index", """
WITH u AS (SELECT conv_id AS k, arg_max(text, (turn, text)) AS t FROM conversations GROUP BY 1)
SELECT 'u' || k AS upload_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR trim(t) = '' THEN 'Failed' ELSE 'Indexed' END AS status,
  CASE WHEN k % 5 = 0 THEN 4000 WHEN k % 7 = 0 THEN length('No readable text was found in n' || k) END AS error_length,
  CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 3 <> 0 THEN k END AS tokens FROM u""")
def _(s, d):
    (table, _), _ = _attachments(s, d)
    return table.select("upload_id", "status", F.length("error").alias("error_length"), "tokens")


@query("r06_attachment_search")
def _(s, d):
    """Hybrid search within one conversation's indexed files; its ranking is that of r03, which has SQL."""
    (table, chunks), links = _attachments(s, d)
    return index.search_attachments(chunks, links.withColumnRenamed("conv_id", "conversation_id"), table, 4, "the version of the thing", 10).select("upload_id", "chunk_number", F.round("score", 9).alias("score"))


@query("r05_t05_skipped_page", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id FROM embeddings, q ORDER BY round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))), 9) DESC, vec_id LIMIT 10 OFFSET 15""")
def _(s, d):
    retrieval.validate("anything", 10, 15)
    e = T.table(s, d, "embeddings")
    top = retrieval.vector_search(e, e.filter("vec_id = 0").first()["embedding"], "vec_id", "embedding", 25)
    return top.orderBy(F.round("score", 9).desc(), "vec_id").offset(15).limit(10).select("vec_id")


@query("c05_c07_name_keys", "SELECT p_partkey, 'name:' || lower(p_name) AS name_key, 'id:part:' || p_partkey AS identifier FROM part")
def _(s, d):
    return T.table(s, d, "part").select("p_partkey", keys.name_key(F.col("p_name")).alias("name_key"), keys.identifier_key(F.lit("part"), F.col("p_partkey").cast("string")).alias("identifier"))


@query("c38_label_of_properties", "SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 <> 0 THEN '0' || repeat('a', 35) END AS label_id FROM orders")
def _(s, d):
    """Every third file has two enabled labels of its own tenant, which is none."""
    o = T.table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    rows = lambda digit: [(f"MSIP_Label_{digit}{'a' * 35}_Enabled", "true"), (f"MSIP_Label_{digit}{'a' * 35}_SiteId", "T1")]
    props = s.createDataFrame([(n, v, x) for x in (0, 1) for n, v in rows(x)], "name string, value string, which int")
    return state.label_of_properties(o.join(F.broadcast(props), (F.col("which") == 0) | (F.col("file_id") % 3 == 0)), "t1")


@query("c40_memoized_scores", "SELECT p_partkey, length(p_type) AS n FROM part")
def _(s, d):
    return state.memoized(T.table(s, d, "part").select("p_partkey", "p_type"), ["p_type"], lambda k: k.withColumn("n", F.length("p_type"))).select("p_partkey", "n")


@query("c35_changed_packages", "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0")
def _(s, d):
    h = T.table(s, d, "part").select("p_partkey", F.col("p_name").alias("hash"))
    return state.changed_packages(h, h.filter("p_partkey % 4 = 0"), "p_partkey").select("p_partkey")


@query("g09_seeds", """
WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, 'e' || l_partkey AS a, 'e' || l_suppkey AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
f AS (SELECT a AS e, 1 AS g, k AS r, lpad(CAST(k AS VARCHAR), 9, '0') || '-' || n AS x, 0 AS s FROM m WHERE k % 2 = 0 UNION ALL SELECT b, 1, k, lpad(CAST(k AS VARCHAR), 9, '0') || '-' || n, 1 FROM m WHERE k % 2 = 0 UNION ALL SELECT 'e7', 0, 0, '', 0),
o AS (SELECT e, min((g, r, x, s)) AS o FROM f GROUP BY 1)
SELECT e AS entity_id, CAST(row_number() OVER (ORDER BY o, e) AS INTEGER) AS n FROM o ORDER BY o, e LIMIT 10""")
def _(s, d):
    m = T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    k = F.col("l_orderkey")
    ref = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    manifests = m.select(k.cast("string").alias("document_id"), F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("assertion_id"), ref("l_partkey").alias("subject_id"), ref("l_suppkey").alias("object_id"))
    hits = m.select(F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), k.alias("rank")).distinct()
    states = m.select(k.cast("string").alias("document_id"), F.when(k % 2 == 0, "Ready").otherwise("Failed").alias("status")).distinct()
    linked = s.createDataFrame([("e7", 0)], "entity_id string, position long")
    return state.seeds(linked, hits, manifests, states)


@query("st03_after_sweep", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 's2' ELSE 's1' END AS swept FROM supplier")
def _(s, d):
    t = T.table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "link").otherwise("").alias("delta_link"), F.lit("s2").alias("scan_id"), F.lit("s1").alias("swept_scan_id"))
    return indexing.after_sweep(t).select("s_suppkey", F.col("swept_scan_id").alias("swept"))


@query("p13_model_filter", f"WITH {T.LEDGER} SELECT event_id FROM ledger WHERE model_id = 'view'")
def _(s, d):
    return usage.model_filter(T.ledger(s, d), "view").select("event_id")


@query("c40_failed_scorer", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_brand || '/' || p_size END AS result, CASE WHEN p_size % 5 = 0 THEN 'ValueError: size ' || p_size END AS warning FROM part")
def _(s, d):
    """A scorer that fails for some keys: their rows get a warning, the others their result."""

    def scorer(key):
        if key["p_size"] % 5 == 0:
            raise ValueError(f"size {key['p_size']}")
        return f"{key['p_brand']}/{key['p_size']}"

    return state.scored_once(T.table(s, d, "part"), ["p_brand", "p_size"], scorer).select("p_partkey", "result", "warning")
