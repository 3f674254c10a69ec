"""Registered queries of validations and ids: whole tables with a fault in every so-manieth row, and SQL that finds the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import retrieval, snapshot, state
from . import tables as T
from .queries import query

_EVIDENCE = "struct<tenant:string,document_id:string,document_version:string,chunk_id:string,chunk_content_hash:string,section:string,page:int,access_scope_ref:string>"


def _cited(s, d):
    """Suppliers as documents, parts as their sound entities, line items as assertions between parts of one document, orders as resolutions."""
    n = T.table(s, d, "supplier").count()
    doc = lambda p: F.concat(F.lit("drive:"), (p % n + 1).cast("string"))
    kind = lambda p: F.when(p % 2 == 0, "System").otherwise("Project")
    ref = lambda p: F.concat(F.lower(kind(p)), F.lit(":"), p.cast("string"))
    head = T.table(s, d, "supplier").select(F.concat(F.lit("drive:"), F.col("s_suppkey").cast("string")).alias("document_id"), F.lit("t").alias("tenant"), F.lit("r1").alias("document_version"), F.lit(1).alias("schema_version"), F.lit("v1").alias("ontology_version"), F.lit("x1").alias("extraction_version"))
    p = F.col("p_partkey")
    part = T.table(s, d, "part")
    entities = part.select(doc(p).alias("document_id"), F.floor(p / n).cast("int").alias("position"), F.lit("t").alias("tenant"), ref(p).alias("entity_id"), kind(p).alias("entity_type"), F.col("p_name").alias("canonical_name"), F.array("p_type").alias("aliases"), F.create_map().cast("map<string,string>").alias("attributes"))
    most = part.agg(F.max("p_partkey")).first()[0]
    o, i = F.col("l_orderkey"), F.col("l_linenumber")
    rows = T.first_rows(T.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")
    other = F.when(o % 59 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + n * i)
    rows = rows.withColumn("q", other).filter(F.col("q") <= most)
    rows = rows.select(
        doc(F.col("l_partkey")).alias("document_id"), (o * 10 + i).alias("position"), o.alias("o"),
        F.when(o % 47 == 0, "system:none").otherwise(ref(F.col("l_partkey"))).alias("subject_id"), ref(F.col("q")).alias("object_id"),
        F.when(o % 53 == 0, "LIKES").when(i % 3 == 0, "INTEGRATES_WITH").otherwise("DEPENDS_ON").alias("predicate"),
        F.concat(F.lit("c"), o.cast("string"), F.lit("-"), i.cast("string")).alias("c"),
    )
    evidence = F.when(F.col("o") % 61 != 0, F.struct(
        F.when(F.col("o") % 67 == 0, "u").otherwise("t").alias("tenant"), F.when(F.col("o") % 71 == 0, "drive:0").otherwise(F.col("document_id")).alias("document_id"), F.lit("r1").alias("document_version"),
        F.when(F.col("o") % 73 == 0, "a/b").otherwise(F.col("c")).alias("chunk_id"), F.when(F.col("o") % 79 == 0, "md5").otherwise(keys.content_hash(F.col("c"))).alias("chunk_content_hash"),
        F.when(F.col("o") % 89 == 0, " ").alias("section"), F.when(F.col("o") % 83 == 0, 0).otherwise(1).alias("page"), F.when(F.col("o") % 97 == 0, "a?b").alias("access_scope_ref"),
    ))
    derived = keys.assertion_id_column(F.lit("t"), F.col("document_id"), F.lit("r1"), F.col("c"), F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("predicate") == "INTEGRATES_WITH")
    assertions = rows.select(
        "document_id", "position", F.when(F.col("o") % 31 == 0, "u").otherwise("t").alias("tenant"), "subject_id", "object_id", "predicate",
        F.when(F.col("o") % 101 == 0, "wrong:1").when(F.col("o") % 103 == 0, "assertion:same").otherwise(derived).alias("assertion_id"), F.when(F.col("o") % 37 == 0, "Draft").otherwise("Asserted").alias("status"),
        F.when(F.col("o") % 41 == 0, "v0").otherwise("v1").alias("ontology_version"), F.when(F.col("o") % 43 == 0, "x0").otherwise("x1").alias("extraction_version"), evidence.cast(_EVIDENCE).alias("evidence"),
    )
    k = F.col("o_orderkey")
    own = k % n + n * (k % 3)
    resolutions = T.table(s, d, "orders").select("o_orderkey").distinct().select(
        doc(own).alias("document_id"), k.alias("position"), F.when(k % 11 == 0, "a/b").otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("local_ref"),
        F.when(k % 13 == 0, "x:none").otherwise(ref(own)).alias("entity_id"), F.when(k % 17 == 0, "Guess").otherwise("Alias").alias("method"),
        F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.array_repeat(F.lit("system:1"), 11)).otherwise(F.array(F.lit("system:1"))).alias("candidates"),
    )
    return head, entities, assertions, resolutions


@query("g16_assertions_and_resolutions", """
WITH m AS (SELECT count(*) AS n FROM supplier), mx AS (SELECT max(p_partkey) AS x FROM part),
docs AS (SELECT 'drive:' || s_suppkey AS doc FROM supplier),
e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'system:' ELSE 'project:' END || p_partkey AS id, 'drive:' || (p_partkey % n + 1) AS doc, p_partkey % 2 = 0 AS sys FROM part, m),
l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS o, l_linenumber AS i, l_partkey AS p, CASE WHEN l_orderkey % 59 = 0 THEN l_partkey ELSE l_partkey + n * l_linenumber END AS q FROM lineitem, m),
w AS (SELECT o, i, 'drive:' || (p % n + 1) AS doc, 'assertions[' || (o * 10 + i) || ']' AS a, o * 10 + i AS pos, CASE WHEN o % 47 = 0 THEN 'system:none' ELSE CASE WHEN p % 2 = 0 THEN 'system:' ELSE 'project:' END || p END AS s,
  CASE WHEN q % 2 = 0 THEN 'system:' ELSE 'project:' END || q AS ob, CASE WHEN o % 53 = 0 THEN 'LIKES' WHEN i % 3 = 0 THEN 'INTEGRATES_WITH' ELSE 'DEPENDS_ON' END AS pr, 'c' || o || '-' || i AS c FROM l, m, mx WHERE q <= x),
j AS (SELECT w.*, x.sys AS ssys, y.sys AS osys, x.id IS NOT NULL AND y.id IS NOT NULL AND pr <> 'LIKES' AS ends, CASE WHEN pr = 'INTEGRATES_WITH' THEN least(s, ob) ELSE s END AS s1, CASE WHEN pr = 'INTEGRATES_WITH' THEN greatest(s, ob) ELSE ob END AS o1
  FROM w JOIN docs USING (doc) LEFT JOIN e x ON x.doc = w.doc AND x.id = s LEFT JOIN e y ON y.doc = w.doc AND y.id = ob),
k AS (SELECT *, CASE WHEN o % 101 = 0 THEN 'wrong:1' WHEN o % 103 = 0 THEN 'assertion:same' ELSE 'assertion:' || left(sha256(list_aggregate(list_transform(['graph-assertion/v1', 't', doc, 'r1', c, s1, pr, o1], lambda v: length(v) || ':' || v || ';'), 'string_agg', '')), 32) END AS id FROM j),
g AS (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY pos) > 1 AS again FROM k),
t AS (SELECT 'drive:' || ((o_orderkey % n + n * (o_orderkey % 3)) % n + 1) AS doc, o_orderkey AS k, 'resolutions[' || o_orderkey || ']' AS a, CASE WHEN o_orderkey % 11 = 0 THEN 'a/b' ELSE 'r' || o_orderkey END AS lr,
  CASE WHEN o_orderkey % 13 = 0 THEN 'x:none' ELSE CASE WHEN (o_orderkey % n + n * (o_orderkey % 3)) % 2 = 0 THEN 'system:' ELSE 'project:' END || (o_orderkey % n + n * (o_orderkey % 3)) END AS id FROM (SELECT DISTINCT o_orderkey FROM orders), m),
r AS (SELECT doc, 'tenant.mismatch' AS code, a || '.tenantId' AS path FROM g WHERE o % 31 = 0
  UNION ALL SELECT doc, 'assertion.status', a || '.status' FROM g WHERE o % 37 = 0
  UNION ALL SELECT doc, 'ontology.version', a || '.ontologyVersion' FROM g WHERE o % 41 = 0
  UNION ALL SELECT doc, 'extraction.version', a || '.extractionVersion' FROM g WHERE o % 43 = 0
  UNION ALL SELECT doc, 'assertion.entityReference', a || '.subjectEntityId' FROM g WHERE ssys IS NULL
  UNION ALL SELECT doc, 'assertion.entityReference', a || '.objectEntityId' FROM g WHERE osys IS NULL
  UNION ALL SELECT doc, 'predicate.unknown', a || '.predicate' FROM g WHERE pr = 'LIKES'
  UNION ALL SELECT doc, 'assertion.relation', a FROM g WHERE ends AND NOT (osys AND (pr = 'DEPENDS_ON' OR ssys))
  UNION ALL SELECT doc, 'assertion.selfReference', a FROM g WHERE ends AND s = ob
  UNION ALL SELECT doc, 'assertion.symmetricOrientation', a FROM g WHERE ends AND pr = 'INTEGRATES_WITH' AND s > ob
  UNION ALL SELECT doc, 'required', a || '.evidence' FROM g WHERE o % 61 = 0
  UNION ALL SELECT doc, 'tenant.mismatch', a || '.evidence.tenantId' FROM g WHERE o % 61 <> 0 AND o % 67 = 0
  UNION ALL SELECT doc, 'evidence.document', a || '.evidence' FROM g WHERE o % 61 <> 0 AND o % 71 = 0
  UNION ALL SELECT doc, 'identifier.invalid', a || '.evidence.chunkId' FROM g WHERE o % 61 <> 0 AND o % 73 = 0
  UNION ALL SELECT doc, 'evidence.invalid', a || '.evidence.chunkContentHash' FROM g WHERE o % 61 <> 0 AND o % 79 = 0
  UNION ALL SELECT doc, 'evidence.invalid', a || '.evidence.pageNumber' FROM g WHERE o % 61 <> 0 AND o % 83 = 0
  UNION ALL SELECT doc, 'evidence.invalid', a || '.evidence.section' FROM g WHERE o % 61 <> 0 AND o % 89 = 0
  UNION ALL SELECT doc, 'evidence.invalid', a || '.evidence.accessScopeRef' FROM g WHERE o % 61 <> 0 AND o % 97 = 0
  UNION ALL SELECT doc, 'identifier.invalid', a || '.assertionId' FROM g WHERE o % 101 = 0
  UNION ALL SELECT doc, 'id.duplicate', a || '.assertionId' FROM g WHERE o % 101 <> 0 AND again
  UNION ALL SELECT doc, 'assertion.id', a || '.assertionId' FROM g WHERE o % 101 <> 0 AND o % 103 = 0 AND NOT again AND ends AND o % 61 <> 0 AND o % 67 <> 0 AND o % 71 <> 0 AND o % 73 <> 0
  UNION ALL SELECT t.doc, 'resolution.invalid', a || '.localRef' FROM t JOIN docs USING (doc) WHERE k % 11 = 0
  UNION ALL SELECT t.doc, 'resolution.invalid', a || '.entityId' FROM t JOIN docs USING (doc) LEFT JOIN e ON e.doc = t.doc AND e.id = t.id WHERE e.id IS NULL
  UNION ALL SELECT t.doc, 'resolution.invalid', a || '.method' FROM t JOIN docs USING (doc) WHERE k % 17 = 0
  UNION ALL SELECT t.doc, 'resolution.invalid', a || '.candidateEntityIds' FROM t JOIN docs USING (doc) WHERE k % 19 = 0 OR k % 23 = 0)
SELECT doc AS document_id, code, path FROM r""")
def _(s, d):
    whole = snapshot.Limits(entities=10**6, assertions=10**7, resolutions=10**7, errors=10**7)
    return snapshot.validate(*_cited(s, d), limits=whole).select("document_id", "code", "path")


@query("c09_assertion_ids", """
SELECT l_orderkey, l_linenumber, 'assertion:' || left(sha256(list_aggregate(list_transform(['graph-assertion/v1', 't', 'd:' || l_orderkey, 'r1', 'c' || l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN least('p' || l_partkey, 's' || l_suppkey, 'p' || l_partkey) ELSE 's' || l_suppkey END,
  'R', CASE WHEN l_linenumber % 2 = 0 THEN greatest('p' || l_partkey, 's' || l_suppkey) ELSE 'p' || l_partkey END], lambda v: length(v) || ':' || v || ';'), 'string_agg', '')), 32) AS id FROM lineitem""")
def _(s, d):
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    i = keys.assertion_id_column(F.lit("t"), of("d:", "l_orderkey"), F.lit("r1"), of("c", "l_linenumber"), of("s", "l_suppkey"), F.lit("R"), of("p", "l_partkey"), F.col("l_linenumber") % 2 == 0)
    return T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", i.alias("id"))


@query("c06_predicates", "SELECT p_partkey, upper(regexp_replace(trim(p_type || ' - ' || p_brand), '[ \\-_]+', '_', 'g')) AS predicate FROM part")
def _(s, d):
    return T.table(s, d, "part").select("p_partkey", keys.normalize_predicate(F.concat_ws(" - ", "p_type", "p_brand")).alias("predicate"))


@query("c13_access_scopes", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'perm:' || translate(rtrim(to_base64(unhex(sha256(c_name))), '='), '+/', '-_') END AS scope FROM customer")
def _(s, d):
    hash_ = F.base64(F.unhex(F.sha2("c_name", 256)))
    return T.table(s, d, "customer").select("c_custkey", keys.access_scope(F.when(F.col("c_custkey") % 5 != 0, hash_).otherwise(" ")).alias("scope"))


@query("c28_jittered_delays", "SELECT event_id, round(least(1800.0, 15.0 * pow(2, event_id % 12)) * (0.5 + 0.5 * (event_id % 100) / 100.0), 6) AS delay, TRUE AS bounded FROM events")
def _(s, d):
    """With a given jitter the delay itself, with a random one that it stays between half and all of it."""
    e = T.table(s, d, "events")
    attempt = F.col("event_id") % 12 + 1
    given, drawn, whole = text.retry_delay(attempt, jitter=(F.col("event_id") % 100) / 100.0), text.retry_delay(attempt), text.retry_delay(attempt, jitter=F.lit(1.0))
    return e.select("event_id", F.round(given, 6).alias("delay"), drawn.between(0.5 * whole, whole).alias("bounded"))


@query("c30_sanitized_prompts", "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN '< Target_Text>' || text || '< /context_AFTER>' WHEN doc_id % 3 = 1 THEN text || '<target>' ELSE '< /target_text>' || text END) AS hash FROM documents")
def _(s, d):
    k = F.col("doc_id")
    t = F.when(k % 3 == 0, F.concat(F.lit("<Target_Text>"), "text", F.lit("</context_AFTER>"))).when(k % 3 == 1, F.concat("text", F.lit("<target>"))).otherwise(F.concat(F.lit("</target_text>"), "text"))
    return T.table(s, d, "documents").select("doc_id", F.sha2(text.sanitize(t), 256).alias("hash"))


@query("p19_plan_errors", """
WITH q AS (SELECT o_orderkey AS question, CASE WHEN o_orderkey % 7 = 0 THEN 21 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS k, o_orderkey % 5 = 0 AS blank, o_orderkey % 3 AS asked FROM orders)
SELECT question, CASE WHEN k > 20 THEN 'names' WHEN blank AND k > 0 THEN 'name length' WHEN asked = 2 THEN 'unknown predicate' END AS error,
  CASE WHEN k > 20 OR blank AND k > 0 OR asked = 2 THEN NULL WHEN asked = 0 THEN 'DEPENDS_ON,INTEGRATES_WITH,OWNED_BY,IMPLEMENTS,SUPERSEDES,APPLIES_TO' ELSE 'SUPERSEDES' END AS allowed FROM q""")
def _(s, d):
    k = F.col("o_orderkey")
    count = F.when(k % 7 == 0, 21).otherwise((k % 4).cast("int"))
    plans = T.table(s, d, "orders").select(k.alias("question"), F.array_repeat(F.when(k % 5 == 0, " ").otherwise("name"), count).alias("names"), F.when(k % 3 == 1, F.array(F.lit("SUPERSEDES"))).when(k % 3 == 2, F.array(F.lit("SUPERSEDES"), F.lit("KNOWS"))).alias("predicates"))
    return state.plan_errors(plans).select("question", "error", F.array_join("allowed", ",").alias("allowed"))


@query("r05_refused_requests", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'query' WHEN turn % 3 = 0 THEN 'top' WHEN turn % 4 = 0 THEN 'skip' END AS error FROM conversations")
def _(s, d):
    n = F.col("turn")
    m = T.table(s, d, "conversations").select("conv_id", "turn", F.when(n % 5 == 0, " ").otherwise("q").alias("query"), F.when(n % 3 == 0, 101).otherwise(100).alias("top"), F.when(n % 4 == 0, -1).otherwise(0).alias("skip"))
    return retrieval.request_errors(m).select("conv_id", "turn", "error")
