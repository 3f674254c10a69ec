"""Registered queries over stored tables and search structures: each builds them from whole tables, changes them and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, keys
from ..operators import conversations, graph, indexing, usage
from ..storage.files import scratch
from ..storage.log import LogTable
from ..storage.postings import PostingStore
from ..storage.publication import STEPS, Publication
from ..storage.rollups import Rollup, Rollups, over_limit
from ..storage.trigrams import TrigramIndex
from ..storage.vectors import VectorIndex
from . import tables as T
from .queries import _FUSED, ORACLES, query


def _posted(s: SparkSession, d: str) -> PostingStore:
    """Documents as files of one chunk, open to everyone; the first batch has them all, the second replaces every fifth by itself."""
    docs = T.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"), F.lit(True).alias("anonymous"), F.lit(None).cast("array<string>").alias("allowed"))
    store = PostingStore(s, scratch(s, "postings"))
    store.ingest(docs, ("load", 0))
    store.ingest(docs.filter("file % 5 = 0"), ("load", 1))
    return store


@query("r01_posting_store", ORACLES["r01_full_text"])
def _(s, d):
    return _posted(s, d).scores("Licensed version").select(F.col("key").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


_TOP = f"SELECT doc_id, score FROM ({ORACLES['r01_full_text'].replace(', 6) AS score', ', 9) AS score')}) ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 25"


@query("r01_block_maxima", _TOP)
def _(s, d):
    """The best 25 by skipping slices."""
    return _posted(s, d).top("Licensed version", 25).select(F.col("key").cast("long").alias("doc_id"), "score")


@query("r03_posting_store", _FUSED)
def _(s, d):
    k = F.col("doc_id")
    docs = T.table(s, d, "documents").select("doc_id", "text")
    cut = chunking.chunk_table(docs, ["doc_id"], "text", 1000, 100)
    chunks = cut.select(k.cast("string").alias("file"), keys.chunk_key(F.lit("drive"), k.cast("string"), F.col("chunk_number")).alias("key"), "content", (k % 3 == 0).alias("anonymous"), F.array(F.concat(F.lit("g"), (k % 4).cast("string"))).alias("allowed"))
    store = PostingStore(s, scratch(s, "postings"))
    store.ingest(chunks, ("load", 0))
    return store.hybrid("the licensed version of the thing", 20, view=store.view("u1", ["g1"])).select(F.col("key").alias("chunk_id"), F.round("score", 9).alias("score"))


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, VectorIndex]:
    e = T.table(s, d, "embeddings").select("vec_id", "embedding")
    return e, VectorIndex.build(e, scratch(s, "vectors"), "vec_id", "embedding")


@query("r08_exact_lists", ORACLES["r02_vector_topk"])
def _(s, d):
    """Only lists that can hold one of the ten best are opened."""
    e, lists = _vectors(s, d)
    return lists.search(e.filter("vec_id = 0").first()["embedding"], 10, exact=True).select("vec_id", F.round("score", 6).alias("score"))


@query("r08_approximate_index")
def _(s, d):
    """The ten best of each vector whose id 100 divides, by the lists of its nearest centroids."""
    e, lists = _vectors(s, d)
    return lists.search_many(e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", F.col("key").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("r08_recall_and_files", "SELECT TRUE AS recall_reached, TRUE AS few_files")
def _(s, d):
    """Whether those reach 0.9 of the exact search's, and one search opens less than three quarters of the files.  The table's vectors lie evenly, which is the worst case."""
    e, lists = _vectors(s, d)
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    exact = lists.exact_many(asked, 10).select("query", "key")
    both = exact.join(lists.search_many(asked, "query", "q", 10), ["query", "key"], "left")
    opened = lists.search(e.filter("vec_id = 0").first()["embedding"], 10).inputFiles()
    return both.agg((F.avg(F.col("rank").isNotNull().cast("int")) >= 0.9).alias("recall_reached"), F.lit(4 * len(opened) < 3 * len(lists.table.paths())).alias("few_files"))


def _tracked(s: SparkSession, rows: DataFrame, by: tuple[str, ...], buckets: int = 16) -> LogTable:
    return LogTable(s, scratch(s, "table"), ", ".join(f"{c} {t}" for c, t in rows.dtypes), buckets, by)


@query("st01_st08_commit_log", f"""
WITH {T.FILES}, moved AS (SELECT drive_id, CASE WHEN doc_id % 23 = 0 THEN 'new' || item_id ELSE item_id END AS item_id, CASE WHEN doc_id % 6 = 0 THEN etag || 'x' ELSE etag END AS etag, doc_id % 17 = 0 AS gone, doc_id FROM files)
SELECT drive_id, item_id, etag FROM moved WHERE NOT gone UNION ALL SELECT drive_id, item_id, etag FROM files WHERE doc_id % 23 = 0""")
def _(s, d):
    """A table of files, then its feed in three batches of which each comes twice and one a third time, late."""
    rows = T.files(s, d).select("drive_id", "item_id", "etag")
    t = _tracked(s, rows, ("drive_id", "item_id"))
    t.append(rows, ("load", 0))
    feed = T.changes(s, d).select("drive_id", "item_id", "etag", "is_deleted")
    part = F.pmod(F.xxhash64("item_id"), F.lit(3))
    for epoch in (0, 0, 1, 1, 0, 2, 2):
        t.merge(feed.filter(part == epoch), ["drive_id", "item_id"], ("feed", epoch), deleted="is_deleted")
    return t.read()


@query("st08_snapshots", f"WITH {T.FILES} SELECT 'first' AS snapshot, count(*) AS n, count(DISTINCT etag) AS tags FROM files UNION ALL SELECT 'newest', count(*), count(*) FROM files WHERE doc_id % 17 <> 0")
def _(s, d):
    """A reader of the first version keeps its rows while later ones come and go."""
    rows = T.files(s, d).select("drive_id", "item_id", "etag")
    t = _tracked(s, rows, ("drive_id", "item_id"))
    first = t.append(rows)
    t.merge(rows.withColumn("gone", F.col("item_id") % 17 == 0).filter("gone"), ["drive_id", "item_id"], deleted="gone")
    count = lambda name, state: t.read(state).agg(F.lit(name).alias("snapshot"), F.count(F.lit(1)).alias("n"), F.count_distinct("etag").alias("tags"))
    return count("first", first).unionByName(count("newest", t.state()))


@query("s11_bucket_merge", ORACLES["s11_upsert"])
def _(s, d):
    c = T.table(s, d, "customer").select("c_custkey", "c_name")
    t = _tracked(s, c, ("c_custkey",))
    t.append(c)
    t.merge(indexing.truncated(c.filter("c_custkey % 2 = 0"), {"c_name": 10}), ["c_custkey"])
    return t.read()


@query("s17_bucket_merge", f"WITH {T.EDGES}, ends AS (SELECT assertion_id, subject_id AS anchor, status FROM edges UNION SELECT assertion_id, object_id, status FROM edges) SELECT assertion_id, anchor, CASE WHEN anchor = 'e0000007' THEN 'Disputed' ELSE status END AS status FROM ends")
def _(s, d):
    """Each edge at both of its ends, bucketed by the end; a change at one end rewrites its bucket."""
    copies = T.edges(s, d).select("assertion_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("anchor"), "status")
    t = _tracked(s, copies, ("anchor",))
    t.append(copies)
    t.merge(t.read(buckets=_bucket(t, "e0000007")).filter("anchor = 'e0000007'").withColumn("status", F.lit("Disputed")), ["anchor", "assertion_id"])
    return t.read()


def _bucket(t: LogTable, value: str) -> list[int]:
    return [t.spark.createDataFrame([(value,)], f"{t.by[0]} string").select(t.bucket_of()).first()[0]]


@query("s28_bucket_merge", ORACLES["s28_append_messages"])
def _(s, d):
    """Messages bucketed by conversation; a batch reads the last turns of its own buckets to number its messages."""
    m = T.table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    t = _tracked(s, m, ("conv_id",))
    t.append(m)
    fresh = m.groupBy("conv_id").agg(F.lit(1).alias("arrival")).select("conv_id", "arrival", F.lit("user").alias("role"), F.lit("more").alias("text"))
    whole = conversations.append(t.read(), fresh)
    t.merge(whole.join(t.read().select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"), ["conv_id", "turn"], ("send", 0))
    return t.read().select("conv_id", "turn", "role")


def _rolled(s: SparkSession, d: str) -> Rollups:
    """The ledger in four batches dealt by hash, of which one comes twice, and then every row once more."""
    ledger = T.ledger(s, d).select("event_id", "day", "month", "model_id", "user_id", "operation", "total_tokens")
    types = ", ".join(f"{c} {t}" for c, t in ledger.dtypes)
    out = Rollups(s, scratch(s, "rollups"), types, "event_id", (Rollup("day_model", ("day", "model_id"), ("total_tokens",)), Rollup("user_month", ("user_id", "month"), ("total_tokens",))), 8)
    part = F.pmod(F.xxhash64("event_id", "day"), F.lit(4))
    for epoch in (2, 0, 0, 3, 1):
        out.add(ledger.filter(part == epoch), ("run", {2: 0, 0: 1, 3: 2, 1: 3}[epoch]))
    out.add(ledger, ("again", 0))
    return out


@query("a16_running_rollup", f"WITH {T.LEDGER} SELECT day, model_id, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, count(*) AS facts FROM ledger GROUP BY 1, 2")
def _(s, d):
    return _rolled(s, d).read("day_model").select("day", "model_id", F.col("total_tokens").alias("tokens"), "facts")


@query("a17_running_days", ORACLES["a17_daily_rollup"])
def _(s, d):
    return _rolled(s, d).read("day_model").groupBy("day").agg(F.sum("total_tokens").alias("tokens"))


@query("a19_running_quota", ORACLES["a19_quota"])
def _(s, d):
    used = _rolled(s, d).read("user_month").groupBy("user_id").agg(F.sum("total_tokens").alias("used"))
    return over_limit(used, T.users(s, d), "user_id")


@query("a29_day_sketches", f"WITH {T.LEDGER} SELECT CAST(unnest([0.05, 0.5, 0.95, 0.99]) AS DOUBLE) AS p, (SELECT count(*) FROM ledger WHERE duration_seconds IS NOT NULL) AS n, TRUE AS within")
def _(s, d):
    """Quantiles from each day's sketch, merged: how far their ranks are from those asked for, against the sketch's bound."""
    ledger = T.ledger(s, d)
    days = usage.quantile_sketches(ledger, ["day"], "duration_seconds")
    asked = usage.merged_quantiles(days, [0.05, 0.5, 0.95, 0.99])
    return usage.rank_errors(asked, ledger, "duration_seconds").select("p", "n", (F.col("error") <= usage.SKETCH_ERROR).alias("within"))


_MANY = f"""
WITH {T.EDGES}, live AS (SELECT * FROM edges WHERE status <> 'Retracted' AND predicate IN ('DEPENDS_ON', 'INTEGRATES_WITH') AND document_id <> 'd5'),
mv AS (SELECT 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS f, 'e' || lpad(CAST(p_partkey - 1 AS VARCHAR), 7, '0') AS t FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0),
cn AS (SELECT assertion_id, predicate = 'INTEGRATES_WITH' AS sym, coalesce(a.t, subject_id) AS s, coalesce(b.t, object_id) AS o FROM live LEFT JOIN mv a ON a.f = subject_id LEFT JOIN mv b ON b.f = object_id),
st AS (SELECT DISTINCT p_partkey AS question, coalesce(t, 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS id FROM part LEFT JOIN mv ON f = 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHERE p_partkey % 100 = 0),
far AS (SELECT s AS f, assertion_id, o AS t, 0 AS side FROM cn UNION ALL SELECT o, assertion_id, s, 1 FROM cn WHERE sym),
l1 AS (SELECT question, assertion_id, min((side, f, t)) AS e FROM st JOIN far ON f = id GROUP BY 1, 2),
one AS (SELECT question, assertion_id, struct_extract_at(e, 2) AS from_id, struct_extract_at(e, 3) AS to_id FROM l1 WHERE struct_extract_at(e, 2) <> struct_extract_at(e, 3)),
v1 AS (SELECT question, id FROM st UNION SELECT question, to_id FROM one),
fr AS (SELECT * FROM v1 EXCEPT SELECT * FROM st),
l2 AS (SELECT question, assertion_id, min((side, f, t)) AS e FROM fr JOIN far ON f = id GROUP BY 1, 2),
two AS (SELECT question, assertion_id, struct_extract_at(e, 2) AS from_id, struct_extract_at(e, 3) AS to_id FROM l2 ANTI JOIN one USING (question, assertion_id) WHERE struct_extract_at(e, 2) <> struct_extract_at(e, 3)),
nw AS (SELECT question, to_id AS id, min(assertion_id) AS a FROM two ANTI JOIN v1 ON v1.question = two.question AND v1.id = two.to_id GROUP BY 1, 2),
ad AS (SELECT question, id FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a, id) AS r FROM nw) JOIN (SELECT question, 100 - count(*) AS room FROM v1 GROUP BY 1) USING (question) WHERE r <= room),
inside AS (SELECT * FROM v1 UNION ALL SELECT * FROM ad),
kept AS (SELECT question, assertion_id, from_id, to_id, row_number() OVER (PARTITION BY question ORDER BY assertion_id) AS r FROM two SEMI JOIN inside ON inside.question = two.question AND inside.id = two.to_id)
SELECT question, assertion_id, CAST(1 AS BIGINT) AS depth, from_id, to_id FROM one
UNION ALL SELECT question, assertion_id, CAST(2 AS BIGINT), from_id, to_id FROM kept JOIN (SELECT question, 500 - count(*) AS rest FROM one GROUP BY 1) USING (question) WHERE r <= rest"""


@query("g01_many_questions", _MANY)
def _(s, d):
    """A question for each part whose key 100 divides, all at once, within budgets of 100 entities and 500 assertions."""
    states = s.createDataFrame([(f"d{i}", "Failed" if i == 5 else "Ready", "r1") for i in range(20)], "document_id string, status string, active_revision string")
    starts = T.table(s, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("question"), F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"), F.lit(0).alias("n"))
    return graph.traverse_many(T.edges(s, d), states, T.entities(s, d), starts, ["DEPENDS_ON", "INTEGRATES_WITH"], "out", 2, 100, 500)[0]


@query("g07_authorized_paths", f"""
WITH RECURSIVE {T.EDGES}, open AS (SELECT assertion_id, subject_id AS f, object_id AS t FROM edges WHERE document_id = 'd1' AND predicate = 'DEPENDS_ON'),
reach(q, id) AS (SELECT p_partkey, 'e' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') FROM part WHERE p_partkey % 100 = 1 UNION SELECT q, t FROM reach JOIN open ON f = id)
SELECT q AS question, assertion_id, f AS from_id, t AS to_id FROM reach JOIN open ON f = id""")
def _(s, d):
    """Only the assertions of one document's dependencies are open to the reader; every other way is hidden and breaks the paths that need it."""
    mine = T.edges(s, d).filter("document_id = 'd1' AND predicate = 'DEPENDS_ON'").select("assertion_id", F.lit(1).alias("depth"), F.col("subject_id").alias("from_id"), F.col("object_id").alias("to_id"))
    starts = T.table(s, d, "part").filter("p_partkey % 100 = 1").select(F.col("p_partkey").alias("question"), F.concat(F.lit("e"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("id"))
    return graph.reachable(mine, starts).select("question", "assertion_id", "from_id", "to_id")


def _published(s: SparkSession, d: str) -> tuple[Publication, DataFrame, DataFrame]:
    """Orders as documents in their first revision, and their second, which keeps the dependencies under new names."""
    p = Publication(s, scratch(s, "publication"), 8)
    e = T.edges(s, d).select("assertion_id", F.concat(F.lit("d"), F.substring("assertion_id", 2, 9)).alias("document_id"), F.lit("r1").alias("document_version"), "subject_id", "predicate", "object_id", F.lit("Asserted").alias("status"))
    p.publish(e, "first")
    fresh = e.filter("predicate = 'DEPENDS_ON'").withColumns({"assertion_id": F.concat(F.lit("b"), "assertion_id"), "document_version": F.lit("r2")})
    return p, e, fresh


@query("g18_interrupted_publication", f"""
WITH {T.EDGES}, n AS (SELECT assertion_id, predicate, 'd' || substr(assertion_id, 2, 9) AS document_id, CAST(substr(assertion_id, 2, 9) AS INTEGER) % 6 AS step, bool_or(predicate = 'DEPENDS_ON') OVER (PARTITION BY substr(assertion_id, 2, 9)) AS dep FROM edges)
SELECT assertion_id, document_id, 'r1' AS document_version FROM n WHERE step <= 1 OR NOT dep
UNION ALL SELECT 'b' || assertion_id, document_id, 'r2' FROM n WHERE step > 1 AND predicate = 'DEPENDS_ON'""")
def _(s, d):
    """The second revision is interrupted behind each step, for some documents before the first, and then repaired: old or new edges, whole."""
    p, _, fresh = _published(s, d)
    step = F.substring("document_id", 2, 9).cast("int") % 6
    for i, name in enumerate(STEPS, 1):
        p.publish(fresh.filter(step == i), f"second{i}", until=name)
        p.clean(1, 0)  # no one else reads or writes these tables
    p.repair("repair")
    return p.served().select("assertion_id", "document_id", "document_version")


@query("c20_trigram_index", ORACLES["c20_line_grep"])
def _(s, d):
    index = TrigramIndex(s, scratch(s, "trigrams"))
    index.build(T.table(s, d, "documents").select(F.col("doc_id").alias("file"), "text"))
    return index.grep("LICENSED")[0].select(F.col("file").alias("doc_id"), "line_number", "line")


@query("c20_trigram_regex", "SELECT doc_id, CAST(n AS INTEGER) AS line_number, left(l, 500) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(l, '(?i)licensed\\s+under\\s+(the|CC)\\s.*[0-9]\\.[0-9]') ORDER BY doc_id, n LIMIT 1000")
def _(s, d):
    index = TrigramIndex(s, scratch(s, "trigrams"))
    index.build(T.table(s, d, "documents").select(F.col("doc_id").alias("file"), "text"))
    return index.grep(r"licensed\s+under\s+(the|CC)\s.*[0-9]\.[0-9]", regex=True)[0].select(F.col("file").alias("doc_id"), "line_number", "line")
