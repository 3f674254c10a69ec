"""Ranked retrieval: full text (BM25), vector (exact cosine) and their reciprocal-rank fusion.

The permission filter comes before ranking in every mode.  BM25's constants (k1 = 1.2, b = 0.75), the
vectorizer and the fusion constant (60) are this library's choice.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TOKEN), lambda x: F.length(x) > 0)


def validate(query: str, top: int, skip: int) -> None:
    if not (query or "").strip() or not 1 <= top <= 100 or skip < 0:
        raise ValueError("a query, a top of 1 to 100 and a skip of 0 or more are needed")


def request_errors(requests: DataFrame) -> DataFrame:
    """Search requests (query, top, skip) with why each is refused, null if it isn't: :func:`validate` for a table of them."""
    error = F.when(F.length(F.trim(F.coalesce("query", F.lit("")))) == 0, "query").when(~F.coalesce(F.col("top").between(1, 100), F.lit(False)), "top").when(~F.coalesce(F.col("skip") >= 0, F.lit(False)), "skip")
    return requests.withColumn("error", error)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once, so that ``body`` may use it repeatedly without recomputing it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(chunks: DataFrame, terms: list[str], key: str, text_col: str, **more: Column) -> DataFrame:
    """(key, *more, n, tf): length in tokens and the count of each term, of every chunk."""
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    spelt = chunks.select(key, *(c.alias(k) for k, c in more.items()), tokens(F.col(text_col)).alias("__t"))
    counts = _let(F.filter("__t", lambda x: F.array_contains(wanted, x)), lambda hits: F.transform(wanted, lambda w: F.size(F.filter(hits, lambda x: x == w))))
    return spelt.select(key, *more, F.size("__t").alias("n"), counts.alias("tf"))


def _bm25(counted: DataFrame, terms: list[str], key: str, k1: float, b: float) -> DataFrame:
    """(key, score) from (key, n, tf); the statistics are one row."""
    tf = lambda i: F.element_at("tf", i + 1)
    stats = counted.agg(F.count(F.lit(1)).alias("N"), F.avg("n").alias("avg_n"), *(F.count_if(tf(i) > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score, found = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        idf = math.log1p((stats["N"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        score = score + F.lit(idf) * tf(i) * (k1 + 1) / (tf(i) + k1 * (1 - b + b * F.col("n") / F.lit(float(stats["avg_n"] or 1.0))))
        found = found | (tf(i) > 0)
    return counted.filter(found).select(key, score.alias("score"))


def bm25(chunks: DataFrame, query: str, key: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the chunks with a query term.

    The query's few terms are known before the scan, so a chunk becomes one narrow row of counts and no
    inverted index is shuffled.
    """
    terms = sorted(set(_terms(query)))
    return _bm25(term_counts(chunks, terms, key, text_col), terms, key, k1, b)


def _terms(query: str) -> list[str]:
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t]


def _slots(c: Column, dims: int) -> Column:
    """Slot of each token: the first 16 bits of its MD5, modulo ``dims``."""
    return _slots_of(tokens(c), dims)


def _slots_of(words: Column, dims: int) -> Column:
    return F.transform(words, lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int"), F.lit(dims)))


def hashed_vector(c: Column, dims: int = 64) -> Column:
    """Deterministic hashed term frequencies, L2-normalised: a stand-in where no embedding model is at hand.

    Tokens are hashed once a row.
    """
    counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
    norm = lambda raw: F.greatest(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12))
    return _let(_slots(c, dims), lambda s: _let(counts(s), lambda raw: _let(norm(raw), lambda n: F.transform(raw, lambda x: x / n))))


def hashed_cosine(c: Column, query_vector: list[float]) -> Column:
    """Cosine of a text's hashed vector with a unit vector, without building the text's: linear in its tokens.

    The dot product adds the query's weight of each token; the norm adds 2 * run + 1 for each further token
    of a run in slot order, which gives the sum of the squared counts.
    """
    return _let(_slots(c, len(query_vector)), lambda s: slots_cosine(s, slots_norm(s), query_vector))


def slots_cosine(slots: Column, norm: Column, query_vector: list[float]) -> Column:
    """Cosine of hashed term counts, given as the tokens' slots and the norm of the counts, with a unit vector."""
    weights = F.array(*(F.lit(float(x)) for x in query_vector))
    dot = F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.element_at(weights, x + 1))
    return F.coalesce(F.try_divide(dot, norm), F.lit(0.0))


def slots_norm(slots: Column) -> Column:
    """Root of the squared counts' sum, linear in the tokens."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"]).otherwise(0)
        return F.struct(x.alias("last"), (run + 1).alias("run"), (a["sum"] + 2 * run + 1).alias("sum"))

    return F.sqrt(F.aggregate(F.array_sort(slots), start, step, lambda a: a["sum"].cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def vector_search(vectors: DataFrame, query: list[float], key: str, vector_col: str, k: int) -> DataFrame:
    """Exact top k by cosine: the query is a literal, each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """(key, rank) of the best k; scores are equal to nine places.  The window runs over k rows."""
    best = scored.select(key, F.round("score", 9).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def fuse(a: DataFrame, b: DataFrame, key: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    joined = a.withColumnRenamed("rank", "ra").join(b.withColumnRenamed("rank", "rb"), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return joined.select(key, (part("ra") + part("rb")).alias("score"))


def hybrid_search(chunks: DataFrame, query: str, key: str, text_col: str, top: int, skip: int = 0, vector_col: str | None = None, query_vector: list[float] | None = None, depth: int = 100) -> DataFrame:
    """(key, score): the page of the fused list.

    One pass over the texts makes a narrow row of each chunk (length, counts of the query's terms, cosine),
    which is kept for both rankings.
    """
    validate(query, top, skip)
    depth = max(depth, top + skip)
    terms = sorted(set(_terms(query)))
    if vector_col is None:
        query_vector = chunks.sparkSession.range(1).select(hashed_vector(F.lit(query)).alias("v")).first()["v"]
        near = hashed_cosine(F.col(text_col), query_vector)
    else:
        near = cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query_vector)))
    counted = term_counts(chunks, terms, key, text_col, near=near).persist(StorageLevel.DISK_ONLY)
    text = ranked(_bm25(counted, terms, key, 1.2, 0.75), key, depth)
    return fuse(text, ranked(counted.select(key, F.col("near").alias("score")), key, depth), key).orderBy(F.desc("score"), key).offset(skip).limit(top)


def distinct_citations(hits: DataFrame) -> DataFrame:
    """First hit of each (name, chunk_number), by rank."""
    w = Window.partitionBy("name", "chunk_number").orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def strategy_overlap(hits: DataFrame, strategies: int) -> DataFrame:
    """From (strategy, chunk_id, file_id): distinct chunks and files, and how many all or just one found."""
    per = hits.groupBy("chunk_id", "file_id").agg(F.count_distinct("strategy").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_id").alias("files"), F.count_if(F.col("k") == strategies).alias("in_all"), F.count_if(F.col("k") == 1).alias("in_one"))


def evaluation(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean recall and precision, share of full recall, nearest-rank latencies; a missing run found nothing."""
    both = cases.join(runs, "question", "left")
    want, got = F.array_distinct("expected"), F.array_distinct(F.coalesce("retrieved", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(want, got))
    recall = F.when(F.size(want) == 0, 1.0).otherwise(hit / F.size(want))
    precision = F.when(F.size(got) == 0, F.when(F.size(want) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.size(got))
    rows = both.select(recall.alias("recall"), precision.alias("precision"), "latency_ms")
    return rows.agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.avg((F.col("recall") >= 1).cast("int")).alias("full_recall"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"))


def within_budget(items: Column, sizes: Column, most_items: int, most_size: int) -> Column:
    """Greedy: in order, what doesn't fit is skipped and the next is tried."""
    zipped = F.arrays_zip(items.alias("item"), sizes.alias("size"))
    start = F.struct(F.filter(items, lambda x: F.lit(False)).alias("taken"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < most_items) & (acc["used"] + x["size"] <= most_size)
        return F.struct(F.when(fits, F.concat(acc["taken"], F.array(x["item"]))).otherwise(acc["taken"]).alias("taken"), F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).cast("long").alias("used"))

    return F.aggregate(zipped, start, step, lambda acc: acc["taken"])
