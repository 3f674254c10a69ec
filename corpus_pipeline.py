"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and all documents that its predecessor kept; all but the last
return the columns of ``docs``.  Stages that drop rows find the rows' keys first.  Keys are broadcast
while there are at most MAX_BROADCAST of them (counted); beyond that the same join is a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, op3_decontaminate, op6_quality, op7_pii, op9_jaccard, op10_bpe
from quillspark.llm.common import benchmark, documents, written

MAX_BROADCAST = 1_000_000
#: Near duplicates: five words, similarity 0.8.
SHINGLE, SIMILARITY = 5, 80
#: SQL can't express the robust estimates, the components or the encoder; the stages are tested by brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose columns named as in ``keys`` equal no row of it; null equals null."""
    keys = written(keys.distinct(), "pipeline-keys")
    if keys.count() <= MAX_BROADCAST:
        keys = F.broadcast(keys)
    left, right = docs.alias("d"), keys.alias("k")
    same = F.lit(True)
    for c in keys.columns:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}"))
    return left.join(right, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  What is judged is a row's text, language and source.

    Null and empty texts are rejected; null languages and sources are groups of their own; repeated rows are judged alike; an
    empty table stays empty.
    """
    name = "__quality_key"
    while name in docs.columns:
        name += "_"
    key = F.xxhash64("text", "lang", "source")
    judged = op6_quality.judge(docs, also={name: key})
    rejected = judged.filter(~F.col("kept")).select("doc_id", name)
    return _without(docs.withColumn(name, key), rejected).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, the document with the smallest id stays, once.

    Empty texts and null ids are near to nothing and stay; of rows with the id that stays and one text, one stays; an empty
    table stays empty.
    """
    found = written(op9_jaccard.jaccard_components(docs, k=SHINGLE, threshold=SIMILARITY), "pipeline-groups")
    kept = _without(docs, found.filter("doc_id <> component_id").select("doc_id"))
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = written(repeated, "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return _without(kept, repeated).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts and items overlap nothing, null ids go like others."""
    hits = op3_decontaminate.contaminated(docs, benchmark(spark, sf_dir))
    return _without(docs, hits.select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows.  Rows are kept, null and empty texts as they are."""
    clean = op7_pii.redact(docs, op7_pii.bootstrap(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as little-endian unsigned 32-bit integers, and the hash of what they decode to; null texts have none."""
    out = op10_bpe.encode_decode(docs, bpe.default_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", personal_data), ("BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
