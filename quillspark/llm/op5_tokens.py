"""Operator 5: token counts by a two-tier lookup on the map side.

Tier 1 is a compact table of frequent pre-tokens and their token counts, of at most
``frequent`` entries, made from about ``sample_rows`` documents and broadcast.  Tier 2 is a bounded
cache in each worker, filled by encoding what tier 1 misses.  No pre-token is shuffled.  Both tiers
only save time: what a count is never depends on them.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids and repeated rows stay; of equally
frequent pre-tokens the first by name is pinned; very long texts and pre-tokens are counted whole; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_batches, documents

LIMIT = 512
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class TwoTier:
    """Pre-token to token count: a pinned tier, and a tier that is emptied when full."""

    def __init__(self, pinned: dict[str, int], coder: bpe.Bpe, most: int):
        self.pinned, self.coder, self.most, self.table = pinned, coder, most, dict(pinned)

    def fill(self, wanted: set[str]) -> dict[str, int]:
        if len(self.table) + len(wanted) > len(self.pinned) + self.most:
            self.table = dict(self.pinned)
        missing = [p for p in wanted if p not in self.table]
        short = [p for p in missing if len(p) <= bpe.PIECE_LEAF]
        for p, e in zip(short, self.coder.tok.encode_batch_fast(short, add_special_tokens=False)):
            self.table[p] = len(e.ids)
        for p in missing:
            if len(p) > bpe.PIECE_LEAF:
                self.table[p] = len(self.coder.tree(p))
        return self.table

    def count(self, texts: list[str]) -> list[int]:
        coder = self.coder
        odd = [bool(t) and coder.has_special(t) for t in texts]
        split = [[] if o or not t else coder.pieces(t) for t, o in zip(texts, odd)]
        get = self.fill(set().union(*split)).__getitem__
        return [len(coder.encode_many([t])[0]) // 4 if o else sum(map(get, s)) for t, o, s in zip(texts, odd, split)]


def frequent_lengths(texts: DataFrame, tokenizer: str, sample_rows: int, frequent: int) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in about ``sample_rows`` rows, spread by hash."""
    rows = texts.count()
    share = min(1.0, sample_rows / max(rows, 1))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = bpe.loaded(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not coder.has_special(text):
                    seen.update(coder.pieces(text))
        top = seen.most_common(frequent)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    picked = texts.filter(F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53) < share).select("text")
    top = picked.mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(frequent)
    pieces = [r["piece"] for r in top.collect()]
    coder = bpe.loaded(tokenizer)
    return {p: len(e.ids) for p, e in zip(pieces, coder.tok.encode_batch_fast([*pieces], add_special_tokens=False))}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, sample_rows: int = 500, frequent: int = 16384, worker_entries: int = 200_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(frequent_lengths(src, tokenizer, sample_rows, frequent))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = TwoTier(table.value, bpe.loaded(tokenizer), worker_entries)
        for batch in batches:
            n = []
            for at in range(0, batch.num_rows, 100):
                n += lookup.count(batch.column(1).slice(at, 100).to_pylist())
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(counted, COUNTED)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), bpe.default_path())
