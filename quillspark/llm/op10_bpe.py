"""Operator 10: BPE encoding and decoding, long texts by tree concatenation.

Texts of up to ``leaf_chars`` characters are encoded where they are.  A longer text is cut into
leaves at any place, the leaves are encoded in parallel as rows of their own, and pairs of
neighbours are joined level by level: the window around a join is encoded again and grows until
both sides agree exactly (see :meth:`Bpe.concat`).

Defined results: a null or empty text has no ids and decodes to the empty text; null ids are kept;
repeated rows give repeated results; a text with a special token is encoded as a whole; ties can't arise, since merges have
an order; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_batches, documents

ENCODED = "doc_id long, ids binary, decoded string"
LEAF_CHARS = 16384


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, digests: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): ids are little-endian unsigned 32-bit integers.

    With ``digests`` the rows are (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids and texts
    never leave the workers.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    special = list(bpe.loaded(tokenizer).special)
    is_long = F.length("text") > leaf_chars
    for s in special:
        is_long = is_long & ~F.contains("text", F.lit(s))
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED

    def finish(coder: bpe.Bpe, ids: bytes) -> tuple:
        text = coder.decode(ids)
        return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digests else (ids, text)

    def frame(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.binary(), pa.string()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                yield frame(part.column(0), [finish(coder, ids) for ids in coder.encode_many(part.column(1).to_pylist())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each long text is read once, and its leaves go out a few megabytes at a time."""
        for batch in batches:
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                last = -(-len(text) // leaf_chars)
                for lo in range(0, last, 256):
                    numbers = range(lo, min(lo + 256, last))
                    m = len(numbers)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * m, pa.int64()), pa.array([key] * m, pa.string()), pa.array(numbers, pa.int32()), pa.array([text[i * leaf_chars : (i + 1) * leaf_chars] for i in numbers], pa.string())], ["doc_id", "key", "leaf_no", "leaf"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(tokenizer)
        for batch in batches:
            ids, edges = [], []
            for text in batch.column("leaf").to_pylist():
                pieces = coder.pieces(text)
                known = coder.learn(set(pieces))
                own = [known[p] for p in pieces]
                ids.append(b"".join(own))
                edges.append(coder.edges(pieces, own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "leaf_no", "leaf")), pa.array(ids, pa.binary()), pa.array(edges, pa.binary())], ["doc_id", "key", "leaf_no", "leaf", "ids", "edges"])

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        """One long document: its leaves, pairwise joined; equal rows of the input repeat their leaves."""
        coder = bpe.loaded(tokenizer)
        copies = int((pdf["leaf_no"] == 0).sum())
        pdf = pdf.drop_duplicates("leaf_no").sort_values("leaf_no")
        level = [coder.part(*row) for row in zip(pdf["leaf"], pdf["ids"], pdf["edges"])]
        while len(level) > 1:
            level = [coder.concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        ids = coder.flat(level[0])
        doc_id = pdf["doc_id"].iloc[0]
        rows = [(None if pd.isna(doc_id) else int(doc_id), *finish(coder, ids))] * copies
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    whole = src.filter(~is_long).mapInArrow(short, out)
    cut = (
        src.filter(is_long)
        .withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)))
        .select("doc_id", "key", "text")
        .mapInArrow(cut_up, "doc_id long, key string, leaf_no int, leaf string")
        .repartition(F.col("key"), F.col("leaf_no"))
        .mapInArrow(leaves, "doc_id long, key string, leaf_no int, leaf string, ids binary, edges binary")
        .groupBy("key")
        .applyInPandas(tree, out)
    )
    return whole.unionByName(cut)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), bpe.default_path(), digests=True)
