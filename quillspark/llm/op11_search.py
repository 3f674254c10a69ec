"""Operator 11: ranked lexical search, document at a time over compressed postings.

Index.  A scanning task cuts its documents into shards of about ``SHARD_TOKENS`` tokens.  A shard's documents are numbered
by ascending doc_id, and each of its terms has one row: the documents that hold it, as varint gaps of these numbers and
term counts.  One more row has the shard's doc_ids and lengths.  Nothing is shuffled to build it; document frequencies are
sums over the rows' counts.

Search.  Items are taken in blocks of a bounded number of terms.  The rows of a block's terms go to their shards, and each
item's lists are merged by a heap of k cursors in document order.  The best ``k`` documents so far are kept in a
bounded heap, ordered by score, then by doc_id; it goes on from shard to shard within a task.  Lists whose greatest
contributions together stay below the heap's least score can't bring a new document in, so they are only probed (exact).
A last step merges the tasks' heaps.

Defined results: null and blank texts have no term and are not documents of the index; rows with a null doc_id count in the
statistics and are never a result; repeated rows are documents of their own; items are rows, so repeated items have
repeated results; equal scores go by ascending doc_id; an empty table of either kind gives no row; very long texts are
one document each; a score must be above 0; other columns are not read.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow_batches, benchmark, documents, parallelism, written

#: Tokens of a shard; one text more may be in it.
SHARD_TOKENS = 1 << 20
#: Distinct terms of the items that are searched together: their weights and heaps are what a task holds.
BLOCK_TERMS = 100_000
#: Items of a block.
BLOCK_ITEMS = 2_000
INDEX = "shard long, term long, docs long, tokens long, payload binary"
#: Bytes that are in no term: ASCII but for digits and letters.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
U64 = np.uint64


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each value): seven bits a byte, the last byte below 128."""
    v = values.astype(U64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >= (U64(1) << U64(bits))
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at, left, rest = ends - size, size.copy(), v.copy()
    while len(at):
        out[at] = (rest & U64(127)).astype(np.uint8) | np.where(left > 1, 128, 0).astype(np.uint8)
        on = left > 1
        at, left, rest = at[on] + 1, left[on] - 1, rest[on] >> U64(7)
    return out, size


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw & 127).astype(U64) << (U64(7) * place.astype(U64)), starts).view(np.int64)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each row and the end)."""
    return H.word_hashes(column, lower=True, space=BETWEEN)


def shard_rows(shard: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    """The rows of :data:`INDEX` for documents (doc_id, term hashes) with a term each."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    sizes = np.array([len(d[1]) for d in docs])
    hashes, number = np.concatenate([d[1] for d in docs]), np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(hashes, kind="stable")  # within a term, documents stay in order
    hashes, number = hashes[order], number[order]
    new_term = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    new = new_term | np.concatenate([[True], number[1:] != number[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(hashes)))
    number, opens = number[first], new_term[first]
    gap = number - np.where(opens, 0, np.concatenate([[0], number[:-1]]))
    data, size = varint(np.stack([gap, count], 1).reshape(-1))
    lists = np.flatnonzero(opens)
    edges = np.concatenate([[0], np.cumsum(size)])[np.append(2 * lists, len(size))]
    ids = np.array([d[0] for d in docs if d[0] is not None], np.int64)
    start = int(ids[0]) if len(ids) else 0
    gaps, _ = varint(np.diff(ids, prepend=start).view(U64))
    lengths, _ = varint(sizes)
    head = np.array([start, len(gaps)], "<i8").tobytes() + gaps.tobytes() + lengths.tobytes()
    offsets = pa.array(np.concatenate([[0], edges - edges[0] + len(head)]).astype(np.int32), pa.int32())
    payload = pa.BinaryArray.from_buffers(pa.binary(), len(lists) + 1, [None, offsets.buffers()[1], pa.py_buffer(head + data.tobytes())])
    held = np.diff(np.append(lists, len(first)))
    tokens = np.add.reduceat(count, lists)
    n = len(lists) + 1
    term = pa.array(np.concatenate([[0], hashes[first[lists]].view(np.int64)]), mask=np.arange(n) == 0)
    columns = [pa.array(np.full(n, shard, np.int64)), term, pa.array(np.concatenate([[len(docs)], held])), pa.array(np.concatenate([[len(hashes)], tokens])), payload]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "docs", "tokens", "payload"])


def header(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(doc_ids, lengths) of a shard in order; documents without an id are the last lengths."""
    start, size = np.frombuffer(payload[:16], "<i8").tolist()
    return start + np.cumsum(unvarint(payload[16 : 16 + size])), unvarint(payload[16 + size :])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The index of a table, written: a row of :data:`INDEX` for each term of each shard, and one without a term for the shard."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, tokens = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in H.slices(texts):
                hashes, at = terms(texts.slice(a, b - a))
                for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    if e > s:
                        held.append((ids[a + i], hashes[s:e]))
                        tokens += e - s
                        if tokens >= shard_tokens:
                            yield shard_rows((task << 32) + n, held)
                            n, held, tokens = n + 1, [], 0
        if held:
            yield shard_rows((task << 32) + n, held)

    return written(src.mapInArrow(cut, INDEX), "search-index")


def merge(lists: list[tuple[list[int], list[int], int]], ids: list[int], heap: list[tuple[int, int]], k: int) -> None:
    """One item over one shard: ``lists`` are (document numbers, contributions, greatest contribution), ``ids`` the numbers' doc_ids.

    ``heap`` holds up to k (score, -doc_id), the worst first, and is changed in place.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bound, total = [], 0
    for x in lists:
        total += x[2]
        bound.append(total)  # of this list and those before it
    least = heap[0][0] if len(heap) == k else 1
    probed = 0
    while probed < len(lists) and bound[probed] < least:
        probed += 1
    cursors = [(x[0][0], j, 0) for j, x in enumerate(lists) if j >= probed]
    heapq.heapify(cursors)
    places, end = [0] * len(lists), len(ids)
    replace, pop = heapq.heapreplace, heapq.heappop
    while cursors:
        doc = cursors[0][0]
        if doc >= end:
            break  # only documents without an id are left
        score = 0
        while cursors and cursors[0][0] == doc:
            _, j, at = cursors[0]
            numbers, given, _ = lists[j]
            score += given[at]
            at += 1
            if at < len(numbers):
                replace(cursors, (numbers[at], j, at))
            else:
                pop(cursors)
        j = probed - 1
        while j >= 0 and score + bound[j] >= least:
            numbers, given, _ = lists[j]
            at = places[j] = bisect_left(numbers, doc, places[j])
            if at < len(numbers) and numbers[at] == doc:
                score += given[at]
            j -= 1
        if j >= 0 or score < least:
            continue
        entry = (score, -ids[doc])
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            replace(heap, entry)
        if len(heap) == k and heap[0][0] > least:
            least = heap[0][0]
            if probed < len(lists) and bound[probed] < least:
                while probed < len(lists) and bound[probed] < least:
                    places[probed] = 0
                    probed += 1
                cursors = [c for c in cursors if c[1] >= probed]
                heapq.heapify(cursors)


def contributions(payload: bytes, weight: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, what the term adds to their scores)."""
    pairs = unvarint(payload).reshape(-1, 2)
    number, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
    return number, weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[number]))


def _blocks(items: list[tuple[int, int]], terms_most: int, items_most: int) -> Iterator[tuple[int, int]]:
    """Ranges of item numbers with a bounded number of terms, one item at least."""
    first, terms_now, n = None, 0, 0
    for item, size in items:
        if first is not None and (terms_now + size > terms_most or n == items_most):
            yield first, item
            first = None
        if first is None:
            first, terms_now, n = item, 0, 0
        terms_now, n = terms_now + size, n + 1
    if first is not None:
        yield first, items[-1][0] + 1


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item with a score above 0, in an ``index`` of :func:`build`."""
    spark = index.sparkSession
    out = f"item long, {item_col} {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long"
    n, tokens = index.filter("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col), F.col(text_col).cast("string").alias("text"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            hashes, at = terms(texts)
            each = [np.unique(hashes[s:e], return_counts=True) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.view(np.int64) for t, _ in each], pa.list_(pa.int64())), pa.array([c for _, c in each], pa.list_(pa.int64()))], ["item", "terms", "counts"])

    asked = written(asked, "search-items")
    spelt = written(asked.select("item", "text").mapInArrow(spell, "item long, terms array<long>, counts array<long>").filter("size(terms) > 0"), "search-terms")
    found = None
    for first, end in _blocks([tuple(r) for r in spelt.select("item", F.size("terms")).orderBy("item").toLocalIterator()], block_terms, block_items):
        part = _block(index, spelt.filter((F.col("item") >= first) & (F.col("item") < end)), n, tokens, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], out)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", item_col), "item").select("item", item_col, "rank", "doc_id", "score")


def _block(index: DataFrame, spelt: DataFrame, n: int, tokens: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of each item; the block's terms and weights are bounded, and go to the tasks."""
    spark = index.sparkSession
    wanted = F.broadcast(spelt.select(F.explode("terms").alias("term")).distinct())
    lists = index.join(wanted, "term", "left_semi")
    df = dict(lists.groupBy("term").agg(F.sum("docs")).collect())
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = [(r["item"], [(t, c) for t, c in zip(r["terms"], r["counts"]) if weights.get(t, 0) > 0]) for r in spelt.collect()]
    given = spark.sparkContext.broadcast((weights, asked))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = given.value
        heaps: dict[int, list] = {item: [] for item, _ in asked}
        shard, head, held = None, None, {}

        def finish() -> None:
            if head is None or not held:
                return
            ids, lengths = header(head)
            m = 25 + (75 * lengths * n) // tokens
            spread = {t: contributions(p, weights[t], m) for t, p in held.items()}
            spread = {t: (a.tolist(), v, int(v.max())) for t, (a, v) in spread.items()}
            as_list, names = {}, ids.tolist()
            for item, terms_of in asked:
                lists = []
                for t, c in terms_of:
                    if t in spread:
                        if (t, c) not in as_list:
                            as_list[t, c] = (spread[t][1] * c).tolist()
                        lists.append((spread[t][0], as_list[t, c], spread[t][2] * c))
                if lists:
                    merge(lists, names, heaps[item], k)

        for batch in batches:
            for s, t, p in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "payload"))):
                if s != shard:
                    finish()
                    shard, head, held = s, None, {}
                if t is None:
                    head = p
                elif weights.get(t, 0) > 0:
                    held[t] = p
        finish()
        rows = [(item, -x[1], x[0]) for item, heap in heaps.items() for x in heap]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 10_000]], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    rows = lists.unionByName(index.filter("term is null")).select("shard", "term", "payload")
    dealt = rows.repartition(parallelism(spark), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(rank, "item long, doc_id long, score long")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build(documents(spark, sf_dir)), benchmark(spark, sf_dir))
    return found.select("item_id", "rank", "doc_id", "score")
