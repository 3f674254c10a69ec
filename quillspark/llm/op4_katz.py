"""Operator 4: language-model scores by Katz backoff over word n-grams, of order three unless told otherwise.

Counting: every token ends a gram of each order; a text begins behind ``order - 1`` start marks and ends with an end token.
All counted grams are in the model.

Good-Turing discounts (Katz, k = 5) come from each order's counts of counts.  P(w | history) is the discounted share of a seen
gram, and the backoff weight of a history is (1 - sum of its grams' probabilities) / (1 - sum of their lower grams'
probabilities), so that the probabilities of all tokens, one unknown token included, add up to one at every order.

A position is a token with its ``order - 1`` words before.  All grams of two words or more that end there, their histories and
lower grams share the word before the token, so positions are dealt by that word, and what meets in one bucket is counted, made
into a model and scored in place: no table of grams is kept, and a text gets sums back.  This is done twice: first for the counts
of counts, then for the scores.  A position travels as the difference of sorted words, its row and two bytes for each
other word, or eight if the word is not among the 65,534 most frequent.

A word that many positions follow is dealt to several buckets, by the word before it.  Its grams of two words are counted apart
(merged in the tasks, then by gram), and each of its buckets gets their counts.

Tokens' own counts come from one table.  The ``frequent`` most frequent tokens (a bounded number) are broadcast; of the others
the bucket says which row asks for which token, and what the distinct ones behind one word add to that word's backoff weight is a join.

Words are hashed to 64 bits, as are grams: a gram is the pair of its history and its last word.

Defined results: a null or empty text is its end token alone; null ids count as training documents; a null
``learn`` is no training and stays null; repeated rows stay and count; with no training document every token is unknown with probability one; of equally frequent tokens the
least are broadcast; very long texts are taken in slices of rows, each whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow_batches, crc_remainder, discard, documents, parallelism, written

END = np.uint64(0x0123456789ABCDEF)
START = np.uint64(0xFEDCBA9876543210)
K = 5
ORDER = 3
#: Tokens that a task merges at once.
FLUSH = 1_000_000
#: Words of two bytes, the start mark among them; the last number says that the word follows whole.
SHORT = 65_535
#: Buckets of each partition: a task holds one at a time.
BUCKETS = 8

POSITIONS, PAIRS, SHARES, ROWS = range(4)
RECORD = {"bucket": pa.int32(), "kind": pa.int32(), "row": pa.int64(), "data": pa.binary(), "rest": pa.binary(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64()}
RECORD_DDL = "bucket int, kind int, row long, data binary, rest binary, doc_id long, held_out boolean, n long, known long, base double"
JUDGED = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "key": pa.int64(), "k": pa.int64(), "u": pa.int64()}
JUDGED_DDL = "row long, doc_id long, held_out boolean, n long, known long, base double, score double, key long, k long, u long"


def frame(types: dict[str, pa.DataType], m: int, **known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(m, t) for c, t in types.items()], list(types))


def shifted(x: np.ndarray, starts: np.ndarray, fill) -> np.ndarray:
    """What stands before each place of a text, ``fill`` at its start."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = fill
    return out


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first token of each row and the end)."""
    words, per_row = H.word_hashes(column, lower=True)
    bounds = per_row + np.arange(len(column) + 1)
    token = np.empty(len(words) + len(column), H.U64)
    at_end = np.zeros(len(token), bool)
    at_end[bounds[1:] - 1] = True
    token[at_end], token[~at_end] = END, words
    return token, bounds


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x in sorted keys."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def discounts(n: dict[int, int], k: int = K) -> list[float]:
    """Factor of each count r = 1..k, 1 where Good-Turing gives none between 0 and 1."""
    if not n.get(1):
        return [1.0] * k
    common = (k + 1) * n.get(k + 1, 0) / n[1]
    out = []
    for r in range(1, k + 1):
        star = (r + 1) * n.get(r + 1, 0) / n[r] / r if n.get(r) else 1.0
        d = (star - common) / (1 - common) if common < 1 else 1.0
        out.append(d if 0 < d < 1 else 1.0)
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.where(c > K, 1.0, np.array(d)[np.clip(c, 1, K).astype(np.int64) - 1])


class Places:
    """Where positions go: by the word before the token, words that many positions follow by the word before that one as well."""

    def __init__(self, hot: dict[int, int], buckets: int):
        order = sorted(hot)
        self.hot, self.parts, self.buckets = np.array(order, H.U64), np.array([hot[m] for m in order], H.U64), buckets
        self.split = np.sort(np.concatenate([self.part(np.full(n, m, H.U64), np.arange(n, dtype=H.U64)) for m, n in hot.items()])) if hot else self.hot

    @staticmethod
    def part(m: np.ndarray, part: np.ndarray) -> np.ndarray:
        return H.mix(m + (part + H.U64(1)) * H.U64(0x9E3779B97F4A7C15))

    def of(self, m: np.ndarray, by: np.ndarray) -> np.ndarray:
        i, hit = found(self.hot, m)
        if hit.any():
            m = m.copy()
            m[hit] = self.part(m[hit], H.mix(by[hit]) % self.parts[i[hit]])
        return m

    def everywhere(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(m, row) for each of the parts."""
        i, hit = found(self.hot, m)
        times = np.where(hit, self.parts[i], H.U64(1)).astype(np.int64) if len(self.hot) else np.ones(len(m), np.int64)
        row = np.repeat(np.arange(len(m)), times)
        part = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(H.U64)
        return np.where(hit[row], self.part(m[row], part), m[row]), row

    def cut(self, m: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, start, end) of sorted m."""
        bucket = ((m >> H.U64(40)) * H.U64(self.buckets)) >> H.U64(24)
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(m)) if len(m) else [0]
        for s, e in zip(edges[:-1], edges[1:]):
            yield int(bucket[s]), s, e


class Tokens:
    """The most frequent tokens and their counts in training, sorted by token; given most frequent first, the first have two bytes."""

    def __init__(self, key: np.ndarray, c: np.ndarray):
        short = key[: SHORT - 1]
        self.short = np.concatenate([[START], short])
        by = np.argsort(key, kind="stable")
        self.key, self.c = key[by], c[by]
        self.codes = np.where(by < len(short), by + 1, SHORT).astype(np.uint16)
        self.place = np.zeros(len(short) + 1, np.int64)
        self.place[1:][by[by < len(short)]] = np.flatnonzero(by < len(short))
        # Hashes are evenly spread, so their first bits tell nearly where they are.
        bits = max(1, len(key).bit_length() + 1)
        self.shift = H.U64(64 - bits)
        self.start = np.searchsorted(self.key, np.arange(1 << bits, dtype=H.U64) << self.shift).astype(np.int32)

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each token."""
        if not len(self.key):
            return np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        last = len(self.key) - 1
        at = np.minimum(self.start[token >> self.shift], last)
        key = self.key[at]
        hit, behind = key == token, np.flatnonzero((key < token) & (at < last))
        while len(behind):
            at[behind] += 1
            key, want = self.key[at[behind]], token[behind]
            hit[behind] = key == want
            behind = behind[(key < want) & (at[behind] < last)]
        return at, hit

    def code(self, place: np.ndarray, hit: np.ndarray) -> np.ndarray:
        return np.where(hit, self.codes[place], np.uint16(SHORT)) if len(self.key) else np.full(len(place), SHORT, np.uint16)

    def words(self, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
        whole = code == SHORT
        out = self.short[np.where(whole, 0, code)]
        out[whole] = rest
        return out

    def find_coded(self, token: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``find``, of tokens with known codes."""
        hit = code != SHORT
        at = self.place[np.where(hit, code, 0)]
        whole = np.flatnonzero(~hit)
        at[whole], hit[whole] = self.find(token[whole])
        return at, hit


def dealt(shared, order: int, base_unknown: float = 0.0, rows: bool = True) -> Callable:
    """Positions of rows (doc_id, held_out, text) as packed records; with ``rows`` also one record for each row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, places = shared.value
        row = TaskContext.get().partitionId() << 33
        held, size, first = [], 0, row

        def flush() -> pa.RecordBatch:
            token, before, at, *codes = (np.concatenate(x) for x in zip(*(h[0] for h in held)))
            further = [np.concatenate(x) for x in zip(*(h[1] for h in held))]
            m = places.of(H.mix(before), further[0] if further else (at >> np.uint32(1)).astype(H.U64))
            by = np.argsort(m)
            m, at, codes, words = m[by], at[by], [x[by] for x in codes], [x[by] for x in (token, *further)]
            cuts = list(places.cut(m))
            data = [squeezed(H.pack(m[s:e], at[s:e], *(x[s:e] for x in codes))) for _, s, e in cuts]
            rest = [b"".join(w[s:e][x[s:e] == SHORT].tobytes() for w, x in zip(words, codes)) for _, s, e in cuts]
            held.clear()
            return frame(RECORD, len(cuts), bucket=[b for b, _, _ in cuts], kind=[POSITIONS] * len(cuts), row=[first] * len(cuts), data=data, rest=rest)

        for batch in batches:
            for a, b in H.slices(batch.column(2), 1 << 19):
                part = batch.slice(a, b - a)
                token, bounds = tokens_of(part.column(2))
                count, who = len(part), np.repeat(np.arange(len(part)), np.diff(bounds))
                i, hit = tokens.find(token)
                if rows:
                    known = hit & (tokens.c[i] > 0) if len(tokens.key) else hit
                    base = np.bincount(who[hit], np.log10(tokens.c[i[hit]] + 1.0) + base_unknown, count).astype(np.float64)
                    numbers = np.arange(count) + row
                    spread = (H.mix(numbers.view(H.U64)) % H.U64(places.buckets)).astype(np.int32)
                    yield frame(RECORD, count, bucket=spread, kind=np.full(count, ROWS, np.int32), row=numbers, doc_id=part.column(0), held_out=part.column(1), n=np.diff(bounds), known=np.bincount(who[known], minlength=count), base=base)
                learn = ~part.column(1).fill_null(True).to_numpy(zero_copy_only=False)
                at = (((who + (row - first)) << 1) | learn[who]).astype(np.uint32) if rows else np.ones(len(token), np.uint32)
                starts, code, before, codes, further = bounds[:-1], tokens.code(i, hit), token, [], []
                codes.append(code)
                for k in range(1, order):
                    code, before = shifted(code, starts, 0), shifted(before, starts, START)
                    if k == 1:
                        last = before
                    else:
                        codes.append(code)
                        further.append(before)
                held.append(((token, last if order > 1 else np.full(len(token), START), at, *codes), further))
                size += len(token)
                row += count
                if size >= FLUSH:
                    yield flush()
                    size, first = 0, row
        if held:
            yield flush()

    return deal


class Bucket:
    """What meets in one bucket."""

    def __init__(self, records: list[tuple], tokens: Tokens, order: int):
        parts = []
        for _, _, row, data, rest, *_ in (r for r in records if r[1] == POSITIONS):
            m, at, *codes = H.unpack(opened(data), np.uint64, np.uint32, *[np.uint16] * max(1, order - 1))
            rest, words, code = np.frombuffer(rest, H.U64), [], codes[0]
            for x in codes:
                n = int((x == SHORT).sum())
                words.append(tokens.words(x, rest[:n]))
                rest = rest[n:]
            parts.append((m, row + (at >> np.uint32(1)).astype(np.int64), (at & np.uint32(1)).astype(bool), code, *words))
        none = [np.zeros(0, H.U64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint16), *[np.zeros(0, H.U64)] * max(1, order - 1)]
        self.m, self.row, self.learn, self.code, self.c, *self.further = (np.concatenate(x) for x in zip(none, *parts))
        self.pairs = self.joined(records, PAIRS, np.uint64, np.int64)
        self.shares = self.joined(records, SHARES, np.float64)

    @staticmethod
    def joined(records: list[tuple], kind: int, *dtypes) -> list[np.ndarray]:
        parts = [H.unpack(opened(r[3]), np.uint64, *dtypes) for r in records if r[1] == kind]
        return [np.concatenate(x) for x in zip([np.zeros(0, d) for d in (np.uint64, *dtypes)], *parts)]

    def histories(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """The history of each position, from the order of two on."""
        h = self.m
        for k in range(2, order + 1):
            yield k, h
            if k < order:
                h = H.pair(self.further[k - 2], h)


def by_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The records of each bucket; those of rows come by themselves."""
    held = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][0] != r[0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def met(records: DataFrame, work: Callable, types: str, name: str) -> DataFrame:
    """The table of what ``work`` makes of each bucket's records; the shuffle's files go as soon as it is written."""
    conf, key = records.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(records.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, types), name)
    finally:
        conf.set(key, before)


def vocabulary(src: DataFrame) -> DataFrame:
    """(key, c, t): how often each token is in training rows, and in all."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            c = np.bincount(at, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)
            t = np.bincount(at, minlength=len(key))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), c, t)], ["key", "c", "t"])

        for batch in batches:
            for a, b in H.slices(batch.column(1), 1 << 19):
                token, bounds = tokens_of(batch.column(1).slice(a, b - a))
                learn = ~batch.column(0).slice(a, b - a).fill_null(True).to_numpy(zero_copy_only=False)
                held.append((token, np.repeat(learn, np.diff(bounds))))
                size += len(token)
                if size >= 4 * FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counted = src.select("held_out", "text").mapInArrow(tally, "key long, c long, t long")
    return written(counted.groupBy("key").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "katz-tokens")


def hot_pairs(training: DataFrame, shared) -> DataFrame:
    """(m, w, n): counts of two words of which the first is hot."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size = shared.value[1].hot, [], 0

        def flush() -> pa.RecordBatch:
            m, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, first, n = np.unique(H.pair(m, w), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (m[first].view(np.int64), w[first].view(np.int64), n)], ["m", "w", "n"])

        for batch in batches:
            for a, b in H.slices(batch.column(0), 1 << 19):
                token, bounds = tokens_of(batch.column(0).slice(a, b - a))
                m = H.mix(shifted(token, bounds[:-1], START))
                hit = found(hot, m)[1]
                held.append((m[hit], token[hit]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    counted = training.select("text").mapInArrow(tally, "m long, w long, n long")
    return written(counted.groupBy("m", "w").agg(F.sum("n").alias("n")), "katz-hot")


def counts_of_counts(shared, order: int) -> Callable:
    """(k, r, n, m, w): n grams of order k that come r times, and with k = 0 pairs whose second word is not frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = shared.value
        total = np.zeros((order + 1, K + 2), np.int64)
        for records in by_buckets(batches):
            b = Bucket(records, tokens, order)
            for k, h in b.histories(order):
                gram = H.pair(h, b.c)
                if k == 2:
                    cold = ~found(places.split, b.m)[1]
                    _, first, c = np.unique(gram[cold], return_index=True, return_counts=True)
                    m, w = b.m[cold][first], b.c[cold][first]
                    rare = ~tokens.find_coded(w, b.code[cold][first])[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(rare.sum()), np.int32)), *(pa.nulls(int(rare.sum()), pa.int64()),) * 2, pa.array(m[rare].view(np.int64)), pa.array(w[rare].view(np.int64))], list("krnmw"))
                else:
                    c = np.unique(gram, return_counts=True)[1]
                total[k] += np.bincount(c[c <= K + 1], minlength=K + 2)
        k, r = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(r), pa.array(total[k, r]), *(pa.nulls(len(k), pa.int64()),) * 2], list("krnmw"))

    return count


def packed(shared, kind: int) -> Callable:
    """Rows (m, ...) as records for all places of m."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value[1]
        for batch in batches:
            m, *others = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            m, row = places.everywhere(m.view(H.U64))
            by = np.argsort(m, kind="stable")
            m, others = m[by], [x[row][by] for x in others]
            cuts = list(places.cut(m))
            yield frame(RECORD, len(cuts), bucket=[b for b, _, _ in cuts], kind=[kind] * len(cuts), data=[squeezed(H.pack(m[s:e], *(x[s:e] for x in others))) for _, s, e in cuts])

    return pack


def judged(shared, order: int, of_counts: dict[int, dict[int, int]], whole: float, log_unknown: float) -> Callable:
    """(row, score) sums of positions, and (row, key, k, u) for tokens that are not frequent: k in all, u of them after no known word."""
    cut = {k: discounts(of_counts[k]) for k in range(1, order + 1)}

    def probabilities(c_of: np.ndarray, h_of_gram: np.ndarray, n_h: int, q: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """(P of grams, log of the backoff weight of histories): ``q`` has the lower probabilities of the seen grams of each history."""
        dc = discounted(c_of, d)
        ch, s = np.bincount(h_of_gram, c_of, n_h), np.bincount(h_of_gram, dc, n_h)
        under = np.where(s < ch * (1 - 1e-12), ch, ch + 1.0)
        ratio = (1 - s / under) / (1 - q)
        la = np.where((ch > 0) & (ratio > 0), np.log10(np.where(ratio > 0, ratio, 1.0)), 0.0)
        return dc / under[h_of_gram], la

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = shared.value
        p_key = discounted(tokens.c.astype(np.float64), cut[1]) / (whole or 1.0)
        log_p = np.where(tokens.c > 0, np.log10(np.where(tokens.c > 0, p_key, 1.0)), log_unknown)
        rows, sums, size = [], [], 0

        def collapsed() -> tuple[np.ndarray, np.ndarray]:
            row, at = np.unique(np.concatenate(rows), return_inverse=True)
            return row, np.bincount(at, np.concatenate(sums), len(row))

        for records in by_buckets(batches):
            own = [r for r in records if r[1] == ROWS]
            if own:
                yield frame(JUDGED, len(own), **{c: [r[i] for r in own] for c, i in (("row", 2), ("doc_id", 5), ("held_out", 6), ("n", 7), ("known", 8), ("base", 9))})
            b = Bucket(records, tokens, order)
            if not len(b.m):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                place, frequent = tokens.find_coded(b.c, b.code)
                logp = np.where(frequent, log_p[place], 0.0) if len(log_p) else np.zeros(len(b.m))
                seen = np.zeros(len(b.m), bool)
                lower = None
                for k, h in b.histories(order):
                    word, weight = b.c, b.learn.astype(np.float64)
                    if k == 2:  # words before that are dealt to several buckets have their counts from elsewhere
                        weight[found(places.split, h)[1]] = 0
                        low = np.where(frequent, p_key[place], 0.0) if len(p_key) else np.zeros(len(b.m))
                        i, hit = tokens.find(b.pairs[1])
                        low = np.concatenate([low, np.where(hit, p_key[i], 0.0) if len(p_key) else np.zeros(len(i))])
                        h, word, weight = np.concatenate([h, b.pairs[0]]), np.concatenate([b.c, b.pairs[1]]), np.concatenate([weight, b.pairs[2]])
                    hist, h_of = np.unique(h, return_inverse=True)
                    _, first, g_of = np.unique(H.pair(h, word), return_index=True, return_inverse=True)
                    c = np.bincount(g_of, weight, len(first))
                    is_gram = c > 0
                    low = (low if k == 2 else lower)[first]
                    q = np.bincount(h_of[first][is_gram], low[is_gram], len(hist))
                    if k == 2:
                        i, hit = found(hist, b.shares[0])
                        np.add.at(q, i[hit], b.shares[1][hit])
                    p, la = probabilities(c, h_of[first], len(hist), q, cut[k])
                    n = len(b.m)
                    at = is_gram[g_of[:n]]
                    lower = p[g_of[:n]]
                    logp = np.where(at, np.log10(np.where(at, lower, 1.0)), la[h_of[:n]] + logp)
                    seen |= at
            row, at = np.unique(b.row, return_inverse=True)
            rows.append(row)
            sums.append(np.bincount(at, logp, len(row)))
            size += len(row)
            if size > FLUSH:
                row, s = collapsed()
                rows, sums, size = [row], [s], 0
            rare = ~frequent
            row, key, u = b.row[rare], b.c[rare], ~seen[rare]
            by = np.lexsort((key, row))
            row, key, u = row[by], key[by], u[by]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
            if len(first):
                yield frame(JUDGED, len(first), row=row[first], key=key[first].view(np.int64), k=np.diff(np.append(first, len(row))), u=np.add.reduceat(u.astype(np.int64), first))
        if rows:
            row, s = collapsed()
            yield frame(JUDGED, len(row), row=row, score=s)

    return judge


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, frequent: int = 500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens); held_out is where ``learn`` does not hold."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learn).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    training = src.filter(~F.col("held_out"))

    vocab = vocabulary(src)
    of_counts: dict[int, dict[int, int]] = {k: {} for k in range(1, order + 1)}
    for r in vocab.filter(F.col("c").between(1, K + 1)).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect():
        of_counts[1][r["c"]] = r["n"]
    n, v, everything = vocab.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("t")))).first()
    d = discounts(of_counts[1])
    free = sum((1 - d[r - 1]) * r * of_counts[1].get(r, 0) for r in range(1, K + 1))
    whole = n if free > 1e-12 else n + 1  # with nothing discounted, one more count for the unknown token
    free = free if free > 1e-12 else 1.0
    log_unknown, base_unknown = math.log10(free / whole) if n else 0.0, -math.log10(n + v + 1)

    top = vocab.orderBy(F.desc("t"), "key").limit(frequent).toArrow()
    t, key = (top.column(c).to_numpy() for c in ("t", "key"))
    tokens = Tokens(key.view(H.U64), top.column("c").to_numpy())
    rest = vocab
    if len(key):
        rest = vocab.filter((F.col("t") < int(t[-1])) | ((F.col("t") == int(t[-1])) & (F.col("key") > int(key[-1]))))
    # A word that a partition's share of all positions follows is dealt to several buckets; the start mark is before each text.
    share = max(1, everything // parallelism(spark))
    hot = {int(H.mix(np.array([START if r["key"] == int(END.view(np.int64)) else H.U64(r["key"] % 2**64)], H.U64))[0]): -(-r["t"] // share) for r in vocab.filter(F.col("t") > share).select("key", "t").collect()}
    places = Places(hot if order > 1 else {}, BUCKETS * parallelism(spark))
    shared = spark.sparkContext.broadcast((tokens, places))

    more = []
    if order > 1:
        dealing = training.mapInArrow(dealt(shared, order, rows=False), RECORD_DDL)
        counted = met(dealing, counts_of_counts(shared, order), "k int, r long, n long, m long, w long", "katz-counts")
        pairs = counted.filter("k = 0").select("m", "w")
        for r in counted.filter("k > 0").groupBy("k", "r").agg(F.sum("n").alias("n")).collect():
            of_counts[r["k"]][r["r"]] = r["n"]
        if hot:
            apart = hot_pairs(training, shared)
            for r in apart.filter(F.col("n") <= K + 1).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect():
                of_counts[2][r["n"]] = of_counts[2].get(r["n"], 0) + r["c"]
            pairs = pairs.unionByName(apart.select("m", "w"))
            more.append(apart.select("m", "w", "n").mapInArrow(packed(shared, PAIRS), RECORD_DDL))
        factor = F.when(F.col("c") > K, F.lit(1.0)).otherwise(F.element_at(F.array(*map(F.lit, d)), F.least("c", F.lit(K)).cast("int")))
        p = rest.filter("c > 0").select(F.col("key").alias("w"), (F.col("c") * factor / F.lit(float(whole or 1))).alias("p"))
        shares = written(pairs.join(p, "w").groupBy("m").agg(F.sum("p").alias("q")), "katz-shares")
        discard(counted)
        more.append(shares.mapInArrow(packed(shared, SHARES), RECORD_DDL))

    dealing = src.mapInArrow(dealt(shared, order, base_unknown), RECORD_DDL)
    for part in more:
        dealing = dealing.unionByName(part)
    out = met(dealing, judged(shared, order, of_counts, float(whole), log_unknown), JUDGED_DDL, "katz-judged")
    asked = out.filter("key is not null").select("row", "key", "k", "u").join(rest, "key")
    seen = F.col("c") > 0
    value = F.when(seen, F.log10(F.col("c") * F.when(F.col("c") > K, F.lit(1.0)).otherwise(F.element_at(F.array(*map(F.lit, d)), F.greatest(F.lit(1), F.least("c", F.lit(K))).cast("int"))) / F.lit(float(whole or 1)))).otherwise(F.lit(log_unknown))
    asked = asked.select("row", F.when(seen, F.col("k")).otherwise(0).alias("known"), (F.col("k") * (F.log10(F.col("c") + 1.0) + base_unknown)).alias("base"), F.when(F.col("u") > 0, F.col("u") * value).otherwise(0.0).alias("score"))
    out = out.filter("key is null").select("row", "doc_id", "held_out", "n", "known", "base", "score").unionByName(asked, allowMissingColumns=True)
    out = out.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return out.drop("row").withColumn("train_tokens", F.lit(int(n)).cast("long"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), crc_remainder(F.col("doc_id"), 7) != 2)
