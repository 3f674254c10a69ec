"""Operator 9: n-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles.  Documents with equal sets are one class, which its
smallest id represents.  The join finds which classes are linked:

1. Groups.  A class goes to the group of that of its three least shingles which most classes have among theirs (similar sets
   mostly share it); groups of over ``block`` classes or ``block_items`` shingles are cut.  Any partition gives the same
   result; a good one is cheaper.
2. Matrix.  Each group's token union and its range of sizes is a row of a table.
3. Candidates.  Two sets of the wanted similarity share one of their first n - ceil(threshold * n) + 1 shingles
   in any fixed order, and ``SHARED`` of so many and ``SHARED`` - 1 more (or all that they share), so only groups
   that share as many can hold a link; frequent shingles come last in the order (at most ``max_common`` are
   broadcast; they change the cost, never the result).
   What meets are groups and shingles: copies and near copies of a text are one posting.
4. Bound.  Of two such groups the members of the smaller one are queries; how many shingles of a query the
   other group's union holds bounds its overlap with any member.  Queries that the bound rules out are done.
5. Only qualifying groups are opened: the exact sets of query and members decide.  A group's own classes
   are compared with each other in the same place.  Links become counts, and edges to one member of each
   connected part, so that no row is made for a pair; components of the edges name the classes.

Bound and opening run over rows sorted by group, the group's row first, so that a task holds one group at a time; a
group with many queries is dealt to several tasks.  No link is lost.  Postings are packed by hash bucket and merged per
task.  Classes and shingles are told apart by 64-bit hashes.

Defined results: null and empty texts have an empty set and no link; rows with a null id have no
component; rows with one id and different texts are separate; repeated rows stay, and count as one class;
ties (sets of equal size and order) change nothing; an empty table gives no row; very long texts are one
set each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import arrow_batches, by_bucket, discard, documents, joined, parallelism, shared_dir, written
from .components import components

FLUSH = 300_000
#: Least shingles of a class that its group is chosen from.
KEYS = 3
#: Classes that make a key popular; below that, what shares it are mostly passages, not texts.
POPULAR = 8
#: Shingles of a 0/1 matrix.
WIDTH = 8192
#: Shingles of queries that are compared at once.
LOT = 250_000
#: Queries of a group in one task.
QUERIES = 512
#: Shingles that two groups must share to be compared: one is shared by chance, and chance grows with the square of the groups.
SHARED = 4
#: Rows and bytes of an Arrow batch. The JVM holds each batch outside its heap several times over, for every Python worker of a stage.
ROWS, BYTES = 250, 4 << 20


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, bounds = H.word_hashes(column, lower=True)
    g = H.grams(words, k)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= k:
            x = np.sort(g[s : e - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif e > s:
            out.append(H.mix(H.grams(words[s:e], e - s) + H.U64(e - s)))
        else:
            out.append(np.zeros(0, H.U64))
    return out


def class_of(x: np.ndarray) -> int:
    """One number for equal sets."""
    with np.errstate(over="ignore"):
        return int(H.mix(np.array([H.mix(x ^ H.U64(0x5851F42D4C957F2D)).sum() + H.U64(len(x))], H.U64)).view(np.int64)[0])


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _sets_of(batches: Iterator[pa.RecordBatch], column: int, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for a, b in H.slices(batch.column(column)):
            part = batch.slice(a, b - a)
            yield part, shingle_sets(part.column(column), k)


def _packed_buckets(columns: list[np.ndarray], token: np.ndarray, buckets: int) -> tuple[list, list]:
    at, data = [], []
    for b, rows in by_bucket(((token >> H.U64(13)) % H.U64(buckets)).astype(np.int64), buckets):
        at.append(b), data.append(H.pack(*(c[rows] for c in columns)))
    return at, data


def _surveyed(src: DataFrame, k: int, threshold: int, buckets: int) -> str:
    """Path of (kind, ...): kind 0 has a row a document, kind 1 packed counts of prefix shingles."""
    types = {"kind": pa.int32(), "doc_id": pa.int64(), "cid": pa.int64(), "n": pa.int64(), "keys": pa.list_(pa.int64()), "bucket": pa.int32(), "data": pa.binary()}

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0

        def rows(m: int, **known) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known[c], t) if c in known else pa.nulls(m, t) for c, t in types.items()], list(types))

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear(), seen.clear()
            at, data = _packed_buckets([tokens, counts.astype(np.int64)], tokens, buckets)
            return rows(len(at), kind=[1] * len(at), bucket=at, data=data)

        for part, sets in _sets_of(batches, 1, k):
            cids = [class_of(x) for x in sets]
            for cid, x in zip(cids, sets):
                if len(x) and cid not in seen:
                    seen.add(cid)
                    held.append(x[: prefix_length(len(x), threshold)].copy())
                    size += len(held[-1])
            keys = [x[:KEYS].view(np.int64).tolist() for x in sets]
            yield rows(len(part), kind=[0] * len(part), doc_id=part.column(0), cid=cids, n=[len(x) for x in sets], keys=keys)
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    path = shared_dir(src.sparkSession, "jaccard-survey")
    src.mapInArrow(survey, "kind int, doc_id long, cid long, n long, keys array<long>, bucket int, data binary").write.partitionBy("kind").parquet(path)
    return path


def group_of(keys: list[int], cid: int, popular: dict[int | None, tuple[int, int]]) -> int:
    """The most popular key, else the least; with the number of the class's part where the group is cut.

    ``popular`` has, of keys that many classes have, how many do and the number of parts; under None, the greatest number of parts that
    any other key can need, so that no group stays uncut because its key isn't among them.
    """
    _, key = max(((popular[k][0], k) for k in keys if k in popular), default=(0, keys[0]))
    return key ^ cid % popular.get(key, popular[None])[1]


def _common_shingles(counts: DataFrame, common: int, most: int) -> np.ndarray:
    """Shingles in at least ``common`` prefixes, the ``most`` most frequent at most."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, c = (np.concatenate(x) for x in zip(*(H.unpack(d, np.uint64, np.int64) for d in pdf["data"])))
        order = np.argsort(tokens, kind="stable")
        tokens, c = tokens[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        tokens, c = tokens[first], np.add.reduceat(c, first)
        return pd.DataFrame({"token": tokens[c >= common].view(np.int64), "c": c[c >= common]})

    found = counts.groupBy("bucket").applyInPandas(total, "token long, c long").orderBy(F.desc("c"), "token").limit(most)
    return np.sort(found.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _candidates(src: DataFrame, k: int, threshold: int, common: np.ndarray, popular: dict[int | None, tuple[int, int]], buckets: int) -> DataFrame:
    """Distinct pairs (g, h), g < h, of groups whose members share SHARED prefix shingles and may be similar by size and place.

    Two sets that have ``o`` shingles in common share min(o, SHARED) of their first prefix_length + SHARED - 1.  What two groups share is
    counted over all buckets; a shingle counts for SHARED where members are so small that fewer in common may be enough.
    """
    shared = src.sparkSession.sparkContext.broadcast((common, popular))

    def collapsed(token, group, least, most, left):
        order = np.lexsort((group, token))
        token, group, least, most, left = (x[order] for x in (token, group, least, most, left))
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]))
        return token[first], group[first], np.minimum.reduceat(least, first), np.maximum.reduceat(most, first), np.maximum.reduceat(left, first)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keyed = shared.value
        held, seen, size = [], set(), 0

        def flush() -> pa.RecordBatch:
            sizes = [len(h[0]) for h in held]
            group, n = (np.repeat(np.array([h[i] for h in held], t), sizes) for i, t in ((1, np.int64), (2, np.int32)))
            left = n - np.concatenate([np.arange(m, dtype=np.int32) for m in sizes])
            token, group, least, most, left = collapsed(np.concatenate([h[0] for h in held]), group, n, n, left)
            held.clear(), seen.clear()
            at, data = _packed_buckets([token, group, least, most - least, most - left], token, buckets)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        for _, sets in _sets_of(batches, 1, k):
            for x in sets:
                n, cid = len(x), class_of(x)
                if not n or cid in seen:
                    continue
                seen.add(cid)
                group, p = group_of(x[:KEYS].view(np.int64).tolist(), cid, keyed), min(n, prefix_length(n, threshold) + SHARED - 1)
                if len(last):
                    rare = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] != x
                    mine = x[rare][:p]
                    x = mine if len(mine) == p else np.concatenate([mine, x[~rare][: p - len(mine)]])
                held.append((x[:p].copy(), group, n))
                size += p
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        token, group, least, extra, before = (np.concatenate(x) for x in zip(*(H.unpack(d, np.uint64, np.int64, np.int32, np.int32, np.int32) for d in pdf["data"])))
        most = least.astype(np.int64) + extra
        token, group, least, most, left = collapsed(token, group, least.astype(np.int64), most, most - before)
        edges = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
        out = [np.zeros((3, 0), np.int64)]

        def pair_up(i, j):
            """Pairs whose sizes are near enough and, were this one of the first SHARED shingles that two members share, enough is left behind it."""
            a, b = np.maximum(least[i], -(-threshold * least[j] // 100)), np.maximum(least[j], -(-threshold * least[i] // 100))
            need = threshold * (a + b)
            ok = (a <= most[i]) & (b <= most[j]) & ((np.minimum(left[i], left[j]) + SHARED - 1) * (100 + threshold) >= need)
            weight = np.where((SHARED - 1) * (100 + threshold) >= need, SHARED, 1)
            out.append(np.stack([np.broadcast_to(group[i], ok.shape)[ok], group[j][ok], weight[ok]]))

        size = np.diff(edges)
        two = edges[:-1][size == 2]
        pair_up(two, two + 1)
        for s, e in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist()):
            for i in range(s, e - 1):  # each group against the later ones of its postings
                pair_up(i, np.arange(i + 1, e))
        *pairs, weight = np.concatenate(out, axis=1)
        low, high = np.minimum(*pairs), np.maximum(*pairs)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(fresh)
        return pd.DataFrame({"g": low[first], "h": high[first], "c": np.add.reduceat(weight[order], first) if len(first) else weight})

    shipped = src.mapInArrow(ship, "bucket int, data binary")
    met = shipped.groupBy("bucket").applyInPandas(meet, "g long, h long, c long").groupBy("g", "h").agg(F.sum("c").alias("c"))
    found = written(met.filter(F.col("c") >= SHARED).select("g", "h"), "jaccard-candidates")
    shared.destroy()
    return found


def _small(table: DataFrame, max_broadcast: int) -> DataFrame:
    """To be broadcast if it has few rows; of a written table that is a look at file footers."""
    return F.broadcast(table) if table.count() <= max_broadcast else table


def _spelt(src: DataFrame, wanted: DataFrame, k: int, max_broadcast: int) -> DataFrame:
    """Sets (gid, cid, n, items) of the wanted classes (doc_id, cid, gid)."""
    wanted = _small(wanted, max_broadcast)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets_of(batches, 2, k):
            # Of rows with one id, the class tells which text is meant.
            ok = [class_of(x) == c for x, c in zip(sets, part.column(1).to_pylist())]
            own, keep = [x for x, o in zip(sets, ok) if o], pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array([len(x) for x in own], pa.int64()), pa.array([H.pack(x) for x in own], pa.binary())], ["gid", "cid", "n", "items"])

    spelt = src.join(wanted, "doc_id").select("gid", "cid", "text").mapInArrow(spell, "gid long, cid long, n long, items binary")
    return written(spelt, "jaccard-sets")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _marks(items: bytes) -> np.ndarray:
    """The upper 24 bits of a set's hashes, sorted: what two sets share is never more than their marks share."""
    return (H.unpack(items, np.uint64)[0] >> H.U64(40)).astype(np.uint32)


def _marked(sets: DataFrame, also: str) -> DataFrame:
    """(gid, also, n, marks) of sets (gid, also, n, items): gaps of sorted marks take two bytes each, where hashes take eight."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([H.pack(_marks(x)) for x in b.column(3).to_pylist()], pa.binary())], ["gid", also, "n", "marks"])

    return sets.select("gid", also, "n", "items").mapInArrow(marked, f"gid long, {also} long, n long, marks binary")


def _matrix(sets: DataFrame, several: DataFrame) -> DataFrame:
    """(gid, least, most, marks): the token union of each group, as marks, and its range of sizes."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(gid: int, sizes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            union = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((gid, pa.int64()), (min(sizes), pa.int64()), (max(sizes), pa.int64()), (H.pack(union), pa.binary()))], ["gid", "least", "most", "marks"])

        at, sizes, held = None, [], []
        for gid, _, n, marks in _rows(batches):
            if gid != at and held:
                yield row(at, sizes, held)
                sizes, held = [], []
            at = gid
            sizes.append(n), held.append(H.unpack(marks, np.uint32)[0])
        if held:
            yield row(at, sizes, held)

    placed = _marked(sets.join(several, "gid", "left_semi"), "cid").repartition("gid").sortWithinPartitions("gid")
    return written(placed.mapInArrow(unite, "gid long, least long, most long, marks binary"), "jaccard-matrix")


def _dealt(pairs: DataFrame, weight: str) -> DataFrame:
    """(h, salts): into how many parts a group's queries are dealt."""
    return pairs.groupBy("h").agg(F.ceil(F.sum(weight) / QUERIES).cast("int").alias("salts"))


def _by_group(table: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of groups (tag 0) and of queries (tag 1) with one layout, sorted so that a group's own come first."""
    both = table.withColumn("tag", F.lit(0)).unionByName(queries.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return both.repartition("h", "salt").sortWithinPartitions("h", "salt", "tag").select("h", "salt", "tag", *columns)


def _bounded(pairs: DataFrame, sets: DataFrame, matrix: DataFrame, several: DataFrame, threshold: int, max_broadcast: int) -> DataFrame:
    """(g, cid, h): queries whose overlap with the union of h may be enough."""

    few = lambda t: _small(t, max_broadcast)
    sets = _marked(sets, "cid")
    salts = written(_dealt(pairs, "m"), "jaccard-salts")
    asking = written(pairs.select("g", "h").join(salts, "h").select("h", F.pmod(F.xxhash64("g"), F.col("salts")).cast("int").alias("salt"), F.col("g").alias("gid")), "jaccard-asking")
    queries = sets.join(few(asking), "gid").select("h", "salt", F.col("gid").alias("g"), "cid", "n", "marks")
    # A group of one class is its own union.
    single = sets.join(few(several), "gid", "left_anti").select("gid", F.col("n").alias("least"), F.col("n").alias("most"), "marks")
    table = matrix.unionByName(single).withColumnRenamed("gid", "h").join(few(salts), "h")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = least = most = None
        for batch in batches:
            out = []
            for h, _, tag, g, cid, n, lo, hi, marks in _rows([batch]):
                x = H.unpack(marks, np.uint32)[0]
                if tag == 0:
                    union, least, most = x, lo, hi
                    continue
                # The smallest member that can be similar, and the overlap that it needs.
                small = max(least, -(-threshold * n // 100))
                if small > most or threshold * small > 100 * n:
                    continue
                same = int((union[np.minimum(np.searchsorted(union, x), len(union) - 1)] == x).sum())
                if same * (100 + threshold) >= threshold * (n + small):
                    out.append((g, cid, h))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["g", "cid", "h"])

    return written(_by_group(table, queries, ["g", "cid", "n", "least", "most", "marks"]).mapInArrow(bound, "g long, cid long, h long"), "jaccard-qualified")


def linked(block: list[np.ndarray], queries: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which queries (rows) are linked with which sets of the block (columns)."""
    sets = block + queries
    sizes = np.array([len(x) for x in sets], np.int64)
    who = np.repeat(np.arange(len(sets)), sizes)
    _, at, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = np.cumsum(found > 1) - 1  # a shingle of one set is in no overlap
    who, at = who[found[at] > 1], met[at[found[at] > 1]]
    order = np.argsort(at, kind="stable")
    who, at, m = who[order], at[order], len(block)
    same = np.zeros((len(queries), m), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, WIDTH):
        s, e = np.searchsorted(at, (lo, lo + WIDTH))
        x = np.zeros((len(sets), int(min(WIDTH, at[-1] + 1 - lo))), np.float32)
        x[who[s:e], at[s:e] - lo] = 1
        same += (x[m:] @ x[:m].T).astype(np.int64)
    return 100 * same >= threshold * (sizes[m:, None] + sizes[None, :m] - same)


def _opened(qualified: DataFrame, sets: DataFrame, several: DataFrame, threshold: int, max_broadcast: int) -> DataFrame:
    """(a, b, links): edges between classes (links null), and links of a class (b null)."""
    salts = _dealt(qualified.withColumn("m", F.lit(1)), "m").unionByName(several.select(F.col("gid").alias("h"), F.lit(1).alias("salts")))
    salts = written(salts.groupBy("h").agg(F.max("salts").alias("salts")), "jaccard-salts")
    asking = qualified.join(salts, "h").select("h", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt"), "cid")
    asking = _small(written(asking, "jaccard-asking"), max_broadcast)
    queries = sets.select("cid", "items").join(asking, "cid").select("h", "salt", "cid", "items")
    table = sets.select(F.col("gid").alias("h"), "cid", "items").join(_small(salts, max_broadcast), "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of the block that are connected, by queries or inside, share the label of their first member."""
        at, cids, block, held, label, links, out = None, [], [], [], None, None, []

        def tie(members: np.ndarray) -> None:
            label[np.isin(label, label[members])] = label[members].min()

        def ask() -> None:
            nonlocal links
            if held and block:
                ok = linked(block, [x for _, x in held], threshold)
                links += ok.sum(axis=0)
                for (cid, _), row in zip(held, ok):
                    members = np.flatnonzero(row)
                    if len(members):
                        tie(members)
                        out.append((cid, cids[members[0]], None))
                        out.append((cid, None, len(members)))
            held.clear()

        def within() -> None:
            nonlocal label, links
            label, links = np.arange(len(block)), np.zeros(len(block), np.int64)
            if at[1] == 0 and len(block) > 1:
                ok = linked(block, block, threshold)
                for i, row in enumerate(ok):
                    tie(np.flatnonzero(row))
                links += ok.sum(axis=1) - 1

        def close() -> Iterator[pa.RecordBatch]:
            if label is None and block:
                within()
            ask()
            out.extend((cids[i], cids[j], None) for i, j in enumerate(label.tolist() if block else []) if i != j)
            out.extend((c, None, n) for c, n in zip(cids, links.tolist() if block else []) if n)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["a", "b", "links"])
            out.clear(), cids.clear(), block.clear()

        for h, salt, tag, cid, items in _rows(batches):
            if (h, salt) != at:
                if at is not None:
                    yield from close()
                at, label = (h, salt), None
            x = H.unpack(items, np.uint64)[0]
            if tag == 0:
                if cid not in cids[-1:]:  # rows are sorted by class; repeated rows of the input repeat theirs
                    cids.append(cid), block.append(x)
                continue
            if label is None and block:
                within()
            if not held or held[-1][0] != cid:
                held.append((cid, x))
            # Queries wait in small lots, by number and by shingles, so that a task's memory has a bound.
            if len(held) >= 256 or sum(len(x) for _, x in held) >= LOT:
                ask()
        if at is not None:
            yield from close()

    both = table.withColumn("tag", F.lit(0)).unionByName(queries.withColumn("tag", F.lit(1)))
    both = both.repartition("h", "salt").sortWithinPartitions("h", "salt", "tag", "cid").select("h", "salt", "tag", "cid", "items")
    return written(both.mapInArrow(open_groups, "a long, b long, links long"), "jaccard-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: int = 85, common: int = 32, max_common: int = 500_000, block: int = 256, block_items: int = 250_000, max_popular: int = 100_000, max_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) for each row.

    Two documents link where 100 * intersection >= threshold * union.  n_links counts the other classes
    (different sets) that the document's class is linked with.
    """
    spark = docs.sparkSession
    arrow_batches(spark, ROWS, BYTES)
    buckets = 2 * parallelism(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    survey = spark.read.schema("doc_id long, cid long, n long, keys array<long>, bucket int, data binary, kind int").parquet(_surveyed(src, k, threshold, buckets))
    rows = survey.filter("kind = 0").select("doc_id", "cid", "n", "keys")
    known = rows.filter("n > 0 and doc_id is not null")
    named = src.filter("doc_id is not null")
    least = known.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    least = written(least, "jaccard-classes")
    # Of the keys, the max_popular whose groups are the largest say where these go: what passes through the driver is bounded.
    parts = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("items") / block_items)).cast("long")
    keyed = least.select(F.explode("keys").alias("key"), "n").groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"))
    keyed = keyed.filter(F.col("m") >= POPULAR).withColumn("parts", parts).orderBy(F.desc("parts"), F.desc("m"), "key").limit(max_popular + 1).toArrow()
    key, m, cut = (keyed.column(c).to_pylist() for c in ("key", "m", "parts"))
    popular = dict(zip(key[:max_popular], zip(m, cut))) | {None: (0, cut[max_popular] if len(cut) > max_popular else 1)}
    shared = spark.sparkContext.broadcast(popular)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gids = [group_of(k, c, shared.value) for c, k in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(gids, pa.int64())], ["cid", "rep", "n", "gid"])

    classes = written(least.select("cid", "rep", "n", "keys").mapInArrow(grouped, "cid long, rep long, n long, gid long"), "jaccard-grouped")
    shared.destroy()
    discard(least)

    common_shingles = _common_shingles(survey.filter("kind = 1").select("bucket", "data"), common, max_common)
    pairs = _candidates(named, k, threshold, common_shingles, popular, buckets)
    sizes = written(classes.groupBy("gid").agg(F.count(F.lit(1)).alias("m")), "jaccard-groups")
    several = written(sizes.filter("m > 1").select("gid"), "jaccard-several")
    # The smaller group asks.
    side = lambda c: sizes.select(F.col("gid").alias(c), F.col("m").alias(f"m_{c}"))
    pairs = pairs.join(side("g"), "g").join(side("h"), "h")
    swap = F.col("m_g") > F.col("m_h")
    pairs = pairs.select(F.when(swap, F.col("h")).otherwise(F.col("g")).alias("g"), F.when(swap, F.col("g")).otherwise(F.col("h")).alias("h"), F.least("m_g", "m_h").alias("m"))
    pairs = written(pairs, "jaccard-pairs")
    active = pairs.select(F.explode(F.array("g", "h")).alias("gid")).unionByName(several).distinct()
    wanted = written(classes.join(active, "gid", "left_semi").select(F.col("rep").alias("doc_id"), "cid", "gid"), "jaccard-wanted")
    sets = _spelt(named, wanted, k, max_broadcast)
    matrix = _matrix(sets, _small(written(pairs.select(F.col("h").alias("gid")).join(several, "gid", "left_semi").distinct(), "jaccard-asked"), max_broadcast))
    qualified = _bounded(pairs, sets, matrix, several, threshold, max_broadcast)
    links = _opened(qualified, sets, several, threshold, max_broadcast)
    discard(sets)
    discard(matrix)

    roots = components(links.filter("b is not null").select("a", "b"))
    roots = written(roots.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "jaccard-roots")
    names = roots.groupBy("root").agg(F.min("rep").alias("name"))
    degree = links.filter("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("n_links"))
    found = joined(roots, names, "root").select(F.col("node").alias("cid"), "name")
    merged = classes.select("cid", "rep").join(found, "cid", "left").join(degree, "cid", "left")
    merged = written(merged.select("cid", F.coalesce("name", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "jaccard-merged")
    out = joined(rows.select("doc_id", "n", "cid"), merged, "cid")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"), F.col("cid").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
