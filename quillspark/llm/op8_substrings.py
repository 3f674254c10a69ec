"""Operator 8: substring deduplication by suffix automata of reference shards.

A window of 13 words is removed if the same words start in a document with a smaller id.  The
reference is the corpus itself, so its automata can't be broadcast whole (that would be every shard
to every task, quadratic in the corpus); each shard's automaton is built in one task, and just the
passages that it can match are streamed to it.

1. Every window chooses its least 5-gram as anchor.  Neighbouring windows with one anchor make a
   passage of up to 21 words.  Equal windows choose equal anchors, so what is shared meets by anchor.
   Tasks ship (anchor, passage hash, id), packed by bucket and merged per task.
2. Passages that are equal as a whole need no automaton: all but the smallest id's are removed.
3. Anchors with several different passages remain (a few percent).  One passage of each kind goes
   to the shard of its anchor.  There, ids ascending, its matching statistics are read from the
   suffix automaton of the passages of smaller ids; spans of 13 and more are removed, then the
   passage joins the automaton.  Anchors with over ``hot`` passages are cut into single windows and
   dealt by their own hash instead, so that no common phrase fills a shard.

Decisions are (id, passage hash, windows), are grouped by id, and meet the texts again.  Only texts
with decisions are shuffled, as long as their ids are at most ``max_broadcast`` (checked); beyond that, all are.

Defined results: null and empty texts have no words; rows with a null id are compared with nothing
and keep all words; rows with equal ids are no smaller than each other (ties remove nothing); repeated rows stay; very long texts are
taken in whole rows; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from . import winnow
from .common import arrow_batches, by_bucket, documents, parallelism, written

WINDOW, GRAM = 13, 5
FLUSH = 1_000_000
ALL = (1 << (WINDOW - GRAM + 1)) - 1


class SuffixAutomaton:
    """Of several word sequences, added one by one."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for the strings that end in c after p."""
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(self.len[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
            last = new

    def matching(self, sequence: list) -> list[int]:
        """Matching statistics: at each place, the longest suffix so far that occurs in the automaton."""
        step, link, length = self.next, self.link, self.len
        state = matched = 0
        out = []
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state, matched = step[state][c], matched + 1
            else:
                matched = 0
            out.append(matched)
        return out


def _groups(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, content, id), and where anchors and passages begin in it."""
    order = np.lexsort((ids, content, anchor))
    a, c = anchor[order], content[order]
    new_a = np.ones(len(order), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_c = new_a.copy()
    new_c[1:] |= c[1:] != c[:-1]
    return order, new_a, new_c


def passages(src: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(doc_id, content, anchor, hot): anchor is null where the whole passage goes, else it asks for the automaton."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, content, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, _, new_c = _groups(anchor, content, ids)
            anchor, content, ids = anchor[order], content[order], ids[order]
            kinds, at, data = [], [], []
            # A smaller id in this very task decides at once; one row of each passage is shipped.
            owner = ids[np.maximum.accumulate(np.where(new_c, np.arange(len(ids)), 0))] if len(ids) else ids
            done = ids > owner
            for b, rows in by_bucket((content[done] % H.U64(buckets)).astype(np.int64), buckets):
                kinds.append(1), at.append(b), data.append(H.pack(ids[done][rows], content[done][rows]))
            anchor, content, ids = anchor[new_c], content[new_c], ids[new_c]
            for b, rows in by_bucket(((anchor >> H.U64(17)) % H.U64(buckets)).astype(np.int64), buckets):
                kinds.append(0), at.append(b), data.append(H.pack(anchor[rows], content[rows], ids[rows]))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["kind", "bucket", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in H.slices(batch.column(1)):
                words, bounds = H.word_hashes(batch.column(1).slice(a, b - a), lower=False)
                first, count, anchor, row = winnow.anchors(words, bounds, WINDOW, GRAM)
                held.append((anchor, winnow.contents(words, first, count, WINDOW), ids[a:b][row]))
                size += len(anchor)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == 1:
            ids, content = (np.concatenate(x) for x in zip(*(H.unpack(d, np.int64, np.uint64) for d in pdf["data"])))
            return pd.DataFrame({"doc_id": ids, "content": content.view(np.int64), "anchor": pd.array([None] * len(ids), "Int64"), "hot": False})
        anchor, content, ids = (np.concatenate(x) for x in zip(*(H.unpack(d, np.uint64, np.uint64, np.int64) for d in pdf["data"])))
        order, new_a, new_c = _groups(anchor, content, ids)
        anchor, content, ids = anchor[order], content[order], ids[order]
        owner = ids[np.maximum.accumulate(np.where(new_c, np.arange(len(ids)), 0))]
        whole = ids > owner
        group = np.cumsum(new_a) - 1
        kinds = np.bincount(group, weights=new_c).astype(np.int64)[group]
        ask = new_c & (kinds > 1)
        out = pd.DataFrame({"doc_id": np.concatenate([ids[whole], ids[ask]]), "content": np.concatenate([content[whole], content[ask]]).view(np.int64)})
        out["anchor"] = pd.array([*[None] * int(whole.sum()), *anchor[ask].view(np.int64).tolist()], "Int64")
        out["hot"] = np.concatenate([np.zeros(int(whole.sum()), bool), kinds[ask] > hot])
        return out

    shipped = src.mapInArrow(ship, "kind int, bucket int, data binary")
    return shipped.groupBy("kind", "bucket").applyInPandas(meet, "doc_id long, content long, anchor long, hot boolean")


def _spelt(shards: int):
    """Passages that ask for the automaton, as (shard, doc_id, content, at, words)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in H.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words, bounds = H.word_hashes(part.column(1), lower=False)
                first, count, anchor, row = winnow.anchors(words, bounds, WINDOW, GRAM)
                content = winnow.contents(words, first, count, WINDOW).view(np.int64)
                edges = np.searchsorted(row, np.arange(len(part) + 1))
                out = []
                for i, (doc_id, asked) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    hot = {x["content"]: x["hot"] for x in asked}
                    for j in range(edges[i], edges[i + 1]):
                        is_hot = hot.pop(int(content[j]), None)
                        if is_hot is None:
                            continue
                        f, n = int(first[j]), int(count[j])
                        own = words[f : f + n + WINDOW - 1].view(np.int64)
                        if is_hot:
                            dealt = H.grams(own.view(np.uint64), WINDOW) % H.U64(shards)
                            out += [(int(dealt[k]), doc_id, int(content[j]), k, own[k : k + WINDOW].tobytes()) for k in range(n)]
                        else:
                            out.append((int((anchor[j] >> H.U64(9)) % H.U64(shards)), doc_id, int(content[j]), 0, own.tobytes()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["shard", "doc_id", "content", "at", "words"])

    return spell


def match_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One reference shard: stream its passages, ids ascending, past the automaton of all smaller ids."""
    automaton, out = SuffixAutomaton(), []
    pdf = pdf.sort_values(["doc_id", "content", "at"], kind="stable").drop_duplicates(["doc_id", "content", "at"])
    for doc_id, own in pdf.groupby("doc_id", sort=False):
        fresh = []
        for content, at, words in zip(own["content"], own["at"], own["words"]):
            sequence = np.frombuffer(words, np.int64).tolist()
            hits = [e - WINDOW + 1 for e, m in enumerate(automaton.matching(sequence)) if m >= WINDOW]
            if hits:
                out.append((doc_id, content, sum(1 << (at + h) for h in hits)))
            if len(hits) < len(sequence) - WINDOW + 1:  # else it has no window that the automaton lacks
                fresh.append(sequence)
        for sequence in fresh:
            automaton.add(sequence)
    return pd.DataFrame(out, columns=["doc_id", "content", "mask"]).astype({"doc_id": "int64", "content": "int64", "mask": "int32"})


def _removed(words: np.ndarray, bounds: np.ndarray, decisions: list[list | None]) -> np.ndarray:
    """Which words go."""
    gone = np.zeros(len(words) + 1, np.int64)
    first, count, _, row = winnow.anchors(words, bounds, WINDOW, GRAM)
    content = winnow.contents(words, first, count, WINDOW).view(np.int64)
    edges = np.searchsorted(row, np.arange(len(bounds)))
    for i, own in enumerate(decisions):
        if not own:
            continue
        masks: dict[int, int] = {}
        for x in own:
            masks[x["content"]] = masks.get(x["content"], 0) | x["mask"]
        for j in range(edges[i], edges[i + 1]):
            mask = masks.get(int(content[j]), 0)
            for k in range(int(count[j])) if mask else ():
                if mask >> k & 1:
                    gone[first[j] + k] += 1
                    gone[min(first[j] + k + WINDOW, len(words))] -= 1
    return np.cumsum(gone[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, hot: int = 256, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by spaces, or with ``digests`` kept_sha256."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = 4 * parallelism(spark)
    found = written(passages(src.filter("doc_id is not null"), 2 * parallelism(spark), hot), "substring-passages")
    asked = found.filter("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("content", "hot")).alias("asked"))
    askers = written(found.filter("anchor is not null").select("doc_id").distinct(), "substring-askers")
    some = src.join(F.broadcast(askers), "doc_id", "left_semi") if askers.count() <= max_broadcast else src
    spelt = some.join(asked.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "asked").mapInArrow(_spelt(shards), "shard int, doc_id long, content long, at int, words binary")
    matched = spelt.groupBy("shard").applyInPandas(match_shard, "doc_id long, content long, mask int")
    decisions = found.filter("anchor is null").select("doc_id", "content", F.lit(ALL).alias("mask")).unionByName(matched)
    decisions = written(decisions.groupBy("doc_id").agg(F.collect_list(F.struct("content", "mask")).alias("decisions")), "substring-decisions")
    last = "kept_sha256" if digests else "kept"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in H.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                own = part.column(2).to_pylist() if part.num_columns > 2 else []
                gone = None
                if any(own):
                    words, bounds = H.word_hashes(part.column(1), lower=False)
                    gone = _removed(words, bounds, own)
                n, cut, kept = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    spelling = text.encode().split()
                    n.append(len(spelling))
                    if gone is not None:
                        spelling = [w for w, g in zip(spelling, gone[bounds[i] : bounds[i + 1]].tolist()) if not g]
                    cut.append(n[-1] - len(spelling))
                    joined = b" ".join(spelling)
                    kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", last])

    out = f"doc_id long, n_words long, n_removed long, {last} string"
    if decisions.count() > max_broadcast:
        return src.join(decisions, "doc_id", "left").select("doc_id", "text", "decisions").mapInArrow(apply, out)
    ids = F.broadcast(decisions.select("doc_id"))
    clean = src.join(ids, "doc_id", "left_anti").mapInArrow(apply, out)
    touched = src.join(ids, "doc_id", "left_semi").join(decisions.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "decisions")
    return clean.unionByName(touched.mapInArrow(apply, out))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), digests=True)
