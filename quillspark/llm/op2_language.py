"""Operator 2: language identification by averaged hashed subword embeddings.

A text's lower-cased byte n-grams (2 to 4 bytes, anything but letters counts as one space) are hashed
into ``buckets`` embeddings; their mean goes through a linear softmax.  Both layers are trained by
stochastic gradient descent in numpy on the driver, on about ``sample_rows`` labelled rows, spread
evenly over the languages by hash; of each, at most ``draws`` n-grams from anywhere in the text.
A temperature fitted on a fifth of the sample calibrates the score, and the score under which the
calibration rows fall short of ``target`` accuracy is the rejection threshold.

Since the mean and the last layer are linear, embeddings times weights is one table of
``buckets`` x languages, which is what is broadcast: 4 bytes x 65,536 x languages.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected, as is
everything if no row is labelled; null ids and repeated rows stay; of equally likely languages the first by name wins; very
long texts are read whole, in slices; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc_remainder, documents

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
SLICE = 1 << 20
#: Greatest change of a gram's vector, and of the output weights, in one step: a gram that all rows of a batch repeat can't run away.
CLIP = 1.0
_ASCII = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def normalized(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_ASCII) + b" "


def gram_ids(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each position."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = (h + data[k : k + size]) * _MIX[k]
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def drawn(text: str, draws: int) -> np.ndarray:
    """Up to ``draws`` n-grams of the whole text, evenly spaced by a fixed random draw."""
    data = np.frombuffer(normalized(text), np.uint8).astype(np.uint32)
    ids = np.concatenate([gram_ids(data, n) for n in GRAMS])
    if len(ids) > draws:
        ids = ids[np.random.default_rng(len(ids)).integers(0, len(ids), draws)]
    return ids.astype(np.int32)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean table row of each text's n-grams; texts are taken in slices of bounded size."""
        out, at = np.zeros((len(texts), len(self.labels))), 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= SLICE:
                size += len(texts[end])
                end += 1
            data = np.frombuffer(b"".join(texts[at:end]), np.uint8).astype(np.uint32)
            starts = np.cumsum([0, *(len(t) for t in texts[at:end])])
            total, count = np.zeros((end - at, len(self.labels))), np.zeros(end - at)
            for lo in range(0, len(data), 4 * SLICE):
                for n in GRAMS:
                    ids = gram_ids(data[lo : lo + 4 * SLICE + n - 1], n)
                    if not len(ids):
                        continue
                    sums = np.vstack([np.zeros(len(self.labels)), np.cumsum(self.table[ids], axis=0, dtype=np.float64)])
                    first, last = np.clip(starts[:-1] - lo, 0, len(ids)), np.clip(starts[1:] - n + 1 - lo, 0, len(ids))
                    last = np.maximum(first, last)
                    total += sums[last] - sums[first]
                    count += last - first
            out[at:end] = total / np.maximum(count, 1)[:, None]
            at = end
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [bool(t) and bool(self.labels) and any(map(str.isalpha, t)) for t in texts]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, k in enumerate(known) if k]
        if at:
            z = self.logits([normalized(texts[i]) for i in at]) / self.temperature
            p = softmax(z)
            best = p.argmax(axis=1)
            for i, b, s in zip(at, best, p.max(axis=1)):
                names[i], scores[i] = self.labels[b], s
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def clipped(steps: np.ndarray) -> np.ndarray:
    """Rows no longer than CLIP."""
    size = np.linalg.norm(steps, axis=1, keepdims=True)
    return steps * np.minimum(1.0, CLIP / np.maximum(size, 1e-12))


def fit(labels: list[str], grams: list[np.ndarray], target: float = 0.99, dim: int = 16, epochs: int = 6, rate: float = 4.0, batch: int = 32, seed: int = 1) -> Model:
    """Train on (label, n-gram ids) pairs."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    order = rng.permutation(len(y))
    cut = len(y) // 5 if len(y) >= 10 else 0
    held, train = order[:cut], order[cut:]
    e, w, b = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    epochs = max(epochs, -(-400 * batch // max(len(train), 1)))  # few rows are seen more often
    steps = max(1, epochs * -(-len(train) // batch))
    done = 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for at in range(0, len(train), batch):
            rows, lr = train[at : at + batch], rate * (1 - done / steps)
            ids = np.concatenate([grams[i] for i in rows])
            sizes = np.array([len(grams[i]) for i in rows])
            who = np.repeat(np.arange(len(rows)), sizes)
            mean = np.zeros((len(rows), dim))
            np.add.at(mean, who, e[ids])
            mean /= np.maximum(sizes, 1)[:, None]
            g = softmax(mean @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = (g @ w.T) / np.maximum(sizes, 1)[:, None]
            w -= clipped(lr / len(rows) * (mean.T @ g).reshape(1, -1)).reshape(w.shape)
            b -= lr / len(rows) * 0.1 * g.sum(axis=0)
            seen, at_gram = np.unique(ids, return_inverse=True)
            step = np.zeros((len(seen), dim))
            np.add.at(step, at_gram, lr * back[who])
            e[seen] -= clipped(step)
            done += 1
    model = Model(names, (e @ w).astype(np.float32), b, 1.0, 0.0)
    if cut:
        z = np.array([model.table[grams[i]].mean(axis=0) if len(grams[i]) else np.zeros(len(names)) for i in held]) + b
        temps = np.geomspace(0.05, 20, 61)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(cut), y[held]], 1e-300)).mean() for t in temps]
        model.temperature = float(temps[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        by = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, cut + 1) >= target)
        model.threshold = float(score[by][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample_rows: int = 4000, draws: int = 512) -> Model:
    """Fit on a bounded sample of the rows where ``learn`` holds.

    A row is drawn by the hash of its text, with an even share for each label; copies of a text are one row.
    Of what is drawn, ``2 * sample_rows`` rows at most go to the driver, those with the least hashes.
    """
    src = docs.filter(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    src = src.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    counts = {r[0]: r[1] for r in src.groupBy("label").count().collect()}
    if not counts:
        return fit([], [])
    quota = max(1.0, sample_rows / len(counts))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, quota / n)))
    hashed = src.withColumn("h", F.xxhash64("text"))
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)
    picked = hashed.filter(unit < F.element_at(share, F.col("label"))).dropDuplicates(["label", "h"]).orderBy("h", "label").limit(2 * sample_rows)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [drawn(t, draws).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["label", "grams"])

    rows = picked.select("label", "text").mapInArrow(draw, "label string, grams binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["grams"])))
    return fit([r["label"] for r in rows], [np.frombuffer(r["grams"], np.int32) for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(id, *keep, lang_pred, score, rejected) for each row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col), *(keep or []), F.col(text_col).cast("string").alias("__text"))
    schema = src.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = m.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n == "und" or s < m.threshold for n, s in zip(names, scores)])], schema.fieldNames())

    return src.mapInArrow(apply, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs, ~held, "doc_id", "text", "lang")
    return identify(docs, model, keep=[held.alias("held_out")])
