"""Operator 3: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are lower-cased.  A document overlaps an item where a window of 13 words of either agrees in at least 11
places.  The fixed mask 1001001001 hashes four words and ignores the two between each: laid at places 0, 1 and 2 of
a window it reads three sets of places that have none in common, so two substitutions, wherever they are, leave one
of them whole, and no overlap is missed.  Seeds of the items are a table; every place of a document is hashed
once as it streams by and looked up in it.  Around each hit the words on both sides are compared place by place,
in all windows that can hold the seed.

Shorter items must occur as a whole.  Items of 7 to 12 words may have one word substituted, those of 5 and 6 none: the
mask 10101, laid at places 0 and 1, reads two sets of places that have none in common.  An item of under
five words says nothing inside a text; it is found where it is all of a document's words.

Seeds are broadcast where their count is at most ``max_broadcast`` (checked).  Beyond that (seed, row, place) are
joined by a shuffle, and words are compared for the hits only.

Defined results: one row per (doc_id, item_id) with an overlap; null and empty texts and items have none; rows that share an
id are one document here; null ids are kept as such; repeated items change nothing; of several
windows the best counts; very long texts are read whole; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import benchmark, documents, words, written

SPAN, AGREE = 13, 11
MASK, SHORT_MASK = "1001001001", "10101"
#: Items of fewer words are compared with whole documents.
TINY = 5
#: Places before and behind a seed's first that its windows reach.
BEFORE, BEHIND = SPAN - len(MASK), SPAN - 1
LONG_KIND, SHORT_KIND, TINY_KIND = 0, 1, 2


def _hashed(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    return F.transform(words(F.lower(text.cast("string"))), lambda w: F.xxhash64(w))


def _seed(kind: int, mask: str, h: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(kind), *(F.get(h, at + k) for k, bit in enumerate(mask) if bit == "1"))


def _whole(h: Column) -> Column:
    """Seed of all words where they are few."""
    return F.xxhash64(F.lit(TINY_KIND), F.size(h), *(F.get(h, F.lit(k)) for k in range(TINY - 1)))


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(seed, item_id, kind, place, n, window): the window holds the item's words around a seed, or all of a short item's."""
    src = items.select(F.col(id_col).alias("item_id"), _hashed(F.col(text_col)).alias("h")).withColumn("n", F.size("h"))
    places = lambda last: F.explode(F.sequence(F.lit(0), last)).alias("place")
    around = F.transform(F.sequence(F.lit(-BEFORE), F.lit(BEHIND)), lambda k: F.get(F.col("h"), F.col("place") + k))
    h, place = F.col("h"), F.col("place")
    long = src.filter(F.col("n") >= SPAN).select("item_id", "n", "h", places(F.col("n") - len(MASK)))
    short = src.filter(F.col("n").between(TINY, SPAN - 1)).select("item_id", "n", "h", places(F.least(F.lit(1), F.col("n") - len(SHORT_MASK))))
    tiny = src.filter(F.col("n").between(1, TINY - 1))
    out = long.select(_seed(LONG_KIND, MASK, h, place).alias("seed"), "item_id", F.lit(LONG_KIND).alias("kind"), "place", "n", around.alias("window"))
    out = out.unionByName(short.select(_seed(SHORT_KIND, SHORT_MASK, h, place).alias("seed"), "item_id", F.lit(SHORT_KIND).alias("kind"), "place", "n", h.alias("window")))
    out = out.unionByName(tiny.select(_whole(h).alias("seed"), "item_id", F.lit(TINY_KIND).alias("kind"), F.lit(0).alias("place"), "n", h.alias("window")))
    return out.dropDuplicates(["seed", "item_id", "place", "window"])


def _matched() -> Column:
    """Agreeing words of the best window, null where too few agree; from h, at, kind, place, n and window.

    Spelt out place by place: a lambda would end the generated loop.
    """
    own = lambda k: F.get("h", F.col("at") + k)
    same = {k: F.when(own(k) == F.get("window", F.lit(k + BEFORE)), 1).otherwise(0) for k in range(-BEFORE, BEHIND + 1)}
    inside = lambda k: own(k).isNotNull() & F.get("window", F.lit(k + BEFORE)).isNotNull()
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    best = F.greatest(*(F.when(inside(s) & inside(s + SPAN - 1), add(same[k] for k in range(s, s + SPAN))).otherwise(0) for s in range(-BEFORE, 1)))
    first = F.col("at") - F.col("place")
    short = add(F.when(F.get("h", first + k) == F.get("window", F.lit(k)), 1).otherwise(0) for k in range(SPAN - 1))
    least = F.col("n") - F.floor(F.col("n") * (SPAN - AGREE) / SPAN).cast("int")
    fits = (first >= 0) & (first + F.col("n") <= F.size("h")) & ((F.col("kind") == SHORT_KIND) | (F.size("h") == F.col("n")))
    return F.when(F.col("kind") == LONG_KIND, F.when(best >= AGREE, best)).when(fits & (short >= least), short)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, item_id, matched, width): agreeing words in the best window, and the window's width."""
    seeds = written(item_seeds(items, item_col, item_text), "decontaminate-seeds")
    kinds = {r["kind"]: r["k"] for r in seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("k")).collect()}
    src = docs.select(F.col(id_col).alias("doc_id"), _hashed(F.col(text_col)).alias("h"))
    h, at, n = F.col("h"), F.col("at"), F.size("h")
    # Only the kinds of seed that the items have are looked up.
    each = [F.when(at + len(MASK) <= n, _seed(LONG_KIND, MASK, h, at))] if LONG_KIND in kinds else []
    each += [F.when(at + len(SHORT_MASK) <= n, _seed(SHORT_KIND, SHORT_MASK, h, at))] if SHORT_KIND in kinds else []
    each += [F.when((at == 0) & (n < TINY), _whole(h))] if TINY_KIND in kinds else []
    seed = (each[0] if len(each) == 1 else F.explode(F.array(*each)) if each else F.lit(None).cast("long")).alias("seed")
    place = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at")
    if sum(kinds.values()) <= max_broadcast:
        # One generated loop over an array that is never copied.
        found = src.select("doc_id", "h", place).select("doc_id", "h", "at", seed).join(F.broadcast(seeds), "seed")
    else:
        keyed = src.select("doc_id", "h", F.xxhash64("h").alias("row"))
        hits = keyed.select("doc_id", "h", "row", place).select("doc_id", "row", "at", seed).join(seeds, "seed")
        rows = keyed.dropDuplicates(["doc_id", "row"]).withColumnRenamed("doc_id", "__id")
        found = hits.join(rows, "row").filter(F.col("doc_id").eqNullSafe(F.col("__id")))
    found = found.select("doc_id", "item_id", _matched().alias("matched"), F.least("n", F.lit(SPAN)).alias("width")).filter("matched is not null")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("width").alias("width"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
