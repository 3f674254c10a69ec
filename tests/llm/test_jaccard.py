import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm import op9_jaccard as op9
from quillspark.llm.common import written
from quillspark.llm.components import components
from quillspark.llm.op9_jaccard import jaccard_components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, k):
    w = lower(t or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, threshold=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and same and 100 * same >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i)]
        out.append((-1 if d is None else d, len(sets[i]), -1 if d is None else min(ids)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    line = [rng.choice(vocab) for _ in range(12)]
    rows, d = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 4, 9, 30, 80]))]
        if rng.random() < 0.5:
            base += line
        for _ in range(rng.choice([1, 1, 4, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(w) + 1)
                w[i : i + 1] = rng.choice([[], ["New"], ["x", "y"]])
            rows.append((d, " ".join(w)))
            d += 1
    rows += [(None, rows[0][1]), (3, rows[3][1]), (4, "other text under an old id"), (d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "A b"), (d + 4, "a B"), (d + 5, "a b c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"common": 3}), (3, {"block": 2, "max_broadcast": 0, "common": 2}), (4, {"threshold": 60})])
def test_equals_brute_force(spark, monkeypatch, seed, kw):
    monkeypatch.setattr(op9, "FLUSH", 300)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = jaccard_components(df, **kw).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == brute(rows, threshold=kw.get("threshold", 85))


@pytest.mark.parametrize("kw", [{"block": 3}, {"threshold": 60, "common": 2}, {"block": 5, "max_popular": 0}, {"block_items": 100}])
def test_link_counts_equal_brute_force(spark, monkeypatch, kw):
    monkeypatch.setattr(op9, "WIDTH", 16)
    monkeypatch.setattr(op9, "QUERIES", 5)
    rng = random.Random(6)
    base = [f"w{rng.randrange(60)}" for _ in range(60)]
    rows = corpus(6) + [(1000 + i, " ".join([*base, f"own{i}"])) for i in range(20)] + [(1030, " ".join([*base, "own3"]))]
    threshold = kw.get("threshold", 85)
    sets = [frozenset(shingles(t, 4)) for _, t in rows]
    classes = {s for s, (d, _) in zip(sets, rows) if d is not None and s}
    want = {s: sum(s != o and 100 * len(s & o) >= threshold * len(s | o) for o in classes) for s in classes}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.n_links) for r in jaccard_components(df, **kw).collect() if r.doc_id is not None)
    assert got == sorted((d, len(s), want.get(s, 0)) for s, (d, _) in zip(sets, rows) if d is not None)
    assert all(n == 19 for d, _, n in got if d >= 1000 or d == 1030) or threshold == 60


def test_unlike_texts_with_a_shingle_in_common_do_not_meet(spark, monkeypatch):
    """Shingles that texts share by chance made a pair of each two; such pairs grow with the square of the texts."""
    met, candidates = [], op9._candidates
    monkeypatch.setattr(op9, "_candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    rng = random.Random(8)
    phrase = "one shingle of all"
    rows = [(i, " ".join([phrase] + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(20)]
    rows += [(100 + i, t.replace(phrase, "own start")) for i, (_, t) in enumerate(rows[:5])]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), threshold=50).collect()
    assert sorted(r[:3] for r in map(tuple, got)) == brute(rows, threshold=50)
    assert met[0].count() <= 5


@pytest.mark.parametrize("shared,threshold", [(2, 85), (9, 40)])
def test_few_shingles_in_common_are_enough_for_small_sets(spark, monkeypatch, shared, threshold):
    monkeypatch.setattr(op9, "SHARED", shared)
    rng = random.Random(shared)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(3, 14)))) for i in range(120)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), threshold=threshold, common=6).collect()
    assert sorted(r[:3] for r in map(tuple, got)) == brute(rows, threshold=threshold)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("few", [0, 100_000])
def test_small_tables_join_in_one_job(spark, monkeypatch, few):
    """Rows of frequent, rare, unmatched and null keys; a small table is broadcast whole, and no table of frequent keys is written."""
    calls = []
    monkeypatch.setattr(common, "FEW", few, raising=False)
    monkeypatch.setattr(common, "written", lambda df, name: calls.append(name) or written(df, name))
    keys = [1] * 50 + [2, 3, 3, 4, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k long, v string")
    want = {(k, i, {1: "a", 2: "b", 3: "c"}.get(k)) for i, k in enumerate(keys)}
    got = [tuple(r) for r in common.joined(rows, table, "k").collect()]
    assert len(got) == len(keys) and set(got) == want
    assert calls == ([] if few else ["hot-keys"])


def test_empty_long_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, 5, "a"), (2, long + " end", 6, "b"), (3, "x" * 2_000_000, 7, "c"), (4, "x" * 2_000_000, 7, "c")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n int, cid string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 199_997, 1), (2, 199_998, 1), (3, 1, 3), (4, 1, 3)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_are_told_apart(spark):
    """Words that a polynomial modulo a power of two maps to one number."""
    mark = lambda n, flip: "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
    rows = [(i, mark(n, f)) for i, (n, f) in enumerate((n, f) for n in (8, 16, 128, 136, 1024, 4096) for f in (0, 1))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_batches_of_long_sets_are_small(spark):
    """Sets of 100 KB, in the batches that the operator's plans pass to workers."""
    jaccard_components(spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string")).collect()

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    sets = spark.range(0, 200, 1, 1).select(F.expr("cast(repeat('x', 100000) as binary)").alias("items"))
    assert max(r.n for r in sets.mapInArrow(sizes, "n long").collect()) <= 5 << 20
