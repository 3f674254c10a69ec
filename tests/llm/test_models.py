"""Operators 2 and 4, and the pipeline."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, op4_katz
from quillspark.llm.common import crc_remainder
from quillspark.llm.op2_language import _MIX, BUCKETS, GRAMS, fit, identify, normalized, op2_language, train
from quillspark.llm.op4_katz import score


def test_language_held_out(spark, sf):
    got = op2_language(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out and any(c.isalpha() for c in r.text)]
    assert len(rows) == truth.count() and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 10
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, None), (101, "", "en"), (102, "123 !?", None), (None, "und der hund", None), (103, "the " * 600_000, None), (1, rows[1][1], "en")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    model = train(df, crc_remainder(F.col("doc_id"), 4) != 2, "doc_id", "text", "lang")
    got = identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert by[None].lang_pred == "de" and by[103].lang_pred == "en" and by[100].rejected
    none = identify(df, train(df.limit(0), F.lit(True), "doc_id", "text", "lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert fit(["a"], [np.array([1, 2], np.int32)]).predict(["xy"])[0] == ["a"]


def test_language_of_ambiguous_short_texts_stays_finite(spark):
    """Rows that two languages share, each a gram over and over, pull both ways in every step."""
    rng = random.Random(1)
    words = {"de": "der hund und die katze sind nicht im haus".split(), "en": "the dog and the cat are not in this house".split()}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(40))) for lang, w in words.items() for _ in range(200)]
    rows += [(lang, f"ok {i}") for lang in words for i in range(200)] + [(lang, "a " * 500) for lang in words for _ in range(50)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = train(df, F.lit(True), "doc_id", "text", "lang")
    assert np.isfinite(model.table).all() and np.isfinite(model.bias).all()
    got = identify(df, model, keep=[F.col("lang")]).collect()
    assert all(0 <= r.score <= 1 for r in got)
    prose = [r for r in got if r.doc_id < 400]
    assert sum(r.lang_pred == r.lang for r in prose) >= 0.97 * len(prose)
    marks = identify(spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½", "① ²", "ª", "x²", "_1"])], "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" for r in sorted(marks, key=lambda r: r.doc_id)] == [True, True, True, False, False, True]


def test_language_equals_plain_averages(spark):
    """The served table against n-grams taken one by one."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("the cat and dog", "der hund und katze", "le chat et chien")[i % 3].split()) for _ in range(12)), ("en", "de", "fr")[i % 3]) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, "x", "en"), (901, "É", None), (902, "the 1 hund!", None)], "doc_id long, text string, lang string")
    model = train(df, F.lit(True), "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, model).collect()}
    for d, text, _ in [*rows, (901, "É", None), (902, "the 1 hund!", None)]:
        data, total, n = list(normalized(text)), np.zeros(len(model.labels)), 0
        for size in GRAMS:
            for i in range(len(data) - size + 1):
                h = size
                for k in range(size):
                    h = (h + data[i + k]) * int(_MIX[k]) % 2**32
                    h ^= h >> 15
                total += model.table[h % BUCKETS]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[d][0] == model.labels[int(p.argmax())] and abs(got[d][1] - p.max()) < 1e-6
    assert sum(got[d][0] == lang for d, _, lang in rows) >= 88


def test_language_sample_is_bounded_and_never_empty(spark):
    """Copies of one text are one row of the sample, null ids are nothing special, and a huge label keeps its share."""
    df = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("und der hund "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    model = train(df.unionByName(more), F.lit(True), "doc_id", "text", "lang", sample_rows=40)
    assert "de" in model.labels


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*low.encode().split(), "END"]


def good_turing(counts):
    """Discounted counts by the textbook formula; the module's own is not used."""
    n = Counter(counts.values())
    common = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for g, c in counts.items():
        d = 1.0
        if c <= 5 and common < 1 and n[1]:
            d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
        out[g] = c * (d if 0 < d < 1 else 1.0)
    return out


def brute(rows, order=3):
    """Katz by recursion over dictionaries."""
    learn = [tokens(t) for _, held, t in rows if not held]
    counts = [Counter() for _ in range(order + 1)]
    for w in learn:
        padded = ["START"] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    cut = [None] + [good_turing(c) for c in counts[1:]]
    free = n - sum(cut[1].values())
    whole, free = (n, free) if free > 1e-9 else (n + 1, 1.0)
    seen, under = defaultdict(dict), {}
    for k in range(2, order + 1):
        for g, c in cut[k].items():
            seen[g[:-1]][g[-1]] = c
            under[g[:-1]] = under.get(g[:-1], 0) + counts[k][g]
    for h, f in seen.items():
        under[h] += not sum(f.values()) < under[h] * (1 - 1e-12)

    def probability(h, w):
        if not h:
            return cut[1].get((w,), free) / whole
        if w in seen.get(h, {}):
            return seen[h][w] / under[h]
        return alpha(h) * probability(h[1:], w)

    known_alpha = {}

    def alpha(h):
        if h not in seen:
            return 1.0
        if h not in known_alpha:
            known_alpha[h] = (1 - sum(seen[h].values()) / under[h]) / (1 - sum(probability(h[1:], w) for w in seen[h]))
        return known_alpha[h]

    for h in list(seen)[:40]:  # exactly normalised, the unknown token included
        assert abs(sum(probability(h, w) for (w,) in counts[1]) + probability(h, "never seen") - 1) < 1e-9
    out = []
    for d, _, t in rows:
        w = tokens(t)
        padded = ["START"] * (order - 1) + w
        s = sum(math.log10(probability(tuple(padded[i : i + order - 1]), padded[i + order - 1])) for i in range(len(w)))
        base = sum(math.log10((counts[1][(x,)] + 1) / (n + v + 1)) for x in w)
        out.append((-1 if d is None else d, len(w), sum(counts[1][(x,)] > 0 for x in w), base, s))
    return sorted(out, key=lambda r: r[:3]), n


@pytest.mark.parametrize("order,frequent", [(3, 500_000), (3, 5), (2, 0), (1, 3)])
def test_katz_equals_brute_force(spark, monkeypatch, order, frequent):
    monkeypatch.setattr(op4_katz, "FLUSH", 400)
    rng = random.Random(4)
    vocab = [f"W{int(rng.paretovariate(0.8))}" for _ in range(400)]
    rows = [(i, i % 5 == 0, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, True, None), (201, False, ""), (None, False, "w1 w2"), (3, False, rows[3][2]), (202, True, "never seen w1")]
    df = spark.createDataFrame([(d, h, t, 1.0) for d, h, t in rows], "doc_id long, held boolean, text string, score double").repartition(3)
    got = score(df, ~F.col("held"), order=order, frequent=frequent).collect()
    want, n = brute(rows, order)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [r[:3] for r in have] == [r[:3] for r in want] and all(r.train_tokens == n for r in got)
    assert np.allclose([r[3:] for r in have], [r[3:] for r in want], rtol=1e-9)


def test_katz_query_keeps_all_grams(spark, tmp_path):
    rng = random.Random(5)
    vocab = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)]
    rows = [(i, zlib.crc32(str(i).encode()) % 7 == 2, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in op4_katz.op4_katz(spark, str(tmp_path)).collect())
    want = brute(rows)[0]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


def test_katz_keeps_few_bytes_a_position(spark, tmp_path, monkeypatch):
    """All tables of a run, on texts in which nearly every gram of two and three words is new."""
    for module in (common, op4_katz):
        monkeypatch.setattr(module, "shared_dir", lambda _, name: f"file://{tmp_path}/{name}-{time.time_ns()}", raising=False)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(100)]
    got = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 7 != 2).collect()
    held = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert sum(r.n_tokens for r in got) == 40_100 and held < 10 * 40_100


@pytest.mark.parametrize("order", [2, 3])
def test_katz_words_of_many_positions_are_split(spark, order):
    """The word before most tokens, in several buckets, with rare, common and unknown tokens behind it."""
    rng = random.Random(9)
    rows = [(i, i % 4 == 0, " ".join(x for _ in range(rng.randint(0, 25)) for x in (f"v{rng.randrange(5)}", "the", f"w{int(rng.paretovariate(0.6))}"))) for i in range(90)]
    got = score(spark.createDataFrame(rows, "doc_id long, held boolean, text string"), ~F.col("held"), order=order, frequent=20).collect()
    want = brute(rows, order)[0]
    have = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert [r[:3] for r in have] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in have], [r[3:] for r in want], rtol=1e-9)


def test_katz_null_learn_is_no_training(spark):
    rows = [(1, False, "a b c a b"), (2, True, "a b d"), (3, None, "a b d")]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, held boolean, text string"), ~F.col("held")).collect()}
    assert [got[i].held_out for i in (1, 2, 3)] == [False, True, None] and got[3].train_tokens == 6 and got[2][2:] == got[3][2:]


def test_katz_without_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = score(df, F.lit(False)).first()
    assert r.n_known == 0 and r.score == 0 and r.train_tokens == 0
    assert score(df.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(80), "en", "s", 0) for i in range(80)]
    leaked = rows[10][1].split()[5:30]
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[4][1] + " end", "en", "s", 0), (102, "short", "en", "s", 0), (103, None, None, None, None), (104, text(60) + " mail a.b@c.de now", "en", "s", 0), (None, text(70), "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    sf_dir = tempfile.mkdtemp()
    spark.createDataFrame([(1, " ".join(leaked))], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    gone = [{102, 103}, {100, 101}, {10}, set(), set()]
    have = Counter(r[0] for r in rows)
    for (_, stage), out in zip(corpus_pipeline.STAGES, gone):
        left = corpus_pipeline.written(stage(spark, left, sf_dir), "test")
        for d in out:
            del have[d]
        if 100 in out:
            have[5] = 1  # a repeated row is a copy, too
        assert Counter(r.doc_id for r in left.collect()) == have
        if "text" in left.columns:
            assert left.columns == docs.columns
        if stage is corpus_pipeline.personal_data:
            r = left.filter("doc_id = 104").first()
            assert "[EMAIL]" in r.text and r.n_chars == len(r.text)
    assert corpus_pipeline.run(spark, sf_dir).count() == left.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
