import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import op8_substrings as op8
from quillspark.llm.op8_substrings import SuffixAutomaton, dedup_substrings


def brute(rows, window=13):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    phrases = [[rng.choice(vocab) for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(phrases)
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    for d in range(n, n + 60):
        w = rng.choice(rows)[1].split()
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = "edit"
        rows.append((d, " ".join(w)))
    rows += [(None, rows[3][1]), (5, rows[5][1]), (7, rows[9][1]), (500, None), (501, ""), (502, "a " * 200), (503, "a " * 100), (504, "é\xa0x " * 30)]
    rng.shuffle(rows)
    return rows


def test_automaton_matching():
    rng = random.Random(1)
    a, seen = SuffixAutomaton(), []
    for _ in range(60):
        s = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
        text = ["".join(x) for x in seen]
        want = [max(k for k in range(e + 2) if k == 0 or any("".join(s[e + 1 - k : e + 1]) in t for t in text)) for e in range(len(s))]
        assert a.matching(s) == want
        a.add(s)
        seen.append(s)


@pytest.mark.parametrize("hot,limit", [(256, 10**6), (2, 10**6), (256, 0)])
def test_equals_brute_force(spark, hot, limit, monkeypatch):
    monkeypatch.setattr(op8, "FLUSH", 500)
    rows = corpus(hot)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, decisions int").repartition(5)
    got = dedup_substrings(df, digests=True, hot=hot, max_broadcast=limit).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df).count() == 0
