import hashlib
import random

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.op5_tokens import count_tokens
from quillspark.llm.op10_bpe import encode_decode


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.default_path())


def texts():
    rng = random.Random(7)
    odd = ["", " ", "\n\n x", "a<|endoftext|>b", "it's we're I'll'", "x" * 5000, "näive 日本語 　 text", "’s", "a\x1c\x1db", "12 345²"]
    for alphabet in ("ab", "a' rsel", "the of\n", "é ß\t1.", "".join(map(chr, range(32, 600)))):
        odd += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (3, 50, 700, 3000)]
    return odd


def test_encoding_equals_library(tok):
    coder = bpe.Bpe(bpe.default_path(), cache_entries=50)
    for t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        got = coder.encode_many([t])[0]
        assert np.frombuffer(got, "<u4").tolist() == ids, t[:50]
        assert coder.decode(got) == tok.decode(ids, skip_special_tokens=False)


def test_frequent_pieces_stay_known(tok):
    """A full cache loses what is met no more, and never a piece of every text."""
    coder = bpe.Bpe(bpe.default_path(), cache_entries=50)
    first = coder.learn({" the"})[" the"]
    for i in range(40):
        for p, ids in coder.learn({" the", *(f" {i}x{j}é" for j in range(7))}).items():
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(p, add_special_tokens=False).ids
        assert coder.learn({" the"})[" the"] is first
    assert len(coder.cache) + len(coder.older) <= 50


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_parts_join_exactly(tok, leaf):
    coder = bpe.Bpe(bpe.default_path())
    for t in texts():
        if coder.has_special(t) or not t:
            continue
        t = t[:900]
        level = []
        for i in range(0, len(t), leaf):
            ids = coder.encode_many([t[i : i + leaf]])[0]
            level.append([(p, np.frombuffer(coder.learn({p})[p], "<u4").tolist()) for p in coder.pieces(t[i : i + leaf])])
        while len(level) > 1:
            level = [coder.concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert [i for _, own in level[0] for i in own] == tok.encode(t, add_special_tokens=False).ids, (leaf, t[:60])


@pytest.mark.parametrize("leaf,edge", [(9, 1), (64, 2), (300, 4), (300, 16)])
def test_leaves_join_at_their_edges(tok, monkeypatch, leaf, edge):
    """Only the pre-tokens at a leaf's ends are taken apart again, unless a join needs the others."""
    monkeypatch.setattr(bpe, "EDGE", edge)
    coder = bpe.Bpe(bpe.default_path())
    plain = "the cat's 12 hats, " * 150
    for t in [*texts(), plain]:
        if coder.has_special(t) or not t:
            continue
        level = []
        for i in range(0, len(t), leaf):
            pieces = coder.pieces(t[i : i + leaf])
            own = [coder.learn({p})[p] for p in pieces]
            level.append((t[i : i + leaf], b"".join(own), coder.edges(pieces, own)))
        taken = []
        with monkeypatch.context() as m:
            m.setattr(coder, "pieces", lambda x: taken.append(len(x)) or bpe.Bpe.pieces(coder, x))
            level = [coder.part(*row) for row in level]
            while len(level) > 1:
                level = [coder.concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert np.frombuffer(coder.flat(level[0]), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, (leaf, t[:60])
        assert t != plain or leaf < 300 or sum(taken) < len(t) // 2


def test_split_of_near_texts_equals_the_published_pattern():
    rng = random.Random(9)
    near = bpe.near_split().findall
    published = regex.compile(bpe.PRE_TOKEN).findall
    letters = "".join(map(chr, range(0x250))) + "' \n\x85\xa0" * 30 + "strevmld19" * 10
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert near(t) == published(t), t


def test_join_of_unsplit_text(tok):
    rng = random.Random(3)
    coder = bpe.Bpe(bpe.default_path())
    for alphabet in ("ab", "thean", "aaaab", "ing"):
        for _ in range(30):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 400)))
            cut = rng.randint(1, len(s) - 1)
            assert coder.join(coder.raw(s[:cut]), coder.raw(s[cut:]), k=1) == coder.raw(s)


def test_queries_over_rows(spark, tok):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (0, "again", "y"), (0, "again", "y"), (77, "long word " * 4000, "z"), (77, "long word " * 4000, "z"), (78, "q" * 40000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((-1 if d is None else d, len(ids := tok.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for d, t, _ in rows)
    got = encode_decode(df, bpe.default_path(), digests=True).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    got = count_tokens(df, bpe.default_path(), sample_rows=5, frequent=10, worker_entries=20).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == [w[:2] for w in want]
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    empty = df.limit(0)
    assert encode_decode(empty, bpe.default_path()).count() == 0 and count_tokens(empty, bpe.default_path()).count() == 0
