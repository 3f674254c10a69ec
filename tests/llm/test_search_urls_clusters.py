"""Ranked lexical search, URL filters and centroid clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from quillspark.llm import op11_search as S
from quillspark.llm import op12_urls as U
from quillspark.llm import op13_centroids as C

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k=10):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, t in held:
            m, score = 25 + (75 * len(t) * n) // total, 0
            for x in terms_of(text):
                if x in df:
                    tf = t.count(x)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_varint_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63 - 1], np.int64)
    data, size = S.varint(v)
    assert S.unvarint(data.tobytes()).tolist() == v.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 5, 9]
    assert S.unvarint(b"").tolist() == []


def test_search_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["a", "B", "c1", "straße", "ÀB", "d", "日本", "x" * 300, "9", "e", "f", "g"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "-", ".\n", "\x7f"]) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 10, 40]))) for i in range(-40, 160)] + [(None, "a B"), (7, None), (8, ""), (9, " .- "), (10, "a a a"), (10, "a a a"), (2**62, "日本 straße"), (500, "a " * 300_000)]
    docs += [(600 + i, "tie tie") for i in range(30)]
    items = [(1, "a b C1 a"), (2, None), (3, "unknown"), (4, "Tie"), (4, "tie"), (None, "日本, straße! 9"), (5, text(30)), (6, "")]
    got = {}
    for name, shard, blocks in (("many", 50, 1), ("one", 1 << 20, 1000)):
        table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
        index = S.build(table, shard_tokens=shard)
        found = S.search(index, spark.createDataFrame(items, "item_id int, text string"), block_items=blocks)
        got[name] = sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found.collect()], key=repr)
    assert got["many"] == got["one"] == ranked(docs, items)
    heads = index.filter("term is null").collect()
    assert sum(x["docs"] for x in heads) == sum(bool(terms_of(t)) for _, t in docs)


def test_search_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert S.search(S.build(none), items).collect() == [] and S.search(S.build(docs), items.limit(0)).collect() == []


def test_merge_prunes_exactly():
    r = random.Random(2)
    for _ in range(300):
        ids = sorted(r.sample(range(1000), 60))
        lists = []
        for _ in range(r.randint(1, 8)):
            numbers = sorted(r.sample(range(60), r.randint(1, 60)))
            most = r.choice([1, 5, 1000])
            given = [r.randint(0, most) for _ in numbers]
            lists.append((numbers, given, max(given)))
        total = {}
        for numbers, given, _ in lists:
            for d, x in zip(numbers, given):
                total[ids[d]] = total.get(ids[d], 0) + x
        heap = [(3, -i) for i in range(r.randint(0, 3))]
        want = sorted(heap + [(s, -d) for d, s in total.items() if s > 0], reverse=True)[:4]
        heap.sort()
        S.merge(lists, ids, heap, 4)
        assert sorted(heap, reverse=True) == want


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return re.compile(out, re.S)


def test_automaton_equals_regular_expressions():
    r = random.Random(3)
    for _ in range(40):
        globs = ["".join(r.choice(["a", "b", "/", "é", "*", "**", "?", "日"]) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 40))]
        rules = tuple(U.Rule(f"{i}" * r.randint(1, 3), "block", (g,), r.randint(0, 1)) for i, g in enumerate(globs))
        order = sorted(range(len(rules)), key=lambda i: (-rules[i].level, -len(rules[i].name), i))
        forms = ["".join(r.choice("ab/é日") for _ in range(r.randint(0, 12))) for _ in range(60)] + [""]
        want = [next((i for i in order if as_regex(globs[i]).fullmatch(f)), -1) for f in forms]
        a = U.Automaton(rules)
        assert a.match_many([f.encode() for f in forms]).tolist() == want
        assert [a.match(f.encode()) for f in forms] == want
    assert a.match_many([]).tolist() == []


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(raw) :])[0]
    host = raw.translate(UPPER)
    rules = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block"), ("com/", "allow")]
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            return host, path, rule, verdict
    return host, path, None, None


def test_urls_of_every_form(spark):
    urls = [None, "", "example.com/en/", "http://", "HTTP://WWW.Example.COM/en/A?x=1", "https://a.example.com/en/b#c", "http://example.com/en", "http://notexample.com/en/x", "http://net/es/", "http://a.net/fr/q", "http://foo.net/x.com/", "http://x.org?u=http://y.com/z", "ftp://com", "http://com/", "://.com/", "http://É.com/en/?#", "http://x.net/" + "y" * 1_000_000 + ".exe", "http://ads-track.example.org/", "http://free-bets.example.net/", "http://x.org/a/login.php", "http://x.org/a/LOGIN", "http://a@b:80/es/?q", "http://x\ny.com/\nz", "http://x.org/cart/1", "a://b://c.com/d"]
    rows = [(i, u, "com/") for i, u in enumerate(urls)] + [(8, "http://com/", "x"), (None, "http://com/", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(2)
    got = U.filter_urls(table, U.SITES + U.SCREENS).collect()
    assert sorted(repr((x["page_id"], x["host"], x["path"])) for x in got) == sorted(repr((i, *judged(u)[:2])) for i, u, _ in rows)
    by_id = {(x["page_id"], x["path"]): x for x in got}
    for i, u, _ in rows:
        host, path, rule, verdict = judged(u)
        x = by_id[i, path]
        if rule:
            assert (x["fits"], x["verdict"], x["level"]) == (rule, verdict, 1)
        else:
            assert x["level"] in (None, 0)
    screen = {i: by_id[i, judged(u)[1]]["fits"] for i, u, _ in rows if i is not None}
    assert screen[0] == screen[2] == screen[3] == "no address" and screen[16] == "binaries" and screen[17] == "adverts" and screen[18] == "betting"
    assert screen[19] == "forms" and screen[20] is None and screen[23] == "forms"
    assert U.filter_urls(table.limit(0), U.SITES).collect() == []


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


@pytest.mark.parametrize("kind", ["even", "ties", "large", "few"])
def test_clusters_equal_brute_force(spark, kind):
    r = np.random.default_rng(4)
    n = {"few": 5}.get(kind, 300)
    scale = {"ties": 0.002, "large": 20_000.0}.get(kind, 1.0)
    data = [(i, [float(np.float32(x)) for x in r.normal(size=64) * scale]) for i in range(n)]
    if kind == "ties":
        data = [(i, [float(np.round(x * 600) / 1024) for x in v]) for i, v in data]
    data += [(n, None), (n + 1, [1.0] * 63), (n + 2, [1.0] * 63 + [None]), (n + 3, [1.0] * 63 + [float("nan")]), (n + 4, [float("inf")] + [0.0] * 63), (None, data[0][1]), (1, data[1][1]), (2, data[1][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, cluster int").repartition(3)
    rows, centroids = C.cluster(table)
    want, last = brute_clusters(data)
    assert sorted([tuple(x) for x in rows.collect()], key=repr) == want
    assert centroids.tolist() == last


def test_screening_never_decides_wrongly():
    r = np.random.default_rng(9)
    for span in (3, 1000, 1 << 20, (1 << 27) - 1):
        c = r.integers(-span, span, (12, 64))
        c[5] = c[2]  # equal centroids: the lower number wins
        x = np.concatenate([r.integers(-span, span, (200, 64)), c, (c[:6] + c[6:]) // 2, c[:6] + r.integers(-1, 2, (6, 64))])
        out, distance, decided = C.assign(x.astype(np.int64), c)
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert out.tolist() == [min(range(12), key=lambda j, e=e: (e[j], j)) for e in d]
        assert distance.tolist() == [min(e) for e in d]
        assert 0 < decided < len(x) or span == 3


def test_components_beyond_64_bits_are_an_error(spark):
    table = spark.createDataFrame([(1, [200_000.0] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceed 64 bits"):
        C.cluster(table)
    assert C.cluster(table.limit(0))[0].collect() == []
