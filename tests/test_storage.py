"""The commit log, its keyed merge, and the search structures that are kept in it."""

import hashlib
import json
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import access, retrieval
from quillspark.sources import feed
from quillspark.storage import files
from quillspark.storage.log import Conflict, LogTable
from quillspark.storage.postings import PostingStore
from quillspark.storage.vectors import VectorIndex
from quillspark.streaming import ingest


def table(spark, tmp_path, **more):
    return LogTable(spark, str(tmp_path / "t"), "k long, v string", 8, ("k",), **more)


def kv(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def got(t, state=None):
    return sorted(tuple(r) for r in t.read(state).collect())


def test_versions_are_snapshots(spark, tmp_path):
    t = table(spark, tmp_path)
    assert got(t) == [] and t.state().version == -1
    t.append(kv(spark, [(1, "a"), (2, "b")]))
    old = t.state()
    before = {f.bucket: f.path for f in old.files.values()}
    t.merge(kv(spark, [(2, "c"), (3, "d")]), ["k"])
    assert got(t) == [(1, "a"), (2, "c"), (3, "d")] and got(t, old) == [(1, "a"), (2, "b")] == got(t, t.state(0))
    touched = {r[0] for r in kv(spark, [(2, ""), (3, "")]).select(t.bucket_of()).collect()}
    after = {f.bucket: f.path for f in t.state().files.values()}
    assert all((after[b] == p) == (b not in touched) for b, p in before.items())
    t.merge(spark.createDataFrame([(1, "x", True, 2), (1, "y", False, 1), (9, "z", False, 1)], "k long, v string, gone boolean, arrival int"), ["k"], deleted="gone")
    assert got(t) == [(2, "c"), (3, "d"), (9, "z")]
    t.delete(F.col("v") == "d")
    t.merge(kv(spark, [(None, "n"), (None, "m")]), ["k"])
    t.merge(kv(spark, []), ["k"])
    assert sorted((repr(r.k), r.v) for r in t.read().collect()) == [("2", "c"), ("9", "z"), ("None", "n")]
    t.overwrite(kv(spark, [(5, "e")]))
    assert got(t) == [(5, "e")]


def test_a_batch_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for _ in range(3):
        t.append(kv(spark, [(1, "a")]), ("run", 0))
    t.append(kv(spark, [(1, "b")]), ("run", 1))
    t.append(kv(spark, [(1, "a")]), ("run", 0))  # replayed late
    t.append(kv(spark, [(1, "c")]), ("other", 0))
    assert got(t) == [(1, "a"), (1, "b"), (1, "c")] and t.state().version == 2


def test_a_crash_before_the_entry_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(kv(spark, [(1, "a"), (2, "b")]))
    monkeypatch.setattr(files, "create_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.merge(kv(spark, [(1, "x")]), ["k"], ("run", 0))
    monkeypatch.undo()
    assert got(t) == [(1, "a"), (2, "b")]
    t.merge(kv(spark, [(1, "x")]), ["k"], ("run", 0))
    assert got(t) == [(1, "x"), (2, "b")]
    assert t.clean(keep=1, age_s=0) >= 2 and got(t) == [(1, "x"), (2, "b")]  # the lost writer's files, and those replaced


def test_writers_of_other_buckets_both_win_and_of_one_bucket_begin_again(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(kv(spark, [(i, "a") for i in range(40)]))
    at, turns = t.state(), []

    def change(state):
        turns.append(state.version)
        if len(turns) == 1:  # someone else is faster
            t.merge(kv(spark, [(7, "other")]), ["k"])
        return t.write_files(t.read(state).filter("k <> 7").unionByName(t.read(state).filter("k = 7").withColumn("v", F.concat("v", F.lit("!"))))), list(state.files), None

    t.update(change)
    assert turns == [0, 1] and dict(got(t))[7] == "other!"
    with pytest.raises(Conflict):
        t.commit(at, [], list(at.files), touched=None)
    bucket = {r["k"]: r["b"] for r in t.read().select("k", t.bucket_of().alias("b")).collect()}
    a, b = 0, next(k for k in bucket if bucket[k] != bucket[0])
    errors = []

    def write(k):
        try:
            t.merge(kv(spark, [(k, "both")]), ["k"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (a, b)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and dict(got(t))[a] == dict(got(t))[b] == "both" and len(got(t)) == 40


def test_it_gives_up_after_five_retries(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(kv(spark, [(1, "a")]))
    turns = []

    def change(state):
        turns.append(1)
        t.merge(kv(spark, [(1, "other")]), ["k"])
        return [], list(state.files), None

    with pytest.raises(Conflict):
        t.update(change)
    assert len(turns) == 6


def test_old_versions_go(spark, tmp_path):
    t = table(spark, tmp_path)
    for i in range(22):
        t.overwrite(kv(spark, [(i, "a")]).coalesce(1))
    assert any(n.endswith(".whole") for n in files.names(spark, f"{t.folder}/log"))
    assert t.clean(keep=3, age_s=3600) == 0
    assert t.clean(keep=3, age_s=0) > 15
    assert got(t) == [(21, "a")] and got(t, t.state(20)) == [(20, "a")]
    with pytest.raises(ValueError):
        t.state(5)
    t.append(kv(spark, [(99, "b")]))
    assert got(t) == [(21, "a"), (99, "b")]


FILES = "drive_id string, item_id string, name string, etag string, index_fingerprint string, scan_id string"


def test_a_second_walk_over_several_batches(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    page = lambda n, rows: (pages / f"{n:05d}.json").write_text("\n".join(json.dumps({"drive_id": "d", **r}) for r in rows))
    page(0, [{"item_id": "old", "name": "a.txt"}, {"item_id": "both", "name": "c.txt", "etag": "1"}])
    page(1, [{"item_id": "older", "name": "b.txt"}])
    page(2, [{"expired": True}])
    page(3, [{"item_id": "new", "name": "d.txt"}])
    page(4, [{"item_id": "both", "name": "c.txt", "etag": "2"}])
    page(5, [{"item_id": "newer", "name": "e.txt"}, {"item_id": "new", "is_deleted": True}])
    t = LogTable(spark, str(tmp_path / "files"), FILES, 4, ("drive_id", "item_id"))
    stream = lambda after: feed.feed_stream(spark, str(pages), after, pages_per_batch=1)
    start = lambda cp, after: ingest.delta_pass(stream(after), cp, ingest.index_batch(t, ["txt"], "fp", cp.rsplit("/", 1)[1]))
    resets = []
    assert ingest.with_restart(start, str(tmp_path / "cp"), resets.append) == 2 and resets == [2]
    rows = {r.item_id: (r.etag, r.scan_id) for r in t.read().collect()}
    assert rows == {"old": (None, "walk=0"), "older": (None, "walk=0"), "both": ("2", "walk=1"), "newer": (None, "walk=1")}
    for _ in range(2):
        ingest.end_walk(t, "walk=1")
    assert {r.item_id for r in t.read().collect()} == {"both", "newer"}
    version = t.state().version
    handle = ingest.index_batch(t, ["txt"], "fp", "walk=1")
    for epoch in (2, 0):  # replays, the last one and an older one
        handle(feed.feed_table(spark, str(pages)).filter("page = 3"), epoch)
    assert t.state().version == version and {r.item_id for r in t.read().collect()} == {"both", "newer"}


def clustered(n=500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    return [(i, (centres[i % 20] + rng.normal(size=16) * 0.15).tolist()) for i in range(n)]


def test_vector_lists(spark, tmp_path):
    data = clustered()
    df = spark.createDataFrame(data + [(9000, [0.0] * 16), (9001, None)], "id long, v array<double>").cache()
    index = VectorIndex.build(df, str(tmp_path / "v"), "id", "v")
    every, state = set(index.table.paths()), index.table.state()
    assert state.notes["probes"] < 25  # of 89 lists
    for q in (3, 250, 401):
        exact = [tuple(r) for r in retrieval.vector_search(df.filter("id < 9000"), data[q][1], "id", "v", 10).collect()]
        found = index.search(data[q][1], 10, exact=True)
        assert [tuple(r) for r in found.collect()] == exact
        assert len(found.inputFiles()) < len(every) / 2  # the lists that can't hold one are not opened
        few = index.search(data[q][1], 10)
        assert len(few.inputFiles()) < len(every) / 3
    asked = df.filter("id < 40").selectExpr("id as query", "v as q")
    both = index.exact_many(asked, 10).select("query", "key").join(index.search_many(asked, "query", "q", 10), ["query", "key"])
    assert both.count() >= 0.9 * 400
    many = index.search_many(df.filter("id in (3, 250, 401)"), "id", "v", 10).collect()
    assert len(many) == 30 and {(r.query, r.key) for r in many if r["rank"] == 1} == {(3, 3), (250, 250), (401, 401)}
    assert index.search(data[3][1], 5, where=F.col("id") % 2 == 0).filter("id % 2 = 1").count() == 0
    # One vector moves far away, one goes, one is new: other lists keep their files, old readers their rows.
    moved = [(3, data[10][1], False), (23, data[23][1], True), (5000, data[3][1], False), (23, data[23][1], True)]
    index.upsert(spark.createDataFrame(moved, "id long, v array<double>, gone boolean"), ("batch", 0), deleted="gone")
    now = dict((i, v) for i, v in data if i != 23) | {3: data[10][1], 5000: data[3][1]}
    after = spark.createDataFrame(list(now.items()), "id long, v array<double>")
    for q in (3, 10, 23):
        assert [tuple(r) for r in index.search(data[q][1], 12, exact=True).collect()] == [tuple(r) for r in retrieval.vector_search(after, data[q][1], "id", "v", 12).collect()]
    assert len(every - set(index.table.paths())) <= 4 and index.table.read().count() == 500
    assert index.table.read(state).filter("id = 23").count() == 1
    version = index.table.state().version
    index.upsert(spark.createDataFrame(moved, "id long, v array<double>, gone boolean"), ("batch", 0), deleted="gone")
    assert index.table.state().version == version


def test_searches_of_many_take_parts_and_keep_ties_in_order(spark, tmp_path, monkeypatch):
    from quillspark.storage import vectors

    monkeypatch.setattr(vectors, "PART", 30)
    monkeypatch.setattr(vectors, "SCORES", 500)
    data = clustered(120) + [(1000 - i, clustered(1)[0][1]) for i in range(60)]  # one vector many times over
    df = spark.createDataFrame(data, "id long, v array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), "id", "v")
    asked = df.filter("id in (0, 7, 119, 950)").selectExpr("id as query", "v as q")
    whole = len(index.centroids())
    for found in (index.exact_many(asked, 5), index.search_many(asked, "query", "q", 5, probes=whole)):
        found = found.collect()
        for q in (0, 7, 119, 950):
            want = [tuple(r) for r in retrieval.vector_search(df, dict(data)[q], "id", "v", 5).collect()]
            assert [(r.key, r.score) for r in sorted((r for r in found if r.query == q), key=lambda r: r["rank"])] == want


def test_vector_lists_of_few_and_of_none(spark, tmp_path):
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>"), str(tmp_path / "a"), "id", "v")
    assert [r.id for r in one.search([1.0, 1.0], 3, exact=True).collect()] == [1]
    none = VectorIndex.build(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path / "b"), "id", "v")
    assert none.search([1.0, 1.0], 3).collect() == [] == none.search([1.0, 1.0], 3, exact=True).collect()


CHUNK = "file string, key string, content string, anonymous boolean, allowed array<string>"


def same_search(spark, store, current, query, who=(None, None)):
    """The store's rankings are those of the plain scan over the chunks that the reader sees."""
    seen = spark.createDataFrame(list(current), CHUNK).filter(access.permission_filter(F.col("anonymous"), F.col("allowed"), *who))
    view = store.view(*who)
    plain = retrieval.bm25(seen, query, "key", "content")
    rounded = lambda df: sorted((r.key, round(r.score, 9)) for r in df.collect())
    assert rounded(store.scores(query, view)) == rounded(plain)
    best = [tuple(r) for r in plain.select("key", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "key").limit(7).collect()]
    assert [tuple(r) for r in store.top(query, 7, view).collect()] == best
    if seen.count():
        got, want = ([(r.key, round(r.score, 9)) for r in x.collect()] for x in (store.hybrid(query, 5, 2, view), retrieval.hybrid_search(seen, query, "key", "content", 5, 2)))
        assert got == want


def test_postings_follow_their_files(spark, tmp_path, monkeypatch):
    from quillspark.storage import postings

    monkeypatch.setattr(postings, "SLICE", 8)
    r = np.random.default_rng(1)
    words = ["red", "green", "blue", "the", "the", "the", "Ünï", "rare", "x1"]
    chunks = lambda f, n: [(f"f{f}", f"k{f}-{i}", " ".join(r.choice(words, r.integers(0, 30))), bool(f % 3 == 0), None if f % 5 == 0 else [f"g{f % 4}"]) for i in range(n)]
    rows = {f: chunks(f, 4) for f in range(20)}
    flat = lambda: [c for x in rows.values() for c in x]
    store = PostingStore(spark, str(tmp_path / "s"), 8, 4)
    store.ingest(spark.createDataFrame(flat(), CHUNK), ("run", 0))
    same_search(spark, store, flat(), "green the rare")
    same_search(spark, store, flat(), "the blue Ünï green", ("u", ["g1"]))
    old, before = store.view(), flat()
    # A batch that dies before its last commit is not seen, also when another comes instead of it.
    lost = store.chunks.replace
    monkeypatch.setattr(store.chunks, "replace", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.ingest(spark.createDataFrame(chunks(2, 3), CHUNK), ("lost", 0))
    monkeypatch.setattr(store.chunks, "replace", lost)
    rows |= {1: chunks(1, 2), 30: chunks(30, 3)}
    del rows[4]
    for _ in range(2):
        store.ingest(spark.createDataFrame(rows[1] + rows[30], CHUNK), ("run", 1), spark.createDataFrame([("f4",), ("none",)], "file string"))
    same_search(spark, store, flat(), "green the rare")
    same_search(spark, store, flat(), "red x1", ("u", []))
    assert sorted(x.key for x in store.scores("the", old).collect()) == sorted(c[1] for c in before if "the" in c[2].split())
    store.compact(("tidy", 0))
    assert store.view().dead is None
    same_search(spark, store, flat(), "green the rare", ("u", ["g1", "g2"]))
    assert store.scores("nowhere").collect() == [] == store.top("...", 3).collect()


def test_a_search_opens_its_terms_buckets_and_skips_slices(spark, tmp_path, monkeypatch):
    from quillspark.storage import postings

    monkeypatch.setattr(postings, "SLICE", 16)
    rows = [(f"f{i}", f"k{i:04d}", "common " * 5 + f"filler{i % 50} " * (i % 7) + ("needle " * 6 if i in (40, 300) else ""), True, None) for i in range(400)]
    store = PostingStore(spark, str(tmp_path / "s"), 32, 4)
    store.ingest(spark.createDataFrame(rows, CHUNK), ("run", 0))
    view = store.view()
    blocks = store.blocks(["needle"], view)
    assert len(blocks.inputFiles()) <= 2 < len(store.postings.paths()) / 8
    terms = ["common", "needle"]
    stats = store.statistics(terms, view)
    top = store.top("common needle", 2, view).collect()
    assert [x.key for x in top] == ["k0040", "k0300"] or [x.key for x in top] == ["k0300", "k0040"]
    bounds = [x["bound"] for x in store.bounds(terms, stats, view).collect()]
    assert len(bounds) > 10 and sum(b >= top[-1].score for b in bounds) <= 2


def test_a_posting_takes_no_room_for_its_key(spark, tmp_path, monkeypatch):
    from quillspark.storage import postings

    monkeypatch.setattr(postings, "SLICE", 64)
    monkeypatch.setattr(postings, "LOT", 300)
    size = {}
    for long in (False, True):
        name = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 4 if long else f"k{i:03d}"  # noqa: B023, E731
        rows = [(name(i), name(i), " ".join(f"w{(i * 7 + j * j) % 31}" for j in range(i % 40)), True, None) for i in range(300)]
        store = PostingStore(spark, str(tmp_path / f"s{long}"), 4, 4)
        store.ingest(spark.createDataFrame(rows, CHUNK).coalesce(1), ("run", 0))
        size[long] = sum(f.bytes for f in store.postings.state().files.values())
        same_search(spark, store, rows, "w3 w4 w9")
    assert size[True] <= 1.05 * size[False]


def test_rollups_count_late_and_repeated_facts_once(spark, tmp_path):
    from quillspark.storage.rollups import Rollup, Rollups

    schema = "id long, day int, model string, tokens long"
    rng = np.random.default_rng(2)
    facts = [(i, int(rng.integers(1, 6)), None if i % 7 == 0 else f"m{i % 3}", None if i % 5 == 0 else int(rng.integers(0, 100))) for i in range(120)]
    (tmp_path / "in").mkdir()
    for n in range(3):
        rows = [f for f in facts if f[0] % 3 == n] + [facts[int(x)] for x in rng.integers(0, 120, 30)]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "day", "model", "tokens"), r))) for r in rows))
    out = Rollups(spark, str(tmp_path / "r"), schema, "id", (Rollup("daily", ("day", "model"), ("tokens",)),), 4)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(out.handle("ledger")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    want = {}
    for _, day, model, tokens in facts:
        a, b = want.get((day, model), (0, 0))
        want[day, model] = (a + (tokens or 0), b + 1)
    read = lambda: {(r.day, r.model): (r.tokens, r.facts) for r in out.read("daily").collect()}
    assert read() == want
    versions = out.tables["daily"].state().version
    out.add(spark.createDataFrame(facts[:10], schema), ("ledger", 2))  # a replayed batch
    assert read() == want and out.tables["daily"].state().version == versions
    out.facts.insert(spark.createDataFrame([(500, 1, "m0", 7)], schema), ["id"], ("late", 0))  # died between the two tables
    out.add(spark.createDataFrame([(500, 1, "m0", 7)], schema), ("late", 0))
    assert read()[1, "m0"] == (want[1, "m0"][0] + 7, want[1, "m0"][1] + 1)


def test_publication_repairs_every_interruption(spark, tmp_path):
    from quillspark.storage.publication import EDGES, STEPS, Publication

    edge = lambda a, d, v: (a, d, v, "s", "DEPENDS_ON", "o", "Asserted")
    rows = lambda xs: spark.createDataFrame(xs, EDGES)
    p = Publication(spark, str(tmp_path / "p"), 4)
    served = lambda: sorted((r.assertion_id, r.document_version) for r in p.served().collect())
    p.publish(rows([edge("a1", "d1", "r1"), edge("a2", "d1", "r1"), edge("z", "d2", "r1")]), "one")
    old, other = [("a1", "r1"), ("a2", "r1")], [("z", "r1")]
    assert served() == old + other
    for i, step in enumerate(STEPS):
        new = [(f"b{i}", f"n{i}"), (f"c{i}", f"n{i}")]
        p.publish(rows([edge(a, "d1", v) for a, v in new]), f"next{i}", until=step)
        assert served() == (sorted(other + new) if i >= 2 else sorted(old + other))  # never anything between
        for k in range(2):
            p.repair(f"repair{i}-{k}")
        assert served() == (sorted(other + new) if i >= 1 else sorted(old + other))
        state = {r.document_id: r for r in p.states.read().collect()}["d1"]
        assert state.pending_revision is None and state.superseded == [] and state.pending_manifest == [] and state.status == "Ready"
        old = new if i >= 1 else old
    left = {r.assertion_id: r.status for r in p.edges.read().collect()}
    assert left["a1"] == "Retracted" and "b0" not in left and left["b4"] == "Asserted"


def test_trigrams_search_what_the_plain_search_finds(spark, tmp_path):
    from quillspark.functions import text
    from quillspark.storage.trigrams import TrigramIndex, grams_of, required_runs

    assert required_runs(r"foo\.bar+baz") == ["foo.bar", "baz"] and required_runs("abc|def") == [] and required_runs("abcd?xyz") == ["abc", "xyz"]
    assert required_runs("(abc)*def[xyz]ghi") == ["def", "ghi"] and required_runs("ab{2}cdefg") == ["cdefg"] and required_runs(r"(?i)abc") == [] and required_runs(r"\bword\d+") == ["word"]
    assert grams_of(["LICe", "ab"]) == ["ice", "lic"] and grams_of(["İstanbul"]) == grams_of(["stanbul"])
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "straße", "x", "e-mail", "λόγος"]
    docs = [(i, "\n".join(" ".join(rng.choice(words, 5)) for _ in range(4)) + ("\nNeedle in line 7" if i % 40 == 3 else "")) for i in range(120)] + [(900, None), (901, ""), (902, "needle\0binary")]
    df = spark.createDataFrame(docs, "file long, text string")
    index = TrigramIndex(spark, str(tmp_path / "t"), buckets=4, text_buckets=8)
    index.build(df)
    for pattern, regex, ignore in (("needle", False, True), ("Needle", False, False), (r"need\w+ in line [0-9]", True, True), ("a beta", False, True), ("x", False, True), ("(alpha|beta) x", True, True), ("λόγος λόγος", False, True), ("STRASSE", False, True), ("nowhere", False, True)):
        want = text.grep(df, ["file"], "text", pattern, regex=regex, ignore_case=ignore)[0]
        got, searched = index.grep(pattern, regex, ignore)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], pattern
        if "need" in pattern.lower():
            assert searched.count() <= 4


def test_trigrams_are_gathered_in_bounded_lots(spark, tmp_path, monkeypatch):
    from quillspark.storage import trigrams

    monkeypatch.setattr(trigrams, "LOT", 500)
    rng = np.random.default_rng(6)
    docs = [(i, "\n".join("".join(rng.choice(list("abCé\u0130𝄞 "), int(rng.integers(0, 60)))) for _ in range(i % 9))) for i in range(90)]
    lots = list(trigrams._lots(iter([pa.RecordBatch.from_pylist([{"file": f, "text": t} for f, t in docs[i : i + 40]]) for i in range(0, 90, 40)])))
    assert len(lots) > 9 and all(len(x) == 1 or sum(map(len, x["text"].to_pylist())) <= 500 for x in lots)
    assert [f for x in lots for f in x["file"].to_pylist()] == list(range(90))
    index = trigrams.TrigramIndex(spark, str(tmp_path / "t"), buckets=4, text_buckets=2)
    index.build(spark.createDataFrame(docs, "file long, text string"))
    want = {(t.lower()[i : i + 3], f) for f, t in docs for i in range(len(t.lower()) - 2) if "\n" not in t.lower()[i : i + 3]}
    got = [tuple(r) for r in index.postings.read().select("gram", F.explode("files")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_cleaned_publication_keeps_what_is_served(spark, tmp_path):
    from quillspark.storage.publication import Publication

    p = Publication(spark, str(tmp_path / "p"), 2)
    e = spark.createDataFrame([(f"a{i}", f"d{i % 3}", "r1", "s", "DEPENDS_ON", "o", "Asserted") for i in range(9)], "assertion_id string, document_id string, document_version string, subject_id string, predicate string, object_id string, status string")
    p.publish(e, "first")
    p.publish(e.filter("document_id = 'd1'").withColumns({"document_version": F.lit("r2"), "assertion_id": F.concat(F.lit("b"), "assertion_id")}), "second", until="edges")
    assert p.clean(1, 0) > 0
    for t in (p.states, p.edges):
        assert {f for f, _, _ in files.data_files(spark, f"{t.folder}/data")} == set(t.state().files)
    p.repair("repair")
    p.clean(1, 0)
    assert sorted(r.assertion_id for r in p.served().collect()) == sorted([f"a{i}" for i in range(9) if i % 3 != 1] + [f"ba{i}" for i in (1, 4, 7)])
