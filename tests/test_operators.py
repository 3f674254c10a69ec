import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import keys, text
from quillspark.operators import access, conversations, graph, index, indexing, retrieval, snapshot, state, usage

EDGE = "assertion_id string, subject_id string, predicate string, object_id string, status string, document_id string, document_version string"


def edges(spark, rows):
    return spark.createDataFrame([(a, s, p, o, "Active", "d", "r1") for a, s, p, o in rows], EDGE)


@pytest.fixture
def states(spark):
    return spark.createDataFrame([("d", "Ready", "r1")], "document_id string, status string, active_revision string")


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([(x, None) for x in "ABCDE"], "entity_id string, redirect_to string")


def ends(t):
    return {(f, x) for _, _, f, x in t.edges}


def test_chain_stops_at_depth(spark, states, nodes):
    e = edges(spark, [("1", "A", "DEPENDS_ON", "B"), ("2", "B", "DEPENDS_ON", "C"), ("3", "C", "DEPENDS_ON", "D")])
    t = graph.traverse(e, states, nodes, ["A"], ["DEPENDS_ON"], "out", 2)
    assert ends(t) == {("A", "B"), ("B", "C")} and t.truncated is None and t.visited == 3
    assert ends(graph.traverse(e, states, nodes, ["C"], ["DEPENDS_ON"], "in", 1)) == {("C", "B")}


def test_star_is_capped(spark, states, nodes):
    e = edges(spark, [(str(i), "A", "DEPENDS_ON", x) for i, x in enumerate("BCDE")])
    t = graph.traverse(e, states, nodes, ["A"], ["DEPENDS_ON"], "out", 2, 3, 200)
    assert t.truncated == "entities" and [x for *_, x in t.edges] == ["B", "C"]
    t = graph.traverse(e, states, nodes, ["A"], ["DEPENDS_ON"], "out", 2, 50, 2)
    assert t.truncated == "assertions" and len(t.edges) == 2


def test_cycle_symmetry_and_merges(spark, states, nodes):
    e = edges(spark, [("1", "A", "DEPENDS_ON", "B"), ("2", "B", "DEPENDS_ON", "A"), ("3", "C", "INTEGRATES_WITH", "A")])
    assert len(graph.traverse(e, states, nodes, ["A"], ["DEPENDS_ON"], "out", 3).edges) == 2
    assert ends(graph.traverse(e, states, nodes, ["A"], ["INTEGRATES_WITH"], "out", 1)) == {("A", "C")}
    merged = spark.createDataFrame([("A", None), ("X", "A"), ("B", None)], "entity_id string, redirect_to string")
    e = edges(spark, [("1", "X", "DEPENDS_ON", "B"), ("2", "A", "DEPENDS_ON", "X")])
    assert ends(graph.traverse(e, states, merged, ["X"], ["DEPENDS_ON"], "out", 1)) == {("A", "B")}
    with pytest.raises(ValueError):
        graph.traverse(e, states, merged, ["A"], ["DEPENDS_ON"], max_depth=4)
    assert graph.traverse(e, states.limit(0), merged, ["A"], ["DEPENDS_ON"]).edges == []


def test_verification_reasons(spark):
    import hashlib

    h = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    rows = [("ok", "t", "d1", "r1", "c1", h("x"), 0), ("tenant", "u", "d1", "r1", "c1", h("x"), 1), ("rev", "t", "d1", "r0", "c1", h("x"), 2), ("acl", "t", "d1", "r1", "c9", h("x"), 3), ("hash", "t", "d1", "r1", "c1", h("y"), 4), ("doc", "t", "d2", "r1", "c1", h("x"), 5), ("late", "t", "d3", "r1", "c1", h("x"), 6)]
    e = spark.createDataFrame(rows, "assertion_id string, tenant string, document_id string, document_version string, chunk_id string, chunk_hash string, position int")
    rev = spark.createDataFrame([("d1", "r1"), ("d2", "r1"), ("d3", "r1")], "document_id string, revision string")
    chunks = spark.createDataFrame([("c1", "d1", "x")], "chunk_id string, document_id string, content string")
    got = {r.assertion_id: r.reason for r in graph.verify(e, rev, chunks, "t", 2).collect()}
    assert got == {"ok": None, "tenant": "tenant", "rev": "revision", "acl": "unauthorized", "hash": "content", "doc": "content", "late": "budget"}


def test_reachability_needs_authorized_paths(spark):
    e = spark.createDataFrame([("2", 2, "B", "C"), ("3", 3, "X", "Y")], "assertion_id string, depth int, from_id string, to_id string")
    start = spark.createDataFrame([("A",)], "id string")
    assert graph.reachable(e, start).count() == 0
    e = e.unionByName(spark.createDataFrame([("1", 1, "A", "B")], e.schema))
    assert [r.assertion_id for r in graph.reachable(e, start).collect()] == ["1", "2"]


def test_linking_and_resolution(spark):
    """Random names over three types: links and decisions against plain dictionaries."""
    rng = random.Random(11)
    types, names = ["System", "Team", "Policy"], [f"name{i}" for i in range(30)]
    rows = sorted({(rng.choice(types), rng.choice(names), f"x:{rng.randrange(40)}") for _ in range(60)})
    moves = {f"x:{i}": f"x:{i + 100}" for i in range(0, 40, 9)}
    aliases = spark.createDataFrame(rows, "entity_type string, alias string, entity_id string")
    by_name, by_type = {}, {}
    for t, n, e in rows:
        by_name.setdefault(n, set()).add(e)
        by_type.setdefault((t, n), set()).add(moves.get(e, e))
    got = {r.phrase: (r.entity_id, r.ambiguous) for r in graph.link_phrases(spark.createDataFrame([(n,) for n in [*names, "absent"]], "phrase string"), aliases).collect()}
    assert got == {n: (next(iter(e)), False) if len(e) == 1 else (None, True) for n, e in by_name.items()}
    mentions = [(i, rng.choice(types), rng.choice(names), None) for i in range(80)] + [(90, "Team", "fresh", "x:7"), (91, "Team", "fresh", None)]
    entities = spark.createDataFrame([(a, b) for a, b in moves.items()], "entity_id string, redirect_to string")
    decided = {r.mention_id: (r.decision, r.entity_id) for r in graph.resolve(spark.createDataFrame(mentions, "mention_id long, entity_type string, alias string, identifier_entity string"), aliases, entities).collect()}
    for i, t, n, known in mentions[:80]:
        found = by_type.get((t, n), set())
        assert decided[i] == (("new", None) if not found else ("alias", next(iter(found))) if len(found) == 1 else ("ambiguous", None))
    assert decided[90] == ("identifier", "x:7") and decided[91] == ("alias", "x:7")


def test_graph_states(spark):
    assert graph.DEFAULT.errors() == []
    bad = graph.Ontology("x", ("A", "A"), (graph.Relation("lower", ("A",), ("B",), symmetric=True, antisymmetric=True),))
    assert len(bad.errors()) >= 4
    e = edges(spark, [("1", "A", "SUPERSEDES", "B"), ("2", "B", "SUPERSEDES", "A"), ("3", "A", "SUPERSEDES", "C")])
    assert {r.assertion_id: r.status for r in graph.mark_contradictions(e).collect()} == {"1": "Disputed", "2": "Disputed", "3": "Active"}
    new, gone = graph.apply_snapshot(e, e.filter("assertion_id < '3'"), e.filter("assertion_id = '2'"))
    assert [r[0] for r in gone.collect()] == ["1"] and {r.assertion_id: r.status for r in new.collect()} == {"1": "Retracted", "2": "Active", "3": "Active"}
    merged = graph.merge_entity(spark.createDataFrame([("e", "Old", ["a", "b"])], "entity_id string, canonical_name string, aliases array<string>"), spark.createDataFrame([("e", "New", ["b", "c"]), ("f", "F", ["f"])], "entity_id string, canonical_name string, aliases array<string>"))
    assert {r.entity_id: (r.canonical_name, r.aliases) for r in merged.collect()} == {"e": ("Old", ["a", "b", "c"]), "f": ("F", ["f"])}


def test_evaluation(spark):
    rng = random.Random(12)
    some = lambda: [f"c{rng.randrange(12)}" for _ in range(rng.randrange(7))]
    cases = {f"case {i}": some() for i in range(25)}
    runs = {q: (some(), float(rng.randrange(50, 900))) for q in list(cases)[:21]}  # four were never run
    recall, precision, times = [], [], sorted(t for _, t in runs.values())
    for q, want in cases.items():
        want, got = set(want), set(runs.get(q, ([], 0))[0])
        recall.append(len(want & got) / len(want) if want else 1.0)
        precision.append(len(want & got) / len(got) if got else float(not want))
    nearest = lambda p: times[math.ceil(p * len(times)) - 1]
    row = retrieval.evaluation(spark.createDataFrame(list(cases.items()), "question string, expected array<string>"), spark.createDataFrame([(q, *r) for q, r in runs.items()], "question string, retrieved array<string>, latency_ms double")).first()
    mean = lambda x: sum(x) / len(x)
    assert tuple(row) == pytest.approx((mean(recall), mean(precision), mean([r >= 1 for r in recall]), nearest(0.5), nearest(0.95)))


def test_budget_is_greedy(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [5, 9, 4, 1])], "i array<string>, s array<int>")
    assert df.select(retrieval.within_budget(F.col("i"), F.col("s"), 3, 10)).first()[0] == ["a", "c", "d"]


def test_permission_filter(spark):
    df = spark.createDataFrame([(1, True, []), (2, False, ["g1"]), (3, False, ["g2"]), (4, None, None)], "id long, anon boolean, allowed array<string>")
    ids = lambda u, p: [r.id for r in df.filter(access.permission_filter(F.col("anon"), F.col("allowed"), u, p)).orderBy("id").collect()]
    assert ids(None, None) == [1, 2, 3, 4] and ids("u", []) == [1] and ids("u", ["g2"]) == [1, 3]


def test_usage_report(spark):
    rng = random.Random(13)
    people = {f"id{i}": (f"Given{i} Family{i % 3}", f"given{i}@mail{i % 2}.test") for i in range(6)}
    rows = [(rng.choice([20240228, 20240229, 20240301, 20240302]), rng.choice([*people, None]), rng.choice([None, rng.randrange(1, 400)]), rng.randrange(10**6), rng.choice([None, rng.random() * 60])) for _ in range(200)]
    led = spark.createDataFrame(rows, "day int, user_id string, total_tokens long, audio_bytes long, duration_seconds double")
    led = led.withColumns({"input_tokens": F.col("total_tokens"), "output_tokens": F.lit(0).cast("long")})
    users = spark.createDataFrame([(k, *v) for k, v in people.items()], "user_id string, name string, email string")
    period, mine = usage.day_range(led, 20240229, 20240301), [r for r in rows if r[0] in (20240229, 20240301)]
    r = period.agg(*usage.measures(), usage.total("audio_bytes").alias("b"), F.sum("duration_seconds").alias("d")).first()
    assert (r.calls, r.unknown_calls, r.total_tokens, r.b) == (len(mine), sum(x[2] is None for x in mine), sum(x[2] or 0 for x in mine), sum(x[3] for x in mine))
    assert r.d == pytest.approx(sum(x[4] or 0 for x in mine))
    for term in ("id3", "family1", "MAIL0", "given5@", "nobody"):
        who = {k for k, (n, m) in people.items() if k == term or term.lower() in n.lower() or term.lower() in m.lower()}
        assert usage.user_term(period, users, term).count() == sum(x[1] in who for x in mine)
    assert usage.user_term(period, users, None).count() == len(mine)
    for start, end in ((20240301, 20240229), (20230101, 20240201)):
        with pytest.raises(ValueError):
            usage.day_range(led, start, end)
    for skip, top in ((-3, 10), (0, 1000), (2, -1)):
        with pytest.raises(ValueError):
            usage.page_limits(skip, top)
    assert usage.token_summary(led.limit(0).withColumns({"question_id": F.lit(1), "model_id": F.lit("m")})).first().total_tokens == 0


def test_classification(spark):
    s = "drive_id string, item_id string, name string, parent_path string, web_url string, mime_type string, size long, last_modified timestamp, sensitivity_label string, etag string, ctag string, permissions_hash string"
    base = ("d", "i", "a.docx", "/p", "w", "m", 1, None, "l", "e", "c", "h")
    tracked = spark.createDataFrame([(*base, 3, "fp")], s + ", chunk_count int, index_fingerprint string")

    def action(deleted=False, is_file=True, fp="fp", **kw):
        row = [kw.get(c.split()[0], v) for c, v in zip(s.split(", "), base)]
        return indexing.classify(spark.createDataFrame([(*row, deleted, is_file)], s + ", is_deleted boolean, is_file boolean"), tracked, ["DOCX"], fp).first().action

    assert action() == "skip" and action(deleted=True) == "remove" and action(is_file=False) == "ignore" and action(name="a.exe") == "remove"
    assert action(name="b.docx") == "merge" and action(permissions_hash="x") == "merge"
    assert action(ctag="x") == action(etag="x") == action(fp="fp2") == action(item_id="new") == "reindex"


def test_merge_reports_missing_chunks(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    out, ok = indexing.merge_metadata(c, spark.createDataFrame([(2, None), (3, "z")], "id long, v string"), "id", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, None)] and not ok.first()[0]


def test_sections_and_status(spark):
    h = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 5, 3), (1, 7, 2), (1, 9, 1)], "doc_id long, line int, level int")
    t = spark.createDataFrame([(1, 12)], "doc_id long, total_lines int")
    assert {r.line: r.end_line for r in conversations.section_ends(h, t).collect()} == {1: 8, 3: 6, 5: 6, 7: 8, 9: 12}
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k long, o long, s string")
    assert [r.o for r in conversations.changed_only(rows, ["k"], ["o"], "s").orderBy("o").collect()] == [1, 3, 5]


HEAD = "document_id string, tenant string, document_version string, schema_version int, ontology_version string, extraction_version string"
ENTITY = "document_id string, position int, tenant string, entity_id string, entity_type string, canonical_name string, aliases array<string>, attributes map<string,string>"
EVIDENCE = "struct<tenant:string,document_id:string,document_version:string,chunk_id:string,chunk_content_hash:string,section:string,page:int,access_scope_ref:string>"
ASSERTION = f"document_id string, position int, tenant string, assertion_id string, subject_id string, predicate string, object_id string, status string, ontology_version string, extraction_version string, evidence {EVIDENCE}"
RESOLUTION = "document_id string, position int, local_ref string, entity_id string, method string, candidates array<string>"


def made(spark, cited=(), **kw):
    """A snapshot's one assertion, with some fields of it or of its evidence changed."""
    ev = {"tenant": "t", "document_id": "d:1", "document_version": "r1", "chunk_id": "c1", "chunk_content_hash": "sha256:" + "0" * 64, "section": None, "page": None, "access_scope_ref": "perm:x", **dict(cited)}
    row = {"document_id": "d:1", "position": 0, "tenant": "t", "subject_id": "system:1", "predicate": "DEPENDS_ON", "object_id": "system:2", "status": "Asserted", "ontology_version": "v1", "extraction_version": "x1", **kw}
    derived = spark.range(1).select(keys.assertion_id_column(*(F.lit(x) for x in (ev["tenant"], ev["document_id"], ev["document_version"], ev["chunk_id"], row["subject_id"], row["predicate"], row["object_id"])), F.lit(row["predicate"] == "INTEGRATES_WITH"))).first()[0]
    row = {"assertion_id": derived, "evidence": ev, **row}
    return tuple(row[c.split(" ")[0]] for c in ASSERTION.split(" struct<")[0].split(", "))


def test_assertion_and_resolution_rules(spark):
    e = lambda d: [(d, 0, "t", "system:1", "System", "One", [], {}), (d, 1, "t", "system:2", "System", "Two", [], {}), (d, 2, "t", "team:1", "Team", "T", [], {})]
    cases = {
        "": {}, "tenant.mismatch": {"tenant": "u"}, "assertion.status": {"status": "Retracted"}, "ontology.version": {"ontology_version": "v0"}, "extraction.version": {"extraction_version": "x0"},
        "assertion.entityReference": {"subject_id": "system:9"}, "predicate.unknown": {"predicate": "KNOWS"}, "assertion.relation": {"object_id": "team:1"}, "assertion.selfReference": {"object_id": "system:1"},
        "assertion.symmetricOrientation": {"predicate": "INTEGRATES_WITH", "subject_id": "system:2", "object_id": "system:1"}, "assertion.id": {"assertion_id": "assertion:1"}, "identifier.invalid": {"assertion_id": "other"},
        "required": {"evidence": None}, "evidence.document": {"ev": {"document_version": "r0"}}, "evidence.invalid": {"ev": {"page": 0}},
    }
    heads, entities, assertions = [], [], []
    for i, (code, kw) in enumerate(cases.items()):
        d = f"d:{i}"
        heads.append((d, "t", "r1", 1, "v1", "x1"))
        entities += e(d)
        kw = dict(kw)
        ev = {"document_id": d, **kw.pop("ev", {})}
        assertions.append(made(spark, ev, document_id=d, **kw))
    heads.append(("d:100", "t", "r1", 1, "v1", "x1"))
    entities += e("d:100")
    twice = made(spark, {"document_id": "d:100"}, document_id="d:100")
    assertions += [twice, (twice[0], 1, *twice[2:])]
    resolutions = [("d:100", 0, "r1", "system:1", "Alias", []), ("d:100", 1, "r1", "system:1", "New", []), ("d:100", 2, "r2", "none", "New", []), ("d:100", 3, "r3", "team:1", "Guess", ["a/b"])]
    frame = spark.createDataFrame
    got = snapshot.validate(frame(heads, HEAD), frame(entities, ENTITY), frame(assertions, ASSERTION), frame(resolutions, RESOLUTION)).collect()
    for i, code in enumerate(cases):
        assert {r.code for r in got if r.document_id == f"d:{i}"} == ({code} if code else set()), code
    last = sorted((r.code, r.path) for r in got if r.document_id == "d:100")
    assert last == [("id.duplicate", "assertions[1].assertionId"), ("resolution.invalid", "resolutions[1].localRef"), ("resolution.invalid", "resolutions[2].entityId"), ("resolution.invalid", "resolutions[3].candidateEntityIds"), ("resolution.invalid", "resolutions[3].method")]
    few = snapshot.validate(frame(heads, HEAD), frame(entities, ENTITY), frame(assertions, ASSERTION), frame(resolutions, RESOLUTION), limits=snapshot.Limits(entities=2, assertions=1, errors=3))
    assert {(r.code, r.path) for r in few.filter("document_id = 'd:0'").collect()} >= {("limit.exceeded", "entities")} and few.groupBy("document_id").count().agg(F.max("count")).first()[0] == 3


def test_grounding(spark):
    chunks = spark.createDataFrame([("c", "The Billing Core, also BC, needs the \u201cLedger Hub\u201d to post invoices daily. Vendor: Acme.")], "chunk_id string, content string")
    entities = spark.createDataFrame([
        ("c", 0, "a", "System", "billing core ", ["BC", "bc", "Billing CORE", "unseen"], {"vendor": "Acme", "colour": "Acme"}),
        ("c", 1, "b", "System", "Ledger Hub", [], {}), ("c", 2, "a", "System", "Ledger Hub", [], {}), ("c", 3, "x", "System", "Absent", [], {}),
        ("c", 4, "y", "Planet", "Acme", [], {}), ("c", 5, "z", "Team", "Acme", [], {}), ("c", 6, "bad ref", "Team", "Acme", [], {}),
    ], "chunk_id string, position int, ref string, type string, name string, aliases array<string>, attributes map<string,string>")
    quote = 'needs the "ledger hub" to'
    relations = spark.createDataFrame([("c", 0, "a", "depends on", "b", quote), ("c", 1, "a", "DEPENDS_ON", "b", quote), ("c", 2, "a", "DEPENDS_ON", "x", quote), ("c", 3, "b", "DEPENDS_ON", "a", "not in the text"), ("c", 4, "b", "DEPENDS_ON", "b", quote), ("c", 5, "z", "DEPENDS_ON", "a", quote)], "chunk_id string, position int, subject_ref string, predicate string, object_ref string, quote string")
    kept, related = snapshot.ground(chunks, entities, relations)
    assert {r.ref: (r.name, r.aliases, r.attributes) for r in kept.collect()} == {"a": ("billing core", ["BC"], {"vendor": "Acme"}), "b": ("Ledger Hub", [], {})}
    assert [(r.subject_ref, r.predicate, r.object_ref) for r in related.collect()] == [("a", "DEPENDS_ON", "b")]
    same = snapshot.extract(chunks, lambda c: (entities, relations))
    assert same[0].count() == 2 and snapshot.ground(chunks, entities, relations, most_entities=1)[1].count() == 0
    assert snapshot.plan_query("q", lambda q: (["one"], ["OWNED_BY"])) == (["one"], ["OWNED_BY"])
    with pytest.raises(ValueError):
        snapshot.plan_query("q", lambda q: (["one"], ["KNOWS"]))


def test_tombstones_come_first(spark):
    state_of = "tenant string, document_id string, status string, active_revision string, active_extraction_version string, pending_revision string, manifest array<string>, pending_manifest array<string>, updated_at string"
    states = spark.createDataFrame([("t", "d1", "Ready", "r1", "x", None, ["1", "2"], ["3"], "then"), ("t", "d2", "Ready", "r1", "x", None, ["4"], [], "then"), ("t", "d3", "Tombstoned", None, None, None, [], [], "then")], state_of)
    gone = snapshot.tombstone(states, spark.createDataFrame([("t", "d1"), ("t", "d3"), ("t", "d9")], "tenant string, document_id string"), F.lit("now"))
    rows = {r.document_id: r for r in gone.collect()}
    assert rows["d1"].status == "Tombstoned" and rows["d1"].active_revision is None and sorted(rows["d1"].pending_manifest) == ["1", "2", "3"] and rows["d1"].manifest == []
    assert rows["d2"].status == "Ready" and rows["d3"].updated_at == "then" and rows["d9"].pending_manifest == []
    edges_ = spark.createDataFrame([("1", "Active", None), ("3", "Retracted", "old"), ("4", "Active", None)], "assertion_id string, status string, retracted_at string")
    after, settled = snapshot.settle(edges_, gone, F.lit("now"))
    assert {r.assertion_id: (r.status, r.retracted_at) for r in after.collect()} == {"1": ("Retracted", "now"), "3": ("Retracted", "old"), "4": ("Active", None)}
    assert settled.filter("size(pending_manifest) > 0").count() == 0


def test_one_writer_wins(spark):
    t = spark.createDataFrame([("a", 1, "old"), ("b", 3, "old")], "id string, token long, value string")
    w = spark.createDataFrame([("a", 1, "late", 2), ("a", 1, "early", 1), ("b", 2, "stale", 1), ("c", None, "one", 1), ("c", None, "two", 2), ("a", None, "again", 1)], "id string, token long, value string, arrival int")
    after, lost = state.conditional_write(t, w, "id")
    assert sorted(map(tuple, after.collect())) == [("a", 2, "early"), ("b", 3, "old"), ("c", 1, "one")]
    assert sorted(r.id for r in lost.collect()) == ["a", "a", "b", "c"]
    patched, ok = indexing.merge_metadata(spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(1, "p", 1), (1, "q", 2)], "id long, v string, arrival int"), "id", ["v"])
    assert [tuple(r) for r in patched.collect()] == [(1, "q")] and ok.first()[0]


def test_groups_of_any_depth(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "n38"), ("n0", "m"), ("m", "n2")]  # a chain, a cycle at its end, a diamond
    got = access.transitive_groups(spark.createDataFrame(rows, "member string, group string")).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {r.group for r in got if r.member == "n0"} == {f"n{i}" for i in range(1, 41)} | {"m"}
    assert {r.group for r in got if r.member == "n39"} == {"n38", "n39", "n40"}


def test_folding_and_quotes(spark):
    import unicodedata

    t = "A \u201csmart\u201d  quote\u2014and \uff26\uff35\uff2c\uff2c width, caf\u00e9"
    df = spark.createDataFrame([(t, "SMART\" quote-and full"), (t, "not there at all"), (t, "short")], "t string, q string")
    got = [r[0] for r in df.select(text.grounded_quote(keys.fold_text(F.col("t")), keys.fold_text(F.col("q")))).collect()]
    assert got == [True, False, False] and unicodedata.normalize("NFKC", "\uff26") == "F"


def test_attachment_status_and_search(spark):
    cols = "upload_id string, status string, chunk_count int, tokens long, error string, updated_at string, indexed_at string"
    table = spark.createDataFrame([(u, "NotStarted", 0, None, "x", None, None) for u in ("u1", "u2", "u3", "u4")], cols)
    begun = index.begin_indexing(table, spark.createDataFrame([("u1",), ("u2",), ("u3",)], "upload_id string"), F.lit("t0"))
    assert {r.upload_id: (r.status, r.error) for r in begun.collect()} == {"u1": ("Indexing", None), "u2": ("Indexing", None), "u3": ("Indexing", None), "u4": ("NotStarted", "x")}
    conv = "upload_id string, name string, mime_type string, markdown string, error string, tokens long"
    done = spark.createDataFrame([("u1", "a.txt", "text/plain", "green apples and pears " * 20, None, 7), ("u2", "b.png", "image/png", " ", None, None), ("u3", "c.txt", "text/plain", "x", "broken " * 2000, None)], conv)
    old = index.attachment_chunks(done.limit(0)).unionByName(spark.createDataFrame([("k", "u1", "a.txt", "text/plain", 9, "stale")], "id string, upload_id string, name string, mime_type string, chunk_number int, content string"))
    after, chunks = index.finish_indexing(begun, old, done, F.lit("t1"), 100, 10)
    rows = {r.upload_id: r for r in after.collect()}
    assert rows["u1"].status == "Indexed" and rows["u1"].chunk_count == chunks.count() > 3 and rows["u1"].tokens == 7 and rows["u1"].indexed_at == "t1"
    assert rows["u2"].status == "Failed" and "b.png" in rows["u2"].error and len(rows["u3"].error) == 4000 and rows["u4"].status == "NotStarted"
    links = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u4")], "conversation_id long, upload_id string")
    found = index.search_attachments(chunks, links, after, 1, "green pears", 99)
    assert 0 < found.count() <= 10 and index.search_attachments(chunks, links, after, 2, "green").count() == 0 and index.search_attachments(chunks, links, after, 1, " ").count() == 0


@pytest.mark.parametrize("direction", ["out", "both"])
def test_many_questions_equal_one_by_one(spark, direction):
    """Random graphs with merges, cycles and symmetric edges, and budgets that cut: each question as if it were alone."""
    import random

    rng = random.Random(direction)
    name = lambda i: f"e{i:02d}"
    edges = [(f"a{i:03d}", name(rng.randrange(40)), rng.choice(["DEPENDS_ON", "INTEGRATES_WITH", "OWNED_BY"]), name(rng.randrange(40)), rng.choice(["Asserted"] * 5 + ["Retracted"]), f"d{rng.randrange(5)}", "r1") for i in range(110)]
    e = spark.createDataFrame(edges, "assertion_id string, subject_id string, predicate string, object_id string, status string, document_id string, document_version string").cache()
    states = spark.createDataFrame([(f"d{i}", "Ready" if i else "Failed", "r1") for i in range(5)], "document_id string, status string, active_revision string").cache()
    entities = spark.createDataFrame([(name(i), name(i - 1) if i in (7, 8, 20) else None) for i in range(40)], "entity_id string, redirect_to string").cache()
    questions = [(q, name(rng.randrange(40)), n) for q in range(5) for n in range(rng.choice([1, 1, 3]))]
    starts = spark.createDataFrame(questions, "question long, id string, n int")
    bounds = dict(direction=direction, max_depth=3, max_entities=9, max_assertions=12)
    found, status = graph.traverse_many(e, states, entities, starts, ["DEPENDS_ON", "INTEGRATES_WITH"], **bounds)
    rows, told = {}, {r.question: r for r in status.collect()}
    for r in found.collect():
        rows.setdefault(r.question, []).append((r.assertion_id, r.depth, r.from_id, r.to_id))
    ends = set()
    for q in range(5):
        one = graph.traverse(e, states, entities, [i for k, i, _ in questions if k == q], ["DEPENDS_ON", "INTEGRATES_WITH"], **bounds)
        assert sorted(rows.get(q, [])) == sorted(one.edges), q
        assert (told[q].visited, told[q].assertions, told[q].truncated) == (one.visited, len(one.edges), one.truncated)
        ends.add(one.truncated)
    assert ends - {None}


def test_authorized_paths_equal_a_fixpoint(spark):
    import random

    rng = random.Random(8)
    edges = [(q, f"a{i:02d}", rng.randint(1, 3), f"e{rng.randrange(15)}", f"e{rng.randrange(15)}") for q in range(4) for i in range(14)]
    edges += [(9, f"c{i}", 3 - i % 3, f"n{i}", f"n{i + 1}") for i in range(6)]  # a way longer than any depth
    starts = [(q, f"e{q}") for q in range(4)] + [(9, "n0")]
    got = graph.reachable(spark.createDataFrame(edges, "question long, assertion_id string, depth int, from_id string, to_id string"), spark.createDataFrame(starts, "question long, id string")).collect()
    want = set()
    for q, s in starts:
        known, grown = {s}, True
        while grown:
            more = {e[4] for e in edges if e[0] == q and e[3] in known} - known
            known |= more
            grown = bool(more)
        want |= {(q, e[1]) for e in edges if e[0] == q and e[3] in known}
    assert {(r.question, r.assertion_id) for r in got} == want
    assert [(r.question, r.depth, r.assertion_id) for r in got] == sorted((r.question, r.depth, r.assertion_id) for r in got)


def test_state_functions(spark):
    assert keys.extraction_version("p", "m", "o").startswith("p.o.") and keys.extraction_version("p", "m", "o") != keys.extraction_version("p", "n", "o")
    df = spark.createDataFrame([(" depends  on ", "c", "e", "fp")], "p string, c string, e string, f string")
    r = df.select(keys.normalize_predicate(F.col("p")).alias("p"), state.alias_key(F.lit("t"), F.lit("System"), F.lit("a"), F.lit("e")).alias("k")).first()
    assert r.p == "DEPENDS_ON" and len(r.k) == 32
    assert "DEPENDS_ON" in state.instructions() and "symmetric" in state.instructions()
    e = spark.createDataFrame([("c1", 1, "a1"), ("c2", 1, "a2"), ("c3", 2, "a3")], "chunk_id string, depth int, assertion_id string")
    c = spark.createDataFrame([("c1", "x" * 10), ("c2", "x" * 50), ("c3", "x" * 5)], "chunk_id string, content string")
    assert state.assemble(e, c, spark.createDataFrame([("c9",)], "chunk_id string"), 5, 20).first()[0] == ["c1", "c3"]
    with pytest.raises(ValueError):
        retrieval.validate(" ", 10, 0)


def shuffled(df):
    """Names of the columns that each exchange of a plan carries."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo, out = [df.withColumn("__plan", F.lit(1))._jdf.queryExecution().executedPlan()], []
        while todo:
            p = todo.pop()
            if p.nodeName() == "Exchange":
                out.append([p.output().apply(i).name() for i in range(p.output().size())])
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return out
    finally:
        conf.unset("spark.sql.adaptive.enabled")
        conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_validation_shuffles_no_evidence(spark, sf):
    from quillspark.plans import checks

    exchanges = shuffled(snapshot.validate(*checks._cited(spark, sf)))
    assert len(exchanges) > 4 and not any("evidence" in names for names in exchanges)


def test_assertions_meet_their_decisions_by_the_chunk(spark, sf):
    from quillspark.plans import graphs, queries

    assert graphs  # registers its queries
    exchanges = shuffled(queries.QUERIES["g13_assertion_build"](spark, sf))
    assert sum("subject_ref" in names for names in exchanges) == 1, exchanges


def test_the_first_row_in_the_files_counts(spark, tmp_path):
    from quillspark.plans import tables

    path = str(tmp_path / "rows")
    row = lambda k, v: {"k": k % 50, "v": v}
    for n, rows in enumerate(([row(i, -i) for i in range(100)], [row(i, i) for i in range(5000)])):
        spark.createDataFrame(rows, "k long, v long").coalesce(1).write.parquet(f"{path}/{n}")
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert sorted(map(tuple, tables.first_rows(df, ["k"], "v").collect())) == [(k, -k) for k in range(50)]
    one = spark.read.parquet(f"{path}/1")
    assert sorted(map(tuple, tables.first_rows(one, ["k"], "v").collect())) == [(k, k) for k in range(50)]
