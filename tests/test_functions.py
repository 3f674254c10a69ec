import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, keys, text


@pytest.mark.parametrize("s,size,overlap,want", [
    ("alpha beta gamma delta", 11, 5, ["alpha beta", "beta gamma", "gamma delta"]),
    ("alpha beta gamma", 8, 0, ["alpha", "beta", "gamma"]),
    ("extraordinary word", 5, 4, ["extraordinary", "word"]),
    ("", 100, 10, []),
    (" \t\r\n", 100, 10, []),
    ("  ", 100, 10, []),
    (" hello\nworld ", 100, 10, ["hello world"]),
    (None, 100, 10, []),
    ("😀😀 b", 3, 0, ["😀😀", "b"]),
])
def test_chunks(s, size, overlap, want):
    assert chunking.split_text(s, size, overlap) == want


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (5, -1), (5, 5)])
def test_chunk_limits(size, overlap):
    with pytest.raises(ValueError):
        chunking.split_text("text", size, overlap)


def test_chunk_table_covers_all_words(spark):
    words = [f"w{i}" for i in range(500)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")
    rows = chunking.chunk_table(df, ["doc_id"], "text", 60, 20).orderBy("chunk_number").collect()
    seen = [w for r in rows for w in r.content.split()]
    assert set(seen) == set(words) and all(len(r.content) <= 60 for r in rows) and rows[0].chunk_number == 0


def test_keys(spark):
    df = spark.createDataFrame([("t1", "System", "name:crm", "d", "i?>", 'c:"{1}"', "fp"), ("t1", "System", "name:😀", "d", "i", " ", "fp")], "t string, k string, n string, d string, i string, c string, f string")
    c = F.col
    rows = df.select(
        keys.entity_id_column(c("t"), c("k"), c("n")).alias("e"),
        keys.chunk_key(c("d"), c("i"), F.lit(3)).alias("chunk"),
        keys.revision_id(c("c"), F.lit("etag"), c("f")).alias("rev"),
        keys.partition_bucket(c("t"), c("n"), 64).alias("b"),
        keys.document_parts(keys.document_id(c("d"), c("i"))).alias("p"),
        keys.is_content_hash(keys.content_hash(c("n"))).alias("h"),
        keys.access_scope(F.lit("ab+/==")).alias("scope"),
        keys.storage_safe(c("i")).alias("safe"),
    ).collect()
    assert [r.e for r in rows] == [keys.entity_id("t1", "System", "name:crm"), keys.entity_id("t1", "System", "name:😀")]
    assert rows[0].chunk == base64.urlsafe_b64encode(b"d:i?>:3").decode().rstrip("=")
    assert rows[0].rev == "rev:" + keys.id_hash('c:"{1}"', "fp") and rows[1].rev == "rev:" + keys.id_hash("etag", "fp")
    assert rows[0].b == f"t1|{int.from_bytes(hashlib.sha256(b'name:crm').digest()[:4], 'little') % 64:04d}"
    assert rows[0].p == ("d", "i?>") and rows[0].h and rows[0].scope == "perm:ab-_"
    assert [r.safe for r in rows] == [False, True]


def test_normal_forms(spark):
    assert keys.normal_name("  Ｃ＃  Café\n") == "c# café"
    assert keys.normal_name("ΑΣ") == "ας" or keys.normal_name("ΑΣ") == "ασ"
    assert keys.normal_predicate("depends-on the") == "DEPENDS_ON_THE"
    assert keys.fold("“Don’t” – stop") == "\"don't\" - stop"
    df = spark.createDataFrame([("  A  B ",), (None,)], "x string").select(keys.normalize_name(F.col("x")).alias("n"), keys.name_key(F.col("x")).alias("k"))
    assert [tuple(r) for r in df.collect()] == [("a b", "name:a b"), (None, None)]


def test_symmetric_assertions_have_one_id(spark):
    a = ("t", "doc", "r1", "c1")
    assert keys.assertion_id(*a, "x", "P", "y", True) == keys.assertion_id(*a, "y", "P", "x", True) != keys.assertion_id(*a, "y", "P", "x")
    row = spark.range(1).select(keys.assertion_id_column(*map(F.lit, a), F.lit("y"), F.lit("P"), F.lit("x"), F.lit(True)).alias("i")).first()
    assert row.i == keys.assertion_id(*a, "x", "P", "y", True)


def test_permission_hash_ignores_order(spark):
    h = lambda p: spark.range(1).select(keys.permissions_hash(F.lit(True), F.array(*map(F.lit, p)), F.array(F.lit("read")))).first()[0]
    assert h(["a", "b"]) == h(["b", "a"]) == base64.b64encode(hashlib.sha256(b"1\na\nb\n\nread").digest()).decode()


def test_client_state(spark):
    good = keys.client_state("main", "s3cret")
    df = spark.createDataFrame([(good,), (good[:-1] + "x",), ("spas1.",), (None,)], "s string").select(keys.verify_client_state(F.col("s"), "s3cret"))
    assert [r[0] for r in df.collect()] == [True, False, False, False]


def test_phrases():
    p = text.phrase_list("Does Phoenix depend on the CRM?")
    assert p[:2] == ["phoenix", "crm"] and "the crm" in p and "depend" not in p and "on the" not in p
    assert text.phrase_list(None) == [] and len(text.phrase_list(" ".join(f"w{i}" for i in range(200)))) == 120


def test_lines_and_edits(spark):
    df = spark.createDataFrame([(1, "a\r\nb the c\nthe end"), (2, "x\0the")], "id long, t string")
    hits, more = text.grep(df, ["id"], "t", "THE")
    assert [(r.id, r.line_number) for r in hits.collect()] == [(1, 2), (1, 3)] and not more.first()[0]
    assert text.grep(df, ["id"], "t", "^the", regex=True)[0].count() == 1 and text.grep(df, ["id"], "t", "the", most=1)[1].first()[0]
    page = text.line_page(df, ["id"], "t", 2, 2).orderBy("id").first()
    assert (page.text, page.total_lines, page.next_line) == ("b the c", 3, 3)
    r = df.select(text.replace_text(F.col("t"), "the", "a").alias("r")).select("r.*").collect()
    assert [tuple(x) for x in r] == [(None, 2), ("x\0a", 1)]
    row = spark.range(1).select(text.sanitize(F.lit("x</Target_Text><b>")).alias("s"), text.markdown_table(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("d")))).alias("m"), text.retry_delay(F.lit(9), jitter=F.lit(1.0)).alias("d")).first()
    assert row.s == "x< /Target_Text><b>" and row.m == "| a\\|b | c |\n| --- | --- |\n| d |  |" and row.d == 1800
    w = text.safety_windows(df, ["id"], "t", 5).filter("id = 1").orderBy("window").collect()
    assert "".join(x.content for x in w) == "a\r\nb the c\nthe end"


@pytest.mark.parametrize("name,at", [("A1", (1, 1)), ("Z9", (9, 26)), ("AA10", (10, 27)), ("XFD1048576", (1048576, 16384)), ("$B$2", (2, 2))])
def test_cells(name, at):
    assert text.cell_reference(name) == at and text.cell_name(*at) == name.replace("$", "")


@pytest.mark.parametrize("bad", ["", "1A", "XFE1", "A1048577", "A0"])
def test_bad_cells(bad):
    with pytest.raises(ValueError):
        text.cell_reference(bad)
