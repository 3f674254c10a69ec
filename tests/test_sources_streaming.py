import io
import json
import os
import time
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import feed, files, office
from quillspark.storage.log import LogTable
from quillspark.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def docx():
    p = lambda t, pr="", r="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:rPr>{r}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("plain") + p("strong", r="<w:b/>") + p("item", '<w:numPr><w:ilvl w:val="1"/></w:numPr>')
    body += f"<w:tbl><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda t, x, y: f'<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="50"/><a:ext cx="10" cy="10"/><a:chOff x="0" y="0"/><a:chExt cx="10" cy="10"/></a:xfrm></p:grpSpPr>{sp("grouped", 5, 0)}</p:grpSp>'
    title = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:txBody></p:sp>'
    tree = lambda x: f"<p:sld {ns}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    layout = tree('<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="-5"/></a:xfrm></p:spPr></p:sp>')
    return packed({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": tree(sp("low", 0, 100) + sp("right", 9, 10) + sp("left", 1, 10) + group + title),
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="../slideLayouts/slideLayout1.xml"/></Relationships>',
        "ppt/slideLayouts/slideLayout1.xml": layout,
    })


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t></is></c>', '<c r="A2"><v>1.5</v></c><c r="B2" s="1"><v>45000</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><f>A2*2</f><v>3</v></c>'
    return packed({
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>sha</t><t>red</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1">{cells[0]}</row><row r="2">{cells[1]}</row></sheetData></worksheet>',
    })


def test_office_files(spark, tmp_path):
    for name, data in (("a.docx", docx()), ("b.pptx", pptx()), ("c.xlsx", xlsx()), ("d.txt", b"text"), ("e.pdf", b"%PDF"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-6:]: r for r in office.read_documents(raw).collect()}
    assert got["a.docx"].markdown == "# Title\n\nplain\n\n**strong**\n\n  - item\n\n| a\\|b | c |\n| --- | --- |\n| d |  |"
    assert got["b.pptx"].markdown == "# Head\n\nleft\n\nright\n\ngrouped\n\nlow"
    assert "| sha" in got["c.xlsx"].markdown and "## A1:E2" in got["c.xlsx"].markdown
    assert got["/d.txt"].markdown == "text" and "4 bytes" in got["/e.pdf"].markdown and got["f.docx"].error
    cells = {(r.row, r.column): (r.value, r.formula) for r in office.read_cells(raw).collect()}
    assert cells == {(1, 1): ("shared", None), (1, 2): ("in", None), (2, 1): ("1.5", None), (2, 2): ("2023-03-15", None), (2, 4): ("TRUE", None), (2, 5): ("3", "A2*2")}
    assert office.serial_date(59) == "1900-02-28" and office.serial_date(60) == "1900-02-29" and office.serial_date(61) == "1900-03-01" and office.serial_date(0, True) == "1904-01-01"


def test_archives_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.zip").write_bytes(packed({"a/b.txt": "hi", "../evil": "no"}))
    found, more = files.listing(spark, str(tmp_path), "*.zip")
    assert found.count() == 1 and not more
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {r.entry: (bytes(r.content) if r.content else None, r.error) for r in files.unzipped(raw).collect()}
    assert got == {"a/b.txt": (b"hi", None), "../evil": (None, "leaves the folder")}
    z = files.zipped(spark.createDataFrame([("k", "b", b"2"), ("k", "a", b"1")], "id string, entry string, content binary"), "id").first()
    assert zipfile.ZipFile(io.BytesIO(z.archive)).namelist() == ["a", "b"]


def test_outline(spark):
    md = "intro\n# One\ntext\n## Sub ##\n```\n# no\n```\n# Two\nend"
    got = files.outline(spark.createDataFrame([(1, md)], "id long, t string"), "id", "t").orderBy("line").collect()
    assert [(r.line, r.level, r.title, r.end_line) for r in got] == [(2, 1, "One", 7), (4, 2, "Sub", 7), (8, 1, "Two", 9)]


FILES = "drive_id string, item_id string, name string, etag string, index_fingerprint string"


def test_delta_stream(spark, tmp_path):
    pages, table, checkpoint = tmp_path / "pages", tmp_path / "files", tmp_path / "cp"
    pages.mkdir()
    page = lambda n, rows: (pages / f"{n:05d}.json").write_text("\n".join(json.dumps({"drive_id": "d", **r}) for r in rows))
    page(0, [{"item_id": "1", "name": "a.txt", "etag": "e1"}, {"item_id": "2", "name": "b.exe"}, {"item_id": "3", "name": "folder", "is_file": False}])
    page(1, [{"item_id": "1", "name": "a.txt", "etag": "e2"}, {"item_id": "4", "name": "c.txt", "etag": "x"}])
    assert feed.feed_table(spark, str(pages)).count() == 5
    run = lambda: ingest.delta_pass(feed.feed_stream(spark, str(pages)), str(checkpoint), ingest.index_batch(LogTable(spark, str(table), FILES, 4, ("drive_id", "item_id")), ["txt"], "fp"))

    def settle():
        q = run()
        q.processAllAvailable() if q.isActive else None
        q.awaitTermination(60)
        return {r.item_id: r.etag for r in LogTable(spark, str(table), FILES).read().collect()}

    assert settle() == {"1": "e2", "4": "x"}
    page(2, [{"item_id": "4", "is_deleted": True}])
    assert settle() == {"1": "e2"}


def test_expired_token_starts_a_full_walk(spark, tmp_path):
    pages, table = tmp_path / "pages", tmp_path / "files"
    pages.mkdir()
    page = lambda n, rows: (pages / f"{n:05d}.json").write_text("\n".join(json.dumps({"drive_id": "d", **r}) for r in rows))
    page(0, [{"item_id": "old", "name": "a.txt"}])
    page(1, [{"expired": True}])
    page(2, [{"item_id": "new", "name": "b.txt"}])
    resets = []
    start = lambda cp, after: ingest.delta_pass(feed.feed_stream(spark, str(pages), after), cp, ingest.index_batch(LogTable(spark, str(table), FILES, 4, ("drive_id", "item_id")), ["txt"], "fp"))
    assert ingest.with_restart(start, str(tmp_path / "cp"), resets.append) == 2 and resets == [1]
    assert [r.item_id for r in LogTable(spark, str(table), FILES).read().collect()] == ["new"]


def test_signals_are_consumed_once(spark, tmp_path):
    topic, calls = str(tmp_path / "topic"), []
    ingest.publish(spark.createDataFrame([("d1", "1"), ("d1", "2"), ("d9", "3"), (None, "4")], "drive_id string, sent_at string"), topic)
    for _ in range(2):  # the second run has nothing left
        ingest.consume(spark, topic, ["d1", "d2"], str(tmp_path / "cp"), str(tmp_path / "rejects"), lambda d, e: calls.append(d)).awaitTermination(60)
    assert calls == [["d1"]]
    assert sorted(r.sent_at for r in LogTable(spark, str(tmp_path / "rejects"), "drive_id string, sent_at string, reason string").read().collect()) == ["3", "4"]


def test_due_retries_and_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key": "a", "outcome": "transient"}\n{"key": "b", "outcome": "permanent"}\n')
    src = spark.readStream.schema("key string, outcome string").json(str(tmp_path / "in"))
    actions = ingest.Retry(base_s=0.2).stateful(src)
    q = actions.writeStream.foreachBatch(ingest.settle_actions(str(tmp_path / "dead"), str(tmp_path / "queue"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    queued = lambda: [(r.key, r.attempt) for r in spark.read.schema("key string, attempt int").json(str(tmp_path / "queue")).collect()] if (tmp_path / "queue").exists() else []
    try:
        until = time.time() + 60
        while time.time() < until and not queued():
            time.sleep(0.5)
    finally:
        q.stop()
    assert queued() == [("a", 2)]
    assert [(r.key, r.attempt) for r in LogTable(spark, str(tmp_path / "dead"), "key string, attempt int").read().collect()] == [("b", 1)]


def test_silent_workers_are_stale(spark, tmp_path):
    folder = tmp_path / "beats"
    q = ingest.beat(spark, "w0", str(folder), str(tmp_path / "cp0"), every_s=1)
    try:
        until = time.time() + 60
        while time.time() < until and not (folder.exists() and spark.read.schema("worker string, at string").json(str(folder)).count()):
            time.sleep(0.5)
    finally:
        q.stop()
    assert spark.read.json(str(folder)).first().worker == "w0"
    beats = tmp_path / "in"
    beats.mkdir()
    for n, rows in enumerate([[("w1", "2024-01-01 00:00:00"), ("w2", "2024-01-01 00:00:10")], [("w2", "2024-01-01 00:02:30")], [("w2", "2024-01-01 00:02:31")]]):
        (beats / f"{n}.json").write_text("\n".join(json.dumps({"worker": w, "at": t}) for w, t in rows))
        os.utime(beats / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("worker string, at timestamp").option("maxFilesPerTrigger", 1).json(str(beats))
    q = ingest.stale(stream).writeStream.format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [r.worker for r in spark.table("stale").collect()] == ["w1"]


def test_signals_and_retries(spark):
    n = spark.createDataFrame([("s1", "ok", 1), ("s1", "bad", 2), ("s9", "ok", 3)], "subscription_id string, client_state string, received_at long")
    s = spark.createDataFrame([("s1", "ok", "d")], "subscription_id string, client_state string, drive_id string")
    good, bad = ingest.signals(n, s)
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"client state", "unknown subscription"}
    r = ingest.Retry()
    assert r.decide(1, "transient") == ("retry", 15) and r.decide(8, "transient")[0] == "dead" and r.decide(1, "permanent")[0] == "dead" and r.decide(7, "transient") == ("retry", 960)


def test_retry_stream(spark, tmp_path):
    rows = [("a", "transient"), ("a", "ok"), ("b", "permanent")]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "key string, outcome string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, outcome string").json(str(tmp_path / "in"))
    q = ingest.Retry().stateful(src).writeStream.format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = spark.table("retries").orderBy("key", "attempt").collect()
    assert [(r.key, r.attempt, r.action) for r in got] == [("a", 1, "retry"), ("a", 2, "done"), ("b", 1, "dead")]


def test_once_per_question(spark):
    led = spark.createDataFrame([(1,)], "question_id long")
    fall = spark.createDataFrame([(1, 5), (2, 7)], "question_id long, tokens long")
    assert [r.question_id for r in ingest.once_per_question(led, fall).collect()] == [2]
    assert spark.range(1).select(ingest.inherited(F.lit(None), F.lit("p"))).first()[0] == "p"
