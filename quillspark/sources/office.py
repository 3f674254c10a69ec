"""Readers of office files: Word, PowerPoint and Excel packages, with the standard library only.

Each parser takes bytes and gives plain rows; the Spark side runs them over ``binaryFile`` frames in
Arrow batches.  A file that can't be read gives a row with ``error``, never an exception.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_name, cell_reference

#: Limits of what is opened.
MAX_INPUT, MAX_EXPANDED, MAX_ENTRIES, MAX_CELLS = 50 << 20, 200 << 20, 10_000, 1_000_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class Package:
    """An office file's parts, within limits."""

    def __init__(self, data: bytes):
        if len(data) > MAX_INPUT:
            raise ValueError("the file is too large")
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        entries = self.zip.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED:
            raise ValueError("the package is too large")
        self.names = {e.filename for e in entries}

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise ValueError("document types are refused")
        return ElementTree.fromstring(data)

    def related(self, name: str) -> dict[str, str]:
        """Relationship id to part name."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        return {} if root is None else {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in root.iter(f"{_REL}Relationship") if r.get("TargetMode") != "External"}


def markdown_rows(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    clean = lambda c: " ".join((c or "").replace("|", "\\|").splitlines()).strip()
    line = lambda r: "| " + " | ".join([*map(clean, r), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if width else ""


def _on(properties: ElementTree.Element | None, tag: str) -> bool:
    e = None if properties is None else properties.find(f"{_W}{tag}")
    return e is not None and e.get(f"{_W}val", "1") not in ("0", "false", "none")


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for r in p.iter(f"{_W}r"):
        t = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in r)
        bold = _on(r.find(f"{_W}rPr"), "b") and t.strip()
        if bold and out and out[-1].endswith("**"):
            out[-1] = out[-1][:-2] + t + "**"
        else:
            out.append(f"**{t}**" if bold else t)
    return "".join(out)


def docx_markdown(data: bytes) -> str:
    """Body in order: headings, bold runs, list items and tables."""
    package = Package(data)
    body = package.xml("word/document.xml").find(f"{_W}body")
    styles, levels = package.xml("word/styles.xml"), {}
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        outline, name = s.find(f".//{_W}outlineLvl"), s.find(f"{_W}name")
        label = (name.get(f"{_W}val") if name is not None else "").lower()
        if outline is not None:
            levels[s.get(f"{_W}styleId")] = int(outline.get(f"{_W}val")) + 1
        elif label.startswith("heading ") and label[8:].isdigit():
            levels[s.get(f"{_W}styleId")] = int(label[8:])
    blocks = []
    for e in body:
        if e.tag == f"{_W}p":
            text, pr = _paragraph(e), e.find(f"{_W}pPr")
            style = pr.find(f"{_W}pStyle") if pr is not None else None
            name = style.get(f"{_W}val") if style is not None else ""
            level = levels.get(name) or (int(name[7:]) if name.lower().startswith("heading") and name[7:].isdigit() else 0)
            number = pr.find(f"{_W}numPr") if pr is not None else None
            if not text.strip():
                continue
            if 1 <= level <= 6:
                text = "#" * level + " " + text.replace("**", "").strip()
            elif number is not None:
                depth = number.find(f"{_W}ilvl")
                text = "  " * int(depth.get(f"{_W}val") if depth is not None else 0) + "- " + text
            blocks.append(text)
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(_paragraph(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if rows:
                blocks.append(markdown_rows(rows))
    return "\n\n".join(blocks)


def _place(shape: ElementTree.Element) -> tuple[float, float] | None:
    off = shape.find(f".//{_A}xfrm/{_A}off")
    if off is None:
        off = shape.find(f"{_P}xfrm/{_A}off")
    return None if off is None else (float(off.get("y")), float(off.get("x")))


def _shapes(tree: ElementTree.Element, dx: float = 0, dy: float = 0, sx: float = 1, sy: float = 1) -> Iterator[tuple[tuple[float, float] | None, ElementTree.Element]]:
    """Shapes of a tree with their places; groups scale and move what is in them."""
    for e in tree:
        if e.tag == f"{_P}grpSp":
            f = e.find(f"{_P}grpSpPr/{_A}xfrm")
            if f is None:
                yield from _shapes(e, dx, dy, sx, sy)
                continue
            g = {k: f.find(f"{_A}{k}") for k in ("off", "ext", "chOff", "chExt")}
            v = lambda k, a, z: float(g[k].get(a)) if g[k] is not None else z  # noqa: B023, E731
            kx, ky = v("ext", "cx", 1) / (v("chExt", "cx", 1) or 1), v("ext", "cy", 1) / (v("chExt", "cy", 1) or 1)
            yield from _shapes(e, dx + sx * (v("off", "x", 0) - kx * v("chOff", "x", 0)), dy + sy * (v("off", "y", 0) - ky * v("chOff", "y", 0)), sx * kx, sy * ky)
        elif e.tag in (f"{_P}sp", f"{_P}graphicFrame"):
            at = _place(e)
            yield (None if at is None else (dy + sy * at[0], dx + sx * at[1])), e


def pptx_slides(data: bytes) -> list[str]:
    """Markdown of each slide; shapes by their place, top to bottom and left to right, those without one last.

    A placeholder without a place takes that of its layout's placeholder.
    """
    package = Package(data)
    name = "ppt/presentation.xml"
    parts = package.related(name)
    out = []
    for ref in package.xml(name).iter(f"{_P}sldId"):
        slide_name = parts[ref.get(f"{_R}id")]
        slide = package.xml(slide_name)
        layouts = [p for p in package.related(slide_name).values() if "slideLayout" in p]
        inherited = {}
        for layout in layouts[:1]:
            for at, e in _shapes(package.xml(layout).find(f"{_P}cSld/{_P}spTree")):
                ph = e.find(f".//{_P}ph")
                if ph is not None and at is not None:
                    inherited[ph.get("type", "body"), ph.get("idx")] = at
        shapes = []
        for n, (at, e) in enumerate(_shapes(slide.find(f"{_P}cSld/{_P}spTree"))):
            ph = e.find(f".//{_P}ph")
            if at is None and ph is not None:
                at = inherited.get((ph.get("type", "body"), ph.get("idx")))
            rows = [["\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in c.iter(f"{_A}p")) for c in r.findall(f"{_A}tc")] for r in e.iter(f"{_A}tr")]
            text = markdown_rows(rows) if rows else "\n".join(x for p in e.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t"))))
            title = ph is not None and ph.get("type") in ("title", "ctrTitle")
            if text.strip():
                shapes.append((at is None, at or (0, 0), n, ("# " + text.replace("\n", " ")) if title else text))
        out.append("\n\n".join(x[-1] for x in sorted(shapes)))
    return out


_DATES = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}


def _is_date(number: int, formats: dict[int, str]) -> bool:
    import re

    code = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", formats.get(number, "").lower())
    return number in _DATES or bool(re.search("[ymdhs]", code))


def serial_date(value: float, base_1904: bool = False) -> str:
    """A date serial in ISO form; in the 1900 system, day 60 is a day that never was."""
    if not base_1904 and 60 <= value < 61:
        return "1900-02-29"
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 31) if value < 60 else datetime(1899, 12, 30)
    t = start + timedelta(seconds=round(value * 86400))
    return t.date().isoformat() if value == int(value) else t.isoformat(sep=" ")


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str | None, str | None]]:
    """(sheet, row, column, value, formula) of all cells that hold anything."""
    package = Package(data)
    name = "xl/workbook.xml"
    book, parts = package.xml(name), package.related(name)
    pr = book.find(f"{_S}workbookPr")
    base_1904 = pr is not None and pr.get("date1904") in ("1", "true")
    shared = package.xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared.findall(f"{_S}si")] if shared is not None else []
    styles, dates = package.xml("xl/styles.xml"), []
    if styles is not None:
        formats = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_S}numFmt")}
        xfs = styles.find(f"{_S}cellXfs")
        dates = [_is_date(int(x.get("numFmtId", 0)), formats) for x in xfs] if xfs is not None else []
    out: list = []
    for sheet in book.iter(f"{_S}sheet"):
        root = package.xml(parts[sheet.get(f"{_R}id")])
        for c in root.iter(f"{_S}c"):
            row, column = cell_reference(c.get("r"))
            kind, v, f = c.get("t", "n"), c.find(f"{_S}v"), c.find(f"{_S}f")
            value = v.text if v is not None else None
            if kind == "s" and value is not None:
                value = strings[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif kind == "n" and value is not None and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                value = serial_date(float(value), base_1904)
            if value is not None or f is not None:
                out.append((sheet.get("name"), row, column, value, f.text if f is not None else None))
            if len(out) > MAX_CELLS:
                raise ValueError("too many cells")
    return out


def xlsx_markdown(cells: list, rows_per: int = 100, columns_per: int = 50) -> str:
    """Regions of non-empty rows and columns, each under its A1 range."""
    out = []
    for sheet in dict.fromkeys(c[0] for c in cells):
        own = {(r, c): v if v is not None else f"={f}" for s, r, c, v, f in cells if s == sheet}
        rows, columns = sorted({r for r, _ in own}), sorted({c for _, c in own})
        out.append(f"# {sheet}")
        for i in range(0, len(rows), rows_per):
            for j in range(0, len(columns), columns_per):
                rs, cs = rows[i : i + rows_per], columns[j : j + columns_per]
                if any((r, c) in own for r in rs for c in cs):
                    out.append(f"## {cell_name(rs[0], cs[0])}:{cell_name(rs[-1], cs[-1])}\n\n" + markdown_rows([[own.get((r, c), "") for c in cs] for r in rs]))
    return "\n\n".join(out)


TEXT_EXTENSIONS = ("txt", "md", "csv", "json", "xml", "html", "htm", "log", "yaml", "yml", "ini", "tsv", "sql", "py", "js")


def to_markdown(name: str, data: bytes, convert=None) -> str:
    """Text of a file by its extension; ``convert`` (name, bytes) takes what needs an outside service, else its metadata is the text."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        text = docx_markdown(data)
    elif kind == "pptx":
        text = "\n\n".join(pptx_slides(data))
    elif kind == "xlsx":
        text = xlsx_markdown(xlsx_cells(data))
    elif kind in TEXT_EXTENSIONS:
        text = data.decode("utf-8", "replace")
    else:
        text = convert(name, data) if convert else ""
    return text if text.strip() else f"File: {name}\nSize: {len(data)} bytes"


def read_documents(files: DataFrame, convert=None) -> DataFrame:
    """(path, markdown, error) of a ``binaryFile`` frame."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows.append((path, to_markdown(posixpath.basename(path), bytes(content), convert), None))
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failure
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, markdown string, error string")


def read_cells(files: DataFrame) -> DataFrame:
    """Long cell table of Excel files."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                yield pd.DataFrame([(path, *c) for c in xlsx_cells(bytes(content))], columns=["path", "sheet", "row", "column", "value", "formula"])

    return files.filter(F.lower("path").endswith(".xlsx")).select("path", "content").mapInPandas(parse, "path string, sheet string, row int, column int, value string, formula string")
