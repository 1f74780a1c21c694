"""Office formats of zipped XML, read with the standard library; PDF where a library for it is there."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

from .plain import Source, tab_lines

# The largest slide that is read.
MOST_SLIDE_BYTES = 32 << 20
#: Numbers of built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _own(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in e if _local(x) == name]


def _linked(e: ElementTree.Element) -> str | None:
    """The relationship that an element names."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), None)


def _run_text(e: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join((x.text or "") if _local(x) == "t" else marks.get(_local(x), "") for x in e.iter())


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("the file is damaged or of another format") from e


def pdf(content: bytes) -> list[Source]:
    """A source for each page. Needs the library pypdf; without it the file gives an error row."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF needs the library pypdf") from e
    return [(n, None, page.extract_text() or "") for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]


def docx(content: bytes) -> list[Source]:
    """Paragraphs, then the rows of tables that have any text. The document part is read directly, so broken links to other parts don't matter."""
    with _open(content) as z:
        body = next(_all(ElementTree.fromstring(z.read("word/document.xml")), "body"))
    lines = [t for p in _own(body, "p") if (t := _run_text(p)).strip()]
    for table in _own(body, "tbl"):
        for row in _own(table, "tr"):
            cells: list[str] = []
            for cell in _own(row, "tc"):
                text = "\n".join(map(_run_text, _own(cell, "p"))).strip()
                span = next((v for x in _all(cell, "gridSpan") for k, v in x.attrib.items() if k.endswith("val")), "1")
                cells += [text] * int(span)
            if any(cells):
                lines.append("\t".join(cells))
    return [(None, None, "\n".join(lines))]


def _slides(z: zipfile.ZipFile) -> list[str]:
    """Parts of the slides in the order of the presentation, or by number where that can't be read."""
    there = set(z.namelist())
    try:
        links = {r.get("Id"): r for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels")) if r.get("TargetMode") != "External" and (r.get("Type") or "").endswith("/slide")}
        named = [links[i].get("Target", "").replace("\\", "/") for s in _all(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldId") if (i := _linked(s)) in links]
        parts = [posixpath.normpath(posixpath.join("ppt", t)) for t in named]
        if found := [p for p in parts if p in there]:
            return found
    except (KeyError, ElementTree.ParseError):
        pass
    numbered = [(int(m[1]) if (m := re.search(r"slide(\d+)\.xml$", n)) else float("inf"), n) for n in z.namelist() if re.match(r"ppt/slides/slide.*\.xml$", n)]
    return [n for _, n in sorted(numbered, key=lambda x: x[0])]


def pptx(content: bytes) -> list[Source]:
    """A source for each slide, numbered in the order of the presentation."""
    out: list[Source] = []
    with _open(content) as z:
        for n, part in enumerate(_slides(z), 1):
            if (size := z.getinfo(part).file_size) > MOST_SLIDE_BYTES:
                raise ValueError(f"slide {n} is too large: {size >> 20} MB")
            lines = (_run_text(p).strip() for p in _all(ElementTree.fromstring(z.read(part)), "p"))
            out.append((n, f"第 {n} 页", "\n".join(filter(None, lines))))
    return out


def _shows_dates(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0].lower())
    return bool(re.search("[dmyhs]", bare)) and "general" not in bare


class _Sheets:
    """What the cells of a workbook need: shared strings, which styles show dates, where days begin."""

    def __init__(self, z: zipfile.ZipFile):
        part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")
        # phonetic readings aren't part of a string
        self.strings = ["".join(t.text or "" for x in si if _local(x) in ("t", "r") for t in _all(x, "t")) for si in _all(part("xl/sharedStrings.xml"), "si")]
        styles = part("xl/styles.xml")
        own = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in _all(styles, "numFmt")}
        formats = [int(x.get("numFmtId", 0)) for list_ in _all(styles, "cellXfs") for x in _own(list_, "xf")]
        self.dates = {i for i, f in enumerate(formats) if (_shows_dates(own[f]) if f in own else f in DATE_FORMATS)}
        late = any(p.get("date1904") in ("1", "true") for p in _all(part("xl/workbook.xml"), "workbookPr"))
        self.first_day = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)

    def value(self, cell: ElementTree.Element) -> object:
        kind, raw = cell.get("t", "n"), next((v.text for v in _all(cell, "v")), None)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _all(cell, "t"))
        if raw is None:
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return raw.strip() in ("1", "true")
        if kind != "n":
            return raw
        number = float(raw)
        if int(cell.get("s", 0)) in self.dates:
            return self.moment(number)
        return int(raw) if re.fullmatch(r"-?\d+", raw) else number

    def moment(self, days: float) -> object:
        at = self.first_day + timedelta(milliseconds=round(days * 86_400_000))
        return at.time() if 0 <= days < 1 and at.time() >= time() else at


def _column(place: str) -> int:
    at = 0
    for letter in re.match("[A-Z]*", place)[0]:
        at = 26 * at + ord(letter) - ord("A") + 1
    return at


def xlsx(content: bytes) -> list[Source]:
    """A source for each sheet, with its name as section."""
    out: list[Source] = []
    with _open(content) as z:
        known = _Sheets(z)
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            target = links[_linked(sheet)].replace("\\", "/")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            rows = []
            for row in _all(ElementTree.fromstring(z.read(part)), "row"):
                cells: list[object] = []
                for cell in _own(row, "c"):
                    cells += [None] * (_column(cell.get("r", "")) - 1 - len(cells))
                    cells.append(known.value(cell))
                rows.append(cells)
            out.append((None, sheet.get("name"), tab_lines(rows)))
    return out
