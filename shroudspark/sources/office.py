"""Segments of workbooks, text documents and simple PDF files, with the standard library alone."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from io import BytesIO
from typing import NamedTuple
from xml.etree import ElementTree as ET

_CELL = re.compile(r"([A-Z]+)([0-9]+)$")
_CONTROL = re.compile(r"_x00[01][0-9A-Fa-f]_|\u00a0")


class Segment(NamedTuple):
    locator: str
    kind: str
    text: str
    page: int | None = None


def squeeze(text: str) -> str:
    return " ".join(_CONTROL.sub(" ", text).split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element: ET.Element) -> str:
    """All text below an element; tabs and breaks are spaces."""
    out = []
    for e in element.iter():
        name = _local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br", "cr"):
            out.append(" ")
    return "".join(out)


def read_workbook(content: bytes) -> Iterator[Segment]:
    """Every non-empty cell of every sheet, as computed; cells of row 1 are headers."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        formats = _date_formats(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        links = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        late = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for sheet in (e for e in book.iter() if _local(e.tag) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for _, cell in ET.iterparse(BytesIO(z.read(part))):
                if _local(cell.tag) != "c":
                    continue
                value = _cell_value(cell, strings)
                style = cell.get("s", "0")
                if value and cell.get("t", "n") == "n" and style.isdigit() and int(style) < len(formats) and formats[int(style)]:
                    value = _moment(value, epoch)
                place = _CELL.match(cell.get("r", ""))
                if place and (text := squeeze(value)):
                    kind = "excel_header" if place[2] == "1" else "excel_cell"
                    yield Segment(f"sheet '{sheet.get('name')}' / cell {place[0]}", kind, text)
                cell.clear()


_DATES = {*range(14, 23), *range(45, 48)}  # the number formats of dates and times that every workbook has


def _date_formats(styles: bytes) -> list[bool]:
    """Whether each cell style shows a number as a date or a time."""
    root = ET.fromstring(styles)
    own = {}
    for e in root.iter():
        if _local(e.tag) == "numFmt":
            bare = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", e.get("formatCode", ""))
            own[int(e.get("numFmtId", 0))] = bool(re.search("[dmyhs]", bare.split(";")[0], re.I)) and "general" not in bare.lower()
    cells = next((e for e in root if _local(e.tag) == "cellXfs"), ())
    number = [int(x.get("numFmtId", 0)) for x in cells if _local(x.tag) == "xf"]
    return [own.get(n, n in _DATES) for n in number]


def _moment(serial: str, epoch: datetime) -> str:
    """Days since the epoch as a date with its time; within the first day as a time alone."""
    try:
        days = float(serial)
        moment = epoch + timedelta(days=int(days), seconds=round((days - int(days)) * 86_400))
    except (ValueError, OverflowError):
        return serial
    if 0 <= days < 1:
        return str(moment.time())
    if epoch.year == 1899 and 0 < days < 60:  # that calendar has a 29 February 1900
        moment += timedelta(days=1)
    return str(moment)


def _cell_value(cell: ET.Element, strings: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    value = next((e.text or "" for e in cell if _local(e.tag) == "v"), "")
    if kind == "s" and value:
        return strings[int(value)]
    if kind == "b":
        return {"0": "False", "1": "True"}.get(value, value)
    return value


def read_document(content: bytes) -> Iterator[Segment]:
    """Paragraphs outside tables, then the cells of tables, each numbered from 1."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    body = next((e for e in body if _local(e.tag) == "body"), body)
    number = 0
    for p in (e for e in body if _local(e.tag) == "p"):
        number += 1
        if text := squeeze(_text(p)):
            yield Segment(f"paragraph {number}", "prose", text)
    for t, table in enumerate((e for e in body if _local(e.tag) == "tbl"), 1):
        for r, row in enumerate((e for e in table if _local(e.tag) == "tr"), 1):
            for c, cell in enumerate((e for e in row if _local(e.tag) == "tc"), 1):
                if text := squeeze(" ".join(_text(p) for p in cell.iter() if _local(p.tag) == "p")):
                    yield Segment(f"table {t} / r{r}c{c}", "table_cell", text)


_STRING = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?[0-9.]+|'|\"|\b(?:Tj|TJ|Td|TD|T\*|Tm|ET)\b|T\*", re.S)
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\nendstream", re.S)


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else escapes.get(m[1], b"" if m[1].endswith(b"\n") else m[1]), raw[1:-1], flags=re.S)
    return plain.decode("utf-16-be", "replace") if plain[:2] == b"\xfe\xff" else plain.decode("latin-1")


def _shown(stream: bytes) -> list[str]:
    """Lines of text that a content stream shows."""
    lines, line, held = [], [], []
    for m in _STRING.finditer(stream):
        token = m.group()
        if token[:1] in b"(<":
            held.append(_pdf_string(token))
        elif token in (b"Tj", b"TJ"):
            line += held
            held = []
        elif token in (b"'", b'"'):
            lines.append("".join(line))
            line, held = held, []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            if line:
                lines.append("".join(line))
            line, held = [], []
    return [t for t in map(squeeze, [*lines, "".join(line)]) if t]


def _packed(body: bytes) -> dict[int, bytes]:
    """The objects of an object stream: numbers and offsets first, then the objects."""
    parts, first = _STREAM.match(body), re.search(rb"/First\s+(\d+)", body)
    if not parts or not first:
        return {}
    data = zlib.decompress(parts[2]) if b"FlateDecode" in parts[1] else parts[2]
    head = [int(x) for x in data[: int(first[1])].split()]
    starts = [int(first[1]) + at for at in head[1::2]]
    return {number: data[a:b] for number, a, b in zip(head[::2], starts, [*starts[1:], len(data)])}


def read_pdf(content: bytes) -> Iterator[Segment]:
    """Lines of each page and the page as one block, so that what is broken over lines is found.

    Reads objects, also those in object streams, with Flate or no compression and fonts
    with one-byte codes; an encrypted file is an error.  Tables are read as lines.
    """
    if not content.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(objects.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            objects |= {k: v for k, v in _packed(body).items() if k not in objects}
    pages = [body for body in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    if not pages:
        raise ValueError("no readable pages")
    for number, page in enumerate(pages, 1):
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        lines: list[str] = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", found[1]) if found else ():
            parts = _STREAM.match(objects.get(int(ref), b""))
            if parts:
                lines += _shown(zlib.decompress(parts[2]) if b"FlateDecode" in parts[1] else parts[2])
        for k, text in enumerate(lines, 1):
            yield Segment(f"page {number} / line {k}", "prose", text, number)
        block = squeeze(" ".join(lines))
        yield Segment(f"page {number} / full text", "prose_block", block, number)  # empty pages too, for coverage


READERS = {".docx": read_document, ".pdf": read_pdf, ".xlsm": read_workbook, ".xlsx": read_workbook}
