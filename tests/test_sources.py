from __future__ import annotations

import io
import json
import zipfile
import zlib

from shroudspark.sources import files, office

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def workbook() -> bytes:
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{_S}"><si><t>Name</t></si><si><r><t>Kestrel_x000A_</t></r><r><t>Bay</t></r></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>'
            '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+1</f><v>2</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="D2"/></row></sheetData></worksheet>',
        }
    )


def document() -> bytes:
    body = "<w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>third</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def pdf() -> bytes:
    stream = zlib.compress(b"BT (Call \\(02\\)) Tj ( 5550) Tj 0 -12 Td [(ne) -20 (xt)] TJ ET")
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R 4 0 R] >> endobj\n2 0 obj << /Type /Page /Contents 3 0 R >> endobj\n3 0 obj << /Filter /FlateDecode >> stream\n"
        + stream
        + b"\nendstream endobj\n4 0 obj << /Type /Page >> endobj\n"
    )


def test_office_readers():
    cells = list(office.read_workbook(workbook()))
    assert [(c.locator, c.kind, c.text) for c in cells] == [
        ("sheet 'One' / cell A1", "excel_header", "Name"),
        ("sheet 'One' / cell A2", "excel_cell", "Kestrel Bay"),
        ("sheet 'One' / cell B2", "excel_cell", "2"),
        ("sheet 'One' / cell C2", "excel_cell", "in"),
    ]
    parts = [(c.locator, c.kind, c.text) for c in office.read_document(document())]
    assert parts == [("paragraph 1", "prose", "first"), ("paragraph 3", "prose", "third x"), ("table 1 / r1c1", "table_cell", "cell")]
    lines = [(c.locator, c.kind, c.text) for c in office.read_pdf(pdf())]
    assert lines == [
        ("page 1 / line 1", "prose", "Call (02) 5550"),
        ("page 1 / line 2", "prose", "next"),
        ("page 1 / full text", "prose_block", "Call (02) 5550 next"),
        ("page 2 / full text", "prose_block", ""),
    ]


def test_folders_with_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "book.xlsx").write_bytes(workbook())
    (tmp_path / "in" / "memo.DOCX").write_bytes(document())
    (tmp_path / "scan.pdf").write_bytes(pdf())
    (tmp_path / "bad.xlsx").write_bytes(b"junk")
    (tmp_path / "odd.rtf").write_bytes(b"x")
    found = files.read_documents(spark, str(tmp_path))
    assert {r["document"] for r in found.segments.collect()} == {"book.xlsx", "memo.DOCX", "scan.pdf"}
    assert {(r["document"], r["code"]) for r in found.notes.collect()} == {("bad.xlsx", "unreadable"), ("odd.rtf", "unsupported")}
    assert {(r["page"], r["chars"], r["flag"]) for r in found.coverage.collect()} == {(1, 18, ""), (2, 0, "empty")}
    assert found.files.count() == 5


def test_lists_manifests_and_keys(spark, tmp_path):
    (tmp_path / "names").write_text("# list\n Alder Pty Ltd \n\nBirch\nBirch\n")
    assert {r["name"] for r in files.known_names(spark, str(tmp_path / "names")).collect()} == {"Alder Pty Ltd", "Birch"}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "labels.json").write_text(json.dumps({"default": "internal", "rules": []}))
    assert files.manifest(str(tmp_path / "deep" / "er" / "x.csv"), "labels.json")["default"] == "internal"
    (tmp_path / "labels.json").write_text("{")
    assert files.manifest(str(tmp_path / "deep"), "labels.json") is None
    (tmp_path / "key.jsonl").write_text('{"document": "d", "type": "T", "value": "v", "expected": "detect"}\n\n{broken\n')
    assert files.answer_key(spark, str(tmp_path / "key.jsonl")).count() == 1
    (tmp_path / "records.json").write_text(json.dumps([{"full_text": "t", "spans": [{"entity_type": "A", "start_position": 0, "end_position": 1}]}]))
    assert files.labelled_records(spark, str(tmp_path / "records.json")).first()["spans"][0]["end_position"] == 1
    assert files.write_once(str(tmp_path / "new" / "f"), "a") and not files.write_once(str(tmp_path / "new" / "f"), "b")


def test_dates_of_workbooks_are_dates():
    styles = (
        f'<styleSheet xmlns="{_S}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.00 [Red]"/></numFmts>'
        '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs></styleSheet>'
    )
    cells = "".join(f'<c r="{c}2" s="{s}"><v>{v}</v></c>' for c, s, v in (("A", 0, 32874), ("B", 1, 32874), ("C", 2, 45292.5), ("D", 3, 45292), ("E", 4, 0.25), ("F", 1, "x"), ("G", 9, 7)))
    def book(pr: str) -> bytes:
        return zipped(
            {
                "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}">{pr}<sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
                "xl/styles.xml": styles,
                "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData><row r="2">{cells}</row></sheetData></worksheet>',
            }
        )

    assert [s.text for s in office.read_workbook(book(""))] == ["32874", "1990-01-01 00:00:00", "2024-01-01 12:00:00", "45292", "06:00:00", "x", "7"]
    assert [s.text for s in office.read_workbook(book('<workbookPr date1904="1"/>'))][1] == "1994-01-02 00:00:00"


def test_pages_in_object_streams():
    inner = b"<< /Type /Pages /Kids [2 0 R] >> << /Type /Page /Contents 3 0 R >>"
    packed = zlib.compress(b"1 0 2 33 " + inner)
    shown = zlib.compress(b"BT (packed page) Tj ET")
    content = (
        b"%PDF-1.5\n3 0 obj << /Filter /FlateDecode >> stream\n" + shown + b"\nendstream endobj\n"
        b"5 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"
    )
    assert [s.text for s in office.read_pdf(content)] == ["packed page", "packed page"]


def test_files_of_one_name_in_two_folders_are_two_documents(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "book.xlsx").write_bytes(workbook())
    (tmp_path / "memo.docx").write_bytes(document())
    found = files.read_documents(spark, str(tmp_path))
    names = [r["document"] for r in found.files.collect()]
    assert [n.rpartition("/")[2] for n in names] == ["book.xlsx", "book.xlsx", "memo.docx"] and len(set(names)) == 3
    assert names[0].endswith("/a/book.xlsx") and names[2] == "memo.docx"
    assert {r["document"] for r in found.segments.collect()} == set(names)
