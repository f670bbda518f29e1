"""Readers on documents made here, with the words that must come out."""

import csv
import io
import json
import zipfile
import zlib

import pytest
from folioforge.sources import office, readers, trees


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def para(text, style="", bold=False):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val=%s/>" % (chr(34) + style + chr(34)) if style else ""}</w:pPr><w:r><w:rPr>{"<w:b/>" if bold else ""}</w:rPr><w:t>{text}</w:t></w:r></w:p>'


def docx():
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in c) + "</w:tr>"
    body = para("Project Proposal", "Heading1") + para("Plain words") + para("strong", bold=True) + para("First", "ListBullet") + para("Second", "ListBullet") + f"<w:tbl>{row('Team', 'Size')}{row('Engineering', '4')}</w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Sales" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'),
            "xl/sharedStrings.xml": "<sst><si><t>Product</t></si><si><t>Alpha</t></si></sst>",
            "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Amount</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>',
        }
    )


def pptx():
    sp = lambda kind, text: f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>'
    ns = 'xmlns:p="p" xmlns:a="a" ' + R
    return zipped(
        {
            "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="rId2"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="rId2" Target="slides/slide1.xml"/>'),
            "ppt/slides/slide1.xml": f"<p:sld {ns}>{sp('title', 'Market Overview')}{sp('body', 'supply chain')}</p:sld>",
            "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="rId1" Target="../notesSlides/notesSlide1.xml"/>'),
            "ppt/notesSlides/notesSlide1.xml": f"<p:notes {ns}>{sp('body', 'Say hello')}</p:notes>",
        }
    )


def epub():
    return zipped(
        {
            "mimetype": "application/epub+zip",
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
            "OEBPS/book.opf": '<package><metadata><title>My Book</title></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
            "OEBPS/one.xhtml": "<html><body><h1>The Beginning</h1><p>once</p></body></html>",
            "OEBPS/two.xhtml": "<html><body><h1>The Middle</h1></body></html>",
        }
    )


def pdf(*pages, flate=True):
    objects = [b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Count 1>> endobj"]
    for i, text in enumerate(pages):
        raw = f"BT /F1 12 Tf 72 700 Td ({text}) Tj 0 -14 Td [(Second) -200 ( line)] TJ ET".encode()
        data = zlib.compress(raw) if flate else raw
        objects.append(b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj" % (10 + 2 * i, 11 + 2 * i))
        objects.append(b"%d 0 obj <</Length %d%s>>\nstream\n%s\nendstream endobj" % (11 + 2 * i, len(data), b" /Filter /FlateDecode" if flate else b"", data))
    return b"%PDF-1.4\n" + b"\n".join(objects)


def test_json_shapes():
    doc = {"title": "Quarterly Report", "team": {"lead": "Ann", "size": 4}, "items": [{"name": "alpha", "value": 1, "active": True}, {"name": "b|c", "value": None}], "none": {}, "tags": ["x", 2, None], "mixed": [{"a": [1]}, 3]}
    md, title = trees.read_json(json.dumps(doc).encode())
    assert title == "Quarterly Report" and md.startswith("# Quarterly Report\n\n## Team\n\n- **lead**: Ann\n- **size**: 4\n")
    assert "| name | value | active |\n| --- | --- | --- |\n| alpha | 1 | true |\n| b\\|c |  |  |" in md
    assert "## None\n\n_(empty)_" in md and "- x\n- 2\n- " in md and "### Item 1\n\n#### A\n\n- 1" in md and "### Item 2\n\n3" in md
    assert trees.read_json(b"{bad") == ("```json\n{bad\n```\n", None)
    assert trees.read_json(b'{"a": 1, "b": ""}')[0] == "- **a**: 1\n- **b**: _(empty)_\n"
    assert trees.read_json(json.dumps(list(range(6000))).encode())[0].startswith("```json\n[\n  0,")
    assert trees.read_json(b'"x"') == ("x\n", None) and trees.read_json(b"[]")[0] == "_(empty list)_\n"


def test_json_deep_levels_become_blocks():
    md = trees.read_json(json.dumps({"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}).encode())[0]
    assert "#### D" in md and "- **e**:\n\n```json\n{\n  \"f\": 1\n}\n```" in md


def test_node_count_stops():
    assert trees.node_count({"a": [1, 2], "b": {}}) == 5 and trees.node_count([[0] * 50] * 50, most=100) > 100


def test_xml_shapes():
    doc = b'<catalog vendor="Acme"><book id="1"><title>Deep Work</title></book><book id="2"><title>B</title><price>5</price></book><note>hi</note><note/><deep><a><b>x</b></a></deep></catalog>'
    md, title = trees.read_xml(doc)
    assert title == "Catalog" and md.startswith("# Catalog\n\n**vendor**: Acme\n\n## Book\n\n| @id | title | price |\n| --- | --- | --- |\n| 1 | Deep Work |  |\n| 2 | B | 5 |\n")
    assert "- **note**: hi\n- **note**" in md and "## Deep\n\n### A\n\n- **b**: x" in md
    assert trees.read_xml(b"<a>")[0] == "```xml\n<a>\n```\n"


def test_xml_entities_are_refused():
    bomb = b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'
    with pytest.raises(trees.EntityRefused):
        trees.parse_xml(bomb.decode())
    assert "refus" not in trees.read_xml(bomb)[0] and trees.read_xml(bomb)[0].startswith("```xml")


def test_notebook():
    nb = {
        "metadata": {"kernelspec": {"language": "Python"}},
        "cells": [
            {"cell_type": "markdown", "source": ["# Analysis\n", "words"]},
            {"cell_type": "code", "source": "print(6*7)", "execution_count": 3, "outputs": [{"output_type": "stream", "text": ["42\n"]}, {"output_type": "display_data", "data": {"image/png": "x"}}, {"output_type": "display_data", "data": {"image/png": "x"}}, {"output_type": "error", "ename": "E", "evalue": "v"}]},
            {"cell_type": "code", "source": "x", "outputs": [{"output_type": "stream", "text": "\n".join(map(str, range(60)))}]},
            {"cell_type": "raw", "source": "raw"},
            "odd",
        ],
    }
    md, title = trees.read_notebook(json.dumps(nb).encode())
    assert title == "Analysis" and "**In [3]:**\n\n```python\nprint(6*7)\n```\n\nOutput:\n\n```\n42\n\nE: v\n```" in md
    assert md.count("_(image output omitted)_") == 1 and "39\n```\n\n_(output truncated)_" in md and "\n40" not in md and md.endswith("```\nraw\n```\n")


def test_csv():
    out = io.StringIO()
    csv.writer(out, delimiter=";").writerows([["Product", "Quantity", "Revenue"], ["Alpha", "1", "50000"], ["a|b", "2"]])
    assert office.read_csv(out.getvalue().encode())[0] == "| Product | Quantity | Revenue |\n| --- | --- | --- |\n| Alpha | 1 | 50000 |\n| a\\|b | 2 |  |\n"
    assert office.read_csv(b"one\ntwo\n")[0].startswith("| one |")


def test_html():
    page = b"<html><head><title>T</title><style>x</style></head><body><h1>Sample Page</h1><script>bad()</script><p>Some <strong>bold</strong> and <a href='http://x'>link</a> <a href='javascript:x'>no</a></p><ul><li>First item</li><li>Two</li></ul><ol><li>a</li><li>b</li></ol><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table><pre>x  y\n z</pre></body></html>"
    md, title = office.read_html(page)
    assert title == "T" and md == "# Sample Page\n\nSome **bold** and [link](http://x) no\n\n- First item\n- Two\n1. a\n2. b\n\n| A | B |\n| --- | --- |\n| 1 | 2\\|3 |\n\n```\nx  y\n z\n```\n"


def test_office_and_books():
    md, title = office.read_docx(docx())
    assert title == "Project Proposal" and md == "# Project Proposal\n\nPlain words\n\n**strong**\n\n- First\n- Second\n\n| Team | Size |\n| --- | --- |\n| Engineering | 4 |\n"
    assert office.read_xlsx(xlsx())[0] == "## Sales\n\n| Product |  | Amount |\n| --- | --- | --- |\n| Alpha |  | 5 |\n"
    md, title = office.read_pptx(pptx())
    assert title == "Market Overview" and md == "# Market Overview\n\n- supply chain\n\n### Notes\n\nSay hello\n"
    md, title = office.read_epub(epub())
    assert title == "My Book" and md == "# My Book\n\n# The Beginning\n\nonce\n\n# The Middle\n"


def test_pdf_text():
    assert office.pdf_pages(pdf("Quarterly \\(Update\\)", "Page Two")) == ["Quarterly (Update)\nSecond line", "Page Two\nSecond line"]
    assert office.read_pdf(pdf("x", flate=False))[0] == "x\nSecond line\n"
    assert office.pdf_pages(b"%PDF-1.4 nothing") == []


def test_pdf_pages_follow_the_tree():
    """Objects in another order than pages, nested nodes, a loop, and a page that the tree doesn't have."""
    page = lambda n, c: b"%d 0 obj <</Type /Page /Parent 2 0 R /Contents [%d 0 R]>> endobj\n%d 0 obj <<>>\nstream\nBT (page %d) Tj ET\nendstream endobj" % (n, c, c, n)
    body = b"\n".join([b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [30 0 R 3 0 R 10 0 R]>> endobj", b"3 0 obj <</Type /Pages /Kids [20 0 R 2 0 R]>> endobj", page(10, 11), page(20, 21), page(30, 31), page(40, 41)])
    assert office.pdf_pages(b"%PDF-1.4\n" + body) == ["page 30", "page 20", "page 10"]


def test_pdf_fonts_with_unicode_maps():
    cmap = b"2 beginbfchar\n<0001> <0048>\n<0002> <00E9>\nendbfchar\n2 beginbfrange\n<0010> <0012> <0061>\n<0020> <0021> [<03B1> <D83DDE00>]\nendbfrange"
    objects = [
        b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [3 0 R] /Resources <</Font <</F1 5 0 R /F2 6 0 R>>>>>> endobj", b"3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj",
        b"4 0 obj <<>>\nstream\nBT /F1 12 Tf <000100020010001100120020> Tj <0021FFFF> Tj /F2 9 Tf 0 -14 Td (plain) Tj ET\nendstream endobj", b"5 0 obj <</Type /Font /ToUnicode 7 0 R>> endobj", b"6 0 obj <</Type /Font>> endobj", b"7 0 obj <<>>\nstream\n" + cmap + b"\nendstream endobj",
    ]
    assert office.pdf_pages(b"%PDF-1.4\n" + b"\n".join(objects)) == ["Héabcα😀\nplain"]


def test_charsets_are_told_apart():
    russian, german = "Широкая электрификация южных губерний даст мощный толчок подъёму", "Die Größe übertrifft alle Erwartungen, schön für Ärzte"
    assert [readers.charset_of(russian.encode(c)) for c in ("cp1251", "koi8-r", "utf-8", "utf-16", "utf-32")] == ["cp1251", "koi8-r", "utf-8", "utf-16", "utf-32"]
    assert readers.charset_of(german.encode("cp1252")) == "cp1252" and readers.charset_of(german.encode("utf-16-le")) == "utf-16-le" and readers.charset_of(german.encode("utf-16-be")) == "utf-16-be"
    assert readers.charset_of(b'<?xml version="1.0" encoding="ISO-8859-2"?><a>\xb1</a>') == "iso-8859-2" and readers.charset_of(b"<meta charset=nonsense>\xe9") == "cp1252"
    assert readers.charset_of(b"") == "utf-8" and readers.charset_of(b"a\0b") == "utf-8"
    assert office.read_csv("größe;b\n1;2".encode("utf-16"), "utf-16")[0].startswith("| größe | b |")


def test_readers_by_priority(monkeypatch):
    monkeypatch.setattr(readers, "CHOSEN", [])
    first, second = (lambda data, cs: ("first", None)), (lambda data, cs: ("second", None))
    readers.register_for(lambda ext, data: ext == ".json", second)
    readers.register_for(lambda ext, data: data.startswith(b"!"), first, priority=-1.0)
    get = lambda ext, data: readers.chosen_reader(ext, data, readers.CHOSEN, readers.READERS)
    assert get(".json", b"!x") is first and get(".json", b"{}") is second and get(".xml", b"<a/>") is trees.read_xml and get(".none", b"") is None
    third = lambda data, cs: ("third", None)
    readers.register_for(lambda ext, data: True, third)
    assert get(".json", b"{}") is third and get(".json", b"!") is first


def test_kinds_of_containers():
    assert [readers.zip_kind(x) for x in (docx(), xlsx(), pptx(), epub(), zipped({"a.txt": "x"}), b"PK\x03\x04broken")] == [".docx", ".xlsx", ".pptx", ".epub", ".zip", None]
    entry = "Workbook".encode("utf-16-le")
    ole = bytearray(512 + 512)
    ole[:8], ole[30:32], ole[48:52] = bytes.fromhex("d0cf11e0a1b11ae1"), (9).to_bytes(2, "little"), (0).to_bytes(4, "little")
    ole[512 : 512 + len(entry)], ole[576:578] = entry, (len(entry) + 2).to_bytes(2, "little")
    assert readers.ole_kind(bytes(ole)) == ".xls" and readers.ole_kind(b"short") == ""


def test_text_faults_and_charsets():
    assert readers.text_fault(".json", b"{", "utf-8").startswith("not valid JSON") and readers.text_fault(".ipynb", b"{}", "utf-8") == "no cells, as a notebook would have"
    assert readers.text_fault(".xml", b"x<a/>", "utf-8") and readers.text_fault(".xml", b"<a/>", "utf-8") is None and readers.text_fault(".html", b"plain", "utf-8")
    assert readers.text_fault(".csv", b" \n", "utf-8") == "empty" and readers.text_fault(".json", b"[" * (600 * 1024), "utf-8") is None
    assert [readers.charset_of(x) for x in (b"\xef\xbb\xbfa", "é".encode(), b"\xe9", b"\x81")] == ["utf-8-sig", "utf-8", "cp1252", "latin-1"]


def test_extension_goes_before_mime():
    assert readers.reader_for(".JSON", "text/html") is trees.read_json and readers.reader_for("", "application/json; charset=x") is trees.read_json
    assert readers.reader_for(".htm") is office.read_html and readers.reader_for(".txt", "application/json") is None and readers.reader_for("", "") is None
