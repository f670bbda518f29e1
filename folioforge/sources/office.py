"""Tables, web pages, office files, e-books and PDF text as Markdown, with the standard library alone."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

from folioforge.sources.trees import cell, decoded, grid, local, parse_xml

HEADINGS = {f"h{n}": n for n in range(1, 7)}
SKIPPED = {"script", "style", "head", "template", "noscript", "svg"}
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "blockquote", "form", "br", "hr", "tr", "body"}


def read_csv(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """The first row is the header, and the mark it has most of parts the cells; short rows are filled."""
    text = decoded(data, charset)
    header = next((line for line in text.splitlines() if line.strip()), "")
    delimiter = max(",;\t|", key=header.count)
    rows = [[cell(c.strip()) for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter) if row]
    if not rows:
        return "", None
    width = max(map(len, rows))
    head, *body = [row + [""] * (width - len(row)) for row in rows]
    return grid(head, body) + "\n", None


class _Page(HTMLParser):
    """Collects blocks of Markdown while tags open and close."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text = self.prefix = ""
        self.title: str | None = None
        self.skip = self.pre = 0
        self.in_title = False
        self.lists: list[int | None] = []
        self.links: list[tuple[str, int]] = []
        self.found: list[tuple[str, str]] = []
        self.rows: list[list[str]] | None = None
        self.cell: int | None = None

    def close_block(self) -> None:
        text = self.text.strip("\n") if self.pre else re.sub(r"\s+", " ", self.text).strip()
        if text:
            self.blocks.append(self.prefix + text)
        self.text = self.prefix = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        about = dict(attrs)
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in INLINE and not self.pre:
            self.text += INLINE[tag]
        elif tag == "a":
            self.links.append((about.get("href") or "", len(self.text)))
        elif tag == "img" and about.get("alt"):
            self.text += f"![{about['alt']}]({about.get('src') or ''})"
        elif self.cell is not None and tag in BLOCKS:
            self.text += " "
        elif tag in HEADINGS:
            self.close_block()
            self.prefix = "#" * HEADINGS[tag] + " "
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.close_block()
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- "
            self.prefix = "  " * max(0, len(self.lists) - 1) + mark
        elif tag == "table":
            self.close_block()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell, self.text = len(self.rows[-1]), ""
        elif tag == "pre":
            self.close_block()
            self.pre += 1
        elif tag in BLOCKS:
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in INLINE and not self.pre:
            self.text += INLINE[tag]
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = self.text[at:].strip()
            if label and href and not re.match(r"(?i)\s*(javascript|data|vbscript):", href):
                self.text = f"{self.text[:at]}[{label}]({href})"
                self.found.append((label, href))
        elif tag in ("td", "th") and self.rows and self.cell is not None:
            self.rows[-1].append(cell(re.sub(r"\s+", " ", self.text).strip()))
            self.cell, self.text = None, ""
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            if rows:
                width = max(map(len, rows))
                head, *body = [r + [""] * (width - len(r)) for r in rows]
                self.blocks.append(grid(head, body))
            self.rows = None
        elif tag == "pre":
            if self.text.strip():
                self.blocks.append(f"```\n{self.text.strip(chr(10))}\n```")
            self.text, self.pre = "", max(0, self.pre - 1)
        elif tag in ("ul", "ol"):
            self.close_block()
            if self.lists:
                self.lists.pop()
        elif tag in HEADINGS or tag == "li" or (tag in BLOCKS and self.cell is None):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.in_title and not self.title:
            self.title = data.strip() or None
        if not self.skip:
            self.text += data


def read_html(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    page = _Page()
    page.feed(decoded(data, charset))
    page.close()
    page.close_block()
    out = ""
    for block in page.blocks:
        tight = re.match(r"\s*(- |\d+\. )", block) and re.match(r"\s*(- |\d+\. )", out.rsplit("\n", 1)[-1])
        out += ("\n" if tight else "\n\n" if out else "") + block
    return out + "\n", page.title


def html_links(data: bytes, charset: str | None = None) -> list[tuple[str, str]]:
    """Label and target of the links that the Markdown of a page has, in order."""
    page = _Page()
    page.feed(decoded(data, charset))
    page.close()
    return page.found


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return parse_xml(z.read(name).decode("utf-8", "replace")) if name in z.namelist() else None


def _all(e: ElementTree.Element | None, tag: str) -> list[ElementTree.Element]:
    return [] if e is None else [x for x in e.iter() if local(x.tag) == tag]


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None) if e is not None else None


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _part(z, f"{folder}/_rels/{name}.rels")
    return {_attr(r, "Id"): posixpath.normpath(posixpath.join(folder, _attr(r, "Target").lstrip("/") if not _attr(r, "Target").startswith("/") else "/" + _attr(r, "Target"))).lstrip("/") for r in _all(root, "Relationship") if _attr(r, "TargetMode") != "External"}


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" if local(x.tag) == "t" else "\t" if local(x.tag) == "tab" else "\n" if local(x.tag) == "br" else "" for x in e.iter())


def _run(r: ElementTree.Element) -> str:
    text, about = _text(r), next((c for c in r if local(c.tag) == "rPr"), None)
    on = lambda tag: any(_attr(x, "val") not in ("0", "false") for x in _all(about, tag))
    mark = "**" * on("b") + "*" * on("i")
    return f"{mark}{text}{mark[::-1]}" if mark and text.strip() else text


def read_docx(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """Headings by style, list items, runs in bold and italics, and tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(_all(_part(z, "word/document.xml"), "body")), None)
    blocks, title = [], None
    for e in body if body is not None else ():
        if local(e.tag) == "tbl":
            rows = [[cell(" ".join(_text(p) for p in _all(c, "p")).strip()) for c in r if local(c.tag) == "tc"] for r in e if local(r.tag) == "tr"]
            if rows:
                blocks.append(grid(rows[0], rows[1:]))
        elif local(e.tag) == "p":
            style = (_attr(next(iter(_all(e, "pStyle")), None), "val") or "").lower()
            text = "".join(_run(r) for r in _all(e, "r")).strip()
            level = 1 if style == "title" else int(m[1]) if (m := re.match(r"heading\s?([1-6])", style)) else 0
            if text and level:
                text = _text(e).strip()
                title = title or text
                blocks.append("#" * level + " " + text)
            elif text and (_all(e, "numPr") or style.startswith("list")):
                item = ("1. " if "number" in style else "- ") + text
                blocks[-1:] = [f"{blocks[-1]}\n{item}"] if blocks and re.match("(- |1[.] )", blocks[-1]) else [*blocks[-1:], item]
            elif text:
                blocks.append(text)
    return "\n\n".join(blocks) + "\n", title


def read_pptx(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """A heading for every slide, its paragraphs as items, tables, and the speaker's notes."""
    blocks, title = [], None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = _related(z, "ppt/presentation.xml")
        order = [rels.get(_attr(s, "id") if "/" not in (_attr(s, "id") or "") else "") for s in _all(_part(z, "ppt/presentation.xml"), "sldId")]
        ids = [next((v for k, v in s.attrib.items() if k.endswith("}id")), None) for s in _all(_part(z, "ppt/presentation.xml"), "sldId")]
        order = [rels[i] for i in ids if i in rels] or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for n, name in enumerate(order, 1):
            slide, lines, heading = _part(z, name), [], None
            for shape in _all(slide, "sp"):
                kind = _attr(next(iter(_all(shape, "ph")), None), "type") or ""
                text = [t for p in _all(shape, "p") if (t := _text(p).strip())]
                if kind in ("title", "ctrTitle") and text and heading is None:
                    heading = " ".join(text)
                else:
                    lines += [f"- {t}" for t in text]
            tables = [[[cell(_text(c).strip()) for c in _all(r, "tc")] for r in _all(t, "tr")] for t in _all(slide, "tbl")]
            notes = [_text(p).strip() for target in _related(z, name).values() if "notesSlide" in target for p in _all(_part(z, target), "p")]
            title = title or heading
            blocks.append(f"{'#' if n == 1 else '##'} {heading or f'Slide {n}'}")
            blocks += ["\n".join(lines)] * bool(lines) + [grid(t[0], t[1:]) for t in tables if t]
            if any(notes):
                blocks.append("### Notes\n\n" + "\n\n".join(filter(None, notes)))
    return "\n\n".join(blocks) + "\n", title


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """A heading and a table for every sheet."""
    blocks = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_part(z, "xl/sharedStrings.xml"), "si")]
        rels = _related(z, "xl/workbook.xml")
        for sheet in _all(_part(z, "xl/workbook.xml"), "sheet"):
            target = rels.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None))
            rows = []
            for r in _all(_part(z, target) if target else None, "row"):
                row: dict[int, str] = {}
                for k, c in enumerate(_all(r, "c")):
                    value = next((v.text or "" for v in _all(c, "v")), "")
                    kind = c.get("t")
                    text = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
                    row[_column(c.get("r") or "") if c.get("r") else k] = cell(text.strip())
                rows.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
            rows = [r for r in rows if any(r)]
            width = max(map(len, rows), default=0)
            blocks.append(f"## {sheet.get('name')}")
            if rows:
                head, *body = [r + [""] * (width - len(r)) for r in rows]
                blocks.append(grid(head, body))
    return "\n\n".join(blocks) + "\n", None


def read_epub(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """The chapters in the order of the spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package = next((_attr(r, "full-path") for r in _all(_part(z, "META-INF/container.xml"), "rootfile")), None)
        root = _part(z, package) if package else None
        files = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package or ""), i.get("href") or "")) for i in _all(root, "item")}
        title = next((t.text.strip() for t in _all(root, "title") if (t.text or "").strip()), None)
        chapters = [read_html(z.read(files[r.get("idref")]))[0].strip() for r in _all(root, "itemref") if files.get(r.get("idref")) in z.namelist()]
    return "\n\n".join([*([f"# {title}"] if title else []), *filter(None, chapters)]) + "\n", title


# PDF: the text operators of page contents, in simple encodings and by the ToUnicode maps of fonts

_STREAM = re.compile(rb"(\d+) \d+ obj\s*(<<(?:(?!endobj).)*?>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_OBJECT = re.compile(rb"(\d+) \d+ obj(.*?)endobj", re.DOTALL)
_SHOWN = re.compile(rb"/[^\s/<>\[\]()]+\s+-?[\d.]+\s+Tf|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|(?<![A-Za-z])(?:Tj|TJ|T\*|Td|TD|Tm|ET|'|\")(?![A-Za-z])|-?\d+\.?\d*", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Codes of a font, each of so many bytes, and the text they stand for.
_Map = tuple[int, dict[int, str]]


def _bytes_of(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)


def _literal(token: bytes, font: _Map | None) -> str:
    raw = _bytes_of(token)
    if font is None:
        return raw.decode("latin-1") if token[:1] == b"<" else raw.decode("cp1252", "replace")
    width, codes = font
    return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _unicode_map(cmap: bytes) -> _Map:
    """The bfchar and bfrange entries of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    codes, width = {}, 1
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            codes[int(code, 16)], width = text(to), len(code) // 2
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for first, last, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            lo, hi, width = int(first, 16), int(last, 16), len(first) // 2
            start, several = text(to) if to else "", re.findall(rb"<([0-9A-Fa-f]+)>", each)
            for k in range(min(hi - lo + 1, 1 << 16)):
                codes[lo + k] = (start[:-1] + chr(ord(start[-1]) + k)) if start else text(several[k]) if k < len(several) else ""
    return max(1, width), codes


def _content_text(content: bytes, fonts: dict[bytes, _Map]) -> str:
    out, held, font = [], [], None
    for m in _SHOWN.finditer(content):
        token = m[0]
        if token[:1] == b"/":
            font = fonts.get(token[1:].split()[0])
        elif token[:1] in b"(<":
            held.append(_literal(token, font))
        elif token in (b"Tj", b"TJ"):
            out.append("".join(held))
            held = []
        elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"'):
            out.append("\n" + "".join(held))
            held = []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def _refs(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects that an entry refers to, alone or in an array."""
    at = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+ \d+ R)", body)
    return [int(x) for x in re.findall(rb"(\d+) \d+ R", at[1])] if at else []


class _Pdf:
    """The objects of a file and its streams, decompressed."""

    def __init__(self, data: bytes):
        self.streams: dict[int, bytes] = {}
        for m in _STREAM.finditer(data):
            raw = m[3]
            if b"FlateDecode" in m[2]:
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error:
                    continue
            self.streams[int(m[1])] = raw
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for n, raw in list(self.streams.items()):
            if n in self.objects and b"/ObjStm" in self.objects[n]:
                first = int(re.search(rb"/First\s+(\d+)", self.objects[n])[1])
                index = list(map(int, raw[:first].split()))
                for k in range(0, len(index) - 1, 2):
                    end = index[k + 3] if k + 3 < len(index) else len(raw)
                    self.objects.setdefault(index[k], raw[first + index[k + 1] : first + end])

    def _is(self, n: int, kind: bytes) -> bool:
        return re.search(rb"/Type\s*/" + kind + rb"(?![s\w])", self.objects.get(n, b"")) is not None

    def page_numbers(self) -> list[int]:
        """Page objects in the order of the page tree; in that of their numbers where no tree leads to any."""
        roots = [r for n in sorted(self.objects) if self._is(n, b"Catalog") for r in _refs(self.objects[n], b"Pages")]
        out, seen, stack = [], set(), roots[-1:]
        while stack:
            n = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            if self._is(n, b"Page"):
                out.append(n)
            stack += reversed(_refs(self.objects.get(n, b""), b"Kids"))
        return out or [n for n in sorted(self.objects) if self._is(n, b"Page")]

    def _inherited(self, n: int, key: bytes) -> bytes:
        """The dictionary of an entry of a page, or of what it stands under."""
        for _ in range(32):
            body = self.objects.get(n, b"")
            at = re.search(rb"/" + key + rb"\s*(\d+) \d+ R", body)
            if at:
                return self.objects.get(int(at[1]), b"")
            if re.search(rb"/" + key + rb"\s*<<", body):
                return body[body.index(b"/" + key) :]
            up = _refs(body, b"Parent")
            if not up:
                break
            n = up[0]
        return b""

    def fonts(self, page: int) -> dict[bytes, _Map]:
        """The fonts of a page by name that have a ToUnicode map."""
        held = self._inherited(page, b"Resources")
        at = re.search(rb"/Font\s*(?:(\d+) \d+ R|<<(.*?)>>)", held, re.DOTALL)
        table = (self.objects.get(int(at[1]), b"") if at[1] else at[2]) if at else b""
        out = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+) \d+ R", table):
            for n in _refs(self.objects.get(int(ref), b""), b"ToUnicode"):
                if n in self.streams:
                    out[name] = _unicode_map(self.streams[n])
        return out

    def text(self, page: int) -> str:
        content = b"\n".join(self.streams.get(r, b"") for r in _refs(self.objects[page], b"Contents"))
        return _content_text(content, self.fonts(page))


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page, in order; [] where nothing can be read."""
    pdf = _Pdf(data)
    return [pdf.text(n) for n in pdf.page_numbers()]


def read_pdf(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    return "\n\n".join(p for p in pdf_pages(data) if p) + "\n", None
