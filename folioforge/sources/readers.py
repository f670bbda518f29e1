"""Which reader turns a format into Markdown, and what a container really is."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable

from folioforge.registry import ALIASES, FORMATS
from folioforge.sources import office, trees

Reader = Callable[[bytes, "str | None"], "tuple[str, str | None]"]

#: By canonical extension. ``register`` adds to it or replaces.
READERS: dict[str, Reader] = {
    ".json": trees.read_json,
    ".xml": trees.read_xml,
    ".ipynb": trees.read_notebook,
    ".csv": office.read_csv,
    ".html": office.read_html,
    ".docx": office.read_docx,
    ".pptx": office.read_pptx,
    ".xlsx": office.read_xlsx,
    ".epub": office.read_epub,
    ".pdf": office.read_pdf,
}
PARSED_BYTES = 512 * 1024
OOXML = {"word/document.xml": ".docx", "ppt/presentation.xml": ".pptx", "xl/workbook.xml": ".xlsx"}
OLE = {"WordDocument": ".doc", "Workbook": ".xls", "Book": ".xls", "PowerPoint Document": ".ppt"}


def register(extension: str, reader: Reader) -> None:
    """Put one's own reader in the place of, or beside, those here. Nothing else is loaded by itself."""
    READERS[extension.lower()] = reader


#: Readers that are asked before those by extension: the lowest priority first, of equals the latest; a reader takes a file
#: by its extension and content.
CHOSEN: list[tuple[float, int, Callable[[str, bytes], bool], Reader]] = []


def register_for(accepts: Callable[[str, bytes], bool], reader: Reader, priority: float = 0.0) -> None:
    """A reader for what ``accepts(extension, content)`` takes."""
    CHOSEN.append((priority, -len(CHOSEN), accepts, reader))
    CHOSEN.sort(key=lambda x: x[:2])


def chosen_reader(extension: str, data: bytes, chosen: list, table: dict[str, Reader]) -> Reader | None:
    return next((reader for *_, accepts, reader in chosen if accepts(extension, data)), table.get(extension))


def reader_for(extension: str, mime: str = "") -> Reader | None:
    """The reader of an extension; the MIME type counts only where there is no extension at all."""
    ext = extension.lower()
    if not ext:
        kind = mime.split(";")[0].strip().lower()
        ext = next((f[0] for f in FORMATS if kind and kind == f[4][0]), next((f[0] for f in FORMATS if kind in f[4]), ""))
    return READERS.get(ALIASES.get(ext, ext))


def zip_kind(data: bytes) -> str | None:
    """What a ZIP container is, by what it holds; None where it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if "mimetype" in names and z.read("mimetype")[:64].strip() == b"application/epub+zip":
                return ".epub"
            return next((e for marker, e in OOXML.items() if marker in names), ".zip")
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
        return None


def ole_kind(data: bytes) -> str:
    """What an OLE2 file is, by the names in its directory sectors (128-byte entries, names in UTF-16)."""
    shift = int.from_bytes(data[30:32], "little") if len(data) > 512 else 9
    at = 512 + (int.from_bytes(data[48:52], "little") << shift) if shift in (9, 12) else len(data)
    names = set()
    for k in range(at, min(len(data), at + 128 * 256), 128):
        size = int.from_bytes(data[k + 64 : k + 66], "little")
        if 2 <= size <= 64:
            names.add(data[k : k + size - 2].decode("utf-16-le", "ignore").lower())
    return next((e for marker, e in OLE.items() if marker.lower() in names), "")


#: Marks at the start of a file, the longer ones first.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DECLARED = re.compile(rb"""(?:encoding|charset)\s*=\s*["']?([A-Za-z0-9._:-]+)""")


def _decodes(data: bytes, charset: str) -> bool:
    try:
        data.decode(charset)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def _in_case(text: str) -> int:
    """Letters beyond ASCII where a text has them: small ones anywhere, capitals at the start of a word; others count against it."""
    pairs = [(b, c) for b, c in zip(" " + text, text, strict=False) if ord(c) > 127]
    return sum(1 if c.islower() or (c.isupper() and not b.isalpha()) else -1 for b, c in pairs)


def charset_of(data: bytes) -> str:
    """By a mark; utf-8 where all bytes are; what the file says of itself, if that reads it; UTF-16 where every other
    byte of most pairs is 0. Else a guess: where most bytes beyond ASCII stand together, a Cyrillic code page, that
    of which more letters are in a likely case; otherwise the Western one, or Latin-1, which takes any byte."""
    for mark, charset in MARKS:
        if data.startswith(mark) and _decodes(data, charset):
            return charset
    if b"\0" not in data[:PARSED_BYTES] and _decodes(data, "utf-8"):
        return "utf-8"
    said = _DECLARED.search(data[:1024])
    if said and _decodes(data, name := said[1].decode().lower()):
        return name
    head = data[: PARSED_BYTES // 2 * 2]
    for zeros, charset in ((head[1::2], "utf-16-le"), (head[::2], "utf-16-be")):
        if len(head) >= 4 and zeros.count(0) > 0.4 * len(zeros) and _decodes(data, charset):
            return charset
    if _decodes(data, "utf-8"):
        return "utf-8"
    high = [len(m[0]) for m in re.finditer(rb"[\x80-\xff]+", head)]
    if sum(high) >= 8 and sum(n for n in high if n > 2) > 0.6 * sum(high):
        known = [c for c in ("cp1251", "koi8-r", "iso8859-5") if _decodes(data, c)]
        if known:
            return max(known, key=lambda c: _in_case(head.decode(c)))
    return "cp1252" if _decodes(data, "cp1252") else "latin-1"


def text_fault(extension: str, data: bytes, charset: str) -> str | None:
    """Why text can't be what its name says; 'empty' where there is none. Only the start of large files is looked at."""
    text = data[:PARSED_BYTES].decode(charset, "replace")
    if not text.strip():
        return "empty"
    whole = len(data) <= PARSED_BYTES
    if extension in (".json", ".ipynb"):
        try:
            value = json.loads(text)
        except (ValueError, RecursionError) as e:
            return f"not valid JSON: {str(e.args[0]).split(':')[0]}" if whole else None
        if extension == ".ipynb" and not (isinstance(value, dict) and "cells" in value):
            return "no cells, as a notebook would have"
    elif extension == ".xml":
        if not text.lstrip().startswith("<"):
            return "text before the first tag"
        try:
            if whole:
                trees.parse_xml(text)
        except Exception as e:
            return f"not well-formed XML: {e}"
    elif extension == ".html" and "<" not in text[:4096]:
        return "no tag within the first 4096 characters"
    return None
