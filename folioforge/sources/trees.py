"""JSON, XML and notebooks as Markdown.

A reader takes bytes and gives (markdown, title). Documents are walked once, and lines are yielded as
the walk meets them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from xml.etree import ElementTree
from xml.parsers import expat

DEEPEST_HEADING, WIDEST_TABLE, MOST_NODES = 4, 12, 5000
OUTPUT_LINES, OUTPUT_CHARS = 40, 4000


def decoded(data: bytes, charset: str | None = None) -> str:
    return data.decode(charset or "utf-8-sig", errors="replace")


def in_words(key: str) -> str:
    """snake_case and kebab-case keys as headings."""
    text = re.sub("[_-]", " ", key).strip()
    return text[:1].upper() + text[1:] or key


def cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def grid(header: Iterable[str], rows: Iterable[Iterable[str]]) -> str:
    head = list(header)
    body = [head, ["---"] * len(head), *map(list, rows)]
    return "\n".join(f"| {' | '.join(row)} |" for row in body)


def first_seen(keys: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(keys))


# JSON


def plain(value: object) -> str:
    return {None: "", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def is_leaf(value: object) -> bool:
    return not isinstance(value, (dict, list))


def json_fence(value: object) -> str:
    return f"```json\n{json.dumps(value, indent=2, ensure_ascii=False)}\n```"


def node_count(value: object, most: int = MOST_NODES) -> int:
    """Nodes of a tree, counted no further than just past ``most``."""
    n, level = 0, [value]
    while level and n <= most:
        n += len(level)
        level = [c for v in level if not is_leaf(v) for c in (v.values() if isinstance(v, dict) else v)]
    return n


def record_table(items: list) -> str | None:
    """Two flat objects or more, with twelve different keys at most, as a table."""
    if len(items) < 2 or not all(isinstance(i, dict) for i in items):
        return None
    columns = first_seen(k for i in items for k in i)
    if not 0 < len(columns) <= WIDEST_TABLE or not all(is_leaf(v) for i in items for v in i.values()):
        return None
    return grid(map(cell, columns), ([cell(plain(i.get(c))) for c in columns] for i in items))


def _section(title: str, value: object, depth: int) -> Iterator[str]:
    yield from (f"{'#' * (depth + 1)} {title}", "")
    yield from json_lines(value, depth + 1)
    yield ""


def json_lines(value: object, depth: int) -> Iterator[str]:
    if isinstance(value, dict):
        yield from _object_lines(value, depth)
    elif isinstance(value, list):
        yield from _list_lines(value, depth)
    else:
        yield plain(value)


def _object_lines(value: dict, depth: int) -> Iterator[str]:
    if not value:
        yield "_(empty)_"
    inner = {k: v for k, v in value.items() if not is_leaf(v)}
    yield from (f"- **{k}**: {plain(v) or '_(empty)_'}" for k, v in value.items() if k not in inner)
    if 0 < len(inner) < len(value):
        yield ""
    for k, v in inner.items():
        if depth < DEEPEST_HEADING:
            yield from _section(in_words(k), v, depth)
        else:
            yield from (f"- **{k}**:", "", json_fence(v), "")


def _list_lines(value: list, depth: int) -> Iterator[str]:
    table = record_table(value)
    if table:
        yield table
    elif not value:
        yield "_(empty list)_"
    elif all(map(is_leaf, value)):
        yield from (f"- {plain(v)}" for v in value)
    else:
        for n, v in enumerate(value, 1):
            yield from _section(f"Item {n}", v, depth) if depth < DEEPEST_HEADING else (json_fence(v), "")


def read_json(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """Small trees by their shape, large ones and what isn't JSON as a fenced block. A title, if there is one, is the heading."""
    raw = decoded(data, charset)
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return f"```json\n{raw.strip()}\n```\n", None
    key = next((k for k in ("title", "name", "Title", "Name") if isinstance(value, dict) and isinstance(value.get(k), str) and value[k].strip()), None)
    title = value[key].strip() if key else None
    if key:
        value = {k: v for k, v in value.items() if k != key}
    lines = [f"# {title}", ""] if title else []
    lines += [json_fence(value)] if node_count(value) > MOST_NODES else json_lines(value, len(lines) // 2)
    return "\n".join(lines).strip() + "\n", title


# XML


class EntityRefused(ValueError):
    """An XML document declares an entity."""


def parse_xml(text: str) -> ElementTree.Element:
    """The root element; declarations of entities are refused before anything is expanded."""

    def refuse(*_: object) -> None:
        raise EntityRefused("entity declarations aren't read")

    guard = expat.ParserCreate()
    guard.EntityDeclHandler = guard.ExternalEntityRefHandler = refuse
    guard.Parse(text.encode("utf-8"), True)
    return ElementTree.fromstring(text)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def own_text(e: ElementTree.Element) -> str:
    return (e.text or "").strip()


def sibling_table(elements: list[ElementTree.Element]) -> str | None:
    """Two siblings or more of one tag whose children have no children, as a table: attributes first, then children."""
    if len(elements) < 2 or any(len(c) for e in elements for c in e):
        return None
    rows = [{f"@{local(k)}": v for k, v in e.attrib.items()} | {local(c.tag): own_text(c) for c in e} for e in elements]
    columns = first_seen(k for row in rows for k in row)
    if not all(rows) or not 0 < len(columns) <= WIDEST_TABLE:
        return None
    return grid((cell(c).strip() for c in columns), ([cell(row.get(c, "")).strip() for c in columns] for row in rows))


def xml_lines(e: ElementTree.Element, depth: int) -> Iterator[str]:
    if e.attrib:
        yield from (" · ".join(f"**{local(k)}**: {v}" for k, v in e.attrib.items()), "")
    if own_text(e):
        yield from (own_text(e), "")
    for tag, run in groupby(e, key=lambda c: local(c.tag)):
        same = list(run)
        heading = (f"{'#' * (depth + 1)} {in_words(tag)}", "") if depth < DEEPEST_HEADING else ()
        table = sibling_table(same)
        if table:
            yield from (*heading, table, "")
            continue
        for c in same:
            value = own_text(c)
            if not len(c) and not c.attrib:
                yield f"- **{tag}**: {value}" if value else f"- **{tag}**"
            elif heading:
                yield from heading
                yield from xml_lines(c, depth + 1)
                yield ""
            else:
                yield f"- **{tag}**"
                yield from (f"  {line}" if line else "" for line in xml_lines(c, depth + 1))


def read_xml(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    raw = decoded(data, charset)
    try:
        root = parse_xml(raw)
    except (expat.ExpatError, ElementTree.ParseError, EntityRefused, UnicodeEncodeError):
        return f"```xml\n{raw.strip()}\n```\n", None
    title = in_words(local(root.tag))
    return "\n".join([f"# {title}", "", *xml_lines(root, 1)]).strip() + "\n", title


# notebooks


def joined(source: object) -> str:
    return "".join(map(str, source)) if isinstance(source, list) else str(source or "")


def clipped(text: str) -> tuple[str, bool]:
    """The first lines and characters of an output, and whether there were more."""
    head = "\n".join(text.split("\n")[:OUTPUT_LINES])[:OUTPUT_CHARS]
    return head.rstrip(), len(head) < len(text)


def kernel_language(notebook: dict) -> str:
    about = notebook.get("metadata") or {}
    found = ((about.get(a) or {}) for a in ("kernelspec", "language_info"))
    names = (x.get(k) if isinstance(x, dict) else None for x, k in zip(found, ("language", "name"), strict=True))
    return next((n.strip().lower() for n in names if isinstance(n, str) and n.strip()), "python")


def _output(o: dict) -> tuple[str, list[str]]:
    """Text of a cell's output, and notes on what can't be shown."""
    kind, data = o.get("output_type"), o.get("data") or {}
    if kind == "stream":
        return joined(o.get("text")), []
    if kind == "error":
        return f"{o.get('ename', 'Error')}: {o.get('evalue', '')}".strip(": "), []
    if kind in ("execute_result", "display_data"):
        notes = ["_(image output omitted)_"] * any(k.startswith("image/") for k in data) + ["_(output omitted)_"] * (not data)
        return joined(data.get("text/plain")), notes
    return "", []


def _cell_lines(c: dict, language: str) -> Iterator[str]:
    source, kind = joined(c.get("source")).strip("\n"), c.get("cell_type")
    shown = bool(source.strip())
    if kind == "markdown" and shown:
        yield from (source, "")
    elif kind == "raw" and shown:
        yield from ("```", source, "```", "")
    elif kind == "code":
        if shown and c.get("execution_count") is not None:
            yield from (f"**In [{c['execution_count']}]:**", "")
        if shown:
            yield from (f"```{language}", source, "```", "")
        outputs = [_output(o) for o in (c.get("outputs") if isinstance(c.get("outputs"), list) else []) if isinstance(o, dict)]
        text, more = clipped("\n".join(t for t, _ in outputs if t.strip()))
        if text:
            yield from ("Output:", "", "```", text, "```", *(["", "_(output truncated)_"] * more), "")
        for note in first_seen(n for _, notes in outputs for n in notes):
            yield from (note, "")


def read_notebook(data: bytes, charset: str | None = None) -> tuple[str, str | None]:
    """Cells in order, with the text of their outputs; the first level-one heading is the title."""
    raw = decoded(data, charset)
    try:
        notebook = json.loads(raw)
    except ValueError:
        return f"```json\n{raw.strip()}\n```\n", None
    cells = [c for c in notebook.get("cells") or [] if isinstance(c, dict)]
    language = kernel_language(notebook)
    headings = (line[2:].strip() for c in cells if c.get("cell_type") == "markdown" for line in joined(c.get("source")).strip("\n").split("\n") if line.startswith("# "))
    return "\n".join(line for c in cells for line in _cell_lines(c, language)).strip() + "\n", next(headings, None)
