"""File names as column expressions."""

from __future__ import annotations

import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.text import BLANK, let, nfc
from folioforge.registry import ALIASES, HINTS

ILLEGAL = r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]'
#: Names of devices that can't be files.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
STEM_CHARS, EXTENSION_CHARS, NAMELESS = 120, 16, "document"


def base_name(c: Column) -> Column:
    """The last component under either separator, whatever drive or folders come before."""
    c = F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), r"[/\\]+\z", "")
    return F.regexp_replace(F.regexp_extract(c, r"[^/\\]*\z", 0), r"^[A-Za-z]:", "")


def safe_name(c: Column, unicode_form: bool = True) -> Column:
    """A name without folders, control or reserved characters, leading dots or device names."""
    x = base_name(F.coalesce(c, F.lit("")))
    x = nfc(x) if unicode_form else x
    x = F.regexp_replace(F.regexp_replace(x, ILLEGAL, "_"), BLANK + "+", " ")
    return let(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\.+", ""), r"[. ]+\z", ""), _shortened)


def _shortened(x: Column) -> Column:
    dotted = F.instr(x, ".") > 0
    stem = F.when(dotted, F.regexp_replace(x, r"\.[^.]*\z", "")).otherwise(x)
    extension = F.when(dotted, F.substring(F.substring_index(x, ".", -1), 1, EXTENSION_CHARS)).otherwise("")
    stem = let(stem, lambda s: F.when(s.rlike(RESERVED), F.concat(s, F.lit("_file"))).when(s == "", NAMELESS).otherwise(s))
    stem = let(stem, lambda s: F.when(F.length(s) > STEM_CHARS, F.regexp_replace(F.substring(s, 1, STEM_CHARS), r"[. ]+\z", "")).otherwise(s))
    return F.when(x == "", NAMELESS).when(extension != "", F.concat_ws(".", stem, extension)).otherwise(stem)


def extension_of(safe: Column) -> Column:
    """Of a safe name: its extension with the dot in lower case, or ''."""
    return F.lower(F.regexp_extract(safe, r"\.[^.]+\z", 0))


def markdown_name(safe: Column) -> Column:
    """A safe name with .md in the place of its extension, or after it where it has none."""
    stem = F.regexp_replace(safe, r"\.[^.]*\z", "")
    return F.concat(F.when(stem == "", safe).otherwise(stem), F.lit(".md"))


def canonical_extension(c: Column) -> Column:
    """One spelling for each format."""
    x = F.lower(c)
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.coalesce(F.element_at(table, x), x)


def hint_for(extension: Column) -> Column:
    """What to tell about a format that can't be read."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in HINTS.items() for v in kv]), extension)


def unsafe_entry(c: Column) -> Column:
    """Whether an archive's entry name could leave the folder it is put in."""
    flat = F.replace(c, F.lit("\\"), F.lit("/"))
    odd = c.isNull() | c.isin("", ".", "..") | (F.instr(c, "\x00") > 0)
    return odd | flat.startswith("/") | flat.rlike(r"(?s)^.:") | F.exists(F.split(flat, "/"), lambda p: p == "..")


@F.pandas_udf(StringType())
def ascii_name(s: pd.Series) -> pd.Series:
    """A name for headers that carry ASCII alone; a stem of which nothing is left is 'download'."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        flat = re.sub(ILLEGAL, "_", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode())
        stem, dot, end = re.sub("[,;]", "_", flat).strip().rpartition(".")
        stem = (stem if dot else end).strip(". ") or "download"
        return f"{stem}.{end}" if dot and end else stem

    return s.map(one)


@F.pandas_udf(StringType())
def content_disposition(s: pd.Series) -> pd.Series:
    """Attachment header of a name: plain ASCII and percent-encoded UTF-8."""
    plain = ascii_name.func(s)
    return pd.Series([None if n is None else f"attachment; filename=\"{p}\"; filename*=UTF-8''{urllib.parse.quote(n, safe='')}" for n, p in zip(s, plain, strict=True)], dtype=object)
