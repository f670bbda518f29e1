"""Markdown text as column expressions: tidying, measuring, classifying."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as risky markup, as a list mark or number, as a blank and as a control character decides flags, counts and Markdown that must
# be these, so the patterns RISKY_HTML, BLANK, BULLET and NUMBER and that of ``clean_characters`` must, too.
#: Markup that can run or embed something when rendered.
RISKY_HTML = r"(?i)<\s*(script|iframe|object|embed|svg|form|link|meta|base)\b|\son[a-z]+\s*=|javascript\s*:"
#: What str.split() of Python takes for blanks, beyond the ASCII ones.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CUT_NOTICE = "\n\n---\n\n_Output truncated: this document exceeded the size limit._\n"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no expression for it."""
    return s.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def stripped(c: Column) -> Column:
    """Without blanks at either end, of all kinds."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def clean_characters(c: Column) -> Column:
    """One kind of line end, no no-break space or byte-order mark, no control character but tab and newline."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, "\u00a0\ufeff", " ")
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def tidy_prose(c: Column) -> Column:
    """Trailing blanks go, headings read '## Title' and stand between blank lines, runs of blank lines
    become one. As lines: an empty one follows another only where the text has none between."""
    c = F.regexp_replace(c, r"(?md)[ \t]+$", "")
    c = F.regexp_replace(c, r"(?md)^(#{1,6})[ \t]*(\S.*?)[ \t]*#*$", "$1 $2")
    c = F.regexp_replace(c, r"([^\n])\n(?=#{1,6} )", "$1\n\n")
    c = F.regexp_replace(c, r"(?md)^(#{1,6} [^\n]*)$", "$1\n")
    c = F.regexp_replace(c, r"\A\n{2,}|\n{2,}\z", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\A\n\z", ""), r"\n{3,}", "\n\n")


FENCED = r"(?md)^[ \t]*(```|~~~)"


#: The mark of a fence at the start of a line, after spaces.
FENCE_MARK = r"^ *(```|~~~)"


def fence_segments(c: Column, mark: str = FENCE_MARK) -> Column:
    """array<struct<code, text, n_lines>>: prose and code by turns. A fence opens at a line that starts, after
    spaces, with ``` or ~~~ (or what group 1 of ``mark`` finds), and closes at the next line that starts with the same mark; an open one runs to the end.
    Prose before a fence at the start, or between two that meet, has no line; a text of '' with one line is an empty line.

    Only the lines with a mark are walked over, which gives where segments begin and end; each is then cut out of the lines as it is."""
    kind = "struct<open:string,since:int,done:array<struct<code:boolean,a:int,z:int>>>"
    part = lambda code, a, z: F.array(F.struct(code.alias("code"), a.alias("a"), z.alias("z")))
    state = lambda open_, since, done: F.struct(open_.alias("open"), since.alias("since"), done.alias("done")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        opened = state(x["mark"], x["i"], F.concat(s["done"], part(F.lit(False), s["since"], x["i"])))
        closed = state(F.lit(""), x["i"] + 1, F.concat(s["done"], part(F.lit(True), s["since"], x["i"] + 1)))
        return F.when(s["open"] == "", opened).when(s["open"] == x["mark"], closed).otherwise(s)

    def segments(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda v, i: F.struct(i.alias("i"), F.regexp_extract(v, mark, 1).alias("mark"))), lambda x: x["mark"] != "")
        last = lambda s: F.when(s["since"] < F.size(lines), F.concat(s["done"], part(s["open"] != "", s["since"], F.size(lines)))).otherwise(s["done"])
        bounds = F.aggregate(marks, state(F.lit(""), F.lit(0), F.array()), step, last)
        return F.transform(bounds, lambda b: F.struct(b["code"].alias("code"), F.array_join(F.slice(lines, b["a"] + 1, b["z"] - b["a"]), "\n").alias("text"), (b["z"] - b["a"]).alias("n_lines")))

    return let(F.split(c, "\n", -1), segments)


def outside_fences(c: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to prose alone. Texts without a fence, most of them, take the direct way."""
    parts = F.transform(fence_segments(c), lambda s: F.when(s["code"], s["text"]).otherwise(change(s["text"])))
    return F.when(c.rlike(FENCED), F.array_join(parts, "\n")).otherwise(change(c))


def normalize_markdown(c: Column, unicode_form: bool = True) -> Column:
    """Tidied Markdown that ends in one newline; '' where nothing but blanks is left, also for null.
    Without ``unicode_form`` the whole expression stays in the JVM. Each step is computed once: a step
    that uses the text of the one before several times gets it by ``let``."""
    c = F.coalesce(c, F.lit(""))
    c = let(clean_characters(nfc(c) if unicode_form else c), lambda x: outside_fences(x, tidy_prose))
    # seams between segments can bring back runs of blank lines; those inside a fence belong to the code
    c = let(c, lambda x: F.when(x.rlike(FENCED) & x.contains("\n\n\n"), outside_fences(x, lambda s: F.regexp_replace(s, r"\n{3,}", "\n\n"))).otherwise(x))
    return let(c, lambda x: F.when(x.rlike(r"^" + BLANK + r"*\z"), "").otherwise(F.concat(F.btrim(x, F.lit("\n")), F.lit("\n"))))


def contains_raw_html(c: Column) -> Column:
    return F.coalesce(c.rlike(RISKY_HTML), F.lit(False))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), BLANK + "+", -1), lambda x: x != "")).cast("long")


def character_count(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))).cast("long")


def cut_output(c: Column, limit: int) -> Column:
    """At most ``limit`` code points, cut at the last line end where that lies past the half, and a notice."""
    head = F.substring(c, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    head = F.when((F.instr(head, "\n") > 0) & (at > limit // 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(head, BLANK + r"+\z", ""), F.lit(CUT_NOTICE)))


def meaningful_text(c: Column, pages: Column, least: int) -> Column:
    """Whether a text layer has ``least`` code points a page or more."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANK}+|{BLANK}+\\z", "")) / F.greatest(pages, F.lit(1)) >= least


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as one: a single hyphen at the end of a line glues it to the next, else a space parts them."""
    def step(out: Column, line: Column) -> Column:
        x = F.trim(line)
        glued = F.concat(F.substring(out, F.lit(1), F.length(out) - 1), x)
        return F.when(x == "", out).when(out == "", x).when(out.endswith("-") & ~out.endswith("--"), glued).otherwise(F.concat_ws(" ", out, x))

    return F.aggregate(F.coalesce(lines, F.array().cast("array<string>")), F.lit(""), step)


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def humanize(c: Column) -> Column:
    """A key as a heading: marks become spaces and the first letter is capital, the rest as it is."""
    x = F.trim(F.translate(c, "_-", "  "))
    return F.when(x == "", c).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))


def local_name(c: Column) -> Column:
    return F.substring_index(c, "}", -1)


BULLET = r"^\s*([•▪●○◦⁃–—*+-])\s+"
NUMBER = r"^\s*\(?([0-9০-৯]{1,3}|[a-zA-Z])[.)]\s+"


def list_item(c: Column) -> Column:
    """A line that opens a list item as Markdown, else null."""
    rest = lambda p: F.trim(F.regexp_replace(c, p, ""))
    return F.when(c.rlike(BULLET), F.concat(F.lit("- "), rest(BULLET))).when(c.rlike(NUMBER), F.concat(F.regexp_extract(c, NUMBER, 1), F.lit(". "), rest(NUMBER)))


def extent_factor(c: Column) -> Column:
    """The part of a font's full height that a line's letters can take up."""
    deep, tall = c.rlike("[gjpqy]"), c.rlike(r"[bdfhklt]|\p{Lu}|\p{Nd}")
    return F.when(~c.rlike("[A-Za-z]") | (deep & tall), 1.0).when(tall, 0.78).when(deep, 0.82).otherwise(0.58)


def heading_level(c: Column, n_words: Column, height: Column, body: Column) -> Column:
    """1 to 3 by height against the body's; 2 for a short line in capitals; null for other lines."""
    ratio = height / F.when(body > 0, body)
    shout = (n_words <= 8) & c.rlike("[a-zA-Z]") & (c == F.upper(c)) & (F.length(c) >= 3)
    return F.when((n_words > 14) | ratio.isNull(), F.lit(None).cast("int")).when(ratio >= 1.70, 1).when(ratio >= 1.40, 2).when(ratio >= 1.22, 3).when(shout, 2)


def byte_size(n: Column) -> Column:
    """A number of bytes to read: 820 B, 4.2 MB, 12 KB."""
    power = F.when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), power)
    shown = F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.round(value).cast("long").cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", shown, F.get(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB")), power - 1)))


def duration(ms: Column) -> Column:
    """Milliseconds to read: 820ms, 8.2s, 2m 5s."""
    s = ms / 1000
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.format_string("%.1fs", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60), F.round(s % 60).cast("long")))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or f"{one}s"))


def badge(filename: Column) -> Column:
    """The extension in capitals, or FILE."""
    end = F.regexp_extract(filename, r"\.([^.]*)\z", 1)
    return F.when(end == "", "FILE").otherwise(F.upper(end))
