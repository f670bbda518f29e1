"""Scalar functions on vectors, and against plain Python."""

import re
import unicodedata

import pytest
from folioforge.functions import names, pages, text
from pyspark.sql import functions as F


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_safe_names(spark):
    vectors = {"../../etc/passwd": "passwd", "..\\..\\windows\\system32\\cmd.exe": "cmd.exe", "C:\\Users\\admin\\secret.docx": "secret.docx", ".hidden": "hidden", "": "document", None: "document", "CON.pdf": "CON_file.pdf", "LPT9.pdf": "LPT9_file.pdf", "a\x00b.md": "ab.md", "a  b\t.md": "a b_.md", 'x<>:"|?*.md': "x_______.md", "e\u0301.md": "é.md", "y" * 200 + ".md": "y" * 120 + ".md", "...": "document", "প্রতিবেদন.pdf": "প্রতিবেদন.pdf"}
    assert dict(zip(vectors, values(spark, names.safe_name, vectors), strict=True)) == {k: unicodedata.normalize("NFC", v) for k, v in vectors.items()}


def test_names(spark):
    assert values(spark, names.markdown_name, ["প্রতিবেদন.pdf", "a", "a.b.c"]) == ["প্রতিবেদন.md", "a.md", "a.b.md"]
    assert values(spark, names.ascii_name, ["প্রতিবেদন.md", "café.md", "a,b;c.md", None]) == ["download.md", "cafe.md", "a_b_c.md", None]
    assert values(spark, names.content_disposition, ["é x.md"]) == ["attachment; filename=\"e x.md\"; filename*=UTF-8''%C3%A9%20x.md"]
    assert values(spark, names.extension_of, ["a.PDF", "a", "a.tar.GZ"]) == [".pdf", "", ".gz"]
    unsafe = ["../../evil.csv", "/etc/passwd.csv", "C:/Windows/evil.csv", "..\\..\\evil.csv", "", ".", "a\x00b", "a/../b"]
    assert all(values(spark, names.unsafe_entry, unsafe)) and not any(values(spark, names.unsafe_entry, ["a/b.csv", "a..b/c.csv", "x.csv"]))


def test_page_ranges(spark):
    good = {"1-3,7": [1, 2, 3, 7], "5,1-2": [1, 2, 5], " 2 - 3 ": [2, 3], "": None, None: None, ",,": None}
    got = values(spark, pages.page_range, [*good])
    assert [g["pages"] for g in got] == [*good.values()] and not any(g["error"] for g in got)
    assert all(g["error"] and g["pages"] is None for g in values(spark, pages.page_range, ["0", "abc", "3-1", "-5", "1-999999", "1-400,300-600", "1,x"]))


def test_modes(spark):
    assert values(spark, pages.recognition_mode, [" FORCE", "off", "x", None]) == ["force", "off", "auto", "auto"]


def tidy_reference(md):
    """The rules of tidying, line by line."""
    md = unicodedata.normalize("NFC", md.replace("\r\n", "\n").replace("\r", "\n")).replace("\xa0", " ").replace("\ufeff", "")
    md = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", md)
    parts, prose, mark = [], [], ""
    for line in md.split("\n"):
        opens = re.match("```|~~~", line.strip())
        if not mark and opens:
            parts.append((False, prose))
            prose, mark = [line], opens[0]
        elif mark and line.strip().startswith(mark):
            parts.append((True, [*prose, line]))
            prose, mark = [], ""
        else:
            prose.append(line)
    if prose:
        parts.append((bool(mark), prose))

    def tidy(lines):
        out = []
        for line in lines:
            line = line.rstrip(" \t")
            m = re.match(r"(#{1,6})[ \t]*(\S.*?)[ \t]*#*$", line)
            line = f"{m[1]} {m[2]}" if m else line
            heading = re.match("#{1,6} ", line)
            for x in ([""] if heading and out and out[-1].strip() else []) + [line] + ([""] if heading else []):
                if x or not out or out[-1]:
                    out.append(x)
        return out

    joined = "\n".join("\n".join(x if code else tidy(x)) for code, x in parts)
    parts, prose, mark = [], [], ""
    for line in joined.split("\n"):
        opens = re.match("```|~~~", line.strip())
        if not mark and opens:
            parts.append((False, prose))
            prose, mark = [line], opens[0]
        elif mark and line.strip().startswith(mark):
            parts.append((True, [*prose, line]))
            prose, mark = [], ""
        else:
            prose.append(line)
    if prose:
        parts.append((bool(mark), prose))
    out = "\n".join("\n".join(x) if code else re.sub(r"\n{3,}", "\n\n", "\n".join(x)) for code, x in parts)
    return out.strip("\n") + "\n" if out.strip() else ""


TEXTS = ["", None, " \n\t", "#Title", "## Title ##", "a\n\n\n\nb", "a\r\nb\rc", "x\n# H\ny", "# A\n# B", "```\n# x\n\n\n\ny  \n```\nafter\n\n\n\n#h", "a\n~~~\n```\n~~~\nb", "```\nopen\n\n\n\n", "e\u0301\xa0\ufeff\x07x", "#!/bin/sh", "##", "#######x", "\n\n\na\n\n\n", "a\u2028b  \n c\x85", "  ```\ncode\n  ```\n```\ntwo\n```", "text\n```\nc\n```", "<script>x</script>"]


def test_normalize_against_line_rules(spark):
    assert values(spark, text.normalize_markdown, TEXTS) == [tidy_reference(t or "") for t in TEXTS]
    plain = [t for t in TEXTS if t is None or t.isascii()]
    assert values(spark, lambda c: text.normalize_markdown(c, unicode_form=False), plain) == [tidy_reference(t or "") for t in plain]


def test_measures(spark):
    inputs = ["a b\u2003c\x1cd\u00a0e", "", None, " x "]
    assert values(spark, text.word_count, inputs) == [len((t or "").split()) for t in inputs]
    assert values(spark, text.contains_raw_html, ["<IFRAME x", "a onclick = b", "JavaScript :x", "a < b", None]) == [True, True, True, False, False]
    assert values(spark, lambda c: text.cut_output(c, 10), ["short", "12345678\nabcdef", "1\n23456789012"]) == ["short", "12345678" + text.CUT_NOTICE, "1\n23456789"[:10] + text.CUT_NOTICE]


def test_lines_and_lists(spark):
    assert values(spark, text.join_lines, [["inter-", "national"], ["a", " ", "b"], ["x--", "y"], [], None], "array<string>") == ["international", "a b", "x-- y", "", ""]
    assert values(spark, text.list_item, ["• x", "(3) y", "১. z", "a. b", "1234. no", "- w ", "plain", "*no"]) == ["- x", "3. y", "১. z", "a. b", None, "- w", None, None]
    assert values(spark, text.humanize, ["snake_case-key", "_", "x"]) == ["Snake case key", "_", "X"]
    assert values(spark, text.extent_factor, ["Ag", "AB", "gap", "nice", "onus", "প্র", "agd"]) == [1.0, 0.78, 0.82, 0.58, 0.58, 1.0, 1.0]


@pytest.mark.parametrize(("ratio", "n", "s", "want"), [(1.7, 3, "Tall", 1), (1.4, 3, "x", 2), (1.22, 14, "x", 3), (2.0, 15, "x", None), (1.0, 3, "ALL CAPS", 2), (1.0, 3, "প্রতি", None), (1.0, 2, "AB", None)])
def test_headings(spark, ratio, n, s, want):
    df = spark.createDataFrame([(s, n, 10.0 * ratio, 10.0)], "t string, n int, h double, b double")
    assert df.select(text.heading_level(F.col("t"), F.col("n"), F.col("h"), F.col("b"))).first()[0] == want
