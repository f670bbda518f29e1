"""Vector codes, lexical search and URL filters against plain versions, on odd rows and at their edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import lexical_search, vector_codes
from folioforge.llm.lexical_search import search
from folioforge.llm.url_filter import Rule, filter_urls
from folioforge.llm.vector_codes import encode, fit_codebooks, hex_code, nearest_entries, with_label_errors
from tests.llm.helpers import corpus, empty_documents, odd_documents, rows

VECTORS = "vec_id long, embedding array<float>, label int, codes string, error string"


def _plain_codes(kept, parts, entries, rounds):
    """kept: vec_id -> integers. Python ints, every distance in full."""
    ids = sorted(kept)
    d = len(kept[ids[0]]) // parts
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(kept[i], p) for i in ids[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for i in ids:
                held.setdefault(near(part(kept[i], p), books[p])[1], []).append(part(kept[i], p))
            for e, xs in held.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = {}
    for i in ids:
        found = [near(part(kept[i], p), books[p]) for p in range(parts)]
        out[i] = ([e for _, e in found], sum(x for x, _ in found))
    return books, out


def test_codes_against_every_distance(spark):
    rng = random.Random(5)
    data = [(i, [rng.choice([-0.5, 0.0, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([1, 2, None]), "x", "y") for i in range(150)]
    data += [(1000 + i, data[i][1], 3, None, None) for i in range(20)]  # copies, so ties
    df = spark.createDataFrame(data, VECTORS).repartition(5)
    books = fit_codebooks(df, parts=4, entries=16, rounds=6)
    kept = {r[0]: [math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in data}
    plain_books, plain = _plain_codes(kept, 4, 16, 6)
    assert books.tolist() == plain_books
    out = {r["vec_id"]: r for r in rows(with_label_errors(encode(df, books)))}
    assert {i: (r["codes"], r["error"]) for i, r in out.items()} == plain
    totals = Counter()
    for r in out.values():
        totals[r["label"]] += r["error"]
    assert all(r["label_error"] == totals[r["label"]] for r in out.values())


def test_partial_distances_keep_ties_low(spark):
    rng = np.random.default_rng(2)
    x, book = rng.integers(-4, 4, (2000, 3)), rng.integers(-4, 4, (16, 3))
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    at, best = nearest_entries(x, book)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
    far = np.full((3, 2), vector_codes.LARGEST)
    assert nearest_entries(far, -far[:1])[1].tolist() == [2 * (2 * vector_codes.LARGEST) ** 2] * 3


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0] * 8, 1, None, None), (1, [1.0] * 8, 1, None, None), (None, [0.5] * 8, None, None, None), (2, None, 1, None, None), (3, [], 1, None, None),
        (4, [1.0] * 7 + [None], 1, None, None), (5, [nan] * 8, 1, None, None), (6, [inf] + [0.0] * 7, 1, None, None), (7, [1.0] * 16, 1, None, None), (8, [1.0] * 5, 1, None, None), (9, [3e38] * 8, None, None, None),
    ]
    df = spark.createDataFrame(data, VECTORS)
    books = fit_codebooks(df, parts=8, entries=16, rounds=2)
    out = rows(with_label_errors(encode(df, books)).withColumn("code", hex_code(__import__("pyspark.sql.functions", fromlist=["col"]).col("codes"))))
    assert Counter(r["vec_id"] for r in out) == {1: 2, None: 1, 9: 1}
    assert all(r["error"] == 0 and len(r["code"]) == 16 for r in out)
    none = spark.createDataFrame([], VECTORS)
    assert fit_codebooks(none) is None and rows(with_label_errors(encode(none, None))) == []
    assert rows(encode(df, None)) == []


def _plain_search(docs, items, k):
    terms = lambda t: [] if t is None else re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in wanted.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(1, length)
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i, s))
        out += [(item, r, i, s) for r, (_, _, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("portion,block", [(8 << 20, 1 << 20), (300, 50)])
def test_search_against_plain(spark, monkeypatch, portion, block):
    monkeypatch.setattr(lexical_search, "PASS_CHARS", portion)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", block)
    docs = [(r[0], r[1]) for r in corpus()]
    rng = random.Random(1)
    items = [(j, " ".join(rng.choice(docs)[1].split()[:12] * rng.randint(1, 2))) for j in range(8)] + [(3, "the ing"), (None, "anan, ANAN!"), (50, None), (51, "nowhere"), (52, "")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k=7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, out), key=str) == _plain_search(docs, items, 7)


def test_search_on_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "one line word"), (2, "çödé"), (3, "password 345 ONE")], "item_id long, text string")
    got = sorted(map(tuple, search(docs, items, k=20).collect()), key=str)
    assert got == _plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "one line word"), (2, "çödé"), (3, "password 345 ONE")], 20)
    assert rows(search(empty_documents(spark), items)) == []
    assert rows(search(docs, items.where("false"))) == []


RULES = (Rule("allow", "org"), Rule("block", "bad.com"), Rule("allow", "bad.com", "/ok/"), Rule("block", "example.org", "/es/"))


def _verdicts(spark, pages, rules=RULES, redirects=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string, node string")
    if redirects:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    return {r["page_id"]: (r["verdict"], r["via"], r["rule"]) for r in rows(filter_urls(df, rules, redirects))}


def _page(i, url, head=""):
    return (i, url, f"<html><head>{head}</head><a href='https://bad.com/'>no</a></html>", "h", "v", "n")


def test_blocks_reach_aliases_but_not_what_is_allowed(spark):
    pages = [
        _page(1, "https://bad.com/a"),
        _page(2, "https://mirror.net/a", '<link REL="alternate canonical" href="https://bad.com/a?utm_source=x#f">'),
        _page(3, "http://third.net/b/c?q=1", "<META http-equiv=refresh content=\"0; URL='//mirror.net/a/'\">"),
        _page(4, "http://third.net/b/d", '<link rel=canonical href="./c?q=1&amp;utm_medium=z">'),
        _page(5, "https://fine.org/x", '<link rel="canonical" href="https://bad.com/a">'),
        _page(6, "https://www.mirror.net/a"),
        _page(7, "https://free.net/a", "<!-- <link rel=canonical href='https://bad.com/a'> --><script>'<link rel=canonical href=https://bad.com/a>'</script>"),
        _page(8, "https://sub.bad.com/ok/a"),
        _page(9, "https://hop1.net/"),
        _page(10, "https://notbad.com/", "<link rel=canonical href='mailto:a@bad.com'><link rel=canonical href='#top'><link rel=stylesheet href=https://bad.com/a>"),
        _page(11, "https://kids.net", '<link rel="canonical" href="/home">'),
        _page(12, "https://kids.net/home"),
    ]
    redirects = [("https://hop1.net", "https://hop2.net"), ("https://hop2.net/", "http://BAD.com/z"), (None, "https://bad.com/"), ("https://free.net/a", None)]
    got = _verdicts(spark, pages, redirects=redirects)
    assert got == {
        1: ("block", "rule", "bad.com/"), 2: ("block", "alias", None), 3: ("block", "alias", None), 4: ("block", "alias", None), 5: ("allow", "rule", "org/"), 6: ("block", "alias", None),
        7: ("allow", "default", None), 8: ("allow", "rule", "bad.com/ok/"), 9: ("block", "alias", None), 10: ("allow", "default", None), 11: ("allow", "default", None), 12: ("allow", "default", None),
    }


def test_many_rules_are_joined_alike(spark):
    pages = [_page(i, u) for i, u in enumerate(["https://a.bad.com/ok/x", "https://bad.com/no", "https://x.example.org/es/1", "https://x.example.org/en/", "https://h7.net/p/3", "https://w.h7.net/p", "http://bad.com", "x", ""])]
    more = (*RULES, *(Rule("block", f"h{i}.net", "/p/") for i in range(250)), Rule("allow", "h7.net", "/p/"))
    few = (*RULES, Rule("block", "h7.net", "/p/"), Rule("allow", "h7.net", "/p/"))
    assert _verdicts(spark, pages, more) == _verdicts(spark, pages, few)
    assert _verdicts(spark, pages, more)[4] == ("allow", "rule", "h7.net/p/")


def test_odd_urls(spark):
    pages = [(1, None, None, "", "", ""), (None, "https://Bad.COM:80/x", None, "", "", ""), (2, "no scheme", "<link rel=canonical href='https://bad.com/'>", "", "", ""), (3, "a://b://c/d", "", "", "", ""), (4, "", "", "", "", ""), (4, "", "", "", "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, verdict string, node string")
    got = {(r["page_id"], r["host"], r["path"], r["verdict"]) for r in rows(filter_urls(df, RULES))}
    assert got == {(1, "", "", "allow"), (None, "bad.com:80", "/x", "allow"), (2, "", "", "allow"), (3, "b:", "//c/d", "allow"), (4, "", "", "allow")}
    assert filter_urls(df, RULES).count() == 6 and rows(filter_urls(df.where("false"), RULES)) == []
    assert {r["verdict"] for r in rows(filter_urls(df, ()))} == {"allow"}
    assert filter_urls(df, RULES, html_col=None).count() == 6


def test_one_target_of_many_pages(spark):
    """A third of all pages name one canonical address; a chain hangs on it."""
    pages = [_page(i, f"https://n{i}.net/", "<link rel=canonical href=https://hub.net/>" if i % 3 == 0 else "") for i in range(600)]
    pages += [_page(1000 + i, f"https://c{i}.net/", f"<link rel=canonical href=https://c{i + 1}.net/>") for i in range(9)]
    got = _verdicts(spark, pages, redirects=[("https://hub.net", "https://c0.net"), ("https://c9.net", "https://bad.com/")])
    assert all((got[i][0] == "block") == (i % 3 == 0) for i in range(600)) and all(got[1000 + i][0] == "block" for i in range(9))
