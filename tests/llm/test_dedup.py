"""Line, near, substring and exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from folioforge.llm.exact_dedup import CountingQuotientFilter, drop_exact_duplicates, exact_groups, repeated_fingerprints
from folioforge.llm.line_dedup import drop_frequent_lines
from folioforge.llm.near_dup import banding, link_components, near_duplicates, shingles
from folioforge.llm.substring_dedup import repeated_passages

from tests.llm.helpers import corpus, empty_documents, odd_documents, rows

BLANKS = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_line_dedup_against_brute_force(spark):
    data = corpus()
    keys = {d: [lower(x).strip(BLANKS) for x in t.split("\n")] for d, t, *_ in data}
    seen = Counter(k for v in keys.values() for k in set(v))
    got = {r["doc_id"]: r for r in rows(drop_frequent_lines(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), 10))}
    assert any(r["n_dropped"] for r in got.values())
    for d, t, *_ in data:
        keep = [x for x, k in zip(t.split("\n"), keys[d], strict=True) if not k or seen[k] < 10]
        assert got[d]["text"] == "\n".join(keep) and got[d]["n_lines"] == len(keys[d]) and got[d]["n_dropped"] == len(keys[d]) - len(keep)


def test_line_dedup_odd_rows(spark):
    got = rows(drop_frequent_lines(odd_documents(spark), min_docs=3))
    assert len(got) == 9
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[2][0]["n_lines"] == 1 and by[2][0]["text"] == "" and by[2][0]["n_dropped"] == 0
    assert [r["n_dropped"] for r in by[1]] == [2, 2] and by[None][0]["n_dropped"] == 2 and by[None][0]["text"] == ""
    assert rows(drop_frequent_lines(empty_documents(spark))) == []


def test_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 20, 5000).astype(np.uint64) for _ in range(2))
    f = CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(a, 44).to_bytes())
    keys, counts = f.items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(a.tolist())
    whole = CountingQuotientFilter.merge([f, CountingQuotientFilter.build(b, 44)], 44)
    keys, counts = whole.items()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(a.tolist()) + Counter(b.tolist())
    three = [rng.integers(0, 1 << 9, k).astype(np.uint64) for k in (0, 1, 900)]
    keys, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(x, 60).to_bytes()) for x in three], 60).items()
    assert keys.tolist() == sorted(set(np.concatenate(three).tolist())) and counts.sum() == 901
    # dense as it is in a merge, a filter is smaller than the fingerprints; of a few of a range each, it is larger
    wide = rng.integers(0, 1 << 56, 20000, dtype=np.uint64)
    assert len(CountingQuotientFilter.build(wide, 56).to_bytes()) < 7 * 20000 and len(CountingQuotientFilter.build(wide[:1], 56).to_bytes()) <= 17
    empty = CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(np.zeros(0, np.uint64), 44).to_bytes())
    assert len(empty.items()[0]) == 0


def test_repeated_fingerprints(spark):
    values = [5, -5, 7, 5, 1 << 62, -5, -5]
    got = rows(repeated_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long").repartition(3), len(values)))
    assert {r["fp"]: r["n"] for r in got} == {5: 2, -5: 3}


def test_exact_groups(spark):
    data = corpus()
    of = defaultdict(list)
    for d, t, *_ in data:
        of[lower(t)].append(d)
    got = rows(exact_groups(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")))
    assert len(got) == len(data) and any(r["group_size"] > 1 for r in got)
    text = {d: t for d, t, *_ in data}
    for r in got:
        same = of[lower(text[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))
        assert r["text_sha256"] == hashlib.sha256(lower(text[r["doc_id"]]).encode()).hexdigest()


def test_exact_odd_rows(spark):
    got = rows(exact_groups(odd_documents(spark)))
    assert len(got) == 9
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3, None)} == {(1, 1, 3, True), (None, 1, 3, False), (2, 3, 2, False), (3, 3, 2, True)}
    kept = rows(drop_exact_duplicates(odd_documents(spark)))
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5, 6, 7] and set(kept[0]) == set(odd_documents(spark).columns)
    assert rows(exact_groups(empty_documents(spark))) == [] and rows(drop_exact_duplicates(empty_documents(spark))) == []


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, size, percent):
    data = corpus(seed=5, n=150)
    sets = {}
    for d, t, *_ in data:
        w = re.split(r"[\x20\x09-\x0D]+", lower(t).strip(BLANKS))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), size, percent))
    assert len(got) == len(data) and any(not r["kept"] for r in got)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["doc_id"] == root(r["doc_id"]))


def test_near_duplicates_large_group_in_blocks(spark, monkeypatch):
    """Copies of one text, each with its own change, and a second such group: buckets of several blocks."""
    import folioforge.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 8)
    base = [[f"w{g}x{i}" for i in range(60)] for g in range(2)]
    data = [(100 * g + k, " ".join(w if i != k else "other" for i, w in enumerate(base[g]))) for g in range(2) for k in range(40)]
    sets = {d: set(shingles(t).tolist()) for d, t in data}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: root(d) for d in sets}


def test_near_duplicates_odd_rows(spark):
    got = rows(near_duplicates(odd_documents(spark)))
    assert len(got) == 9
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[2][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2 and by[2][0]["kept"] and by[7][0]["n_shingles"] == 0
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert rows(near_duplicates(empty_documents(spark))) == []


def test_banding_misses_few_pairs_at_the_threshold():
    for s in (0.8, 0.85, 0.9):
        r, b = banding(s)
        assert r * b <= 180 and (1 - s**r) ** b <= 1e-6


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in rows(link_components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200
    assert rows(link_components(spark.createDataFrame([], "a long, b long"))) == []


def brute_passages(data, n):
    """What must go, from the definition: of every text the spans (start, end) of words that lie in a window of n words
    which a lesser doc_id has too, or the same text n words before or more. Spans that touch are one."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {d: list(word.finditer(lower(t))) for d, t in data}
    where = defaultdict(list)
    for d, m in found.items():
        for i in range(len(m) - n + 1):
            where[tuple(x.group() for x in m[i : i + n])].append((float("inf") if d is None else d, i))
    out = {}
    for d, t in data:
        m, me = found[d], float("inf") if d is None else d
        gone = [False] * len(m)
        for i in range(len(m) - n + 1):
            if any(o < me or (o == me and k <= i - n) for o, k in where[tuple(x.group() for x in m[i : i + n])]):
                gone[i : i + n] = [True] * n
        spans = []
        for i, g in enumerate(gone):
            if g:
                start, end = m[i].start(), m[i + 1].start() if i + 1 < len(m) else len(t)
                spans = [*spans[:-1], (spans[-1][0], end)] if spans and spans[-1][1] == start else [*spans, (start, end)]
        out[d] = spans
    return out


def assert_as_brute(data, got, n):
    want = brute_passages([(d, t or "") for d, t in data], n)
    for d, t in data:
        t = t or ""
        assert [(s["start"], s["end"]) for s in got[d]["removed"]] == want[d], d
        assert got[d]["text"] == "".join(t[a:b] for a, b in zip([0, *(e for _, e in want[d])], [*(a for a, _ in want[d]), len(t)], strict=True))
        assert got[d]["n_removed"] <= got[d]["n_units"] and (got[d]["n_removed"] > 0) == bool(want[d])


def test_repeated_passages(spark):
    passage = " ".join(f"Alpha{i} beta gamma delta epsilon zeta{i}." for i in range(8))
    data = [
        (1, "First words.\n" + passage + "\nLast words here."),
        (2, " - Others stand here.\n" + passage.upper().replace(" ", "  ") + "\n\n * And an end."),
        (3, "First words. Something else. Last words here."),
        (4, "\t" + passage.replace("gamma", "gamma,") + "\n" + passage),
        (5, None),
        (6, ""),
        (None, passage),
        (8, "\n".join(passage.split(". "))),
    ]
    got = {r["doc_id"]: r for r in rows(repeated_passages(spark.createDataFrame(data, "doc_id long, text string"), min_words=40))}
    assert_as_brute(data, got, 40)
    assert got[1]["text"] == data[0][1] and got[3]["text"] == data[2][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == " - Others stand here.\nAnd an end." and got[4]["text"] == "\t" and got[None]["text"] == "" and got[8]["text"] == ""
    span = got[2]["removed"][0]
    assert span["keep_doc_id"] == 1 and span["words"] == 48 and (got[2]["n_units"], got[2]["n_removed"], got[8]["n_removed"]) == (3, 1, 8)
    assert got[5]["text"] == "" and got[5]["n_units"] == 0 and got[6]["removed"] == []


@pytest.mark.parametrize("n", [4, 10, 25])
def test_passages_against_brute_force(spark, n):
    data = [(d, t) for d, t, *_ in corpus(seed=9)]
    got = {r["doc_id"]: r for r in rows(repeated_passages(spark.createDataFrame(data, "doc_id long, text string"), min_words=n))}
    assert any(r["n_removed"] for r in got.values()) and any(not r["n_removed"] for r in got.values())
    assert_as_brute(data, got, n)


def test_passages_odd_rows(spark):
    got = rows(repeated_passages(odd_documents(spark), min_words=1))
    assert len(got) == 9
    assert {r["doc_id"]: r["text"] for r in got}[None] == ""
    # of the long text one of its two different words stays, as it has no earlier place
    assert [r["removed"] for r in got if r["doc_id"] == 1][0] == [r["removed"] for r in got if r["doc_id"] == 1][1]
    assert rows(repeated_passages(empty_documents(spark))) == []


def test_sketches_estimate_and_lose_no_similar_pair():
    """Sets of any size near the threshold: the estimate is close, and what it drops is far below."""
    from folioforge.llm.near_dup import Hashes

    rng, hashes, dropped, errors = np.random.default_rng(5), Hashes(0.85), 0, []
    for n in (2, 7, 40, 300, 1700, 4000, 9000):
        for share in (0.3, 0.5, 0.86, 0.95):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            k = round(2 * share * n / (1 + share))
            b = np.concatenate([a[:k], rng.integers(0, 1 << 63, n - k, dtype=np.uint64)])
            true = k / (2 * n - k)
            x, y = (np.frombuffer(hashes.sketch(hashes.samples(np.sort(s))), np.uint64) for s in (a, b))
            assert hashes.close(x, y) or true < 0.85
            dropped += not hashes.close(x, y)
            if true >= 0.85:
                errors.append(abs(hashes.estimate(np.bitwise_count(x ^ y).sum()) - true))
    assert dropped >= 12 and max(errors) < 0.12


def components_by_all_pairs(data, size, percent):
    sets = {d: set(shingles(t, size).tolist()) for d, t in data}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("edits", [(9, 13), (17, 23)])
def test_loose_groups_give_no_more_rows_than_members(spark, monkeypatch, edits):
    """Edits of one text, pairs just above and just below the threshold, in blocks: components are those of all
    pairs, and what the comparing passes give out is at most what they read."""
    import folioforge.llm.near_dup as module

    rng, counts = random.Random(11), {}
    base = [f"w{i}" for i in range(300)]
    data = []
    for d in range(150):
        w = list(base)
        for i in rng.sample(range(300), rng.randint(*edits)):
            w[i] = f"x{d}y{i}"
        data.append((d, " ".join(w)))
    for name in ("_candidates", "_linked"):

        def counted(cells, how, name=name, real=getattr(module, name)):
            out = real(cells, how).cache()
            counts[name] = (cells.count(), out.count())
            return out

        monkeypatch.setattr(module, name, counted)
    monkeypatch.setattr(module, "BLOCK", 32)
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 32 * 300)
    got = rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 5, 80))
    want = components_by_all_pairs(data, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values()))
    assert all(given <= read for read, given in counts.values())


def test_passages_within_sentences(spark):
    """Passages of exactly 50 words and more that start and end within sentences, with few or no whole units."""
    rng = random.Random(4)
    words = lambda k: [rng.choice("aeiou") + str(rng.randrange(10**6)) for _ in range(k)]
    shared, short = " ".join(words(20)) + ". Ünï " + " ".join(words(9)) + ".\n" + " ".join(words(20)), " ".join(words(49))
    data = [(k, "😀 Own " + " ".join(words(30 + k)) + " " + x + " " + " ".join(words(25)) + ".") for k, x in enumerate([shared, re.sub("[a-z]", lambda m: m[0].upper(), shared), short, short, shared.replace(" ", ", ")])]
    data.append((9, " ".join([short, "one", short, "one two."])))
    got = {r["doc_id"]: r for r in rows(repeated_passages(spark.createDataFrame(data, "doc_id long, text string")))}
    assert [got[k]["text"] == t for k, t in data] == [True, False, True, True, False, False]
    assert_as_brute(data, got, 50)
    for k in (1, 4):
        (s,) = got[k]["removed"]
        text = dict(data)[k]
        assert re.split(r"[ .,\n]+", lower(text[s["start"] : s["end"]]).strip()) == re.split(r"[ .,\n]+", lower(shared))
        assert (s["words"], s["keep_doc_id"], got[k]["n_removed"]) == (50, 0, 2) and got[k]["text"] == text[: s["start"]] + text[s["end"] :]
    assert got[9]["removed"][0]["words"] == 50


@pytest.mark.parametrize("fresh", [True, False])
def test_rows_dealt_grow_with_the_members_of_a_crowded_bucket(spark, monkeypatch, fresh):
    """Texts of one template, each with edits of its own (``fresh``) or of a small vocabulary, that stay below the threshold, and
    a few with a near copy: components are those of all pairs, and four times the members give about four times the rows."""
    import folioforge.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "CROWD", 2)
    real, dealt = module._cells, {}
    for n in (150, 600):
        rng, data, counts = random.Random(n), [], []
        for d in range(n):
            w = [f"w{i}" for i in range(120)]
            for i in range(rng.randrange(12), 120, 14):
                w[i] = f"x{d}y{i}" if fresh else f"x{rng.randrange(200)}"
            data.append((d, " ".join(w)))
            if d % 50 == 7:
                data.append((100000 + d, " ".join([*w[:-1], "last"])))

        def counted(held, open_, capacity):
            out = real(held, open_, capacity).cache()
            counts.append(out.count())  # noqa: B023
            return out

        monkeypatch.setattr(module, "_cells", counted)
        got = rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 75))
        want = components_by_all_pairs(data, 3, 75)
        assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == n
        assert len(counts) == 3, "the bucket wasn't crowded"
        dealt[n] = sum(counts)
    assert dealt[600] <= 6 * dealt[150] + 600, dealt


def test_rare_shingles_meet_every_pair_at_the_threshold(spark):
    """Sets of all sizes over few shingles: each pair that reaches the threshold has a shingle in common where one is active."""
    from folioforge.llm.near_dup import _rare_shingles

    rng = np.random.default_rng(9)
    sets = {}
    for i in range(160):
        s = rng.choice(60, int(rng.integers(1, 30)), replace=False) if i % 3 or i < 3 else np.append(sets[i - 1][:-1], 100 + i)
        sets[i] = np.sort(np.unique(s))
    data = spark.createDataFrame([(i, bytearray(s.astype(np.uint64).tobytes())) for i, s in sets.items()], "node long, s binary")
    for percent in (50, 80, 85, 100):
        at = {}
        for r in rows(_rare_shingles(data, percent)):
            at.setdefault(r["node"], {})[r["h"]] = r["passive"]
        pairs = 0
        for a in sets:
            for b in sets:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    pairs += 1
                    x, y = at.get(a, {}), at.get(b, {})
                    assert any(not (x[h] and y[h]) for h in set(x) & set(y)), (a, b, percent)
        assert pairs or percent == 100
