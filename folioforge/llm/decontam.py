"""Benchmark decontamination by one automaton over the windows of normalised test items."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z lower-cased; every byte that no word has becomes a space. Bytes above 0x7F belong to words. Lengths stay, so offsets do.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    """The text's UTF-8 bytes, normalised in place, and the words in them."""
    flat = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    return flat, flat.split()


class BenchmarkItems:
    """The automaton over normalised test items, and the windows of these that its matches lead to.

    Every window of ``window`` words of an item holds a whole block of half as many, of those that lie one after another from the item's
    first word. So the automaton's patterns are these blocks, and items shorter than a window as they are: about one node a
    character of the items, where the windows themselves would take ``window`` times as many. Where a block occurs in a text, the
    windows around it are looked up by their 128-bit digests, each once."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.block = window, (window + 1) // 2
        patterns: dict[bytes, tuple[bool, list[int]]] = {}
        digests, of = [], []
        for i, text in enumerate(texts):
            words = text.split()
            if 0 < len(words) < window:
                key = b" ".join(words)
                whole, items = patterns.get(key, (False, []))
                patterns[key] = whole, [*items, i]
            for p in range(0, len(words) - self.block + 1 if len(words) >= window else 0, self.block):
                key = b" ".join(words[p : p + self.block])
                patterns[key] = True, patterns.get(key, (False, []))[1]
            each = {xxhash.xxh3_128_digest(b" ".join(words[p : p + window])) for p in range(len(words) - window + 1)}
            digests += each
            of += [i] * len(each)
        # bytes are read as Latin-1, one character a byte
        self.automaton = ahocorasick.Automaton()
        for w, (block, items) in patterns.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), block, items))
        if patterns:
            self.automaton.make_automaton()
        key, self.items = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), np.array(of, np.int64)
        order = np.lexsort((self.items, key[:, 1], key[:, 0]))
        self.high, self.low, self.items = key[order, 0], key[order, 1], self.items[order]

    def with_window(self, words: list[bytes]) -> list[int]:
        """The items that have this window."""
        high, low = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.uint64)
        a, z = np.searchsorted(self.high, high), np.searchsorted(self.high, high, "right")
        return self.items[a:z][self.low[a:z] == low].tolist()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Words of the text; the runs (first word, word after the last) that windows cover, in order
        and apart; the items whose windows occur. The text is normalised and passed through once."""
        _, words = words_of(text)
        if not len(self.automaton):
            return len(words), [], []
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return len(words), [], []
        begins = np.concatenate([[1], 1 + np.cumsum(np.array([len(w) + 1 for w in words]))]).tolist()
        hits, seen, looked = [], set(), set()
        for end, (size, block, items) in found:
            lo = bisect_left(begins, end - size)
            if items:
                hits.append((lo, bisect_right(begins, end - 1)))
                seen.update(items)
            for s in range(max(0, lo + self.block - self.window), min(lo, len(words) - self.window) + 1) if block else ():
                if s not in looked:
                    looked.add(s)
                    if of := self.with_window(words[s : s + self.window]):
                        hits.append((s, s + self.window))
                        seen.update(of)
        runs: list[tuple[int, int]] = []
        for lo, hi in sorted(hits):
            if runs and lo <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
            else:
                runs.append((lo, hi))
        return len(words), runs, sorted(seen)


_built: dict[str, BenchmarkItems] = {}


def _opened(key: str, texts: list[bytes], window: int) -> BenchmarkItems:
    """Built once in each Python worker, and kept for its next batches and tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = BenchmarkItems(texts, window)
    return _built[key]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code-point offsets in the text as it came of runs of words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    in_word = np.frombuffer(words_of(text)[0], np.uint8) != 32
    edges = np.flatnonzero(np.diff(in_word.astype(np.int8), prepend=0, append=0))
    # code points before each byte: all bytes but those that continue one
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = before[edges].reshape(-1, 2).tolist()
    return [{"start": chars[lo][0], "end": chars[hi - 1][1]} for lo, hi in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of each text that lie in a window of ``window`` consecutive words of a test item (an item
    of fewer words is one window), after lower-casing A-Z and taking runs of ASCII letters and digits
    and of all non-ASCII characters as words.

    Returns all columns of ``docs``, one row for each of its rows, with n_words, n_hit (words inside
    an occurrence), n_items, items (ids with occurring windows, sorted as strings), spans (code-point
    offsets in the original text) and contaminated: n_hit > 0 and ``share`` * n_hit >= n_words. A column
    of ``docs`` with such a name is replaced. A null or empty text has no words. Items whose id or text
    is null or has no word are skipped; items that share an id count once. Rows may repeat; an empty
    table gives an empty result, an empty benchmark no hits.

    The benchmark, not the corpus, must fit in memory: its normalised texts are broadcast as they are, and each
    Python worker builds one automaton of them, whatever their size. All texts are scanned with it in one pass, without a shuffle.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null")
    names, known = [], []
    for r in items.toLocalIterator():
        if words := words_of(r["t"])[1]:
            names.append(r["i"])
            known.append(b" ".join(words))
    key = hashlib.sha256(repr((window, len(known))).encode() + b"\n".join(known)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    new = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "spans": SPANS, "contaminated": "boolean"}
    held = docs.drop(*new)
    at = held.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            test = _opened(key, shared.value, window)
            out: dict[str, list] = {k: [] for k in new}
            for text in b.column(at):
                text = text.as_py()
                n, runs, found = test.scan(text)
                hit, ids = sum(hi - lo for lo, hi in runs), sorted({names[k] for k in found})
                values = (n, hit, len(ids), ids, original_spans(text, runs) if runs else [], hit > 0 and share * hit >= n)
                for k, v in zip(new, values, strict=True):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=[*b.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), *(f"{k} {v}" for k, v in new.items())])
    return held.mapInArrow(run, schema)
