"""Substring dedup by hashing runs of lines, and then windows of words for passages that start or end within a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import BROADCAST_ROWS, LOWER_BYTES, ascii_lower, cut, left_on_row, texts

#: A unit: a line with all ASCII marks and blanks after it, so up to the next word. Units cover the text.
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+"
UNIT = r"[^\n]*+" + MARKS

#: What separates words: ASCII other than letters and digits.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The bytes of words in lower-cased text, a number for each byte, and odd multipliers of the rolling hashes.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_M = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bits of the bitmap of fingerprints that occur more than once: 8 MB, however large the corpus.
BITMAP_BITS = 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    x = (x ^ (x >> np.uint64(29))) * _M[2]
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(by: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2^64, kept for the next batch."""
    if len(_POWERS.get(int(by), ((), ()))[0]) < n:
        power = lambda m: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, m, np.uint64))])
        _POWERS[int(by)] = power(by), power(np.uint64(pow(int(by), -1, 1 << 64)))
    return _POWERS[int(by)]


def _runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: np.uint64) -> np.ndarray:
    """Hashes of the runs of ``x`` from ``starts`` to ``ends`` (exclusive), by sums of prefixes modulo 2^64."""
    up, down = _powers(by, len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])])
    return _mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of some texts: row, number, first byte and hash of each, and the code points where it starts and where
    the next one does (or the text ends)."""

    def __init__(self, batch: list[str]):
        # a byte that is in no word stands between texts
        raw = [t.encode("utf-8", "surrogatepass").translate(LOWER_BYTES) for t in batch]
        b = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)]) + 1
        code_point = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        edge = np.flatnonzero(np.diff(_IN_WORD[b].view(np.int8))) + 1
        first, last = edge[::2], edge[1::2]
        self.words = _runs(_BYTE[b], first, last, _M[0])
        self.bounds = np.searchsorted(first, begin)
        self.row = np.repeat(np.arange(len(batch)), np.diff(self.bounds))
        self.base = code_point[begin]
        start = code_point[first]
        after = np.append(start[1:], 0)[: len(first)]
        full = np.flatnonzero(np.diff(self.bounds))
        after[self.bounds[full + 1] - 1] = self.base[full + 1] - 1
        self.start, self.after = start - self.base[self.row], after - self.base[self.row]
        ends = np.cumsum(b == 10)
        self.opens_line = np.append(True, ends[first[1:]] != ends[last[:-1] - 1])[: len(first)]

    def digests(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1, h2 = (_runs(self.words, at, end, m).view(np.int64) for m in (_M[2], _M[0]))
        return h1, h2

    def line_runs(self, passage: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and word after the last of the runs of whole lines: from each line as many as it takes to
        have ``passage`` words; and the shortest at the end of a text."""
        lines, stop = np.flatnonzero(self.opens_line), self.bounds[self.row + 1]
        at = np.append(lines, len(self.row))
        end = at[np.minimum(np.searchsorted(at, lines + passage), len(lines))]
        whole = end <= stop[lines] if len(lines) else np.zeros(0, bool)
        whole &= end - lines >= passage
        long = lines[stop[lines] - lines >= passage] if len(lines) else lines
        last = long[np.append(self.row[long][1:] != self.row[long][:-1], True)[: len(long)]] if len(long) else long
        start, end = np.append(lines[whole], last), np.append(end[whole], stop[last] if len(last) else last)
        return start, end


class Windows(Words):
    """The windows of ``passage`` words of some texts that hold a word outside the spans given (start, end in
    code points). place: the first word of each; fp: its fingerprint, which is the least hash of the runs of half as many
    words in it. Equal windows have equal fingerprints. ``first``: windows that are enough to tell which fingerprints lie
    in two places."""

    def __init__(self, batch: list[str], spans: list[list[tuple[int, int]]], passage: int):
        super().__init__(batch)
        row, absolute = self.row, self.start + self.base[self.row]
        gone = np.zeros(len(row) + 1, np.int64)
        for i, s in enumerate(spans):
            for lo, hi in s:
                gone[np.searchsorted(absolute, self.base[i] + lo)] += 1
                gone[np.searchsorted(absolute, self.base[i] + hi)] -= 1
        stays = np.concatenate([[0], np.cumsum(np.cumsum(gone)[:-1] == 0)])
        n, half = max(0, len(row) - passage + 1), (passage + 1) // 2
        self.place = at = np.flatnonzero((row[:n] == row[passage - 1 :][:n]) & (stays[passage:][:n] > stays[:n]))
        k = np.arange(max(0, len(row) - half + 1))
        least, wide, width = _runs(self.words, k, k + half, _M[1]), 1, passage - half + 1
        while wide < width:
            by = min(wide, width - wide)
            least, wide = np.minimum(least[:-by], least[by:]), wide + by
        self.fp = least[at].view(np.int64)
        new = np.append(True, (np.diff(self.fp) != 0) | (np.diff(at) != 1) | (np.diff(row[at]) != 0))[: len(at)]
        # one run of words is in ``width`` windows at most, so a fingerprint that holds on for longer is repeated
        index = np.arange(len(at))
        self.first = (index - np.maximum.accumulate(np.where(new, index, 0))) % width == 0


_OCCURRENCE = ["doc_id", "_th", "at", "start", "end", "h1", "h2"]


def _occurrences(ids: list[pa.Array], w: Words, at: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Runs of words as rows: where each lies in its text, and its digest."""
    row = w.row[at]
    place = [pa.array(x.astype(np.int32)) for x in (at - w.bounds[row], w.start[at], w.after[end - 1])]
    return pa.RecordBatch.from_arrays([*(i.take(pa.array(row)) for i in ids), *place, *map(pa.array, w.digests(at, end))], names=_OCCURRENCE)


def _occurrence_schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _th long, at int, start int, end int, h1 long, h2 long"


def _portions(b: pa.RecordBatch, chars: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """A batch of doc_id, _th, text, ..., about half a million code points at a time."""
    size = np.cumsum([len(t) for t in b.column(2).to_pylist()], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // chars)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
        yield b.slice(lo, hi - lo)


def _line_runs(rows: DataFrame, passage: int) -> DataFrame:
    """doc_id, _th, at, start, end, h1, h2 of the runs of lines of doc_id, _th, text."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _portions(b):
                w = Words(part.column(2).to_pylist())
                yield _occurrences([part.column(0), part.column(1)], w, *w.line_runs(passage))

    return rows.select("doc_id", "_th", "text").mapInArrow(runs, _occurrence_schema(rows))


def _windows_of(b: pa.RecordBatch, passage: int) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    """The windows of a batch of doc_id, _th, text, spans."""
    for part in _portions(b):
        spans = [[(s["start"], s["end"]) for s in r or ()] for r in part.column(3).to_pylist()]
        yield part, Windows(part.column(2).to_pylist(), spans, passage)


def _repeated_windows(rows: DataFrame, passage: int) -> DataFrame | None:
    """doc_id, _th, at, start, end, h1, h2 of the windows of doc_id, _th, text, spans that may occur more than
    once: of all that do, and of few others. None where no fingerprint occurs twice. Only
    fingerprints are shuffled; which of them are repeated is told by a bitmap of a set size."""
    spark = rows.sparkSession

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w in _windows_of(b, passage):
                yield pa.RecordBatch.from_arrays([pa.array(w.fp[w.first])], names=["fp"])

    twice = rows.mapInArrow(fingerprints, "fp long").groupBy("fp").count().where("count > 1")
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    packed = twice.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    if not packed.num_rows:
        return None
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[packed["word"].to_numpy()] = packed["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, w in _windows_of(b, passage):
                bit = w.fp.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
                on = np.flatnonzero((held.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                yield _occurrences([part.column(0), part.column(1)], w, w.place[on], w.place[on] + passage)

    return rows.mapInArrow(windows, _occurrence_schema(rows))


def _repeats(found: DataFrame, passage: int) -> DataFrame:
    """doc_id, _th, wins (array of start, end, keep_doc_id): the text under runs of words that the document of the
    least doc_id has too, or that an earlier place of this one has, ``passage`` words before or more."""
    found = cut(found)
    often = cut(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_doc_id")).where("n > 1").select("h1", "h2", "keep_doc_id"))
    # by document before anything is ranked: else the join could not be split where a run of words is very common
    found = found.join(often, ["h1", "h2"]).repartition("doc_id", "_th")
    own = F.col("doc_id").eqNullSafe(F.col("keep_doc_id"))
    since = F.col("at") - F.min("at").over(Window.partitionBy("doc_id", "_th", "h1", "h2"))
    found = found.withColumn("since", since).where(~own | (F.col("since") >= passage))
    line = Window.partitionBy("doc_id", "_th").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("island", F.sum(F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).over(line))
    found = found.groupBy("doc_id", "_th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("keep_doc_id", "start").alias("keep_doc_id"))
    return found.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "keep_doc_id"))).alias("wins"))


def repeated_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove passages of ``min_words`` words or more that an earlier document, or an earlier place of the same
    document, has already. Words are what ASCII letters and digits and all non-ASCII characters make up; they are
    compared after lower-casing A-Z, without the marks between them.

    Lines are hashed first, each with as many after it as it takes to have ``min_words`` words (and the last of a text so that they
    end it). Of the occurrences of such a run of lines that of the least doc_id stays, and in it the
    first; the rest goes. Then every window of ``min_words`` words, wherever in a line it starts and ends, goes in the same
    way: where the first occurrence is in another document, or in this one without overlap. Windows in what went
    already are not looked at again. So what goes is just this: every word in a window of ``min_words`` words that a
    document of a lesser doc_id has too, or this one at ``min_words`` words before or more.

    Returns one row for each row of ``docs``: doc_id, text (what stays), n_units (lines), n_removed (lines gone in whole or in
    part), removed (array of start, end in code points of the original text, end exclusive, words, keep_doc_id (of a document that
    has the first words of it); spans that touch are one). A span reaches up to the next word or the end of the text. A null or empty text has no units; blanks and
    marks before the first word never go. Rows that share a doc_id count as one document, so neither loses what the other
    has; null doc_ids come after all others. An empty table gives an empty result; other columns are ignored.

    128-bit digests and positions are shuffled, texts once at most. Counts and least ids are combined before
    the shuffle. Runs of lines and repeated digests are checkpointed, so that their join is one between plain shuffles,
    which AQE can split where one run is very common. Of windows only those are shuffled whose fingerprint
    is repeated; they and what is found are checkpointed. What is removed meets the texts by a broadcast
    where it is for few rows, and else by a shuffle of the texts, which are then checkpointed once.
    """
    base = texts(docs, id_col, text_col)
    id_type = base.schema["doc_id"].dataType.simpleString()
    kind = f"array<struct<start:int,end:int,keep_doc_id:{id_type}>>"
    lines = cut(_repeats(_line_runs(base, min_words), min_words)).withColumnRenamed("wins", "lines")
    out = left_on_row(base, F.broadcast(lines)) if lines.count() <= BROADCAST_ROWS else cut(left_on_row(base, lines))
    spans = F.transform("lines", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    windows = _repeated_windows(out.select("doc_id", "_th", "text", spans.alias("spans")), min_words)
    if windows is None:
        out = out.withColumn("wins", F.lit(None).cast(kind))
    else:
        wins = cut(_repeats(windows, min_words))
        out = left_on_row(out, F.broadcast(wins) if wins.count() <= BROADCAST_ROWS else wins)

    def join(s: Column, x: Column) -> Column:
        """Spans that meet or overlap become one, of the document of the first."""
        last = F.try_element_at(s, F.lit(-1))
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["keep_doc_id"].alias("keep_doc_id"))
        meets = (F.size(s) > 0) & (last["end"] >= x["start"])
        return F.when(meets, F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(one)).cast(kind)).otherwise(F.concat(s, F.array(x)).cast(kind))

    some = F.col("lines").isNotNull() | F.col("wins").isNotNull()
    out = out.withColumn("parts", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    both = F.array_sort(F.concat(F.coalesce(F.col("lines"), F.array()).cast(kind), F.coalesce(F.col("wins"), F.array()).cast(kind)))
    out = out.withColumn("both", F.when(some, F.aggregate(both, F.array().cast(kind), join)).otherwise(F.array().cast(kind)))
    piece = lambda start, end: F.substring(F.col("text"), start + 1, end - start)
    count = lambda t: F.size(F.filter(F.split(F.regexp_replace(ascii_lower(t), NO_WORD, " "), " "), lambda w: w != "")).cast("long")
    # before the text is replaced: a lambda would see the new one
    out = out.withColumn("removed", F.transform("both", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), count(piece(s["start"], s["end"])).alias("words"), s["keep_doc_id"].alias("keep_doc_id"))))
    starts = F.concat(F.array(F.lit(0)), F.transform("both", lambda s: s["end"]))
    ends = F.concat(F.transform("both", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, piece), "")
    in_span = lambda a, z: F.exists("both", lambda s: (s["start"] < z) & (s["end"] > a)).cast("int")
    touched = F.aggregate("parts", F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")), lambda s, x: F.struct((s["chars"] + F.length(x)).alias("chars"), (s["n"] + in_span(s["chars"], s["chars"] + F.length(x))).alias("n")), lambda s: s["n"])
    return out.select(
        "doc_id",
        F.when(some, kept).otherwise(F.col("text")).alias("text"),
        F.size(F.filter("parts", lambda x: x != "")).cast("long").alias("n_units"),
        F.when(some, touched).otherwise(0).cast("long").alias("n_removed"),
        "removed",
    )
