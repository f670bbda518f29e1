"""Exact dedup by counting quotient filters that merge without loss, then byte verification."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, cut, texts, without

#: Bits, bits of a quotient, bytes of a remainder, slots.
_HEAD = struct.Struct("<BBBI")
#: A set of repeated fingerprints of at most so many rows (8 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000
#: Likewise of groups of equal texts (some 120 bytes each).
BROADCAST_GROUPS = 200_000


class CountingQuotientFilter:
    """Multiset of ``bits``-bit fingerprints. The high ``q`` bits of a fingerprint, its quotient,
    say to which run it belongs and aren't stored: a bit for each quotient says whether it has a run
    (occupied), and a bit for each slot whether it ends one (run end). The low bits, its remainder,
    lie in the slots, sorted within each run. A third bit marks the slots with a count above one,
    whose counts follow in slot order. No fingerprint is lost, so filters merge exactly."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, repeated: np.ndarray, counts: np.ndarray):
        self.bits, self.q = bits, q
        self.occupied, self.run_end, self.remainders, self.repeated, self.counts = occupied, run_end, remainders, repeated, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        """fingerprints: uint64 below 2**bits, in any order and with repeats."""
        return cls.of_sorted(*np.unique(fingerprints, return_counts=True), bits)

    @classmethod
    def of_sorted(cls, unique: np.ndarray, total: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of distinct fingerprints in order, and the count of each."""
        total = total.astype(np.int64)
        q = min(bits - 1, max(1, int(len(unique)).bit_length()))
        r = np.uint64(bits - q)
        quotients = (unique >> r).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_end = np.append(quotients[1:] != quotients[:-1], len(unique) > 0)[: len(unique)]
        return cls(bits, q, occupied, run_end, unique & np.uint64((1 << int(r)) - 1), total > 1, total[total > 1])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and the count of each."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64) if len(self.run_end) else np.zeros(0, np.int64)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.repeated] = self.counts
        return (quotients[run] << np.uint64(self.bits - self.q)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        """Seven bytes of a head, the bits, remainders in as many whole bytes as they need, and counts above one."""
        width = (self.bits - self.q + 7) // 8
        flags = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.repeated)]
        remainders = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join((_HEAD.pack(self.bits, self.q, width, len(self.remainders)), *flags, remainders.tobytes(), self.counts.astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, width, n = _HEAD.unpack_from(data)
        at, flags = _HEAD.size, []
        for size in (1 << q, n, n):
            flags.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(bits, q, flags[0], flags[1], remainders.view("<u8").reshape(n).astype(np.uint64), flags[2], np.frombuffer(data, "<i8", -1, at + n * width).astype(np.int64))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """Union of multisets. Runs follow one another by quotient and remainders are sorted within each, so a
        filter is read in the order of its fingerprints; two and two are merged in that order, and equal ones add their counts."""
        parts = [f.items() for f in filters]
        while len(parts) > 1:
            parts = [_merged(*parts[i], *parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return cls.of_sorted(*parts[0], bits) if parts else cls.build(np.zeros(0, np.uint64), bits)


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct fingerprints, with their counts, as one."""
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside]
    n = n.copy()
    n[at[same]] += m[same]
    return np.insert(a, at[~same], b[~same]), np.insert(n, at[~same], m[~same])


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int, rows_per_range: int = 1 << 22) -> DataFrame:
    """fp, n: the values of the long column ``fp`` that more than one row has. Every partition builds
    a filter for each range of fingerprints; those of a range are merged in one task. A range holds about
    ``rows_per_range`` rows, some 40 MB of filters, so ranges are as few as memory lets them be and filters as dense. Equal
    fingerprints are one counted slot already in the filter of a partition, so a value with a third of all rows is no heavier than another."""
    g = max(4, int(n_rows // rows_per_range).bit_length())
    bits = 64 - g

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, held = [], [], 0
        for b in batches:
            u, c = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            parts.append(u)
            counts.append(c)
            held += len(u)
            if held > 4_000_000:
                yield from pieces(parts, counts)
                parts, counts, held = [], [], 0
        if parts:
            yield from pieces(parts, counts)

    def pieces(parts: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = list(zip(parts, counts, strict=True))
        while len(held) > 1:
            held = [_merged(*held[i], *held[i + 1]) if i + 1 < len(held) else held[i] for i in range(0, len(held), 2)]
        fp, n = held[0]
        ranges = fp >> np.uint64(bits)
        ids, first = np.unique(ranges, return_index=True)
        ends = [*first[1:], len(fp)]
        for lo in range(0, len(ids), 256):
            out = [CountingQuotientFilter.of_sorted(fp[s:e] & np.uint64((1 << bits) - 1), n[s:e], bits).to_bytes() for s, e in zip(first[lo : lo + 256], ends[lo : lo + 256], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256].astype(np.int64)), pa.array(out, pa.binary())], names=["range", "cqf"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["cqf"]], bits)
        fp, n = whole.items()
        fp = (fp | (np.uint64(key[0]) << np.uint64(bits)))[n > 1].view(np.int64)
        return pd.DataFrame({"fp": fp, "n": n[n > 1]})

    filters = fingerprints.select("fp").mapInArrow(build, "range long, cqf binary")
    return filters.groupBy("range").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the rows whose texts are equal after lower-casing A-Z; the largest doc_id of a group stays.

    Returns one row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the
    normalised text, UTF-8). A null text counts as empty. A null doc_id loses against any other; where
    all of a group are null, keep_id is null and all are kept. Rows that repeat a doc_id and a text
    count in group_size and share one verdict. An empty table gives an empty result; other columns are ignored.

    Fingerprints that counting quotient filters count more than once send their rows to byte
    verification: these texts are grouped by all their bytes. While at most BROADCAST_FINGERPRINTS repeat, no other text is
    shuffled; beyond that every text is, once, to meet the repeated fingerprints.
    """
    base = texts(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("fp", F.xxhash64("norm"))
    repeated = cut(repeated_fingerprints(base, docs.count()).select("fp"))
    n_repeated = repeated.count()
    candidates = base.join(F.broadcast(repeated) if n_repeated <= BROADCAST_FINGERPRINTS else repeated, "fp", "left_semi")
    groups = candidates.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = cut(groups.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    rows = base.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that ``exact_groups`` keeps; of rows that repeat a doc_id
    and a text, any one. Only ids and digests are shuffled, but for rows whose id repeats."""
    digest = F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256)
    marked = docs.select("*", F.col(f"`{id_col}`").alias("_exact_id"), digest.alias("_exact_sha"))
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_exact_id"), F.col("text_sha256").alias("_exact_sha"))
    marked = without(marked, gone, ["_exact_id", "_exact_sha"])
    twice = cut(docs.groupBy(F.col(f"`{id_col}`").alias("_exact_id")).count().where("count > 1").select("_exact_id"))
    if not twice.isEmpty():
        once = marked.join(twice.withColumnRenamed("_exact_id", "_twice_id"), F.col("_exact_id").eqNullSafe(F.col("_twice_id")), "left")
        repeats = once.where("_twice_id is not null or _exact_id is null").dropDuplicates(["_exact_id", "_exact_sha"])
        marked = once.where("_twice_id is null and _exact_id is not null").unionByName(repeats)
    return marked.select(*[f"`{c}`" for c in docs.columns])
