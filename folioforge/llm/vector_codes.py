"""Vector code compression: product codes in integers, found by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import BROADCAST_ROWS, cut

#: A component x counts as floor(SCALE * x), and as LARGEST or -LARGEST beyond these: squared distances then
#: fit in 64 bits for parts of up to 500 components.
SCALE, LARGEST = 4096, 1 << 26


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` (k x d) for each row of ``x`` (n x d), the lowest of equals, and its
    squared distance; integers throughout.

    Entries are tried one after another. Of an entry, components are added up in the order of the book's falling
    variance; a row gives the entry up once the sum is strictly above its best complete distance so far."""
    k = len(book)
    spread = k * (book.astype(object) ** 2).sum(0) - book.astype(object).sum(0) ** 2  # k*k times the variance, exact
    order = sorted(range(book.shape[1]), key=lambda j: (-spread[j], j))
    cols = [np.ascontiguousarray(x[:, j]) for j in order]
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for e in range(k):
        live, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for c, j in zip(cols, order, strict=True):
            total = total + (c[live] - book[e, j]) ** 2
            keep = total <= best[live]
            if not keep.all():
                live, total = live[keep], total[keep]
                if not len(live):
                    break
        nearer = total < best[live]
        best[live[nearer]], at[live[nearer]] = total[nearer], e
    return at, best


def _integers(vectors: pa.Array, parts: int) -> np.ndarray:
    """n x parts x d, of vectors that all have the same length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)
    return whole.reshape(len(vectors), parts, -1)


def usable(vectors: DataFrame, parts: int, vec_col: str) -> DataFrame:
    """The rows whose vector can be coded: not null, of a length that the parts divide, every component finite."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.coalesce(finite, F.lit(False)))


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: tasks add up what falls to each entry, in numpy, and send one row an entry and
    component; so do the shuffle's partial sums. The driver gets as many rows as the codebooks have numbers, however many vectors there are."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, k), np.int64)
        for b in batches:
            x = _integers(b.column("vector"), parts)
            for p in range(parts):
                at = nearest_entries(x[:, p], books[p])[0]
                np.add.at(sums[p], at, x[:, p])
                counts[p] += np.bincount(at, minlength=k)
        p, e = np.nonzero(counts)
        cell = (p * k + e).repeat(d)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(np.arange(d), len(p))), pa.array(sums[p, e].ravel()), pa.array(counts[p, e].repeat(d))], names=["cell", "j", "s", "n"])

    found = rows.select("vector").mapInArrow(run, "cell long, j long, s long, n long").groupBy("cell", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for cell, j, s, n in found.collect():
        out[cell // k, cell % k, j] = s // n
    return out


def fit_codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_col: str = "embedding", id_col: str = "vec_id") -> np.ndarray | None:
    """Codebooks, parts x entries x components, in integers; fewer entries where there are fewer vectors, None where there is none that
    can be coded. They start as the parts of the vectors of the least ids (null ids last, equal ids by the vector);
    each round gives every part to its nearest entry and moves an entry to the floor of its parts' mean. Unused entries stay.
    All vectors take part; those not as long as the one of the least id are left out."""
    rows = usable(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")), parts, "vector")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    first = [r for r in first if len(r["vector"]) == length]
    if len(first) < entries:  # the others of that length
        first = rows.where(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = _integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    rows = rows.where(F.size("vector") == length)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray | None, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """vec_id, label, codes (entry indexes in the order of parts), error (squared distances, summed over parts): one row for each row of
    ``vectors`` that can be coded by ``books``. A null, empty or ragged vector, one with a component that is null or not
    finite, and one of another length than the codebooks have gives no row; no codebooks give none at all. Rows
    that repeat an id are coded each by itself; null ids and labels stay null. Other columns are ignored.

    No shuffle: the codebooks, some kilobytes, travel with the function."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    if books is None:
        return rows.where("false").select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    parts, _, d = books.shape
    names = ["vec_id", "label", "codes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column("vector"), parts)
            found = [nearest_entries(x[:, p], books[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], 1).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), listed, pa.array(sum(e for _, e in found))], names=names)

    return usable(rows, parts, "vector").where(F.size("vector") == parts * d).mapInArrow(run, schema)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` (label, error, ...) with ``label_error``, the error summed over all rows of a label; nulls are one
    label. A label that a third of the rows have costs one row a task: sums are combined before the shuffle, and join back
    by a broadcast while there are few labels. Beyond that both sides are shuffled by an equi-join that AQE can split."""
    codes = cut(codes)
    sums = cut(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    small = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    return codes.join(small, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def hex_code(codes: Column) -> Column:
    """Two hex digits an index."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
