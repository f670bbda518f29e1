"""Ranked lexical search: a blocked sparse matrix product of items by terms and terms by documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut

#: Byte table of the terms: A-Z lower-cased, other ASCII but letters and digits to a blank; bytes beyond ASCII belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Postings of a block of documents at most, unless one document has more; and characters of the items that one pass
#: over the documents serves. More items take more passes.
BLOCK_POSTINGS, PASS_CHARS = 1 << 20, 8 << 20
#: Groups in which the lists of tasks are reduced before they meet by item.
REDUCE_GROUPS = 64


def terms(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(TERM_BYTES).split()


@dataclass
class Items:
    """A block of items as a sparse matrix by rows: row i holds columns ``cols[ptr[i]:ptr[i+1]]``, terms of ``vocabulary``,
    with multiplicities ``times``."""

    ids: list
    vocabulary: dict[bytes, int]
    ptr: np.ndarray
    cols: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        ptr, cols, times = [0], [], []
        for _, texts in rows:
            at = [vocabulary.setdefault(t, len(vocabulary)) for text in texts for t in terms(text)]
            c, n = np.unique(np.array(at, np.int64), return_counts=True)
            cols.append(c)
            times.append(n)
            ptr.append(ptr[-1] + len(c))
        none = [np.zeros(0, np.int64)]
        return cls([r[0] for r in rows], vocabulary, np.array(ptr), np.concatenate(cols or none), np.concatenate(times or none))


def _postings(texts: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: number of terms of each document, and by document and term of the vocabulary: document, term, occurrences."""
    sizes, docs, cols = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        found = terms(text.as_py())
        sizes[i] = len(found)
        at = [vocabulary[t] for t in found if t in vocabulary]
        docs.append(len(at))
        cols += at
    width = max(1, len(vocabulary))
    key, tf = np.unique(np.arange(len(texts)).repeat(docs) * width + np.array(cols, np.int64), return_counts=True)
    return sizes, key // width, key % width, tf.astype(np.int64)


def _statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Over all documents: how many have a term, how many terms they have, and in how many each term of the items occurs.
    Tasks send one row a term of the items at most."""
    vocabulary, width = docs.sparkSession.sparkContext.broadcast(items.vocabulary), len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 2, np.int64)
        for b in batches:
            sizes, _, term, _ = _postings(b.column("text"), vocabulary.value)
            total[:width] += np.bincount(term, minlength=width)[:width]
            total[width] += np.count_nonzero(sizes)
            total[width + 1] += sizes.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(width + 2, np.int64)
    for k, n in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    vocabulary.unpersist()
    return int(out[width]), int(out[width + 1]), out[:width]


def best_of(score: np.ndarray, doc: np.ndarray, has_id: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, in order; equal ones by ascending id, null ids last."""
    if len(score) > 4 * k:  # what is below the k-th highest score can't be among them
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort([doc[at], ~has_id[at], -score[at]])[:k]]


def _product(items: Items, n_docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of items x documents, by Gustavson: the row of an item is the merge of the rows of its terms, each times its multiplicity.
    Gives item, documents, scores."""
    order = np.argsort(term, kind="stable")
    doc, value = doc[order], value[order]
    starts = np.searchsorted(term[order], np.arange(len(items.vocabulary) + 1))
    row = np.zeros(n_docs, np.int64)
    for i in range(len(items.ids)):
        for e in range(items.ptr[i], items.ptr[i + 1]):
            s, z = starts[items.cols[e]], starts[items.cols[e] + 1]
            row[doc[s:z]] += items.times[e] * value[s:z]  # a term has a document once
        at = np.flatnonzero(row)
        if len(at):
            yield i, at, row[at]
            row[at] = 0


def _ranked(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """i, doc_id, score, part: the k best documents of each item from each task."""
    n, length, df = _statistics(docs, items)
    weight = np.array([int(np.floor(1000 * np.log((2 * n + 2) / (2 * int(x) + 1)))) for x in df], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        block: list[tuple] = []

        def reduce() -> None:
            """Multiply the block and keep the k best of each item."""
            at = np.cumsum([0, *[len(b[0]) for b in block]])
            ids, has_id = np.concatenate([b[0] for b in block]), np.concatenate([b[1] for b in block])
            doc = np.concatenate([b[2] + s for b, s in zip(block, at, strict=False)])
            for i, rows, score in _product(items, len(ids), doc, np.concatenate([b[3] for b in block]), np.concatenate([b[4] for b in block])):
                got = (score, ids[rows], has_id[rows])
                if i in best:
                    got = tuple(np.concatenate(x) for x in zip(best[i], got, strict=True))
                top = best_of(*got, k)
                best[i] = tuple(x[top] for x in got)
            block.clear()

        held_now = 0
        for b in batches:
            sizes, doc, term, tf = _postings(b.column("text"), items.vocabulary)
            norm = 100 - 25 + 25 * sizes * n // max(1, length)
            value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[doc]))
            has_id = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            block.append((b.column("doc_id").fill_null(0).to_numpy(), has_id, doc, term, value))
            held_now += len(doc)
            if held_now >= BLOCK_POSTINGS:
                reduce()
                held_now = 0
        if block:
            reduce()
        for i, (score, ids, has_id) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids, mask=~has_id), pa.array(score)], names=["i", "doc_id", "score"])

    found = docs.mapInArrow(run, "i long, doc_id long, score long")
    return found.withColumn("part", F.spark_partition_id() % REDUCE_GROUPS)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item, all if there are fewer, equal
    scores by ascending doc_id (null ids last).

    Terms are runs of letters, digits and anything beyond ASCII, A-Z lower-cased; null and empty texts have none. A document
    of n terms weighs a term of which it has tf occurrences as w * (10**9*tf div (1000*tf + 12*m)), w = floor(1000*ln((2*N+2)/(2*df+1))),
    m = 75 + 25*n*N div L, of N documents with a term, L terms of them all and df with this term. An item adds these up over its terms, as
    often as it has them. Each row of ``docs`` is a document of its own, also where ids repeat; rows of ``items`` that
    share an id (null ones, too) are one item with the terms of all. An item without a term, or of terms that no document has, gives no row;
    nor does anything when a table is empty. Other columns are ignored. Document ids are integers.

    Documents are read twice, for the statistics and for the product, and never shuffled: a task multiplies block by block and
    keeps k rows an item. Those meet in REDUCE_GROUPS groups an item, and then by item. Items are taken in portions of PASS_CHARS
    characters, each with two passes of its own, so what is broadcast is bounded however many items there are; a single item
    above that is a portion by itself."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    x = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col("text").cast("string").alias("text"))
    x = x.groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    kind = dict(items.dtypes)[item_col]
    out, portion, chars = [], [], 0

    def flush() -> None:
        block = Items.of(portion)
        top = _first(_ranked(rows, block, k), ["i", "part"], k).select("i", "doc_id", "score", "part")
        top = _first(top, ["i"], k)
        names = F.broadcast(items.sparkSession.createDataFrame(list(enumerate(block.ids)), f"i long, item_id {kind}"))
        out.append(cut(top.join(names, "i").select("item_id", "rank", "doc_id", "score"), rows=k * len(block.ids)))
        portion.clear()

    for item, texts in x.toLocalIterator():
        size = sum(map(len, texts))
        if portion and chars + size > PASS_CHARS:
            flush()
            chars = 0
        portion.append((item, texts))
        chars += size
    if portion or not out:
        flush()
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
