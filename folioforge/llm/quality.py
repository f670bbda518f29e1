"""Quality classifier: nearest neighbours among labelled latent-semantic vectors vote."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import fold

DIMS_BITS = 12
#: After the hashed n-grams: one place for words that repeat the one before, counted with this weight.
DIMS, REPEAT_WEIGHT = (1 << DIMS_BITS) + 1, 25


def _shape_table() -> bytes:
    """Bytes by what they look like: letters by case, digits, and marks as they are."""
    return bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 233 if b >= 128 else b for b in range(256))


_SHAPES = _shape_table()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and their counts: byte trigrams of the text, 4-grams of its shape, and immediate repeats of words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS, np.int64)
    half = np.uint32(32 - DIMS_BITS + 1)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        out += np.bincount((code >> half).astype(np.int64), minlength=DIMS)
    s = np.frombuffer(raw.translate(_SHAPES), np.uint8).astype(np.uint32)
    if len(s) >= 4:
        code = ((s[:-3] << np.uint32(24)) | (s[1:-2] << np.uint32(16)) | (s[2:-1] << np.uint32(8)) | s[3:]) * np.uint32(2246822519)
        out += np.bincount((code >> half).astype(np.int64) + (1 << (DIMS_BITS - 1)), minlength=DIMS)
    words = raw.split()
    out[-1] = REPEAT_WEIGHT * sum(map(eq, words, words[1:]))
    at = np.flatnonzero(out)
    return at, out[at]


@dataclass(frozen=True)
class LatentNeighbours:
    """basis: weights of n-grams (inverse document frequency) times the right singular vectors;
    vectors: of the labelled texts, of length 1; labels: 0 or 1 each. Their number is bounded by the fit."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def embed(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Latent-semantic vectors of length 1; a text without n-grams has the zero vector."""
        out = np.zeros((len(found), self.basis.shape[1]), np.float32)
        for i, (at, n) in enumerate(found):
            if len(at):
                out[i] = _damped(n) @ self.basis[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def scores(self, vectors: np.ndarray, block: int = 1024) -> np.ndarray:
        """Exact cosines with all labelled vectors, block by block, and the vote of the nearest (of equally near
        ones those that come first), each weighted by a power of its similarity. Without a similar neighbour: the share of label 1."""
        k = min(self.neighbours, len(self.labels))
        sims = np.full((len(vectors), 0), 0, np.float32)
        labels = np.zeros((len(vectors), 0), np.float32)
        for lo in range(0, len(self.labels), block):
            s = np.hstack([sims, vectors @ self.vectors[lo : lo + block].T])
            y = np.hstack([labels, np.broadcast_to(self.labels[lo : lo + block], (len(vectors), len(self.labels[lo : lo + block])))])
            top = _nearest(s, min(k, s.shape[1]))
            sims, labels = s[top].reshape(len(s), -1), y[top].reshape(len(s), -1)
        w = np.maximum(sims, 0).astype(np.float64) ** 8
        total = w.sum(1)
        return np.where(total > 1e-9, np.clip((w * labels).sum(1) / np.maximum(total, 1e-9), 0, 1), self.prior)


def _nearest(s: np.ndarray, k: int) -> np.ndarray:
    """Marks the k largest of each row, and of equal ones the first."""
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k else np.zeros((len(s), 1), s.dtype)
    above, level = s > least, s == least
    return above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))


def _damped(n: np.ndarray) -> np.ndarray:
    """Counts damped by the square root; length doesn't matter, since vectors get length 1."""
    return np.sqrt(n.astype(np.float32))


def fit_neighbours(docs: DataFrame, labels: DataFrame, per_class: int = 2000, dims: int = 64, neighbours: int = 25, mod: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> LatentNeighbours | None:
    """Fit on labelled rows whose crc32 of the id isn't in the fold ``held_out`` of ``mod``: about
    ``per_class`` of each label, those of the smallest hashes of their ids, so the labelled vectors
    that are broadcast stay below 2 * ``per_class`` * ``dims`` * 4 bytes or so at any size. Texts are
    turned into counts on the executors; only these reach the driver. An id whose rows in ``labels`` contradict each other
    isn't learnt from; different texts under one id all have its label, and equal ones count once. Ids
    without a text, and labels other than 0 and 1, are skipped. None where a label is missing."""
    known = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("i"), mod) != held_out))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    share = {r["y"]: min(1.0, per_class / r["count"]) for r in known.groupBy("y").count().collect()}
    if len(share) < 2:
        return None
    part = (F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0].astype(np.int32).tobytes() for f in found]), pa.array([f[1].astype(np.int32).tobytes() for f in found])], names=["i", "y", "at", "n"])

    sample = rows.join(F.broadcast(known.where(part)), "i").select(F.col("i").cast("string"), "y", "text").distinct()
    got = sample.mapInArrow(count, "i string, y int, at binary, n binary").toPandas().sort_values(["i", "y", "at", "n"], kind="stable")
    if got["y"].nunique() < 2:
        return None
    tf = np.zeros((len(got), DIMS), np.float32)
    for row, at, n in zip(tf, got["at"], got["n"], strict=True):
        row[np.frombuffer(at, np.int32)] = _damped(np.frombuffer(n, np.int32))
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    k = min(dims, *tf.shape)
    q = np.linalg.qr(tf @ rng.standard_normal((tf.shape[1], k + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(tf @ np.linalg.qr(tf.T @ q)[0])[0]
    right = np.linalg.svd(q.T @ tf, full_matrices=False)[2][:k].T
    model = LatentNeighbours((idf[:, None] * right).astype(np.float32), np.zeros((0, k), np.float32), np.zeros(0), neighbours, float(got["y"].mean()))
    vectors = model.embed([(np.frombuffer(a, np.int32), np.frombuffer(n, np.int32)) for a, n in zip(got["at"], got["n"], strict=True)])
    return LatentNeighbours(model.basis, vectors, got["y"].to_numpy(np.float32), neighbours, model.prior)


def score_quality(docs: DataFrame, model: LatentNeighbours | None, threshold: float = 0.3, text_col: str = "text", batch: int = 256) -> DataFrame:
    """All columns of ``docs``, one row for each of its rows, with score (0 to 1, higher: label 1 is
    likelier) and predicted (1 from ``threshold`` on, else 0). A column of ``docs`` with such a name is
    replaced. A null text counts as empty; a text without n-grams gets the share of label 1 among the
    fitted rows, and where there is no model every text gets 0.5. Rows may repeat; an empty table gives
    an empty result. Whole texts are read; nothing is shuffled, and the broadcast model is bounded by its fit."""
    new = {"score": "double", "predicted": "int"}
    held = docs.drop(*new)
    at = held.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                score = np.full(b.num_rows, 0.5) if model is None else model.scores(model.embed([features(t.as_py()) for t in b.column(at)]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*b.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), *(f"{k} {v}" for k, v in new.items())])
    return held.mapInArrow(run, schema)
