"""Language ID by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import fold

DIMS_BITS = 13
#: ASCII that isn't a letter becomes a space; bytes above 0x7F belong to letters.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def ngram_codes(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, words apart from each other by one space."""
    flat = b" ".join((text.lower()).encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    b = np.frombuffer(b" " + flat + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mixed = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - DIMS_BITS)).astype(np.int64)


@dataclass(frozen=True)
class MixtureModel:
    """langs: in order; prob: for each n-gram code the probability in each language (codes x languages)."""

    langs: tuple[str, ...]
    prob: np.ndarray

    def infer(self, docs: list[np.ndarray], penalty: float = 6.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, given as n-gram codes, the share of each language and whether it is in the
        chosen set. Expectation-maximisation over the mixture of the languages' n-gram models gives the
        shares; nested sets of every size, by falling share, are compared by log-likelihood less ``penalty`` * size."""
        n_lang, counts = len(self.langs), [np.bincount(d, minlength=1 << DIMS_BITS) for d in docs]
        codes = [np.flatnonzero(c) for c in counts]
        sizes = np.array([len(c) for c in codes])
        if not sizes.all():
            raise ValueError("a text without n-grams has no mixture")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(docs)), sizes)
        p = self.prob[np.concatenate(codes)]
        w = np.concatenate([c[k] for c, k in zip(counts, codes, strict=True)]).astype(np.float32)
        total = np.add.reduceat(w, starts)[:, None]

        def likelihood(pi: np.ndarray) -> np.ndarray:
            return np.add.reduceat(w * np.log(np.maximum((pi[doc] * p).sum(1), 1e-30)), starts)

        def fit(pi: np.ndarray) -> np.ndarray:
            for _ in range(rounds):
                joint = pi[doc] * p
                pi = np.add.reduceat(joint * (w / np.maximum(joint.sum(1), 1e-30))[:, None], starts) / total
            return pi

        share = fit(np.full((len(docs), n_lang), 1 / n_lang, np.float32))
        order = np.argsort(-share, axis=1, kind="stable")
        rank = np.argsort(order, axis=1)
        best, best_score, kept = None, None, None
        for size in range(1, n_lang + 1):
            inside = rank < size
            pi = np.where(inside, np.maximum(share, 1e-6), 0).astype(np.float32)
            pi /= pi.sum(1, keepdims=True)
            pi = fit(pi) if size > 1 else pi
            score = likelihood(pi) - penalty * size
            if best is None:
                best, best_score, kept = pi, score, inside
            else:
                better = (score > best_score)[:, None]
                best, kept, best_score = np.where(better, pi, best), np.where(better, inside, kept), np.maximum(score, best_score)
        return best, kept


def fit_languages(docs: DataFrame, max_per_lang: int = 3000, mod: int = 4, held_out: int = 2, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> MixtureModel | None:
    """Learn from the texts and non-null languages of the rows whose crc32 of the id isn't in the fold
    ``held_out`` of ``mod``. Of each language about ``max_per_lang`` documents are taken, those of
    the smallest hashes of their ids, so that the model costs the same at any size; all are taken where
    a language has fewer. None where nothing can be learnt. Every distinct value of ``lang_col`` but ``und`` is a
    language; the driver holds one row of 8192 numbers for each."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.where((fold(F.col("i"), mod) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN))
    share = {r["lang"]: min(1.0, max_per_lang / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return None
    langs = tuple(sorted(share))
    cut_at = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(share[k]))])
    part = (F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.element_at(cut_at, F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.bincount(ngram_codes(text.as_py()), minlength=1 << DIMS_BITS)
                seen[lang] = seen.get(lang, 0) + c
        for lang, c in seen.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c[k])], names=["lang", "code", "n"])

    sums = rows.where(part).select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(langs), 1 << DIMS_BITS), smoothing)
    n[sums["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int), sums["code"].to_numpy(int)] += sums["n"].to_numpy(float)
    return MixtureModel(langs, np.ascontiguousarray((n / n.sum(1, keepdims=True)).T.astype(np.float32)))


#: Different n-grams times languages that are worked on at a time: so many floats, and a few arrays of the kind.
CELLS = 1 << 22


def _portions(codes: dict[int, np.ndarray], n_langs: int) -> Iterator[list[int]]:
    """The rows of a batch in portions of at most CELLS, or of one row."""
    some, size = [], 0
    for i, c in codes.items():
        cells = min(len(c), 1 << DIMS_BITS) * n_langs
        if some and size + cells > CELLS:
            yield some
            some, size = [], 0
        some.append(i)
        size += cells
    if some:
        yield some


def identify_languages(docs: DataFrame, model: MixtureModel | None, text_col: str = "text", batch: int = 256) -> DataFrame:
    """All columns of ``docs``, one row for each of its rows, with lang_pred (the language of the
    largest share in the chosen set), score (that share, 0 to 1), lang_set (the set, by falling
    share) and lang_shares. A column of ``docs`` with such a name is replaced. A text that is null or
    has no letter is ``und`` with score 0, and so is every text where there is no model. Rows may
    repeat; an empty table gives an empty result. Whole texts are read, in portions bounded by n-grams times
    languages; nothing is shuffled."""
    new = {"lang_pred": "string", "score": "double", "lang_set": "array<string>", "lang_shares": "array<double>"}
    held = docs.drop(*new)
    at = held.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                rows: list = [(UNKNOWN, 0.0, [], [])] * b.num_rows
                codes = {}
                for i, text in enumerate(b.column(at)):
                    if model is not None and has_letter(text.as_py()) and len(c := ngram_codes(text.as_py())):
                        codes[i] = c
                for some in _portions(codes, len(model.langs) if model else 1):
                    shares, kept = model.infer([codes[i] for i in some])
                    for i, share, inside in zip(some, shares, kept, strict=True):
                        order = [k for k in np.argsort(-share, kind="stable") if inside[k]]
                        rows[i] = (model.langs[order[0]], float(min(1.0, share[order[0]])), [model.langs[k] for k in order], [float(share[k]) for k in order])
                types = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*b.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), *(f"{k} {v}" for k, v in new.items())])
    return held.mapInArrow(run, schema)
