"""MinHash near-dedup with odd sketches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER_BYTES, cut

#: MinHash functions, and the chance at most that a pair at the threshold shares no band; likewise that its sketches drop it.
HASHES, MISS = 180, 1e-6
#: Bits of the parity bitmap into which the MinHash samples are folded.
SKETCH_BITS = 1024
#: Members of a bucket that are compared with each other in one go, and shingles of theirs at most; what is larger is dealt into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: A bucket whose largest component leaves out more blocks of members than these isn't dealt; its members meet in rare shingles.
CROWD = 4
#: A set of ids of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_IDS = 2_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    x = x ^ (x >> np.uint64(29))
    x = x * _M3
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words, after lower-casing A-Z and splitting
    at ASCII blanks; of all words together where there are fewer, none where there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    x = h[: len(h) - size + 1]
    for i in range(1, size):
        x = _mix(x * _M1 + h[i : len(h) - size + 1 + i])
    return np.unique(x)


def banding(similarity: float) -> tuple[int, int]:
    """The most rows in a band, so that buckets are small, for which no more than HASHES functions
    make enough bands to miss a pair at the similarity with a chance of MISS at most; and the bands."""
    need = lambda rows: math.ceil(math.log(MISS) / math.log1p(-min(similarity**rows, 1 - 1e-12)))
    rows = max((r for r in range(1, 65) if r * need(r) <= HASHES), default=1)
    return rows, need(rows)


def most_differing(samples: int, similarity: float) -> int:
    """Of so many MinHash samples, the number that differ in a pair of the similarity at most, but for a chance of MISS."""
    left, differ = 1.0, 1 - similarity
    for d in range(samples + 1):
        left -= math.comb(samples, d) * differ**d * similarity ** (samples - d)
        if left <= MISS:
            return d
    return samples


class Hashes:
    """MinHash functions of a seed: bands for candidates, and odd sketches that estimate similarity."""

    def __init__(self, similarity: float, seed: int = 1):
        self.rows, self.n_bands = banding(similarity)
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.a, self.b = draw(self.rows * self.n_bands) * np.uint64(2) + np.uint64(1), draw(self.rows * self.n_bands)
        self.row, self.band = draw(self.rows) * np.uint64(2) + np.uint64(1), draw(self.n_bands)
        self.place = draw(len(self.a))
        # every sample that differs makes two bits odd at most
        self.least_estimate = self.estimate(np.array(2 * most_differing(len(self.a), similarity)))

    def samples(self, s: np.ndarray) -> np.ndarray:
        """The least value of each function over a set."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            np.minimum(low, (s[i : i + 1024, None] * self.a + self.b).min(0), out=low)
        return _mix(low)

    def bands(self, samples: np.ndarray) -> np.ndarray:
        return _mix((samples.reshape(self.n_bands, self.rows) * self.row).sum(1, dtype=np.uint64) + self.band).view(np.int64)

    def sketch(self, samples: np.ndarray) -> bytes:
        """The samples, each with its function, folded into a bitmap of parities."""
        odd = np.bincount((_mix(samples + self.place) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()

    def estimate(self, odd: np.ndarray) -> np.ndarray:
        """The similarity that an XOR population count of two sketches tells: 1 + n / 4k * ln(1 - 2 odd / n)
        for n bits and k samples, the Jaccard similarity of which half the differing ones cancel on average."""
        return 1 + SKETCH_BITS / (4 * len(self.a)) * np.log(np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9))

    def close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sketches x and y (as words, broadcast against each other) may be of similar sets: the
        estimate is as high as it is for any pair at the threshold, but for a chance of MISS."""
        return self.estimate(np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)) >= self.least_estimate


def link_components(edges: DataFrame) -> DataFrame:
    """node, component (least node that can be reached) of every node of the edges a, b.

    Every node hooks onto its least neighbour, trees are flattened by pointer jumping, and what is left
    of the edges between trees goes on; stars and chains take few rounds. Only minima by key and joins
    are shuffled, and each round is checkpointed. Nothing is collected."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    n = edges.count()
    edges, labels = cut(edges, n), None

    def jumped(tree: DataFrame) -> DataFrame:
        root = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
        return tree.join(root, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))

    while n:
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("up")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("up")))
        tree = both.groupBy("node").agg(F.min("up").alias("up"))
        moved = True
        while moved:
            tree = cut(jumped(jumped(tree).drop("moved")), 2 * n)
            moved = not tree.where("moved").isEmpty()
            tree = tree.drop("moved")
        of = lambda side: tree.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))  # noqa: B023, E731
        edges = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).where("a <> b")
        edges = cut(edges.distinct(), n)
        if labels is None:
            labels = tree.select("node", F.col("up").alias("component"))
        else:
            step = tree.select(F.col("node").alias("component"), "up")
            labels = cut(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), 2 * n)
        n = edges.count()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _profiles(docs: DataFrame, size: int, hashes: Hashes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, bands, sketch = [], [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                low = hashes.samples(s) if len(s) else None
                for to, v in zip((n, d1, d2, bands, sketch), (len(s), digest[0], digest[1], [] if low is None else hashes.bands(low), b"" if low is None else hashes.sketch(low)), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary")


def _words(column: pa.Array) -> np.ndarray:
    """Sketches of a column as 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _passed(pairs: DataFrame, hashes: Hashes) -> DataFrame:
    """The pairs a, b whose sketches pass; with columns sketch_a, sketch_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(hashes.close(_words(b.column(2)), _words(b.column(3)))) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id and s, the full shingle set, of the documents of some ids (column doc_id)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "s"])

    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, s binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs a, b whose full shingle sets have 100 * intersection >= ``percent`` * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    found = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))), docs, size)
    left, right = found.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a")), found.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "s_a", "s_b")
    return both.mapInArrow(compare, "a long, b long")


def _buckets(held: DataFrame) -> DataFrame:
    """h, main (the largest component), w_main, w_rest of the buckets that hold several components. ``held``: h, node, component, w."""
    each = held.groupBy("h", "component").agg(F.sum("w").alias("w"))
    each = each.groupBy("h").agg(F.max(F.struct("w", (-F.col("component")).alias("c"))).alias("top"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.select("h", (-F.col("top.c")).alias("main"), F.col("top.w").alias("w_main"), (F.col("w") - F.col("top.w")).alias("w_rest"))


def _cells(held: DataFrame, open_: DataFrame, capacity: int) -> DataFrame:
    """Deal the members of buckets into cells, so that any two members meet in just one, but for two passive
    ones, who needn't meet. ``held``: h, node, component, passive; ``open_``: h and the weights of a bucket's passive
    members (w_main) and of the others (w_rest).

    Both are dealt into blocks of about ``capacity``. A cell (h, kind, i, j) holds the blocks i and j of the rest (kind 0),
    or block i of the rest and block j of the passive ones (kind 1). side: 0 and 1 are to be
    compared with each other, 2 among themselves. Where the rest fits in a few blocks, the rows grow in proportion to the members."""
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(F.col(w) / capacity)).cast("int")
    open_ = open_.select("h", blocks("w_main").alias("most"), blocks("w_rest").alias("rest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("passive"), F.col("most")).otherwise(F.col("rest")).cast("long")).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("own")
    of_main = F.transform(upto("rest"), lambda k: cell(1, k, mine, F.lit(1)))
    of_rest = F.transform(upto("rest"), lambda k: cell(0, F.least(mine, k), F.greatest(mine, k), F.when(mine == k, 2).when(mine < k, 0).otherwise(1)))
    of_rest = F.concat(of_rest, F.transform(upto("most"), lambda k: cell(1, mine, k, F.lit(0))))
    dealt = held.join(open_, "h").withColumn("own", own).select("h", "node", "component", F.explode(F.when(F.col("passive"), of_main).otherwise(of_rest)).alias("cell"))
    return dealt.select("h", "cell.*", "node", "component")


def _with_passive(held: DataFrame, open_: DataFrame) -> DataFrame:
    """``held`` in the buckets of ``open_``; members of a bucket's largest component are passive."""
    return held.join(open_.select("h", "main"), "h").withColumn("passive", F.col("component") == F.col("main")).drop("main")


def _rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """h (a shingle), node, passive: of each set the shingles in which it can meet a partner, by prefix filtering.

    Shingles have one order, rare ones first. Let 100 * intersection >= percent * union hold for sets of x <= y shingles: then the intersection
    has 2 * percent * x / (100 + percent) shingles or more, and percent * y / 100 or more. So some shingle is among the first
    x - 2 * percent * x / (100 + percent) + 1 of the smaller set (where it is active) and the first y - percent * y / 100 + 1 of
    the larger (where it may be passive). Shingles that no other set has come first and meet nobody, so texts that share a template, but
    not enough of it, give few rows or none, however many they are; a set gives no more rows than a share of its own size.
    ``sets``: node, s (sorted distinct 64-bit hashes as binary)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array(each, pa.list_(pa.int64()))], names=["node", "n", "s"])

    each = cut(sets.select("node", "s").mapInArrow(listed, "node long, n long, s array<long>"))
    each = each.select("node", "n", F.explode("s").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    of_node = Window.partitionBy("node")
    place = F.row_number().over(of_node.orderBy("df", "h")) + F.col("n") - F.count(F.lit(1)).over(of_node)
    least = lambda times, of: F.expr(f"(n * {times} + {of} - 1) div {of}")
    ranked = each.join(often, "h").withColumn("place", place).where(F.col("place") <= F.col("n") - least(percent, 100) + 1)
    return ranked.select("h", "node", (F.col("place") > F.col("n") - least(2 * percent, 100 + percent) + 1).alias("passive"))


def _met_in_rare(rare: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``held`` and ``open_`` for ``_cells``: the rare shingles where an active member meets another component."""
    held = rare.join(labels, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"), "passive")
    held = cut(held)
    sums = held.groupBy("h").agg(F.count_if("passive").alias("w_main"), F.count_if(~F.col("passive")).alias("w_rest"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return held, sums.where("w_rest > 0 and lo < hi").select("h", "w_main", "w_rest")


def _by_cell(rows: DataFrame, run_cell: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``run_cell`` with all rows of each cell: columns h, kind, i, j and what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            keys = np.stack([t.column(i).to_numpy() for i in range(4)], 1)
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                yield from run_cell(t.slice(s, e - s).combine_chunks())
            rest = t.slice(bounds[-1])
        if rest is not None and rest.num_rows:
            yield from run_cell(rest.combine_chunks())

    key = ["h", "kind", "i", "j"]
    return rows.select(*key, *[c for c in rows.columns if c not in key]).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _met_before(bands: np.ndarray, h: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells of members i and j (broadcast against each other) of bucket h whether they share a bucket of an
    earlier band: there, they are compared already."""
    before = bands[:, : int(np.argmax(bands[0] == h))]
    return lambda i, j: (before[i] == before[j]).any(-1)


def _reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the least that it reaches over the pairs i, j."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
    return label


def _candidates(cells: DataFrame, hashes: Hashes) -> DataFrame:
    """h, node, least: the members of a cell of which some pair passes by its sketches, is of different components and in no
    earlier bucket, with the first member of the cell that they reach over such pairs; at most as many rows as the cell has. Columns of ``cells``: of
    ``_cells``, bands, sketch."""

    def run_cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node, comp = (t.column(c).to_numpy() for c in ("side", "node", "component"))
        if (comp == comp[0]).all():
            return
        words, h = _words(t.column("sketch")), int(t.column(0)[0].as_py())
        met = _met_before(np.array(t.column("bands").to_pylist(), np.int64), h)
        x, y, on, label = np.flatnonzero(side != 1), np.flatnonzero(side != 0), np.zeros(len(node), bool), np.arange(len(node))
        for lo in range(0, len(x), step := max(1, (1 << 16) // max(1, len(y)))):
            u = x[lo : lo + step, None]
            i, j = np.nonzero(hashes.close(words[u], words[y][None]) & (comp[u] != comp[y]))
            i, j = u[i, 0], y[j]
            new = ~met(i, j)
            on[i[new]] = on[j[new]] = True
            label = _reached(np.concatenate([i[new], np.arange(len(node))]), np.concatenate([j[new], label]), len(node))
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), h)), pa.array(node[on]), pa.array(node[label[on]])], names=["h", "node", "least"])

    return _by_cell(cells, run_cell, "h long, node long, least long")


def _linked(cells: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links between components that meet in a cell, no more than connect these components, so fewer
    rows than the cell has members. Every pair of a cell of different components is compared by full sets, unless links found
    before connect it or it shares an earlier bucket. Columns of ``cells``: of ``_cells``, bands, s (the set)."""

    def run_cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node = (t.column(c).to_numpy() for c in ("side", "node"))
        comp = np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
        if not comp.any():
            return
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s").chunk(0)]
        size = np.array([len(s) for s in sets])
        start = np.concatenate([[0], np.cumsum(size)])
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(len(distinct), bool)
        met = _met_before(np.array(t.column("bands").to_pylist(), np.int64), int(t.column(0)[0].as_py()))
        x, y, a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0), [], []
        for u in x:
            near = y[(comp[y] != comp[u]) & ((side[u] == 0) | (node[y] > node[u]))]
            # a set too small or large for the other can't reach the threshold
            near = near[100 * np.minimum(size[near], size[u]) >= percent * np.maximum(size[near], size[u])]
            near = near[~met(u, near)]
            if not len(near):
                continue
            mine = code[start[u] : start[u + 1]]
            held[mine] = True
            at = np.concatenate([code[start[k] : start[k + 1]] for k in near])
            both = np.add.reduceat(held[at], np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            held[mine] = False
            for k in near[100 * both >= percent * (size[near] + size[u] - both)]:
                if comp[k] != comp[u]:
                    comp[comp == comp[k]] = comp[u]
                    a.append(min(node[u], node[k]))
                    b.append(max(node[u], node[k]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_cell(cells, run_cell, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link the documents whose sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more, and follow the links.

    Returns one row for each row of ``docs``: doc_id, n_shingles, component_id (the least doc_id that
    can be reached), kept (doc_id = component_id). A null, empty or blank text has no shingle and is
    linked with nothing. doc_id must be an integer; rows that share one are
    linked, and where such rows lead several groups of equal texts one of them stands for the links; a null doc_id has a null component and is kept. An empty table gives an empty result; other columns are ignored.

    Rows with equal sets are one node from the start. MinHash bands deal nodes into buckets; in each
    bucket all are paired with its least member alone, odd sketches of the MinHash samples drop the pairs that can't reach
    the threshold, and the rest is confirmed on full sets. That joins most of a large group at a cost in
    proportion to its size. Then, in buckets that hold several components, members of different
    components meet in blocks inside a task: first their sketches, which tells the members that have a candidate,
    then the full sets of these. Every pair is compared in the first bucket it shares, and only links that
    connect components leave a task.

    A bucket of which more than CROWD blocks of members stay outside its largest component isn't dealt, as rows would grow by its square. Any two
    members of such buckets that reach the threshold share a rare shingle (``_rare_shingles``), so they meet there instead, by sketches, and those that
    candidates connect by full sets. The rows dealt elsewhere are at most some 2 * CROWD times the members. What is still compared by the square, in blocks, are active members of one rare
    shingle, and candidates connected with each other that no link joins. Nothing is left out.
    """
    hashes = Hashes(percent / 100)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    profile = cut(_profiles(docs, size, hashes))
    n = profile.count()
    sets = profile.where("n > 0 and doc_id is not null")
    # checkpointed, so that the joins with them are between plain shuffles, which AQE can split where one set or bucket is very common
    often = cut(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1").select("d1", "d2", "rep"), n)
    twice = cut(sets.groupBy("doc_id").count().where("count > 1").select("doc_id"), n)
    nodes = sets.join(often, ["d1", "d2"], "left").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("node"), "n", "sketch", "bands")
    some_twice = not twice.isEmpty()
    nodes = cut(nodes.dropDuplicates(["node"]) if some_twice else nodes)
    bands = nodes.select("node", F.explode("bands").alias("h"))
    first = cut(bands.groupBy("h").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").select("h", "a"), n)
    shared = cut(bands.join(first, "h").select("h", "node", "a"))

    def sketch_of(side: str) -> DataFrame:
        return nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"))

    star = shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = _confirmed(cut(_passed(star.join(sketch_of("b"), "b").join(sketch_of("a"), "a"), hashes), n), known, percent, size)
    if some_twice:  # rows that share a doc_id but not a text are one document
        links = links.union(sets.join(often, ["d1", "d2"]).where("doc_id <> rep").join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = link_components(cut(links, n))
    held = shared.select("h", "node").join(labels, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    traits = nodes.select("node", "bands", "sketch")
    held = held.withColumn("w", F.lit(1))
    open_ = cut(_buckets(held), n)
    loose = F.col("w_rest") > CROWD * BLOCK
    near = _candidates(_cells(_with_passive(held, open_.where(~loose)), open_.where(~loose), BLOCK).join(traits, "node"), hashes).select("h", "node")
    crowd = cut(held.join(open_.where(loose).select("h"), "h", "left_semi").select(F.col("node").alias("doc_id")).distinct(), n)
    if not crowd.isEmpty():
        sets_of_crowd = _sets_of(crowd, known, size).withColumnRenamed("doc_id", "node")
        met, rare = _met_in_rare(_rare_shingles(sets_of_crowd.dropDuplicates(["node"]) if some_twice else sets_of_crowd, percent), labels)
        # a node is in many shingles, so its set goes on just once: with the nodes it reaches over candidate pairs
        sketches = nodes.select("node", F.array(F.lit(0).cast("long")).alias("bands"), "sketch")
        pairs = _candidates(_cells(met, rare, BLOCK).join(sketches, "node"), hashes).select(F.col("node").alias("b"), F.col("least").alias("a"))
        near = near.union(link_components(pairs).select(F.col("component").alias("h"), "node"))
    near = cut(near.distinct(), n)
    full = _sets_of(near.select(F.col("node").alias("doc_id")), known, size).withColumnRenamed("doc_id", "node")
    if some_twice:
        full = full.dropDuplicates(["node"])
    held = near.join(labels, "node", "left").join(nodes.select("node", F.col("n").alias("w")), "node").select("h", "node", F.coalesce("component", "node").alias("component"), "w")
    open_ = cut(_buckets(held), n)
    found = cut(_linked(_cells(_with_passive(held, open_), open_, BLOCK_SHINGLES).join(nodes.select("node", "bands"), "node").join(full, "node"), percent), n)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    above = link_components(between).select(F.col("node").alias("component"), F.col("component").alias("top"))
    out = profile.select("doc_id", "n", "d1", "d2").join(often, ["d1", "d2"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = out.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(above, "component", "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("top", "component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
