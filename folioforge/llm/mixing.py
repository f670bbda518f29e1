"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents that a window partition has on average: a fine range of one source's order.
DOCS_PER_RANGE = 1000
#: A schedule of at most so many slots is broadcast.
BROADCAST_PLACES = 1_000_000


#: Slots of a period: a multiple of this, at least twice as many as there are sources.
PERIOD = 1000


def period_of(n_sources: int) -> int:
    return PERIOD * max(1, -(-2 * n_sources // PERIOD))


def quantised(weights: dict[str, float], period: int) -> dict[str, int]:
    """Shares of ``period`` slots in proportion to the weights, 1 at least, by largest remainders;
    where the minimum of 1 takes too many, the largest shares give way."""
    if not weights or len(weights) > period or any(not w > 0 for w in weights.values()):
        raise ValueError(f"between 1 and {period} sources with weights above 0 are needed")
    total = sum(weights[s] for s in sorted(weights))
    exact = {s: weights[s] / total * period for s in sorted(weights)}
    share = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: max(0, period - sum(share.values()))]:
        share[s] += 1
    largest = [(-n, s) for s, n in share.items()]
    heapq.heapify(largest)
    for _ in range(sum(share.values()) - period):
        n, s = largest[0]
        share[s] -= 1
        heapq.heapreplace(largest, (n + 1, s))
    return share


def pfair_period(docs: DataFrame, shares: dict[str, int]) -> DataFrame:
    """source, k, slot: in which slot of a period the k-th block (from 1) of a source comes. Block i of
    a source with a share of a in Q slots is released at floor((i - 1) Q / a) and due at ceil(i Q / a);
    in every slot the released block of the earliest deadline goes first, then of the first source.
    As the shares fill the period, every block meets its deadline, so at any slot a source is less
    than one block from its due. After a period the state is that of the start, so one period is enough
    for any amount of data; it has as many rows as the period has slots."""
    names = sorted(shares)
    q = sum(shares.values())
    best = f"""array_min(filter(transform(st.done, (d, i) -> if(d < shares[i] and d * {q} div shares[i] <= t,
        struct(((d + 1) * {q} + shares[i] - 1) div shares[i] as due, i as i), null)), x -> x is not null))"""
    fold = f"""aggregate(sequence(0, {q - 1}), struct(array_repeat(0, {len(names)}) as done, cast(array() as array<int>) as slots),
        (st, t) -> transform(array({best}), p -> struct(transform(st.done, (d, i) -> if(i = p.i, d + 1, d)) as done, concat(st.slots, array(p.i)) as slots))[0], st -> st.slots)"""
    start = docs.sparkSession.range(1).select(F.lit([shares[s] for s in names]).alias("shares"), F.lit(names).alias("names"))
    slots = start.select("names", F.posexplode(F.expr(fold)).alias("slot", "i"))
    k = F.row_number().over(Window.partitionBy("i").orderBy("slot"))
    return slots.select(F.element_at("names", F.col("i") + 1).alias("source"), k.alias("k"), "slot")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = 1 << 17, period: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """Give every row of ``docs`` its place in a mixture of its sources. The documents of a source are
    put in the order of the md5 of their ids and cut into blocks of ``block_chars`` code points (an empty
    text counts one); a document belongs to the block in which it starts. Blocks get slots by
    ``pfair_period``, of a period of ``period`` slots; None: 1000, or more where there are over 500 sources. ``weights``: target
    share of each source, those not named 1e-6 of the largest; None: the square
    root of its size. ``size_col``: the code points of a text, where they are known; ``text_col`` isn't read then.

    Returns all columns of ``docs``, one row for each of its rows, with mix_source, block (from 0), slot,
    release, deadline (slot < deadline), mix_start (code points of the source before the row) and in_mix: the slot
    comes before the first at which some source has run out; up to there the mixture has its weights, as multiples
    of 1 / period, at every slot, with less than one block of deviation. Sorting by slot and mix_start gives the mixture;
    rows after in_mix go on in the same order, with the slots of used-up sources empty. Nothing is dropped or repeated. A column of
    ``docs`` with such a name is replaced. A null source is the source ''. Rows that share an id follow each other in the order
    of a hash of all their columns, and rows without one are spread by that hash, so places are the same
    when a lost task runs again; equal rows are interchangeable. An empty table gives an empty result.

    Running sums within a source come from fine ranges of the md5 order: sums of ranges are added up, in two
    levels, then each range adds up its own rows, so a source with a third of all rows is spread as any other.
    The sources (one row each) and the schedule (2 slots or more each) are all that is collected or broadcast; beyond
    BROADCAST_PLACES they are joined by a shuffle. Scheduling takes time in proportion to slots times sources: seconds for some thousands.
    """
    new = ("mix_source", "block", "slot", "release", "deadline", "mix_start", "in_mix")
    held = docs.drop(*new)
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in held.schema.fields if "map<" not in f.dataType.simpleString()])
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), content.cast("string")).cast("binary"))
    measured = F.col(f"`{size_col}`").cast("long") if size_col else F.length(F.col(f"`{text_col}`").cast("string"))
    size = F.greatest(F.coalesce(measured, F.lit(0)), F.lit(1)).cast("long")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    totals = {r["s"]: (r["n"], r["c"]) for r in held.groupBy(source.alias("s")).agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("c")).collect()}
    if not totals:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(new, ("string", *["long"] * 5, "boolean"), strict=True)]
        return held.select("*", *none)
    least = 1e-6 * max(weights.values()) if weights else 0
    period = period or period_of(len(totals))
    shares = quantised({s: weights.get(s, least) if weights else math.sqrt(n) for s, (n, _) in totals.items()}, period)
    digits = max(1, math.ceil(math.log(max(1, sum(c for _, c in totals.values()) / DOCS_PER_RANGE), 16)))
    schedule = pfair_period(docs, shares)

    names = sorted(shares)
    # what each source has: its share, and its first missing block; at the slot that the first of these would have, the mixture ends
    each = F.lit(names), F.lit([shares[s] for s in names]), F.lit([-(-totals[s][0] // block_chars) for s in names])
    known = docs.sparkSession.range(1).select(F.explode(F.arrays_zip(*[x.alias(c) for x, c in zip(each, ("source", "share", "missing"), strict=True)])).alias("x"))
    known = known.select("x.source", F.col("x.share").cast("long").alias("share"), F.col("x.missing").cast("long").alias("missing"))
    places = schedule.join(F.broadcast(known), "source")
    end = places.where(F.col("k") == F.col("missing") % F.col("share") + 1).agg(F.min(F.floor(F.col("missing") / F.col("share")) * period + F.col("slot"))).first()[0]

    rows = held.select("*", source.alias("mix_source"), size.alias("_mix_size"), key.alias("_mix_key"), content.alias("_mix_row")).withColumn("_mix_range", F.substring("_mix_key", 1, digits))
    part = F.substring("_mix_range", 1, (digits + 1) // 2)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_range = rows.groupBy("mix_source", "_mix_range").agg(F.sum("_mix_size").alias("_mix_sum")).withColumn("_mix_part", part)
    per_part = per_range.groupBy("mix_source", "_mix_part").agg(F.sum("_mix_sum").alias("_mix_sum"))
    per_part = per_part.select("mix_source", "_mix_part", before(Window.partitionBy("mix_source").orderBy("_mix_part"), "_mix_sum").alias("_mix_first"))
    per_range = per_range.withColumn("_mix_next", before(Window.partitionBy("mix_source", "_mix_part").orderBy("_mix_range"), "_mix_sum"))
    per_range = per_range.join(per_part, ["mix_source", "_mix_part"]).select("mix_source", "_mix_range", (F.col("_mix_first") + F.col("_mix_next")).alias("_mix_before"))
    within = Window.partitionBy("mix_source", "_mix_range").orderBy("_mix_key", "_mix_row")
    rows = rows.join(per_range, ["mix_source", "_mix_range"])
    rows = rows.withColumn("mix_start", F.col("_mix_before") + before(within, "_mix_size"))
    rows = rows.withColumn("block", F.floor(F.col("mix_start") / block_chars))
    small = period <= BROADCAST_PLACES
    shared = known.select(F.col("source").alias("mix_source"), F.col("share").alias("_mix_share"))
    rows = rows.join(F.broadcast(shared) if small else shared, "mix_source").withColumn("_mix_k", (F.col("block") % F.col("_mix_share") + 1).cast("int"))
    places = schedule.select(F.col("source").alias("mix_source"), F.col("k").alias("_mix_k"), F.col("slot").alias("_mix_slot"))
    rows = rows.join(F.broadcast(places) if small else places, ["mix_source", "_mix_k"])
    rows = rows.withColumn("slot", F.floor(F.col("block") / F.col("_mix_share")) * period + F.col("_mix_slot"))
    rows = rows.withColumn("release", F.floor(F.col("block") * period / F.col("_mix_share")))
    rows = rows.withColumn("deadline", F.ceil((F.col("block") + 1) * period / F.col("_mix_share"))).withColumn("in_mix", F.col("slot") < end)
    return rows.select(*[f"`{c}`" for c in held.columns], *new)
