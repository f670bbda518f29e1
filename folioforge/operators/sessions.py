"""Clients over time: sessions, limits, keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessions(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Events (user_id, ts, event_id, ...) with ``session``: one more after each pause of ``minutes`` or
    longer. (``session_window`` would still join an event exactly that long after the last.)"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(order)
    fresh = F.coalesce(pause >= minutes * 60_000_000, F.lit(True)).cast("int")
    return events.withColumn("session", F.sum(fresh).over(order))


def session_spans(events: DataFrame, minutes: int = 30) -> DataFrame:
    out = sessions(events, minutes).groupBy("user_id", "session")
    return out.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n_events"))


def apart(events: DataFrame, seconds: int) -> DataFrame:
    """Events (user_id, t in microseconds, ...) with ``piece``: they part where a client pauses for longer than ``seconds``. Hours of that
    length tell it: within one there is no such pause, so only the first and last time of each are compared, and a client with very many events is
    counted in pieces before anything of it meets."""
    span = seconds * 1_000_000
    x = events.withColumn("_hour", F.floor(F.col("t") / span))
    hours = x.groupBy("user_id", "_hour").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = Window.partitionBy("user_id").orderBy("_hour")
    paused = F.coalesce(F.col("first") - F.lag("last").over(order) > span, F.lit(True))
    hours = hours.withColumn("_new", F.when(paused, F.col("_hour"))).withColumn("piece", F.max("_new").over(order))
    hours = hours.select(F.col("user_id").alias("_user"), F.col("_hour").alias("_at"), "piece")
    return x.join(hours, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_hour") == F.col("_at"))).drop("_hour", "_user", "_at")


def rate_limited(events: DataFrame, max_jobs: int = 40, max_bytes: int = 500 << 20, seconds: int = 3600) -> DataFrame:
    """Requests (user_id, ts, event_id, bytes) with ``accepted`` and ``reason``. A request is refused if
    within the last ``seconds`` (both ends count) the client had ``max_jobs`` accepted requests, or
    accepted bytes that with its own go beyond ``max_bytes``. Only accepted ones count later, so each
    decision depends on those before. A null time is the earliest, null bytes are none.

    A client's requests part where it pauses for longer than the window, as nothing carries over; pieces are independent. Within one, requests stream by in order
    past the accepted ones of the window, ``max_jobs`` at most, and their bytes: time grows with the requests, memory doesn't."""
    span = seconds * 1_000_000
    x = events.select("user_id", "event_id", F.coalesce(micros(F.col("ts")), F.lit(0)).alias("t"), F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("b"))
    kinds = {c: x.schema[c].dataType.simpleString() for c in ("user_id", "event_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, used = None, deque(), 0
        for batch in batches:
            users, pieces, times, sizes = (batch.column(c).to_pylist() for c in ("user_id", "piece", "t", "b"))
            reasons = []
            for user, piece, t, size in zip(users, pieces, times, sizes, strict=True):
                if group != (user, piece):
                    group, used = (user, piece), 0
                    held.clear()
                while held and held[0][0] < t - span:
                    used -= held.popleft()[1]
                reason = "jobs" if len(held) >= max_jobs else "bytes" if used + size > max_bytes else None
                if reason is None:
                    held.append((t, size))
                    used += size
                reasons.append(reason)
            accepted = pa.array([r is None for r in reasons], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), accepted, pa.array(reasons, pa.string())], names=["user_id", "event_id", "accepted", "reason"])

    ordered = apart(x, seconds).select("user_id", "event_id", "piece", "t", "b").repartition("user_id", "piece").sortWithinPartitions("user_id", "piece", "t", "event_id", "b")
    return ordered.mapInArrow(run, f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, accepted boolean, reason string")


def client_key(address: Column, salt: str) -> Column:
    """Salted digest that stands for an address in logs and limits."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.coalesce(address, F.lit("unknown"))), 256), 1, 32)


def orphans(folders: DataFrame, live: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Folders (session_id, modified) of no live session that are older than twice a session's time."""
    age = micros(now) - micros(F.col("modified"))
    return folders.join(live.select("session_id"), "session_id", "left_anti").where(age > 2 * minutes * 60_000_000)


def expired(events: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """user_id, last_seen, is_over: whether a client's session has ended by ``now``; each event extends it."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("is_over", micros(now) - micros(F.col("last_seen")) >= minutes * 60_000_000)


def sweep_counts(events: DataFrame, folders: DataFrame, now: Column, minutes: int = 30, window_seconds: int = 3600) -> DataFrame:
    """One row of what a sweep at ``now`` clears: ended_sessions, of clients whose session is over;
    lost_folders, folders (session_id, modified) of no session that still lives, old enough; idle_limits, clients
    without a request within the window of the limit."""
    last = expired(events, now, minutes)
    live = last.where("not is_over").select(F.col("user_id").alias("session_id"))
    idle = micros(now) - micros(F.col("last_seen")) > window_seconds * 1_000_000
    clients = last.agg(F.count_if("is_over").alias("ended_sessions"), F.count_if(idle).alias("idle_limits"))
    lost = orphans(folders, live, now, minutes).agg(F.count(F.lit(1)).alias("lost_folders"))
    return clients.withColumn("_one", F.lit(1)).join(lost.withColumn("_one", F.lit(1)), "_one").select("ended_sessions", "lost_folders", "idle_limits")
