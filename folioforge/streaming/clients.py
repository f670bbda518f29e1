"""The stateful operators on streams: sessions, limits, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def session_stream(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Sessions (user_id, started, last_seen, n_events) of a stream of events, each given out when it is over.

    As in batch, a pause of exactly ``minutes`` ends a session. Events are put in order within a
    micro-batch; state is a few numbers a user, and goes when the watermark has passed the session's end."""
    gap = minutes * 60_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(state.get)
            state.remove()
        else:
            held = list(state.get) if state.exists else None
            for t in sorted(int(x) for b in batches for x in b["t"]):
                if held is None or t - held[1] >= gap:
                    if held is not None:
                        out.append(tuple(held))
                    held = [t, t, 1]
                else:
                    held = [min(held[0], t), max(held[1], t), held[2] + 1]
            if held is not None:
                state.update(tuple(held))
                end = (held[1] + gap) // 1000 + 1
                state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["user_id", "started", "last_seen", "n_events"])

    x = _watermarked(events, late).withColumn("t", F.unix_micros("ts"))
    found = x.groupBy("user_id").applyInPandasWithState(run, "user_id long, started long, last_seen long, n_events long", "started long, last_seen long, n_events long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("last_seen").alias("last_seen"), "n_events")


def rate_limit_stream(requests: DataFrame, max_jobs: int = 40, max_bytes: int = 500 << 20, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, accepted, reason for each request of a stream. State is the accepted requests of
    a client within the window, and is dropped when the watermark has left it behind."""
    span = seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [], "event_id": [], "accepted": [], "reason": []})
            return
        times, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for t, event, size in sorted((int(r.t), int(r.event_id), int(r.bytes)) for b in batches for r in b.itertuples()):
            keep = [i for i, old in enumerate(times) if old >= t - span]
            times, sizes = [times[i] for i in keep], [sizes[i] for i in keep]
            reason = "jobs" if len(times) >= max_jobs else "bytes" if sum(sizes) + size > max_bytes else None
            if reason is None:
                times.append(t)
                sizes.append(size)
            out.append((key[0], event, reason is None, reason))
        state.update((times, sizes))
        state.setTimeoutTimestamp(max(max(times, default=0) // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted", "reason"])

    x = _watermarked(requests, late).withColumn("t", F.unix_micros("ts"))
    return x.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, accepted boolean, reason string", "times array<long>, sizes array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def quiet(touches: DataFrame, activity: DataFrame, seconds: int, beyond: bool, late: str = "1 hour") -> DataFrame:
    """id, since: the touches (id, ts) after which no activity (id, ts) of the same id came for ``seconds``; ``beyond``: it would still count at exactly that time.

    A left outer join of two streams on an interval: each touch waits for what follows it, and comes out unmatched once both watermarks have
    passed the end of its wait. State is what lies within the wait and the allowed lateness; the rest is dropped."""
    a = touches.select(F.col("id").alias("id"), F.col("ts").cast("timestamp").alias("since")).withWatermark("since", late)
    b = activity.select(F.col("id").alias("_id"), F.col("ts").cast("timestamp").alias("_at")).withWatermark("_at", late)
    span = F.expr(f"since + interval {seconds} seconds")
    until = F.col("_at") <= span if beyond else F.col("_at") < span
    return a.join(b, (F.col("id") == F.col("_id")) & (F.col("_at") > F.col("since")) & until, "left_outer").where("_id is null").select("id", "since")


def sweep_stream(events: DataFrame, folders: DataFrame, minutes: int = 30, window_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """kind, id, since: what sweeps clear, each as soon as its time is over: expired_session, a client (events: user_id, ts) that paused for a session's
    time; orphaned_workspace, a folder (session_id, modified) that neither it nor its session was touched for over twice that time; rate_limit_bucket, a client
    without a request for over the window of the limit. One that comes back and pauses again comes out again.

    Three interval joins of the same streams; each has state of its own that goes with the watermark. Events that share client and time count once or more alike."""
    active = events.select(F.col("user_id").alias("id"), "ts")
    touched = folders.select(F.col("session_id").alias("id"), F.col("modified").alias("ts"))
    kinds = [
        ("expired_session", quiet(active, active, 60 * minutes, False, late)),
        ("orphaned_workspace", quiet(touched, active.unionByName(touched), 120 * minutes, True, late)),
        ("rate_limit_bucket", quiet(active, active, window_seconds, True, late)),
    ]
    out = [x.select(F.lit(kind).alias("kind"), "id", "since") for kind, x in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


def status_stream(events: DataFrame) -> DataFrame:
    """file_id, status: the latest status of each file, as an updating aggregate over a stream of
    (file_id, ts, event_id, status)."""
    return events.groupBy("file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def uploads_stream(spark, folder: str, pattern: str = "*", files_per_batch: int = 10_000) -> DataFrame:  # noqa: ANN001
    """Files that arrive in a folder, as rows for ``convert``: a folder is a job, as for files that are read at once, and a file's place in it is the hash of its path."""
    x = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return x.select(F.xxhash64("path").alias("file_id"), F.xxhash64(F.regexp_extract("path", r"^(.*)/", 1)).alias("job_id"), F.xxhash64("path").alias("ord"), F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), "content")
