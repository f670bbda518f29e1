"""The states of a job's files as a stream of events moves them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that keyed state of several variables needs; a setting of the session.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

CHANGES = "job_id long, file_id long, status string, attempt int, error string, event_id long"
_FILE = "status string, attempt int, error string, ts long, event_id long"
#: event: what state it needs, and what state follows. Cancelling and retrying aren't here: they go by rules of their own.
_STEPS = {"start": ("queued", "processing"), "complete": ("processing", "completed"), "fail": ("processing", "failed")}


class FileStates(StatefulProcessor):
    """State of one job: whether it is cancelled, and of each file its status, attempt, error and last event. It goes after
    ``ttl_ms`` without an event."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "cancelled boolean, ts long, event_id long", self.ttl_ms)
        self.files = handle.getMapState("files", "file_id long", _FILE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.job.get() if self.job.exists() else (False, -1, -1)
        cancelled, job_at = known[0], (known[1], known[2])
        held: dict[int, list] = {}
        out: dict[int, tuple] = {}
        events = sorted((int(r.ts), int(r.event_id), r.event, None if pd.isna(r.file_id) else int(r.file_id), None if pd.isna(r.error) else r.error) for b in rows for r in b.itertuples())

        def of(file: int) -> list | None:
            if file not in held and self.files.containsKey((file,)):
                held[file] = list(self.files.getValue((file,)))
            return held.get(file)

        def put(file: int, at: tuple[int, int], status: str, attempt: int, error: str | None) -> None:
            held[file] = [status, attempt, error, *at]
            out[file] = (key[0], file, status, attempt, error, at[1])

        for ts, event_id, event, file, error in events:
            at = (ts, event_id)
            if event == "cancel":
                if at <= job_at:
                    continue
                cancelled, job_at = True, at
                for (f,) in list(self.files.keys()):
                    of(int(f))
                for f, s in list(held.items()):
                    if s[0] == "queued" and (s[3], s[4]) < at:
                        put(f, at, "cancelled", s[1], None)
                continue
            state = of(file) if file is not None else None
            if event == "queue":
                if file is not None and state is None:
                    put(file, at, "queued", 1, None)
            elif state is None or at <= (state[3], state[4]):
                continue  # of no known file, or later than what it would change
            elif event == "retry":
                cancelled, job_at = (False, at) if at > job_at else (cancelled, job_at)
                put(file, at, "processing", state[1] + 1, None)
            elif event in _STEPS and state[0] == _STEPS[event][0]:
                status = _STEPS[event][1]
                if cancelled and event != "complete":  # work that begins or fails in a cancelled job was cancelled
                    put(file, at, "cancelled", state[1], None)
                else:
                    put(file, at, status, state[1], error if status == "failed" else None)
        self.job.update((cancelled, *job_at))
        for file in out:
            self.files.updateValue((file,), tuple(held[file]))
        yield pd.DataFrame(list(out.values()), columns=["job_id", "file_id", "status", "attempt", "error", "event_id"]).astype({"error": object})


def file_states(events: DataFrame, minutes: int = 60) -> DataFrame:
    """job_id, file_id, status, attempt, error, event_id: each file that events (job_id, file_id, ts, event_id, event, error) have changed, once for each
    micro-batch, with the state it has then.

    queue makes a file known; start, complete and fail lead from queued over processing to an end; cancel, of a job (its file_id
    doesn't count), ends what is queued, and what starts or fails after it, while work that completes has completed; retry puts a file
    in work again whatever its state is, clears its error and lifts the cancelling. Nothing else leaves an end, and an event that comes after a later one of its
    file has no effect. Events of files not queued before, of no known kind or without a file are passed over. Events are put in order within a
    micro-batch, by time and then event_id.

    State is one job's, as rows of a map, so an event of a large job reads its own file alone; only cancel reads all. It goes ``minutes`` after the
    last change. The session needs the state store of ``ROCKSDB``. A micro-batch's events
    of one job are sorted in memory, so its size is to be bounded at the source. As state goes by the clock, a run that is to end (availableNow) needs
    spark.sql.streaming.noDataMicroBatches.enabled = false; it else waits for the next thing to go."""
    x = events.selectExpr("job_id", "file_id", "unix_micros(cast(ts as timestamp)) as ts", "event_id", "event", "cast(error as string) as error").where("job_id is not null and ts is not null and event_id is not null")
    _ = events.sparkSession.streams.active  # state stores find each other by an endpoint that comes with the session's streams
    return x.groupBy("job_id").transformWithStateInPandas(FileStates(minutes * 60_000), CHANGES, "Update", "ProcessingTime")


