"""Layout, jobs, sessions, archives, conversion and streams."""

import io
import math
import os
import random
import time
import zipfile

import pytest
from folioforge.operators import archives, formats, imaging, jobs, layout, sessions
from folioforge.plans.convert import convert
from folioforge.registry import CATEGORIES, FORMATS, categories
from folioforge.registry import formats as registry_formats
from folioforge.settings import Settings
from folioforge.sources.files import audit_lines, decoded_text, job_archives, read_files, write_results
from folioforge.streaming.clients import rate_limit_stream, session_stream, status_stream, sweep_stream, uploads_stream
from folioforge.streaming.states import ROCKSDB, file_states
from pyspark.sql import functions as F

from tests.core.test_readers import docx, epub, pdf, pptx, xlsx, zipped

WORDS = "doc_id long, page int, block int, paragraph int, line int, pos int, text string, left int, top int, width int, height int, confidence double"


def page(lines, doc=1, n=1, block=1, gap=30):
    """Words of lines: (text or cells [(x, text)], height)."""
    out = []
    for k, (line, height) in enumerate(lines):
        pos, top = 0, 40 * k if gap == 30 else gap * k
        for x, text in line if isinstance(line, list) else [(100, line)]:
            for w in text.split():
                out.append((doc, n, block, 1, k, pos, w, x, top, 10 * len(w), height, 90.0))
                x += 10 * len(w) + 10
                pos += 1
    return out


def rebuilt(spark, words, width=1700):
    w = spark.createDataFrame(words, WORDS)
    widths = w.select("doc_id", "page").distinct().withColumn("page_width", F.lit(width))
    return {(r["doc_id"], r["page"]): r for r in layout.reconstruct(w, widths).collect()}


def test_title_lists_tables_and_paragraphs(spark):
    prose = "this body text runs on to the very right margin of the page here"
    lines = [("Annual Report", 60), (prose, 26), (prose[:-5] + " inter-", 26), ("nationally typed end.", 26), ("• first item", 60), ("2) second", 26), ([(100, "Item"), (520, "Qty|x")], 26), ([(100, "Widget"), (520, "5")], 26), ([(102, "Gear"), (520, "7")], 26), ("ALL CAPS", 26)]
    md = rebuilt(spark, page(lines))[1, 1]["markdown"]
    assert md.startswith(f"# Annual Report\n\n{prose} {prose[:-5]} internationally typed end.\n\n- first item\n\n2. second\n\n| Item | Qty\\|x |\n| --- | --- |\n| Widget | 5 |\n| Gear | 7 |\n\n### ALL CAPS")


def test_two_columns_are_read_one_after_the_other(spark):
    words = [w for k in range(6) for w in page([([(100, f"left{k} a"), (950, f"right{k} b")], 26)], block=1)]
    words = [(d, p, 1 if x < 900 else 2, 1, k, pos, t, x, 40 * k, w, h, c) for k in range(6) for (d, p, _, _, _, pos, t, x, _, w, h, c) in words[4 * k : 4 * k + 4]]
    md = rebuilt(spark, words)[1, 1]["markdown"]
    assert md.index("left5") < md.index("right0")
    spanning = words + [(1, 1, 3, 1, 9, 0, "wide", 100, 400, 1500, 26, 90.0)]
    assert rebuilt(spark, spanning)[1, 1]["markdown"].index("right0") < rebuilt(spark, spanning)[1, 1]["markdown"].index("left5")


def test_tables_that_cant_be_laid_out_fall_back_to_lines(spark):
    wide = [[(100 + 130 * k, f"c{k}") for k in range(12)] for _ in range(2)]
    prose = "plain words of the body that reach to the margin"
    lines = [(prose, 26), *[(row, 26) for row in wide], (prose, 26), ([(100, "A"), (520, "B")], 26), ([(100, "c"), (520, "d"), (700, "e")], 26), ([(100, "f"), (300, "g"), (520, "h"), (700, "i")], 26)]
    w = spark.createDataFrame(page(lines), WORDS)
    got = layout.page_blocks(w, w.select("doc_id", "page").distinct().withColumn("page_width", F.lit(0))).orderBy("n").collect()
    assert [r["kind"] for r in got].count("table") == 1 and "| A | B |  |" in [r["text"] for r in got if r["kind"] == "table"][0]
    assert " ".join(f"c{k}" for k in range(12)) in "\n".join(r["text"] for r in got if r["kind"] == "prose")
    assert got[-1]["kind"] == "prose" and got[-1]["text"] == "f g h i"


def test_blank_lines_count_for_nothing(spark):
    words = page([("one line of prose here", 26), ("two lines of prose here", 26)])
    blank = [(1, 1, 1, 1, 9, 0, "\u3000", 100, 20, 10, 26, 90.0), (2, 1, 1, 1, 0, 0, "\t", 0, 0, 5, 5, 50.0)]
    got = rebuilt(spark, words + blank)
    assert got[1, 1]["markdown"].split() == "one line of prose here two lines of prose here".split() and got[1, 1]["word_count"] == 11
    assert got[2, 1]["markdown"] == "" and got[2, 1]["warnings"] == ["No readable text was found on this page."]


def test_words_that_dont_count_and_empty_pages(spark):
    w = spark.createDataFrame([(1, 1, 1, 1, 1, 0, " ", 0, 0, 1, 1, 90.0), (1, 1, 1, 1, 1, 1, "x", 0, 0, 1, 1, -1.0), (1, 1, 1, 1, 1, 2, "y", 0, 0, 1, 1, None)], WORDS)
    assert layout.recognised(w).count() == 0


def test_document_confidence_and_warnings(spark):
    rows = [(1, 1, "a", 10, 90.0, ["w"]), (1, 2, " ", 0, 0.0, ["w"]), (1, 3, "b", 30, 50.0, []), (1, 4, "c", 9, -1.0, []), (2, 1, "", 0, -1.0, [])]
    got = {r["doc_id"]: r for r in layout.documents(spark.createDataFrame(rows, "doc_id long, page int, markdown string, word_count long, confidence double, warnings array<string>")).collect()}
    assert got[1]["markdown"] == "a\n\nb\n\nc" and got[1]["confidence"] == 60.0 and got[1]["word_count"] == 49 and got[1]["empty_pages"] == 1
    assert got[1]["warnings"][0] == "w" and len(got[1]["warnings"]) == 3 and got[2]["confidence"] == -1.0


def test_folds(spark):
    one = spark.range(1)
    runs = one.select(layout.table_runs(F.array(*map(F.lit, (3, 3, 4, 5, 1, 2, 2))))).first()[0]
    assert [(r["start"], r["length"]) for r in runs] == [(0, 3), (5, 2)]
    assert one.select(layout.column_anchors(F.array(*map(F.lit, (40, 0, 5, 14, 20, 0))))).first()[0] == [0.0, 14.0, 40.0]
    assert one.select(layout.nearest_column(F.array(*map(F.lit, (0.0, 10.0, 20.0))), F.lit(5))).first()[0] == 0


def test_job_status_priorities(spark):
    cases = {"processing": ["processing", "queued"], "queued": ["queued", "failed"], "failed": ["failed", "failed"], "completed": ["cancelled", "cancelled"]}
    rows = [(k, s) for k, (_, v) in enumerate(cases.items()) for s in v] + [(9, "queued"), (9, "completed")]
    df = spark.createDataFrame(rows, "job_id long, status string")
    got = {r["job_id"]: r["status"] for r in jobs.job_status(df, F.col("job_id") == 9).collect()}
    assert got == {**dict(enumerate(cases)), 9: "cancelled"}


def test_unique_names(spark):
    rows = [(1, i, n) for i, n in enumerate(["a.md", "a-2.md", "a.md", "a.md", "b", "b"])]
    got = sorted((r["ord"], r["name"]) for r in jobs.unique_names(spark.createDataFrame(rows, "job_id long, ord int, filename string")).collect())
    assert [n for _, n in got] == ["a.md", "a-2.md", "a-3.md", "a-4.md", "b", "b-2"]


def test_unique_names_against_one_fold_over_a_job(spark):
    """Names that look like others' with a number, in random order, against a walk over all names of a job."""
    rng = random.Random(5)
    rows = [(j, i, rng.choice(["a", "a-2", "a-2-2", "b", "b-3", "a.tar"]) + rng.choice([".md", ".csv", ""])) for j in range(4) for i in range(40)]
    got = {(r["job_id"], r["ord"]): r["name"] for r in jobs.unique_names(spark.createDataFrame(rows, "job_id long, ord int, filename string")).collect()}
    for j in range(4):
        taken = set()
        for _, i, name in sorted(r for r in rows if r[0] == j):
            stem, dot, end = name.rpartition(".") if "." in name else (name, "", "")
            k, new = 2, name
            while new in taken:
                new, k = f"{stem}-{k}{dot}{end}", k + 1
            taken.add(new)
            assert got[j, i] == new
        assert len(taken) == 40


def test_unique_names_where_numbers_meet(spark):
    """Several levels, dots without an extension, numbers with zeros, numbers beyond reach, names of numbers alone."""
    rng = random.Random(11)
    stems = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-4-2", "a-02", "a-1", "a-10", "a-99999999999999999999", "-2", "", "7-7"]
    rows = [(j, i, rng.choice(stems[: 3 + 5 * j]) + rng.choice([".md", ".", ""])) for j in range(3) for i in range(150)]
    rows += [(9, i, n) for i, n in enumerate(["a-3", "a", "a", "a-2", "a", "a-2", "a-2-2", "a-5", "a", "a"])]
    got = {(r["job_id"], r["ord"]): r["name"] for r in jobs.unique_names(spark.createDataFrame(rows, "job_id long, ord int, filename string")).collect()}
    assert len(got) == len(rows)
    for j in {r[0] for r in rows}:
        taken = set()
        for _, i, name in sorted(r for r in rows if r[0] == j):
            stem, dot, end = name.rpartition(".")
            stem, end = (stem, f".{end}" if end else "") if dot else (name, "")
            k, new = 2, name
            while new in taken:
                new, k = f"{stem}-{k}{end}", k + 1
            taken.add(new)
            assert got[j, i] == new, (j, i, name)


def test_very_many_equal_names(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").alias("ord"), F.when(F.col("id") % 10 == 7, F.concat(F.lit("part-"), (F.col("id") + 3).cast("string"), F.lit(".csv"))).otherwise("part.csv").alias("filename"))
    began = time.monotonic()
    got = jobs.unique_names(rows)
    assert got.select("name").distinct().count() == n and time.monotonic() - began < 120


def test_a_client_with_very_many_requests(spark):
    n, rng = 200_000, random.Random(4)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 30, 400 if i % 1000 else 5000])
        rows.append((1, i, t, rng.randint(0, 90)))
    events = spark.createDataFrame(rows, "user_id long, event_id long, s long, bytes long").withColumn("ts", F.timestamp_seconds("s"))
    began = time.monotonic()
    got = {r["event_id"]: r["reason"] for r in sessions.rate_limited(events, max_jobs=40, max_bytes=1500, seconds=600).collect()}
    assert time.monotonic() - began < 120
    held = []
    for _, i, s, b in rows:
        held = [x for x in held if x[0] >= s - 600]
        want = "jobs" if len(held) >= 40 else "bytes" if sum(x[1] for x in held) + b > 1500 else None
        if want is None:
            held.append((s, b))
        assert got[i] == want


def test_cancel_and_retry(spark):
    rows = [(1, 10, "queued", None, None), (1, 11, "processing", None, None), (1, 12, "failed", "e", None), (2, 20, "queued", None, None), (2, 21, "failed", "e", "m"), (2, 22, "completed", None, "m")]
    files = spark.createDataFrame(rows, "job_id long, file_id long, status string, error string, markdown string")
    after = jobs.cancelled(files, spark.createDataFrame([(1,), (1,), (9,)], "job_id long"))
    assert {r["file_id"]: r["status"] for r in after.collect()} == {10: "cancelled", 11: "processing", 12: "failed", 20: "queued", 21: "failed", 22: "completed"}
    assert {tuple(r) for r in jobs.running(files).collect()} == {(1, 2), (2, 1)}
    again = jobs.retried(files, spark.createDataFrame([(2, 21), (2, 21), (1, 21)], "job_id long, file_id long"))
    assert again.columns == files.columns and {tuple(r) for r in again.collect()} == {r if r[1] != 21 else (2, 21, "processing", None, None) for r in rows}
    owned = files.withColumn("session_id", F.col("job_id") * 100)
    asked = spark.createDataFrame([(100, 1, 12), (100, 2, 21), (200, 2, 99)], "session_id long, job_id long, file_id long")
    assert [r["file_id"] for r in jobs.file_of(owned, asked).collect()] == [12]


def test_sweep_counts(spark):
    events = requests(spark, [(1, 1, 0, 0), (2, 2, 5000, 0), (3, 3, 9900, 0)])
    folders = spark.createDataFrame([(1, 0), (2, 5000), (3, 0), (8, 0), (9, 9000)], "session_id long, s long").select("session_id", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("modified"))
    now = F.timestamp_seconds(F.lit(1_000_010_000))
    assert sessions.sweep_counts(events, folders, now).first()[:] == (2, 3, 2)


def test_spliced_and_nested(spark):
    files = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "job_id long, file_id long, ord int")
    members = spark.createDataFrame([(1, 11, 1), (1, 11, 2)], "job_id long, file_id long, member_ord int")
    got = sorted((r["ord"], r["member_ord"], r["file_id"]) for r in jobs.spliced(files, members).collect())
    assert got == [(0, 0, 10), (1, 1, 11), (1, 2, 11), (2, 0, 12)]
    assert [f["file_id"] for f in jobs.as_response(files).first()["files"]] == [10, 11, 12]


def requests(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, s long, bytes long").select("user_id", "event_id", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"), "bytes")


def test_limits(spark):
    rows = [(1, i, t, 1) for i, t in enumerate([0, 600, 1200, 1800, 3600, 3601, 4300])] + [(2, 10, 0, 900), (2, 11, 1, 900), (2, 12, 2, 100)]
    got = {(r["user_id"], r["event_id"]): (r["accepted"], r["reason"]) for r in sessions.rate_limited(requests(spark, rows), 3, 1024, 3600).collect()}
    assert [got[1, i][0] for i in range(7)] == [True, True, True, False, False, True, True]
    assert [got[2, i][1] for i in (10, 11, 12)] == [None, "bytes", None]


def test_session_ends_at_exactly_the_pause(spark):
    rows = [(1, 1, 0, 0), (1, 2, 1799, 0), (1, 3, 1799 + 1800, 0), (2, 4, 5, 0)]
    got = {r["event_id"]: r["session"] for r in sessions.sessions(requests(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def streamed(spark, tmp_path, df, n=3):
    """The rows in n files that come one after another."""
    src = str(tmp_path / "in")
    ordered, seen = df.orderBy("ts").collect(), {}
    for k in range(n):
        part = spark.createDataFrame(ordered[k * len(ordered) // n : (k + 1) * len(ordered) // n], df.schema)
        part.coalesce(1).write.mode("append").parquet(src)
        for f in (tmp_path / "in").glob("*.parquet"):  # files are taken by age
            seen.setdefault(f, len(seen))
            os.utime(f, (1_000_000 + 10 * seen[f],) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def run_to_memory(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_limit_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(u, 100 * u + i, t, rng.randint(1, 500)) for u in range(3) for i, t in enumerate(sorted(rng.sample(range(20000), 12)))]
    df = requests(spark, rows)
    batch = {(r["event_id"], r["accepted"], r["reason"]) for r in sessions.rate_limited(df, 3, 900, 3600).collect()}
    stream = run_to_memory(rate_limit_stream(streamed(spark, tmp_path, df), 3, 900, 3600, late="10 hours"), "limits")
    assert {(r["event_id"], r["accepted"], r["reason"]) for r in stream.collect()} == batch


def test_session_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, 1, 0, 0), (1, 2, 1799, 0), (1, 3, 3599, 0), (2, 4, 5, 0), (9, 5, 10**6, 0), (9, 6, 2 * 10**6, 0)]
    df = requests(spark, rows)
    batch = {(r["user_id"], r["started"], r["last_seen"], r["n_events"]) for r in sessions.session_spans(df).where("user_id < 9").collect()}
    stream = run_to_memory(session_stream(streamed(spark, tmp_path, df), late="0 seconds"), "spans")
    assert {tuple(r) for r in stream.where("user_id < 9").collect()} == batch


HOUR = 3600


def test_sweeps_as_streams_agree_with_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(u, 100 * u + i, t, 0) for u in range(6) for i, t in enumerate(sorted(rng.sample(range(0, 12 * HOUR, 7), 9)))]
    rows += [(0, 9000, 10**6, 0), (0, 9001, 10**6 + 1, 0), (1, 9002, 10**6 + 5, 0)]  # time goes on
    df = requests(spark, rows)
    spans = {}
    for u, _, t, _ in rows:
        spans.setdefault(u, []).append(t)
    touched = [(u, max(x for x in ts if x < 10**6) - 600 * (u % 3)) for u, ts in spans.items()] + [(77, 5), (77, 5 + HOUR), (78, 3 * HOUR)]
    folders = spark.createDataFrame([(i, t) for i, t in touched] + [(0, 10**6)], "session_id long, s long").withColumn("modified", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    for part in ("ev", "fo"):
        (tmp_path / part).mkdir()
    ev = streamed(spark, tmp_path / "ev", df)
    fo = streamed(spark, tmp_path / "fo", folders.withColumnRenamed("modified", "ts")).withColumnRenamed("ts", "modified")
    q = sweep_stream(ev, fo, late="0 seconds").writeStream.format("memory").queryName("sweeps").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["kind"], r["id"], int(r["since"].timestamp()) - 1_000_000_000) for r in spark.sql("select kind, id, cast(since as timestamp) as since from sweeps").collect()}
    # pauses, one by one
    def paused(own, others, wait, beyond):
        return {(u, t) for u, ts in own.items() for t in ts if not any(x > t and (x - t <= wait if beyond else x - t < wait) for x in others.get(u, [])) and t + wait < 10**6}

    fold = {}
    for i, t in [*touched, (0, 10**6)]:
        fold.setdefault(i, []).append(t)
    both = {u: fold.get(u, []) + spans.get(u, []) for u in {*fold, *spans}}
    assert {x[1:] for x in got if x[0] == "expired_session"} == paused(spans, spans, HOUR // 2, False)
    assert {x[1:] for x in got if x[0] == "rate_limit_bucket"} == paused(spans, spans, HOUR, True)
    assert {x[1:] for x in got if x[0] == "orphaned_workspace"} == paused(fold, both, HOUR, True)
    # as sweeps in batch have it, for folders as they stand when time has gone on
    now = F.timestamp_seconds(F.lit(1_000_000_000 + 10**6 - 1))
    early = df.where(F.col("ts") < now)
    lost = {r["session_id"] for r in sessions.orphans(folders.where(F.col("modified") < now).groupBy("session_id").agg(F.max("modified").alias("modified")), early.where("false").selectExpr("user_id as session_id"), now).collect()}
    assert {i for k, i, _ in got if k == "orphaned_workspace"} == lost - {u for u in lost if max(both[u], key=lambda t: t if t < 10**6 else -1) not in fold[u]}
    counts = sessions.sweep_counts(early, folders.where("false"), now).first()
    assert len({i for k, i, _ in got if k == "expired_session"}) == counts["ended_sessions"] and len({i for k, i, _ in got if k == "rate_limit_bucket"}) == counts["idle_limits"]
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) > kept[-1]


def job_events(files, spark):
    """Events that lead files (job_id, file_id, status) to their states, then cancelling of each third job and retrying of failed files with even ids."""
    rows, n = [], 0
    for job, file, status in files:
        for k, event in enumerate(["queue", *([] if status == "queued" else ["start"]), *{"completed": ["complete"], "failed": ["fail"]}.get(status, [])]):
            rows.append((job, file, 10 * k, n := n + 1, event, "broken" if event == "fail" else None))
    rows += [(job, None, 1000, n := n + 1, "cancel", None) for job in sorted({f[0] for f in files}) if job % 3 == 0]
    rows += [(job, file, 2000, n := n + 1, "retry", None) for job, file, status in files if status == "failed" and file % 2 == 0]
    # too late: a job's end isn't reopened, and what is known already isn't queued again
    rows += [(job, file, -1, n := n + 1, "start", None) for job, file, _ in files] + [(job, file, 3000, n := n + 1, "queue", None) for job, file, _ in files]
    df = spark.createDataFrame(rows, "job_id long, file_id long, s long, event_id long, event string, error string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s").withColumn("arrives", F.col("event_id"))


@pytest.fixture
def keyed_states(spark):
    """The state store of several variables, and runs that end."""
    wanted = {ROCKSDB[0]: ROCKSDB[1], "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_job_states_over_a_stream_and_a_restart(spark, tmp_path, keyed_states):
    rng = random.Random(2)
    files = [(j, 10 * j + i, rng.choice(["queued", "processing", "completed", "failed"])) for j in range(6) for i in range(5)]
    table = spark.createDataFrame([(*f, None, None) for f in files], "job_id long, file_id long, status string, error string, markdown string")
    stopped = jobs.cancelled(table, table.where("job_id % 3 = 0").select("job_id").distinct())
    want = {r["file_id"]: r["status"] for r in jobs.retried(stopped, stopped.where("status = 'failed' and file_id % 2 = 0").select("job_id", "file_id")).collect()}
    events = job_events(files, spark)
    src, n = str(tmp_path / "ev"), events.count()
    for part in range(2):  # the query ends, and starts again from its checkpoint
        events.where(f"arrives > {n * part // 2} and arrives <= {n * (part + 1) // 2}").drop("arrives").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.drop("arrives").schema).parquet(src)
        q = file_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "moved"))).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    # the event that moved a file last tells its state
    out = {r["file_id"]: r for r in spark.read.parquet(str(tmp_path / "moved")).orderBy("event_id").collect()}
    assert {f: r["status"] for f, r in out.items()} == want
    assert all((r["attempt"], r["error"]) == ((2, None) if r["status"] == "processing" and f % 2 == 0 and r["attempt"] > 1 else (1, "broken" if r["status"] == "failed" else None)) for f, r in out.items())


def test_job_states_in_a_cancelled_job(spark, keyed_states):
    rows = [(1, 1, 1, 1, "queue"), (1, 2, 1, 2, "queue"), (1, 3, 1, 3, "queue"), (1, 2, 2, 4, "start"), (1, 3, 2, 5, "start"), (1, None, 3, 6, "cancel"), (1, 2, 4, 7, "fail"), (1, 3, 4, 8, "complete"), (1, 4, 5, 9, "queue"), (1, 4, 6, 10, "start"),
            (1, 1, 7, 11, "retry"), (1, 5, 8, 12, "queue"), (1, 5, 9, 13, "start"), (1, 5, 10, 14, "fail"), (1, 9, 11, 15, "complete"), (1, None, 11, 16, "start"), (1, 5, 12, 17, "odd"), (None, 1, 1, 18, "queue"), (1, 5, 3, 19, "complete")]
    df = spark.createDataFrame([(*r, None) for r in rows], "job_id long, file_id long, s long, event_id long, event string, error string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r["file_id"]: (r["status"], r["attempt"]) for r in file_states(df).collect()}
    assert got == {1: ("processing", 2), 2: ("cancelled", 1), 3: ("completed", 1), 4: ("cancelled", 1), 5: ("failed", 1)}


def test_status_and_upload_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, "queued"), (1, 2, 2, "processing"), (2, 1, 3, "failed")], "file_id long, s long, event_id long, status string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    got = run_to_memory(status_stream(streamed(spark, tmp_path, df)), "states", "complete")
    assert {tuple(r) for r in got.collect()} == {(1, "processing"), (2, "failed")}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.json").write_bytes(b'{"a": 1}')
    got = run_to_memory(uploads_stream(spark, str(tmp_path / "up")).select("filename", "content"), "ups")
    assert convert(got.select(F.lit(1).cast("long").alias("file_id"), F.lit(0).cast("long").alias("job_id"), F.lit(0).alias("ord"), "filename", "content")).first()["markdown"] == "- **a**: 1\n"


def test_archives(spark):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(link, "target")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.csv", b"0" * 2_000_000)
    cases = {"ok": zipped({"d/a.csv": "x,y\n1,2", "b.txt": "no", "in.zip": "z"}), "slip": zipped({"../a.csv": "x"}), "link": out.getvalue(), "bomb": bomb.getvalue(), "many": zipped({f"{i}.csv": "x" for i in range(9)}), "empty": zipped({}), "broken": b"PK\x03\x04"}
    df = spark.createDataFrame([*cases.items()], "file_id string, content binary")
    got = archives.inspect(archives.list_entries(df), Settings(max_archive_files=5)).collect()
    assert {r["file_id"]: r["problem"] for r in got} == {"ok": None, "slip": "unsafe name", "link": "symbolic link", "bomb": "suspicious ratio", "many": "too many files", "empty": "empty", "broken": "corrupt_file"}
    assert {(r["display_name"], r["supported"]) for r in got if r["file_id"] == "ok"} == {("a.csv", True), ("b.txt", False), ("in.zip", False)}
    chosen = spark.createDataFrame([("ok", 0), ("ok", 1)], "file_id string, position int")
    assert {(r["position"], bytes(r["content"])) for r in archives.extract(df, chosen).collect()} == {(0, b"x,y\n1,2"), (1, b"no")}
    assert archives.extract(df, chosen, Settings(max_file_bytes=3)).where("too_large").count() == 1
    archives.register(spark)
    df.createOrReplaceTempView("packed")
    assert spark.sql("select e.name from packed, lateral zip_entries(content) e where file_id = 'ok'").count() == 3


FILES = {
    "a/report.docx": docx(), "book.epub": epub(), "deck.pptx": pptx(), "table.xlsx": xlsx(), "text.pdf": pdf("word " * 40), "scan.pdf": pdf(""), "x.json": b'{"title": "T", "a": [1, 2]}', "x.xml": b"<r><a>1</a></r>", "n.ipynb": b'{"cells": [{"cell_type": "markdown", "source": "# N"}]}',
    "p.html": b"<h1>Hi</h1><p onclick='x'>there &lt;script&gt;</p>", "t.csv": b"h\n1", "latin.csv": "é;b\nü;1".encode("cp1252"), "fake.pdf": b"no pdf", "wrong.docx": xlsx(), "empty.csv": b"", "blank.json": b" ", "bad.json": b"{", "old.doc": b"x", "none": b"x", "i.png": b"\x89PNG\r\n\x1a\n....", "bundle.zip": zipped({"data/table.csv": "p\nAlpha", "data/table.json": '{"k": 1}', "readme.txt": "no"}), "slip.zip": zipped({"../e.csv": "x"}), "only.zip": zipped({"readme.txt": "no"}), "nothing.html": b"<script>x</script>",
}


@pytest.fixture(scope="module")
def converted(spark):
    df = spark.createDataFrame([(i, 1, i, n, d) for i, (n, d) in enumerate(FILES.items())], "file_id long, job_id long, ord int, filename string, content binary")
    return df, convert(df).cache()


def test_conversion_of_every_format(spark, converted):
    got = {r["filename"]: r for r in converted[1].where("source_archive is null").collect()}
    code = {n: r["error"]["code"] if r["error"] else None for n, r in got.items()}
    assert code == {
        "report.docx": None, "book.epub": None, "deck.pptx": None, "table.xlsx": None, "text.pdf": None, "scan.pdf": None, "x.json": None, "x.xml": None, "n.ipynb": None, "p.html": None, "t.csv": None, "latin.csv": None,
        "fake.pdf": "format_mismatch", "wrong.docx": "format_mismatch", "empty.csv": "corrupt_file", "blank.json": "corrupt_file", "bad.json": "format_mismatch", "old.doc": "unsupported_format", "none": "unsupported_format", "i.png": "ocr_unavailable", "slip.zip": "archive_rejected", "only.zip": "archive_rejected", "nothing.html": "empty_result",
    } | {"scan.pdf": code["scan.pdf"]}
    assert "Engineering" in got["report.docx"]["markdown"] and got["report.docx"]["metadata"]["title"] == "Project Proposal" and got["report.docx"]["output_filename"] == "report.md"
    assert got["latin.csv"]["markdown"].startswith("| é | b |") and got["old.doc"]["error"]["message"].startswith("Older .doc")
    assert got["p.html"]["metadata"]["contains_raw_html"] and len(got["p.html"]["warnings"]) == 1
    assert got["text.pdf"]["metadata"]["pages"] == 1 and got["x.json"]["metadata"]["word_count"] == 8 and got["x.json"]["metadata"]["category"] == "data"


def test_archives_give_a_row_for_each_member(converted):
    got = {r["filename"]: r for r in converted[1].where("source_archive = 'bundle.zip'").collect()}
    assert set(got) == {"table.csv", "table.json"} and all(r["status"] == "completed" for r in got.values()) and got["table.csv"]["member_ord"] == 1


def content_scans(df):
    """How many scans of the plan read contents of files."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return sum("binaryFile" in x and "content" in x for x in plan.split("\n"))


def test_contents_are_read_once_and_archives_once_more(spark, tmp_path):
    folder = tmp_path / "plain"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.json").write_bytes(b'{"a": %d}' % k)
    assert content_scans(convert(read_files(spark, str(folder)))) == 1
    (folder / "z.zip").write_bytes(zipped({"m.csv": b"a,b\n1,2\n", "f0.json": b"[]"}))
    both = convert(read_files(spark, str(folder)))
    assert content_scans(both) == 2
    assert sorted(r["filename"] for r in both.collect()) == ["f0-2.json", "f0.json", "f1.json", "f2.json", "m.csv"]


def test_members_get_names_of_their_own(spark):
    packed = zipped({"a/data.csv": "x\n1", "b/data.csv": "y\n2", "c/data-2.csv": "z\n3", "own.csv": "o\n4"})
    df = spark.createDataFrame([(1, 1, 0, "own.csv", b"h\n0"), (2, 1, 1, "z.zip", packed), (3, 2, 0, "z.zip", packed)], "file_id long, job_id long, ord int, filename string, content binary")
    got = {(r["job_id"], r["member_ord"], r["ord"]): r["filename"] for r in convert(df).collect()}
    assert got == {(1, 0, 0): "own.csv", (1, 1, 1): "data.csv", (1, 2, 1): "data-2.csv", (1, 3, 1): "data-2-2.csv", (1, 4, 1): "own-2.csv", (2, 1, 0): "data.csv", (2, 2, 0): "data-2.csv", (2, 3, 0): "data-2-2.csv", (2, 4, 0): "own.csv"}


def test_large_files_and_damaged_members(spark, tmp_path):
    """A file over the limit isn't read, and is too large rather than empty; a damaged member isn't empty either."""
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "big.csv").write_text("x\n" + "1\n" * 300)
    (tmp_path / "two" / "small.csv").write_text("x\n1")
    files = read_files(spark, str(tmp_path), max_bytes=100)
    got = {r["filename"]: (r["error"] or {"code": None})["code"] for r in convert(files, settings=Settings(max_file_bytes=100)).collect()}
    assert got == {"big.csv": "file_too_large", "small.csv": None}
    assert files.select("job_id").distinct().count() == 2 and read_files(spark, str(tmp_path), job_id=7).select("job_id").distinct().first()[0] == 7
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.csv", "a\n1")
        z.writestr("bad.csv", "b\n" + "2\n" * 50)
    data = bytearray(out.getvalue())
    at = data.index(b"bad.csv") + len("bad.csv")
    data[at : at + 3] = b"\xff\xff\xff"
    got = {r["filename"]: r for r in convert(spark.createDataFrame([(1, 1, 0, "z.zip", bytes(data))], "file_id long, job_id long, ord int, filename string, content binary")).collect()}
    assert got["good.csv"]["status"] == "completed" and got["bad.csv"]["error"]["code"] == "corrupt_file" and "can't be read" in got["bad.csv"]["error"]["detail"]


def test_a_reader_that_hangs_is_interrupted(spark):
    def hangs(data, charset):
        import time

        if data == b"slow":
            time.sleep(60)
        if data == b"none":
            raise ImportError("no such library")
        return "quick " * 3, None

    df = spark.createDataFrame([(i, 1, i, "a.pages", d) for i, d in enumerate([b"slow", b"fast", b"none"])], "file_id long, job_id long, ord int, filename string, content binary")
    began = time.monotonic()
    got = {r["ord"]: (r["error"] or {"code": None})["code"] for r in convert(df.withColumn("filename", F.lit("a.xls")).withColumn("content", F.concat(F.unhex(F.lit("d0cf11e0a1b11ae1")), "content")), custom={".xls": lambda data, cs: hangs(data[8:], cs)}, settings=Settings(row_timeout_seconds=1.0)).collect()}
    assert got == {0: "timeout", 1: None, 2: "conversion_failed"} and time.monotonic() - began < 40


def test_options_and_recognition(spark, converted):
    three = spark.createDataFrame([(1, 1, 1, "a.pdf", pdf("one", "two", "three")), (2, 1, 2, "i.png", FILES["i.png"])], "file_id long, job_id long, ord int, filename string, content binary")

    def words(content, extension):
        return [(1, 1, 1, k, 0, t, 100, 40 * k, 10 * len(t), h, 80.0) for k, (t, h) in enumerate([("Title", 60), ("body", 26), ("words", 26), ("more", 26)])]

    got = {r["filename"]: r for r in convert(three, pages="2-3,9").collect()}
    assert got["a.pdf"]["markdown"] == "two\nSecond line\n\nthree\nSecond line\n" and got["a.pdf"]["warnings"][0] == "Only pages 2-3,9 were converted, as requested."
    assert convert(three, pages="x").where("filename = 'a.pdf'").first()["error"]["code"] == "conversion_failed"
    got = {r["filename"]: r for r in convert(three, recognizer=words).collect()}
    assert got["i.png"]["markdown"].startswith("# Title") and got["i.png"]["metadata"]["ocr_confidence"] == 80.0 and got["i.png"]["metadata"]["ocr_used"]
    assert not got["a.pdf"]["metadata"]["ocr_used"] and any("less" in w for w in got["a.pdf"]["warnings"])

    def pages(content, extension):
        return [(p, 1, 1, 0, 0, f"page{p}", 100, 0, 50, 26, 80.0) for p in (1, 2, 3, 4)]

    pdfs = three.where("filename = 'a.pdf'")
    assert convert(pdfs, mode="force", recognizer=pages, settings=Settings(max_pages=2)).first()["markdown"] == "page1\n\npage2\n"
    assert convert(pdfs, mode="force", pages="2-4", recognizer=pages, settings=Settings(max_pages=2)).first()["markdown"] == "page2\n\npage3\n"
    assert convert(three, mode="off", recognizer=words).where("filename = 'i.png'").first()["error"]["code"] == "ocr_unavailable"
    assert convert(three, custom={".pdf": lambda data, charset: ("mine " * 30, "t")}).where("filename = 'a.pdf'").first()["markdown"].startswith("mine")


def test_sinks(spark, converted, tmp_path):
    done = converted[1]
    edits = spark.createDataFrame([(6, "edited\n")], "file_id long, markdown string")
    packed = job_archives(done, edits).first()["archive"]
    with zipfile.ZipFile(io.BytesIO(bytes(packed))) as z:
        names = z.namelist()
        assert len(names) == len(set(names)) and "table.md" in names and "table-2.md" in names and z.read("x.md") == b"edited\n" and "x-2.md" in names
    write_results(done.drop("metadata"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'failed'").count() == done.where("status = 'failed'").count()
    assert audit_lines(done).count() == done.count()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text("x\n1")
    assert convert(read_files(spark, str(tmp_path / "f"))).first()["markdown"] == "| x |\n| --- |\n| 1 |\n"
    assert decoded_text(spark.createDataFrame([(b"a\xff",), (b"ok",)], "content binary")).select("text").orderBy("text").collect()[0][0] == "a�"


def test_registry_holds_together(spark):
    assert len(FORMATS) == 17 and len(CATEGORIES) == 6 and formats.of_no_category(registry_formats(spark), categories(spark)).count() == 0
    webp = "array(struct(0 as offset, '52494646' as hex), struct(8 as offset, '57454250' as hex))"
    df = spark.createDataFrame([(b"RIFF0000WEBP",), (b"RIFF0000WAVE",), (b"RI",)], "c binary")
    assert [r[0] for r in df.select(formats.signatures_match(F.col("c"), F.expr(webp))).collect()] == [True, False, False]


def test_tones_and_skew(spark):
    px = spark.createDataFrame([("a", v) for v in [10] * 50 + [20] * 10 + [200] * 90] + [("b", 7)], "image string, level int")
    assert {r["image"]: r["threshold"] for r in imaging.otsu(px).collect()} == {"a": 20, "b": 128}
    got = {r["image"]: r for r in imaging.ink_paper(px, imaging.otsu(px)).collect()}
    assert got["a"]["paper"] == 200 and (got["b"]["ink"], got["b"]["paper"]) == (0, 255)
    flat = spark.createDataFrame([("f", v) for v in (100, 117, 118, 125, 133, 150)], "image string, level int")
    levels = sorted(r["level"] for r in imaging.stretch(flat, spark.createDataFrame([("f", 100.0, 150.0)], "image string, ink double, paper double")).collect())
    assert levels == [0, 0, 8, 128, 255, 255]
    tilt = [("s", x, round(y - x * math.tan(math.radians(3)))) for y in range(40, 240, 20) for x in range(300)]
    level = [("l", x, y) for y in range(0, 200, 20) for x in range(300)]
    few = [("f", x, 5) for x in range(9)]
    sizes = spark.createDataFrame([(i, 300, 260) for i in "slf"], "image string, width int, height int")
    got = {r["image"]: r["angle"] for r in imaging.skew(spark.createDataFrame(tilt + level + few, "image string, x int, y int"), sizes).collect()}
    assert abs(got["s"] - 3) <= 0.25 and got["l"] == 0.0 and got["f"] == 0.0


def test_images_are_made_ready(spark):
    """Tilted faint lines with specks on a narrow page: afterwards large, level, without specks and with full contrast."""
    rng = random.Random(1)
    w, h = 160, 110
    level = {(x, y): 170 for x in range(w) for y in range(h)}
    for y0 in range(20, 100, 16):
        for x in range(10, w - 10):
            for k in range(5):
                level[x, int(y0 + k + (x - w / 2) * math.tan(math.radians(4)))] = 110
    for _ in range(1500):
        level[rng.randrange(w), rng.randrange(h)] = rng.choice([0, 255])
    px = spark.createDataFrame([(1, x, y, v) for (x, y), v in level.items()] + [(2, x, y, 255) for x in range(3) for y in range(2)], "image int, x int, y int, level int")
    quiet_ = imaging.denoised(px, imaging.sizes_of(px))
    assert {(r["image"], r["changed"]) for r in quiet_.select("image", "changed").distinct().collect()} == {(1, True), (2, False)}
    dark = imaging.dark_pixels(quiet_.where("image = 1"))
    turn = imaging.skew(dark, imaging.sizes_of(px)).first()["angle"]
    assert abs(abs(turn) - 4) <= 0.5
    level_again = imaging.rotated(quiet_.where("image = 1"), imaging.sizes_of(px).where("image = 1").withColumn("angle", F.lit(-turn)))
    assert abs(imaging.skew(imaging.dark_pixels(level_again), imaging.sizes_of(level_again)).first()["angle"]) <= 0.5
    sizes = imaging.upscaled_sizes(imaging.sizes_of(px)).orderBy("image").collect()
    assert [(r["new_width"], r["new_height"]) for r in sizes] == [(1400, 962), (1400, 933)]


def test_the_whole_chain_on_a_wide_page(spark):
    w, h = 1400, 24
    level = [(1, x, y, 100 if y % 8 < 3 and 20 < x < 1380 else 150) for x in range(w) for y in range(h)]
    out = imaging.preprocessed(spark.createDataFrame(level, "image int, x int, y int, level int"))
    got = {(r["x"], r["y"]): r["level"] for r in out.collect()}
    assert len(got) == w * h and got[700, 1] == 0 and got[700, 5] == 255 and set(got.values()) <= {0, 255}


def test_weights_add_up_and_plain_areas_stay(spark):
    for kernel in imaging.KERNELS:
        for n_in, n_out in ((8, 20), (20, 7), (5, 5)):
            sums = imaging.axis_weights(spark.createDataFrame([(n_in, n_out)], "n_in int, n_out int"), kernel).groupBy("target").agg(F.sum("weight").alias("s")).collect()
            assert len(sums) == n_out and all(abs(r["s"] - (1 << imaging.WEIGHT_BITS)) <= 8 for r in sums)
    flat = imaging.grid(spark.createDataFrame([(1, 6, 4)], "image int, width int, height int")).withColumn("level", F.lit(77))
    out = imaging.resized(flat, imaging.sizes_of(flat).withColumns({"new_width": F.lit(13), "new_height": F.lit(3)}))
    assert out.count() == 39 and {r["level"] for r in out.collect()} == {77}


def test_scales(spark):
    one = spark.range(1)
    assert one.select(imaging.upscale_factor(F.lit(700)), imaging.upscale_factor(F.lit(1390)), imaging.render_scale(F.lit(300), F.lit(612), F.lit(792), 10000), imaging.render_scale(F.lit(300), F.lit(7200), F.lit(10), 10000)).first()[:] == (2.0, 1.0, 300 / 72, 10000 / 7200)
    assert one.select(jobs.noted(F.array(F.lit("a")), "b"), jobs.noted(F.array(F.lit("a")), "a")).first()[:] == (["a", "b"], ["a"])
