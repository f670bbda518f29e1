"""Results as files, as a stored table, and of work that is stopped."""

import os
import time

import pytest
from folioforge.plans.convert import convert
from folioforge.sources.files import read_files
from folioforge.sources.markdown_files import MarkdownFiles, write_markdown
from folioforge.sources.stored import delete_session, retry_failed, store_results
from folioforge.streaming.running import convert_folder, folder_results
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.core.test_readers import zipped

FILES = "file_id long, job_id long, ord int, filename string, content binary"
OLE = bytes.fromhex("d0cf11e0a1b11ae1")


def on_disk(folder):
    return {os.path.relpath(os.path.join(at, f), folder): os.path.join(at, f) for at, _, fs in os.walk(folder) for f in fs}


def results(spark, rows):
    """(job_id, ord, output_filename, status, markdown)"""
    return spark.createDataFrame(rows, "job_id long, ord int, output_filename string, status string, markdown string").withColumns({"member_ord": F.lit(0), "file_id": F.monotonically_increasing_id()})


def test_one_file_a_document(spark, tmp_path):
    out = tmp_path / "md"
    rows = [(k % 3, k, "same.md" if k % 2 else f"d{k}.md", "completed", f"text é {k}\n") for k in range(60)]
    rows += [(0, 100, "bad.md", "failed", None), (0, 101, "empty.md", "completed", None), (None, 102, "alone.md", "completed", "x"), (1, 103, "語" * 110 + ".md", "completed", "long"), (1, 104, "語" * 110 + ".md", "completed", "long")]
    write_markdown(results(spark, rows).repartition(5), str(out))
    got = on_disk(out)
    assert len(got) == 64 and not any("bad" in f for f in got) and len(os.listdir(tmp_path)) == 1
    assert open(got["0/d0.md"], "rb").read() == "text é 0\n".encode() and os.path.getsize(got["0/empty.md"]) == 0 and "none/alone.md" in got
    assert [open(got[f"1/same{n}.md"]).read() for n in ("", "-2", "-3")] == ["text é 1\n", "text é 7\n", "text é 13\n"]
    assert sum(f.startswith("1/語") for f in got) == 2
    write_markdown(results(spark, rows[:4]), str(out))
    assert set(on_disk(out)) == {"0/d0.md", "1/same.md", "2/d2.md", "0/same.md"} and len(os.listdir(tmp_path)) == 1
    write_markdown(results(spark, rows[:0]), str(out))
    assert not on_disk(out) and out.is_dir()


def test_nothing_is_left_of_an_aborted_task(spark, tmp_path):
    out = tmp_path / "md"
    write_markdown(results(spark, [(0, 0, "old.md", "completed", "old")]), str(out))
    rows = results(spark, [(0, k, f"d{k}.md", "completed", "x") for k in range(200)])
    bad = F.when(F.col("ord") == 150, F.raise_error(F.lit("no such text"))).otherwise(F.col("markdown"))
    with pytest.raises(Exception, match="no such text"):
        write_markdown(rows.repartition(4).withColumn("markdown", bad), str(out))
    assert set(on_disk(out)) == {"0/old.md"} and os.listdir(tmp_path) == ["md"]
    spark.dataSource.register(MarkdownFiles)
    with pytest.raises(Exception, match="overwrite"):
        rows.select(F.lit("0").alias("job"), F.lit("n").alias("name"), "markdown").write.format("markdown_files").mode("append").save(str(out))


def test_just_the_parts_that_failed_are_written_anew(spark, tmp_path):
    out = str(tmp_path / "table")
    good = [(k, k % 3, k, f"f{k}.json", b'{"a": %d}' % k) for k in range(60)]
    packed = zipped({"m.csv": b"a,b\n1,2\n", "n.json": b"[]"})
    rows = good + [(100, 0, 100, "late.xls", OLE + b"one"), (101, 1, 101, "gone.xls", OLE + b"two"), (102, 2, 102, "never.xls", OLE + b"no"), (103, 0, 103, "z.zip", packed)]
    files = spark.createDataFrame(rows, FILES)
    store_results(convert(files), out, files_per_part=5)
    before = {f: os.stat(p).st_mtime_ns for f, p in on_disk(out).items() if f.endswith(".parquet")}
    table = spark.read.parquet(out)
    parts = {r["file_id"]: f"job_id={r['job_id']}/part={r['part']}" for r in table.select("file_id", "job_id", "part").collect()}
    assert len(set(parts.values())) > 9 and {r["file_id"] for r in table.where("status = 'failed'").collect()} >= {100, 101, 102}
    whole = table.count()

    def late(data, charset):
        if data.endswith(b"no"):
            raise ValueError("still not")
        return "# Read", None

    new = retry_failed(files.where("file_id <> 101"), out, custom={".xls": late})
    after = {f: os.stat(p).st_mtime_ns for f, p in on_disk(out).items() if f.endswith(".parquet")}
    tried = {r["file_id"] for r in new.select("file_id").collect()}
    touched = {os.path.dirname(f) for f in after if before.get(f) != after[f]}
    assert {100, 102} <= tried and 101 not in tried and touched == {parts[i] for i in tried} and len(touched) < len(set(parts.values()))
    again = spark.read.parquet(out)
    got = {r["file_id"]: r["status"] for r in again.where("file_id in (100, 101, 102)").collect()}
    assert got == {100: "completed", 101: "failed", 102: "failed"} and again.count() == whole
    assert again.where("file_id = 100").first()["markdown"] == "# Read\n" and again.where("file_id < 60 and status = 'completed'").count() == 60
    jobs = spark.createDataFrame([("s", 0), ("s", 7), ("t", 1), ("t", 2)], "session_id string, job_id long")
    assert delete_session(out, jobs, "s") == [0] and delete_session(out, jobs, "s") == []
    assert {r["job_id"] for r in spark.read.parquet(out).select("job_id").distinct().collect()} == {1, 2}


def test_nothing_to_do_again(spark, tmp_path):
    out = str(tmp_path / "table")
    files = spark.createDataFrame([(1, None, 0, "a.json", b'{"a": 1}'), (2, 5, 0, "a.json", b'{"a": 1}')], FILES)
    store_results(convert(files), out)
    assert retry_failed(files, out).count() == 0 and spark.read.parquet(out).count() == 2


def test_a_retry_in_a_table_with_rows_without_a_job(spark, tmp_path):
    out = str(tmp_path / "table")
    files = spark.createDataFrame([(1, None, 0, "a.json", b'{"a": 1}'), (2, None, 1, "b.xls", OLE), (3, 4, 1, "c.json", b"[]")], FILES)
    store_results(convert(files), out)
    retry_failed(files, out, custom={".xls": lambda data, charset: ("now", None)})
    got = {r["file_id"]: (r["job_id"], r["status"]) for r in spark.read.parquet(out).collect()}
    assert got[1] == (None, "completed") and got[2] == (None, "completed") and got[3][0] == 4


def test_stages_are_counted(spark):
    rows = [(1, 1, 1, "a.json", b'{"a": 1}'), (2, 1, 2, "b.json", b"{"), (3, 1, 3, "c.csv", b"a\n1"), (4, 1, 4, "d", b"x"), (5, 1, 5, "i.png", bytes.fromhex("89504e470d0a1a0a")), (6, 1, 6, "e.xls", OLE)]
    seen = Observation()
    done = convert(spark.createDataFrame(rows, FILES), recognizer=lambda c, e: [(1, 1, 1, 0, 0, "word", 100, 40, 40, 26, 80.0)], observation=seen)
    statuses = [r["status"] for r in done.collect()]
    # one without a reader doesn't come to that stage, nor does an image
    assert seen.get == {"detecting": 6, "converting": 2, "ocr": 1, "finalizing": statuses.count("completed"), "failed": statuses.count("failed")} and statuses.count("completed") == 3


def slow_reader():
    """Made inside a function, as workers can't import this module."""

    def slow(data, charset):
        import time

        time.sleep(0.3 if data.endswith(b"a") else 280)
        return "# Done", None

    return slow


def upload(folder, n, slow_from):
    folder.mkdir()
    for k in range(n):
        f = folder / f"f{k:02}.xls"
        f.write_bytes(OLE + str(k).encode() + (b"a" if k < slow_from else b"b"))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))


@pytest.mark.parametrize("why", ["cancelled", "timeout"])
def test_a_run_that_is_stopped_keeps_what_is_done_and_goes_on(spark, tmp_path, why):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    upload(folder, 6, 4)
    seen, at = [], []

    def progress(counts):
        seen.append(counts)
        at.append(time.monotonic())

    def stop():  # a while after the third batch has begun
        return len(seen) == 2 and time.monotonic() - at[1] > 4

    began = time.monotonic()
    outcome = convert_folder(spark, str(folder), out, state, files_per_batch=2, should_stop=stop if why == "cancelled" else None, seconds=30 if why == "timeout" else None, on_progress=progress, custom={".xls": slow_reader()})
    assert outcome == why and time.monotonic() - began < 150
    got = {r["filename"]: r for r in folder_results(spark, out).collect()}
    n = 2 * len(seen)  # a slow machine may not come to the third batch in its time
    assert len(got) == 6 and sum(r["status"] == "completed" for r in got.values()) == n and (n == 4 or why == "timeout")
    rest = [r for name, r in got.items() if name >= f"f{n:02}"]
    assert {r["status"] for r in rest} == {"cancelled" if why == "cancelled" else "failed"} and {r["batch"] for r in rest} == {-1}
    assert {(r["error"] or {"code": None})["code"] for r in rest} == {None if why == "cancelled" else "timeout"}
    assert all(s["detecting"] == s["finalizing"] == 2 for s in seen)
    done = {f"batch={s['batch']}" for s in seen}
    kept = {f: os.stat(p).st_mtime_ns for f, p in on_disk(out).items() if f.split("/")[0] in done}
    outcome = convert_folder(spark, str(folder), out, state, files_per_batch=2, on_progress=seen.append, custom={".xls": lambda d, c: ("# Then", None)})
    again = folder_results(spark, out).collect()
    assert outcome == "completed" and len(again) == 6 and all(r["status"] == "completed" for r in again) and sum(s["finalizing"] for s in seen) == 6
    assert kept == {f: os.stat(p).st_mtime_ns for f, p in on_disk(out).items() if f.split("/")[0] in done}


def test_cancelled_goes_before_the_time_limit(spark, tmp_path):
    folder = tmp_path / "in"
    upload(folder, 2, 0)
    assert convert_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), should_stop=lambda: True, seconds=0, custom={".xls": slow_reader()}) == "cancelled"
    got = folder_results(spark, str(tmp_path / "out")).collect()
    assert [r["status"] for r in got] == ["cancelled"] * 2 and {r["output_filename"] for r in got} == {"f00.md", "f01.md"}
    assert {r["file_id"] for r in got} == {r["file_id"] for r in read_files(spark, str(folder)).select("file_id").collect()}
