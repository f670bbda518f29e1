"""Conversion of a folder as work that can be watched, stopped and taken up again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import names
from folioforge.operators import formats
from folioforge.plans.convert import convert
from folioforge.registry import ERROR_SCHEMA
from folioforge.sources.files import read_files
from folioforge.sources.stored import delete_folder
from folioforge.streaming.clients import uploads_stream

#: The folder of the files that a run which was stopped has not done.
REST = "batch=-1"
FILES = "file_id long, job_id long, ord long, filename string, content binary"


def convert_folder(
    spark: SparkSession, folder: str, out: str, state: str, files_per_batch: int = 10_000, should_stop: Callable[[], bool] | None = None,
    seconds: float | None = None, on_progress: Callable[[dict[str, int]], None] | None = None, poll: float = 0.2, **options,
) -> str:
    """Convert the files in ``folder`` in batches, a folder ``out``/batch=... for each, with the ``options`` of ``convert``. Returns completed,
    cancelled or timeout.

    ``should_stop`` is asked all the time, between batches and within them, and ends the jobs that run; so does the end of ``seconds``. If both
    are so, it was cancelled. Batches that were written stay; for all other files there are rows cancelled, or failed with the error timeout,
    so that each file has its rows. Called again with the same ``state`` (a folder of checkpoints that driver and executors share) it goes on with the files that were not done.
    ``on_progress`` gets, after each batch, how many files have come to each stage: detecting, converting, ocr, finalizing (done), and failed.

    Contents are read once: a batch that is cut short is read anew. A batch that ran but wasn't noted as done is written over by the same files."""
    delete_folder(spark, f"{out}/{REST}")

    def one(batch: DataFrame, number: int) -> None:
        seen = Observation()
        convert(batch, observation=seen, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if on_progress is not None:
            on_progress({"batch": number, **seen.get})

    files = uploads_stream(spark, folder, files_per_batch=files_per_batch)
    query = files.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
    outcome, began = "completed", time.monotonic()
    while not query.awaitTermination(poll):
        if should_stop is not None and should_stop():
            outcome = "cancelled"
        elif seconds is not None and time.monotonic() - began > seconds:
            outcome = "timeout"
        if outcome != "completed":
            query.stop()
            break
    if outcome != "completed":
        _write_rest(spark, folder, out, outcome)
    return outcome


def folder_results(spark: SparkSession, out: str) -> DataFrame:
    """The results of all batches, and of the files that weren't done, with the number of the batch."""
    return spark.read.schema(convert(spark.createDataFrame([], FILES)).schema.add("batch", "integer")).parquet(out)


def _write_rest(spark: SparkSession, folder: str, out: str, outcome: str) -> None:
    """Rows for the files that no batch has; their contents aren't read."""
    done = spark.createDataFrame([], FILES).select("file_id")
    home = spark._jvm.org.apache.hadoop.fs.Path(out)
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        done = folder_results(spark, out).select("file_id").distinct()
    x = read_files(spark, folder).drop("content", "size").join(done, "file_id", "left_anti").withColumn("safe", names.safe_name(F.col("filename")))
    error = formats.error("timeout", F.lit("the run's time was over")).cast(ERROR_SCHEMA)
    known = {
        "file_id": F.col("file_id"), "job_id": F.col("job_id"), "ord": F.col("ord"), "member_ord": F.lit(0), "filename": F.col("safe"), "output_filename": names.markdown_name(F.col("safe")),
        "status": F.lit("failed" if outcome == "timeout" else "cancelled"), "warnings": F.array(), "error": error if outcome == "timeout" else F.lit(None),
    }
    schema = convert(spark.createDataFrame([], FILES)).schema
    x.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(f"{out}/{REST}")
