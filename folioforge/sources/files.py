"""Tables of files in, results out."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.jobs import results_with_edits, unique_names


def read_files(spark: SparkSession, path: str, job_id: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files under a path as rows for ``convert``; content of files over ``max_bytes`` isn't read, their size is. A folder is a
    job, so that what is done by job is spread, unless ``job_id`` makes one of all. Files of no bytes give no row."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.when(F.col("length") <= max_bytes, F.col("content")) if max_bytes else F.col("content")
    job = F.xxhash64(F.regexp_extract("path", r"^(.*)/", 1)) if job_id is None else F.lit(job_id).cast("long")
    return x.select(F.xxhash64("path").alias("file_id"), job.alias("job_id"), F.xxhash64("path").alias("ord"), F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), F.col("length").alias("size"), content.alias("content"))


def decoded_text(content: DataFrame, column: str = "content") -> DataFrame:
    """``text``: bytes as UTF-8, bad bytes replaced; only where all are good stays the whole expression native."""
    return content.withColumn("text", F.when(F.is_valid_utf8(F.col(column).cast("string")), F.decode(F.col(column), "UTF-8")).otherwise(F.make_valid_utf8(F.col(column).cast("string"))))


def write_results(results: DataFrame, path: str) -> None:
    """Results as Parquet, by status, so that retries read failures alone."""
    results.write.partitionBy("status").mode("overwrite").parquet(path)


def job_archives(results: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """job_id, archive: a ZIP of a job's completed files under unique names, edits in the place of results.
    An archive is one value, so a job is built in one group: results are to be within the caps on files and bytes of a job
    (``operators.jobs.within_caps``), as those of a folder of any size may not be."""
    x = results.withColumn("file_id", F.col("file_id").cast("long"))
    x = results_with_edits(x, edits) if edits is not None else x.where("status = 'completed'")
    x = x.withColumn("place", F.struct("ord", "member_ord"))
    names = unique_names(x.select("job_id", F.col("place").alias("ord"), F.col("output_filename").alias("filename")))
    x = x.join(names.select("job_id", F.col("ord").alias("place"), "name"), ["job_id", "place"]).select("job_id", F.col("place.ord").alias("o"), F.col("place.member_ord").alias("m"), "name", "markdown")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values(["o", "m"]).itertuples():
                z.writestr(zipfile.ZipInfo(r.name), r.markdown)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "archive": [out.getvalue()]})

    return x.groupBy("job_id").applyInPandas(pack, "job_id long, archive binary")


def audit_lines(results: DataFrame) -> DataFrame:
    """One JSON line a file, without its contents."""
    return results.select(F.to_json(F.struct("file_id", "job_id", "filename", "status", "error.code", "warnings")).alias("value"))


