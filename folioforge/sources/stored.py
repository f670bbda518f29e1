"""Results as a stored table: kept by job, done again in part, and dropped with a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.checkpoints import cut
from folioforge.plans.convert import convert

#: Ids that are sent to every executor to find the files to be done again; beyond that they are met by a shuffle.
BROADCAST_IDS = 1_000_000


def store_results(results: DataFrame, path: str, files_per_part: int = 10_000) -> None:
    """Results as Parquet in folders job_id=.../part=..., in the place of what is there. A job has a part for each ``files_per_part`` of its rows, and a file with all its
    members is in one, by the hash of its id; so the work of writing, and later of writing anew, is spread however large a job is.

    ``results`` is evaluated twice, the first time for the number of rows of each job alone. Job ids are whole numbers; rows without one are kept as one job."""
    size = results.groupBy("job_id").agg(F.ceil(F.count(F.lit(1)) / files_per_part).alias("_parts")).withColumnRenamed("job_id", "_job")
    placed = results.join(size, F.col("job_id").eqNullSafe(F.col("_job"))).withColumn("part", F.pmod(F.xxhash64("file_id"), F.col("_parts")).cast("int")).drop("_job", "_parts")
    placed.repartition("job_id", "part").write.mode("overwrite").partitionBy("job_id", "part").parquet(path)


def retry_failed(files: DataFrame, path: str, statuses: tuple[str, ...] = ("failed", "cancelled"), **options) -> DataFrame:
    """Convert again what failed in the results at ``path``, with the ``options`` of ``convert``, and write just the parts anew that hold it. Returns the
    new rows, checkpointed: those of an archive are all its members'.

    A file that is no longer among ``files`` keeps its row. Parts are replaced when all new ones are written (dynamic overwrite); a run that is lost before leaves
    the table as it was. Contents are read of the files to be done again alone, where the source can tell; the names of the parts concerned come to the driver, which lists them anyway."""
    spark = files.sparkSession
    stored = spark.read.parquet(path)
    failed = cut(stored.where(F.col("status").isin(*statuses)).select("file_id", "job_id", "part").distinct())
    ids = failed.select("file_id").distinct()
    new = cut(convert(files.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "file_id", "left_semi"), **options))
    again = cut(new.select("file_id").distinct().join(failed, "file_id").select("file_id", F.col("job_id").alias("_job"), "part"))
    parts = [r["p"] for r in again.select(_part("_job").alias("p")).distinct().collect()]
    if not parts:
        return new
    # job and part are folders, so this is decided when they are listed
    kept = stored.where(_part("job_id").isin(parts)).join(again.select("file_id"), "file_id", "left_anti")
    anew = new.join(again, "file_id").withColumn("job_id", F.col("_job")).drop("_job")
    merged = kept.unionByName(anew.select(*kept.columns))
    merged.repartition("job_id", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "part").parquet(path)
    spark.catalog.refreshByPath(path)
    return new


def _part(job: str) -> Column:
    return F.concat(F.coalesce(F.col(job).cast("string"), F.lit("")), F.lit("/"), F.col("part").cast("string"))


def delete_folder(spark: SparkSession, folder: str) -> bool:
    """Whether there was such a folder; it is gone with all that is in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_session(path: str, jobs: DataFrame, session_id: object) -> list[int]:
    """Drop the results at ``path`` of all jobs (session_id, job_id) of a session, folder by folder: no other job is read or
    written. Returns the ids of the jobs that had any. The jobs of one session, which limits keep few, come to the driver."""
    spark = jobs.sparkSession
    ids = [r["job_id"] for r in jobs.where(F.col("session_id") == F.lit(session_id)).select("job_id").where("job_id is not null").distinct().orderBy("job_id").collect()]
    gone = [i for i in ids if delete_folder(spark, f"{path.rstrip('/')}/job_id={i}")]
    spark.catalog.refreshByPath(path)
    return gone
