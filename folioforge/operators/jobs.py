"""Files of jobs: status, caps, edits, names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.checkpoints import cut

TERMINAL = ("completed", "failed", "cancelled")


def job_status(files: DataFrame, cancelled: Column | None = None) -> DataFrame:
    """job_id, status, n_files, completed of files (job_id, status). The first that holds: cancelled,
    while a file isn't over; processing and queued, if any file is; failed, if all are; completed, if
    all are over (even if all were cancelled); queued."""
    over = F.col("status").isin(*TERMINAL)
    any_ = lambda s: F.bool_or(F.col("status") == s)
    stopped = F.bool_or(cancelled if cancelled is not None else F.lit(False))
    status = F.when(stopped & ~F.bool_and(over), "cancelled").when(any_("processing"), "processing").when(any_("queued"), "queued").when(F.bool_and(F.col("status") == "failed"), "failed").when(F.bool_and(over), "completed").otherwise("queued")
    return files.groupBy("job_id").agg(status.alias("status"), F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "completed").alias("completed"))


def results_with_edits(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Completed results with their Markdown, an edit in the place of what was converted."""
    done = results.where((F.col("status") == "completed") & F.col("markdown").isNotNull())
    return done.join(edits.withColumnRenamed("markdown", "edited"), "file_id", "left").withColumn("markdown", F.coalesce("edited", "markdown")).drop("edited")


def within_caps(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Files (job_id, ord, size) with ``error``: those from the first that goes over a job's number or bytes."""
    upto = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = files.withColumns({"n_so_far": F.count(F.lit(1)).over(upto), "bytes_so_far": F.sum("size").over(upto)})
    return out.withColumn("error", F.when(F.col("n_so_far") > max_files, "too_many_files").when(F.col("bytes_so_far") > max_bytes, "file_too_large"))


#: A number at the end of a stem that a generated name can have: 2 or more, no leading zero.
_NUMBER = r"-(?:[2-9]|[1-9][0-9]{1,17})"
_STEM = ["job_id", "stem", "end"]


def _fitting(claims: DataFrame) -> DataFrame:
    """Of the claims (job_id, stem, end, k, a) those that come before the generated names, with ``free``, how many numbers from 2 below k stay free.
    A claim on number k holds if no more than ``a`` smaller claims hold. That is one counter going up the numbers of a stem, so rows stream through it in
    order and nothing of them is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, held = None, 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in _STEM), strict=True))
            fits, free = [], []
            for key, k, a in zip(keys, b.column("k").to_pylist(), b.column("a").to_pylist(), strict=True):
                if key != stem:
                    stem, held = key, 0
                fits.append(held <= a)
                free.append(k - 2 - held)
                held += held <= a
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in (*_STEM, "k")), pa.array(free, pa.int64())], names=[*_STEM, "k", "free"])
            yield out.filter(pa.array(fits, pa.bool_()))

    job = claims.schema["job_id"].dataType.simpleString()
    x = claims.select(*_STEM, "k", "a").repartition(*_STEM).sortWithinPartitions(*_STEM, "k")
    return x.mapInArrow(run, f"job_id {job}, stem string, end string, k long, free long")


def unique_names(files: DataFrame) -> DataFrame:
    """Files (job_id, ord, filename) with ``name``: the file's own, or with -2, -3, ... before its
    extension, the first that no earlier file of the job has got.

    Without a walk over the names. Only names that occur twice in a job make new ones, so all others, and what they can meet (equal
    names but for numbers at the end), are left as they are. Of the rest, the i-th file that needs a number gets the i-th one that is free: numbers are
    taken by files really called so, where they came before the count had reached them (``_fitting``), and the i-th gap between
    those is a running count over the taken numbers and the files. A file that finds its own name given away needs a number itself, one level down
    (a-2-2), so levels follow one another, as many as numbers are strung together in the names of such a family. Nulls in filename stay null."""
    dotted = F.instr("filename", ".") > 0
    x = files.select("job_id", "ord", "filename").withColumns({
        "stem": F.when(dotted, F.regexp_replace("filename", r"\.[^.]*\z", "")).otherwise(F.col("filename")),
        "end": F.when(dotted, F.regexp_extract("filename", r"\.[^.]+\z", 0)).otherwise(""),
    })
    numbers = F.regexp_extract("stem", f"((?:{_NUMBER})*)\\z", 1)
    x = x.withColumns({"root": F.regexp_replace("stem", f"(?:{_NUMBER})*\\z", ""), "depth": F.length(numbers) - F.length(F.replace(numbers, F.lit("-"), F.lit("")))})
    family = ["job_id", "root", "end"]
    twice = x.groupBy(*family, "filename").count().where("count > 1").select(*family).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"t.{c}")) for c in family])
    alone = x.alias("x").join(twice.alias("t"), same, "left_anti").select("job_id", "ord", "filename", F.col("filename").alias("name"))
    meet = cut(x.alias("x").join(twice.alias("t"), same, "left_semi").withColumn("first", F.row_number().over(Window.partitionBy("job_id", "filename").orderBy("ord")) == 1))
    last = meet.agg(F.max("depth")).first()[0]
    out, lost = alone, meet.select("job_id", "filename").where("false")
    # the number that a file's own name is, of the stem one level up
    claim = meet.where(F.col("first") & (F.col("depth") > 0) & (F.col("filename") == F.concat("stem", "end")))
    claim = claim.select("job_id", F.regexp_replace("stem", f"{_NUMBER}\\z", "").alias("stem"), "end", "ord", "filename", F.regexp_extract("stem", r"([0-9]+)\z", 1).cast("long").alias("k"), "depth")
    for depth in range(-1 if last is None else last + 1):
        level = meet.where(F.col("depth") == depth).join(lost.withColumn("_lost", F.lit(True)), ["job_id", "filename"], "left")
        level = level.withColumn("wins", F.col("first") & F.col("_lost").isNull())
        spills = level.where("not wins").select(*_STEM, "ord", "filename", F.lit(None).cast("long").alias("k"))
        taken = claim.where(F.col("depth") == depth + 1).join(spills.select(*_STEM).distinct(), _STEM, "left_semi").select(*spills.columns)
        in_time = Window.partitionBy(*_STEM).orderBy("ord", "filename")
        events = cut(spills.unionByName(taken).withColumn("n", F.count(F.when(F.col("k").isNull(), 1)).over(in_time)))
        claims = events.where("k is not null").withColumn("a", F.col("k") - 2 - F.col("n"))
        held = cut(_fitting(claims))
        lost = claims.join(held, [*_STEM, "k"], "left_anti").select("job_id", "filename")
        # files by their turn, and before each the taken numbers that have fewer free ones below them than that
        turns = events.where("k is null").select(*_STEM, "ord", "filename", F.col("n").alias("at"), F.lit(0).alias("gap"))
        gaps = held.select(*_STEM, F.col("free").alias("at"), F.lit(1).alias("gap"))
        upto = F.sum("gap").over(Window.partitionBy(*_STEM).orderBy("at", "gap").rowsBetween(Window.unboundedPreceding, 0))
        named = turns.unionByName(gaps, allowMissingColumns=True).withColumn("k", F.col("at") + 1 + upto).where("gap = 0")
        named = named.select("job_id", "ord", "filename", F.concat("stem", F.lit("-"), F.col("k").cast("string"), "end").alias("name"))
        out = out.unionByName(level.where("wins").select("job_id", "ord", "filename", F.col("filename").alias("name"))).unionByName(named)
    return out


def unique_uploads(files: DataFrame) -> DataFrame:
    """The first upload of each name and size in a job."""
    first = Window.partitionBy("job_id", "filename", "size").orderBy("ord")
    return files.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def spliced(files: DataFrame, members: DataFrame) -> DataFrame:
    """Archives replaced in place by their members: files (file_id, ord, ...) and members (file_id of
    the archive, member_ord, ...), in the order (ord, member_ord)."""
    expanded = members.join(files.select("file_id", "ord"), "file_id")
    rest = files.join(members.select("file_id").distinct(), "file_id", "left_anti").withColumn("member_ord", F.lit(0))
    return rest.unionByName(expanded, allowMissingColumns=True)


def as_response(files: DataFrame) -> DataFrame:
    """One row a job with its files nested in order."""
    each = F.struct("ord", *[c for c in files.columns if c not in ("job_id", "ord")])
    return files.groupBy("job_id").agg(F.array_sort(F.collect_list(each)).alias("files"))


def latest_status(events: DataFrame) -> DataFrame:
    """file_id, status of status events (file_id, ts, event_id, status): the last one counts."""
    return events.groupBy("file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def cancelled(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files (job_id, status, ...) after their jobs (job_id) were cancelled: queued ones become cancelled; those
    in work stop by themselves, and what is over stays as it is."""
    stop = jobs.select("job_id", F.lit(True).alias("_stop")).distinct()
    return files.join(stop, "job_id", "left").withColumn("status", F.when(F.col("_stop") & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))).drop("_stop")


def running(files: DataFrame) -> DataFrame:
    """job_id, affected: how many files of a job aren't over, so what cancelling it would stop."""
    return files.groupBy("job_id").agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("affected"))


def retried(files: DataFrame, again: DataFrame) -> DataFrame:
    """Files (job_id, file_id, status, ...) of which some (job_id, file_id) are done again: they are in work, and without
    the error and Markdown of the last time. Others stay."""
    anew = files.join(again.select("job_id", "file_id", F.lit(True).alias("_again")).distinct(), ["job_id", "file_id"], "left")
    out = anew.withColumn("status", F.when(F.col("_again"), "processing").otherwise(F.col("status")))
    for c in ("error", "markdown"):
        if c in files.columns:
            out = out.withColumn(c, F.when(F.col("_again").isNull(), F.col(c)))
    return out.drop("_again").select(*files.columns)


def file_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files (job_id, file_id, ...) that are asked for (session_id, job_id, file_id) by the session that owns their job;
    ``files`` have session_id, too. Nothing comes of what isn't there or another's."""
    return files.join(wanted.select("session_id", "job_id", "file_id").distinct(), ["session_id", "job_id", "file_id"], "left_semi")


def noted(warnings: Column, message: str) -> Column:
    """Warnings with the message, once."""
    return F.array_union(warnings, F.array(F.lit(message)))


def rollup(results: DataFrame) -> DataFrame:
    """One row over results (status, seconds, confidence): how many passed, total and mean seconds, mean confidence of those known."""
    sure = F.when(F.col("confidence") >= 0, F.col("confidence"))
    return results.agg(F.count_if(F.col("status") == "completed").alias("passed"), F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"), F.avg(sure).alias("mean_confidence"))
