"""One Markdown file a document, by a data source of its own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioforge.operators.jobs import unique_names

#: File systems allow 255 bytes for a name, and a number is still to come.
NAME_BYTES = 230


@dataclass
class Written(WriterCommitMessage):
    files: int


class MarkdownWriter(DataSourceArrowWriter):
    """Tasks write into a folder beside the target; the commit puts that in its place by one rename, however many files there are.

    A file is written under a name that nothing else has and then renamed, and what it is called and holds follows from its row alone, so
    a task that is tried again, or runs twice, leaves the same files. An abort removes the folder beside, and the target stays as it was."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _at(self, kind: str) -> tuple[fs.FileSystem, str, str]:
        system, target = fs.FileSystem.from_uri(self.path)
        head, _, name = target.rpartition("/")
        return system, target, f"{head}/.{name}.{kind}-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staged = self._at("staged")
        n, known = 0, set()
        for batch in iterator:
            for job, name, markdown in zip(*(batch.column(c).to_pylist() for c in ("job", "name", "markdown")), strict=True):
                if job not in known:
                    system.create_dir(f"{staged}/{job}", recursive=True)
                    known.add(job)
                part = f"{staged}/{job}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(markdown.encode("utf-8"))
                final = f"{staged}/{job}/{name}"
                if system.type_name == "hdfs" and system.get_file_info(final).type != fs.FileType.NotFound:
                    system.delete_file(final)
                system.move(part, final)
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, target, staged = self._at("staged")
        old = self._at("old")[2]
        system.create_dir(staged, recursive=True)
        before = system.get_file_info(target).type != fs.FileType.NotFound
        if before:
            system.move(target, old)
        system.move(staged, target)
        if before:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staged = self._at("staged")
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class MarkdownFiles(DataSource):
    """``df.write.format("markdown_files").mode("overwrite").save(path)`` of job, name and markdown, all strings."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:  # noqa: ANN001
        if not overwrite:
            raise ValueError("a folder of Markdown files is written as a whole: use the mode overwrite")
        if not {"job", "name", "markdown"} <= set(schema.names):
            raise ValueError("columns job, name and markdown are needed")
        return MarkdownWriter(self.options["path"])


def write_markdown(results: DataFrame, path: str) -> None:
    """The completed results as files ``path``/job_id/name, each with its Markdown in UTF-8. What was at ``path`` goes, once all is written.

    No two files of a job have one name; names follow the order of uploads. Names too long for a file system are shortened first. Nulls in
    markdown are empty files; rows without a job are in the folder ``none``. ``path`` is a URI that pyarrow knows, or an absolute path, on a file system that renames folders and that all
    executors reach (a shared mount, HDFS). Only names are shuffled to be numbered; texts meet them by a join on the place of a file in its job."""
    done = results.where("status = 'completed'").withColumn("place", F.struct("ord", "member_ord", "file_id"))
    long = F.octet_length("output_filename") > NAME_BYTES
    named = done.select("job_id", F.col("place").alias("ord"), F.when(long, F.concat(F.substring("output_filename", 1, NAME_BYTES // 4 - 3), F.lit(".md"))).otherwise(F.col("output_filename")).alias("filename"))
    place = unique_names(named).select(F.col("job_id").alias("_job"), F.col("ord").alias("_place"), "name")
    out = done.join(place, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("place") == F.col("_place")))
    results.sparkSession.dataSource.register(MarkdownFiles)
    out.select(F.coalesce(F.col("job_id").cast("string"), F.lit("none")).alias("job"), "name", F.coalesce("markdown", F.lit("")).alias("markdown")).write.format("markdown_files").mode("overwrite").save(path)
