"""ZIP archives: what is in them, whether that is safe, and the files themselves."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from folioforge.functions.names import extension_of, safe_name, unsafe_entry
from folioforge.registry import FORMATS
from folioforge.settings import Settings

ENTRY = "name string, declared_size long, compressed_size long, mode int, position int"
CHUNK = 64 * 1024


def entries_of(data: bytes) -> Iterator[tuple[str, int, int, int, int]] | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        yield from ((i.filename, i.file_size, i.compress_size, i.external_attr >> 16, n) for n, i in enumerate(z.infolist()) if not i.is_dir())


@udtf(returnType=ENTRY)
class ZipEntries:
    """A row for each file in an archive; none where it can't be read. For lateral joins in SQL."""

    def eval(self, content: bytes):  # noqa: ANN201
        try:
            yield from entries_of(content or b"")
        except zipfile.BadZipFile:
            return


def register(spark: SparkSession) -> None:
    """Make ``zip_entries(content)`` known to SQL."""
    spark.udtf.register("zip_entries", ZipEntries)


def list_entries(archives: DataFrame, id_col: str = "file_id", carried: Sequence[str] = ()) -> DataFrame:
    """id, ``carried`` columns, readable, entry columns of the archives (id, content). An archive that can't be read has one row with readable = false."""
    names, kept = ["readable", "name", "declared_size", "compressed_size", "mode", "position"], [id_col, *carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for *own, data in zip(*(b[c] for c in kept), b["content"], strict=True):
                try:
                    rows = [(*own, True, *e) for e in entries_of(bytes(data))] or [(*own, True, None, 0, 0, 0, -1)]
                except (zipfile.BadZipFile, TypeError):
                    rows = [(*own, False, None, 0, 0, 0, -1)]
                yield pd.DataFrame(rows, columns=[*kept, *names])

    kinds = ", ".join(f"{c} {archives.schema[c].dataType.simpleString()}" for c in kept)
    return archives.select(*kept, "content").mapInPandas(run, f"{kinds}, readable boolean, {ENTRY}")


def inspect(entries: DataFrame, settings: Settings = Settings(), id_col: str = "file_id") -> DataFrame:
    """Entries with display_name, extension, supported, and ``problem``, which is that of the whole archive:
    the first of unreadable, too many files, an unsafe name, a symbolic link, too many bytes, a suspicious
    ratio, emptiness. Archives within archives aren't supported."""
    from pyspark.sql import Window

    all_ = Window.partitionBy(id_col)
    x = entries.withColumn("display_name", safe_name(F.regexp_extract("name", r"[^/]*\z", 0), unicode_form=False))
    x = x.withColumn("extension", extension_of(F.col("display_name")))
    known = [f[0] for f in FORMATS if f[0] != ".zip"]
    real = F.col("position") >= 0
    link = F.col("mode").bitwiseAND(0o170000) == 0o120000
    dense = (F.col("declared_size") > settings.ratio_from_bytes) & (F.col("compressed_size") > 0) & (F.col("declared_size") / F.col("compressed_size") > settings.max_archive_ratio)
    problem = (
        F.when(F.bool_or(~F.col("readable")).over(all_), "corrupt_file")
        .when(F.count_if(real).over(all_) > settings.max_archive_files, "too many files")
        .when(F.bool_or(real & unsafe_entry(F.col("name"))).over(all_), "unsafe name")
        .when(F.bool_or(real & link).over(all_), "symbolic link")
        .when(F.sum("declared_size").over(all_) > settings.max_archive_uncompressed_bytes, "too large")
        .when(F.bool_or(real & dense).over(all_), "suspicious ratio")
        .when(F.count_if(real).over(all_) == 0, "empty")
    )
    return x.withColumn("supported", real & F.col("extension").isin(*known)).withColumn("problem", problem)


def entry_content(z: zipfile.ZipFile, info: zipfile.ZipInfo, budget: int) -> tuple[bytes | None, bool]:
    """Bytes of an entry, counted as they come, and whether they go over the budget; None then, or where it can't be read."""
    out = bytearray()
    try:
        with z.open(info) as f:
            while part := f.read(CHUNK):
                out += part
                if len(out) > budget:
                    return None, True
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
        return None, False
    return bytes(out), False


def unpack(archives: DataFrame, plan: DataFrame, kind_of: Callable[[bytes], str | None], settings: Settings = Settings()) -> DataFrame:
    """The rows that come of archives (file_id, job_id, ord, filename, safe_name, content) by a plan (file_id, problem,
    members: array of position, name): one with its problem, or one for each member; one as it came where it isn't an
    archive after all, by ``kind_of``."""
    budget = min(settings.max_file_bytes, settings.max_archive_uncompressed_bytes)
    columns = ["file_id", "job_id", "ord", "member_ord", "source_archive", "filename", "size", "content", "problem", "too_large"]

    def rows(r) -> Iterator[tuple]:  # noqa: ANN001
        data = bytes(r.content)
        if kind_of(data) != ".zip":
            yield (r.file_id, r.job_id, r.ord, 0, None, r.filename, len(data), data, None, False)
        elif r.problem is not None:
            yield (r.file_id, r.job_id, r.ord, 0, None, r.filename, len(data), None, r.problem, False)
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = z.infolist()
                for m in r.members:
                    content, over = entry_content(z, infos[m["position"]], budget)
                    yield (r.file_id, r.job_id, r.ord, m["position"] + 1, r.safe_name, m["name"], len(content or b""), content, None, over)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                for row in rows(r):
                    yield pd.DataFrame([row], columns=columns)

    kinds = {c: archives.schema[c].dataType.simpleString() for c in ("file_id", "job_id", "ord")}
    schema = f"file_id {kinds['file_id']}, job_id {kinds['job_id']}, ord {kinds['ord']}, member_ord int, source_archive string, filename string, size long, content binary, problem string, too_large boolean"
    return archives.join(plan, "file_id").mapInPandas(run, schema)


def extract(archives: DataFrame, chosen: DataFrame, settings: Settings = Settings(), id_col: str = "file_id") -> DataFrame:
    """id, position, content, too_large of the chosen entries (id, position). Bytes are counted as they
    come; an entry that goes over the limit for one file ends there, whatever size it declared."""
    budget = min(settings.max_file_bytes, settings.max_archive_uncompressed_bytes)
    wanted = chosen.groupBy(id_col).agg(F.sort_array(F.collect_list("position")).alias("positions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, data, positions in zip(b[id_col], b["content"], b["positions"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    infos = z.infolist()
                    for p in positions:
                        content, over = entry_content(z, infos[p], budget)
                        yield pd.DataFrame({id_col: [i], "position": [p], "content": [content], "too_large": [over]})

    kind = archives.schema[id_col].dataType.simpleString()
    return archives.select(id_col, "content").join(wanted, id_col).mapInPandas(run, f"{id_col} {kind}, position int, content binary, too_large boolean")
