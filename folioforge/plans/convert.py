"""Files in, Markdown and metadata out: one lazy plan over a table of files.

files(file_id, job_id, ord, filename, content) -> results(file_id, job_id, ord, member_ord, filename,
output_filename, status, markdown, metadata, warnings, error). A failure is a row with an error, never
an exception in a task."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.checkpoints import cut
from folioforge.functions import names, text
from folioforge.functions.pages import page_range, recognition_mode
from folioforge.operators import archives, formats, jobs, layout
from folioforge.registry import ERROR_SCHEMA
from folioforge.settings import Settings
from folioforge.sources import office, readers

SNIFFED = StructType().add("real", "string").add("broken", "boolean").add("charset", "string").add("fault", "string")
READ = StructType().add("markdown", "string").add("title", "string").add("pages", "integer").add("code", "string").add("fault", "string").add("ms", "long")
#: Gives the words of the pages of an image or a scanned PDF: (content, extension) -> rows of page, block,
#: paragraph, line, pos, text, left, top, width, height, confidence.
Recognizer = Callable[[bytes, str], list[tuple]]
WORDS = "page int, block int, paragraph int, line int, pos int, text string, left int, top int, width int, height int, confidence double"
IMAGES = (".png", ".jpg", ".webp")


@F.pandas_udf(SNIFFED)
def sniff(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
    """What a container really is, the charset of text, and why it can't be what its name says."""
    rows = []
    for data, ext in zip(content, extension, strict=True):
        data = bytes(data) if data is not None else b""
        real = broken = charset = fault = None
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
            real = readers.zip_kind(data)
            broken = real is None
        elif data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
            real = readers.ole_kind(data) or None
        elif ext in (".csv", ".json", ".xml", ".html", ".ipynb"):
            charset = readers.charset_of(data)
            fault = readers.text_fault(ext, data, charset)
        rows.append((real, bool(broken), charset, fault))
    return pd.DataFrame(rows, columns=["real", "broken", "charset", "fault"])


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Interrupts what is inside after so many seconds with TimeoutError. Only a main thread can be
    interrupted, which is where Python workers run; elsewhere nothing is."""

    def stop(*_: object) -> None:
        raise TimeoutError("reader took too long")

    try:
        before = signal.signal(signal.SIGALRM, stop)
    except ValueError:
        yield
        return
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class OutsidePages(ValueError):
    """No page that is asked for is in the document."""


#: Error codes by exception, the first that fits. A damaged document makes a parser raise anything, so the rest is corrupt_file.
FAULTS = ((TimeoutError, "timeout"), (OutsidePages, "conversion_failed"), (ImportError, "conversion_failed"), (MemoryError, "conversion_failed"), (NotImplementedError, "conversion_failed"), (Exception, "corrupt_file"))


def reader_udf(custom: dict[str, readers.Reader], settings: Settings) -> Callable:
    """The readers, and those that the caller adds, as one vectorised function. Pages of a PDF can be chosen. A
    reader is interrupted at the time limit of a row."""
    table, chosen = {**readers.READERS, **{k.lower(): v for k, v in custom.items()}}, list(readers.CHOSEN)

    @F.pandas_udf(READ)
    def read(content: pd.Series, extension: pd.Series, charset: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = []
        for data, ext, cs, wanted in zip(content, extension, charset, pages, strict=True):
            began = time.monotonic()
            try:
                with time_limit(settings.row_timeout_seconds):
                    reader = readers.chosen_reader(ext, bytes(data), chosen, table)
                    if reader is office.read_pdf:
                        all_ = office.pdf_pages(bytes(data))
                        picked = [all_[p - 1] for p in wanted if p <= len(all_)] if wanted is not None else all_
                        if wanted is not None and not picked:
                            raise OutsidePages("none of the pages asked for exist")
                        row = ("\n\n".join(filter(None, picked)), None, len(picked), None, None)
                    elif reader is None:
                        row = (None, None, None, "unsupported_format", f"no reader for {ext}")
                    else:
                        md, title = reader(bytes(data), cs)
                        row = (md, title, None, None, None)
            except Exception as e:  # the row carries what went wrong
                row = (None, None, None, next(code for kind, code in FAULTS if isinstance(e, kind)), f"{type(e).__name__}: {e}")
            rows.append((*row, int((time.monotonic() - began) * 1000)))
        return pd.DataFrame(rows, columns=["markdown", "title", "pages", "code", "fault", "ms"]).astype({"pages": "Int32"})

    return read


def detected(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Files with safe_name, extension, format columns, charset, detected extension and ``error``. Where files have
    a ``size``, that counts, so that one whose content wasn't read for its size is too large, not empty."""
    x = files.withColumn("safe_name", names.safe_name(F.col("filename"))).withColumn("extension", names.extension_of(F.col("safe_name")))
    known = [F.col("size")] if "size" in files.columns else []
    x = formats.with_format(x).withColumn("size", F.coalesce(*known, F.octet_length("content"), F.lit(0)).cast("long"))
    x = x.withColumn("canonical", names.canonical_extension(F.col("extension"))).withColumn("sniffed", sniff(F.col("content"), F.col("canonical")))
    header = F.substring("content", 1, formats.HEADER_BYTES)
    signed = F.coalesce(formats.signatures_match(header, F.col("signatures")), F.lit(False))
    problem = formats.first_problem(F.col("extension"), F.col("label").isNotNull(), F.col("size"), signed, F.col("sniffed.real"), F.size("signatures") == 0, F.col("sniffed.fault"))
    broken = F.when(F.col("sniffed.broken") & F.col("label").isNotNull() & signed, formats.error("corrupt_file", F.lit("not a readable ZIP file")))
    large = F.when(F.col("label").isNotNull() & (F.col("size") > settings.max_file_bytes), formats.error("file_too_large", F.lit("file is too large")))
    x = x.withColumn("error", F.coalesce(large, broken, problem).cast(ERROR_SCHEMA)).withColumn("detected", F.coalesce("sniffed.real", "canonical")).withColumn("charset", F.col("sniffed.charset")).drop("sniffed")
    # the format of what a file is, and where that is none, of what its name says
    real = formats.with_format(x.select("*", F.col("label").alias("_label"), F.col("category").alias("_category")).drop("label", "category", "icon", "mime_types", "signatures", "ocr_capable"), "detected")
    return real.withColumns({"label": F.coalesce("label", "_label"), "category": F.coalesce("category", "_category")}).drop("_label", "_category")


def expanded(files: DataFrame, settings: Settings) -> DataFrame:
    """Files, detected, with sound archives replaced in place by what in them can be read; an archive that
    isn't safe, or holds nothing readable, stays as a row with an error.

    Where no name ends in .zip, which the names alone tell, contents are read once, by the job itself. Else what is to come of an archive is settled first, in a
    pass of its own over archives alone, on the list of its entries; that list and all that follows from it hold no contents and are checkpointed. The
    job then reads contents twice: of files that aren't archives, and of archives, each of which gives all its rows. Everything is detected after that, once."""
    size = F.coalesce(*([F.col("size")] if "size" in files.columns else []), F.octet_length("content").cast("long"))
    named = files.withColumns({"safe_name": names.safe_name(F.col("filename")), "size": size}).withColumn("extension", names.extension_of(F.col("safe_name")))
    own = lambda x: x.select("file_id", "job_id", "ord", F.lit(0).alias("member_ord"), F.lit(None).cast("string").alias("source_archive"), "filename", "size", "content", F.lit(None).cast("string").alias("problem"), F.lit(False).alias("too_large"))
    if named.where(F.col("extension") == ".zip").select("file_id").isEmpty():
        return _archive_errors(detected(own(named), settings))
    packed = F.coalesce((F.col("extension") == ".zip") & formats.starts_zip(F.col("content")) & (F.col("size") <= settings.max_file_bytes), F.lit(False))
    zips = named.where(packed)
    listed = cut(archives.list_entries(zips.select("file_id", "job_id", "ord", "size", "content"), carried=["job_id", "ord", "size"]))
    entries = archives.inspect(listed, settings)
    verdict = entries.groupBy("file_id").agg(F.first("problem").alias("problem"), F.count_if("supported").alias("n"), F.first("job_id").alias("job_id"), F.first("ord").alias("ord"), F.bool_or(F.col("size") > settings.max_archive_bytes).alias("large"))
    verdict = verdict.withColumn("problem", F.coalesce("problem", F.when(F.col("n") == 0, "archive holds nothing that can be converted"), F.when(F.col("large"), "archive is larger than the limit")))
    sound = entries.where("problem is null and supported").join(verdict.where("problem is null").select("file_id"), "file_id")
    wanted = member_names(named, sound.select("file_id", "job_id", "ord", "position", "display_name"))
    wanted = wanted.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("members"))
    plan = cut(verdict.select("file_id", "problem").join(wanted, "file_id", "left"))
    members = archives.unpack(zips.select("file_id", "job_id", "ord", "filename", "safe_name", "content"), plan, readers.zip_kind, settings)
    return _archive_errors(detected(own(named.where(~packed)).unionByName(members), settings))


def _archive_errors(seen: DataFrame) -> DataFrame:
    """What is wrong with archives and their members, before what was detected."""
    rejected = F.when(F.col("problem") == "corrupt_file", formats.error("corrupt_file", F.col("problem"))).when(F.col("problem").isNotNull(), formats.error("archive_rejected", F.col("problem")))
    large = F.when(F.col("too_large"), formats.error("archive_rejected", F.lit("archive entry is larger than the per-file limit")))
    damaged = F.when(F.col("content").isNull() & F.col("source_archive").isNotNull(), formats.error("corrupt_file", F.lit("archive entry can't be read")))
    return seen.withColumn("error", F.coalesce(rejected.cast(ERROR_SCHEMA), large.cast(ERROR_SCHEMA), damaged.cast(ERROR_SCHEMA), F.col("error"))).drop("problem", "too_large")


def member_names(files: DataFrame, members: DataFrame) -> DataFrame:
    """Members (file_id of their archive, job_id, ord, position, display_name, ...) with ``name``, which no
    file and no earlier member of the job has."""
    place = lambda member, *at: F.struct(F.lit(member).alias("member"), *[c.alias(n) for c, n in zip(at, ("ord", "position", "file_id", "own"), strict=True)])
    none = F.lit(None)
    ids = files.schema["file_id"].dataType
    own = files.join(members.select("job_id").distinct(), "job_id", "left_semi").select("job_id", F.col("safe_name").alias("filename")).distinct()
    own = own.select("job_id", place(0, none.cast(files.schema["ord"].dataType), none.cast("int"), none.cast(ids), F.col("filename")).alias("ord"), "filename")
    at = place(1, F.col("ord"), F.col("position"), F.col("file_id"), none.cast("string"))
    got = jobs.unique_names(own.unionByName(members.select("job_id", at.alias("ord"), F.col("display_name").alias("filename")))).where("ord.member = 1")
    return members.join(got.select(F.col("ord.file_id").alias("file_id"), F.col("ord.position").alias("position"), "name"), ["file_id", "position"])


def recognized(files: DataFrame, recognizer: Recognizer, max_pages: int) -> DataFrame:
    """key, ocr struct<markdown, confidence, pages, warnings> of the files by the recognizer's words, on
    the pages asked for, and of these the first ``max_pages``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, data, ext, wanted in zip(b["key"], b["content"], b["detected"], b["wanted"], strict=True):
                rows = recognizer(bytes(data), ext)
                asked = {r[0] for r in rows} if wanted is None else {r[0] for r in rows} & set(wanted)
                first = set(sorted(asked)[:max_pages])
                rows = [r for r in rows if r[0] in first]
                if rows:
                    yield pd.DataFrame([(key, *r) for r in rows], columns=["doc_id", *(c.split()[0] for c in WORDS.split(", "))])

    w = files.select("key", "content", "detected", F.when(F.col("detected") == ".pdf", F.col("range.pages")).alias("wanted")).mapInPandas(run, f"doc_id long, {WORDS}")
    widths = w.groupBy("doc_id", "page").agg(F.max(F.col("left") + F.col("width")).alias("page_width"))
    d = layout.documents(layout.reconstruct(w, widths))
    return d.select(F.col("doc_id").alias("key"), F.struct("markdown", "confidence", "pages", "warnings").alias("ocr"))


def convert(files: DataFrame, mode: str = "auto", pages: str | None = None, settings: Settings = Settings(), recognizer: Recognizer | None = None, custom: dict[str, readers.Reader] | None = None, observation: Observation | None = None) -> DataFrame:
    """Convert every file; archives give a row for each member. ``mode``: auto, force or off, for
    recognition; ``pages``: of PDFs; ``custom``: readers by extension, before those of the package. ``observation`` has, once the results
    were computed, how many files have come to each stage: detecting (all), converting, ocr, finalizing (those done), and how many failed.

    The only shuffles are those of archives, of recognised words, and of the names of an archive's members by job. Whether there are archives is
    asked, and they are listed, when this is called; on a stream, call it for each batch (``foreachBatch``)."""
    x = expanded(files, settings)
    option = page_range(F.lit(pages).cast("string"))
    x = x.withColumn("range", option).withColumn("mode", recognition_mode(F.lit(mode)))
    x = x.withColumn("key", F.xxhash64("file_id", "member_ord"))
    image, pdf = F.col("detected").isin(*IMAGES), F.col("detected") == ".pdf"
    error = lambda when, code, detail: F.when(when, formats.error(code, F.lit(detail)).cast(ERROR_SCHEMA))
    x = x.withColumn("error", F.coalesce("error", F.when(pdf & F.col("range.error").isNotNull(), formats.error("conversion_failed", F.col("range.error")).cast(ERROR_SCHEMA)), error(image & (F.col("mode") == "off"), "ocr_unavailable", "recognition is switched off"), error(image & F.lit(recognizer is None), "ocr_unavailable", "no recognizer is available"), error(F.col("detected") == ".xls", "conversion_failed", "legacy workbooks need a reader of the caller's" if ".xls" not in (custom or {}) else "") if ".xls" not in (custom or {}) else F.lit(None).cast(ERROR_SCHEMA)))
    read = reader_udf(custom or {}, settings)
    can = F.col("error").isNull() & ~image & ~(pdf & (F.col("mode") == "force"))
    x = x.withColumn("read", read(F.when(can, F.col("content")).otherwise(F.unhex(F.lit(""))), F.when(can, F.col("detected")).otherwise(".none"), F.col("charset"), F.col("range.pages")))
    x = x.withColumn("read", F.when(can, F.col("read")))
    n_pages = F.coalesce("read.pages", F.lit(1))
    x = x.withColumn("scanned", pdf & F.col("error").isNull() & (F.col("mode") != "off") & ((F.col("mode") == "force") | ~text.meaningful_text(F.col("read.markdown"), n_pages, settings.min_chars_per_page)))
    if recognizer is not None:
        x = x.join(recognized(x.where((image & F.col("error").isNull()) | F.col("scanned")), recognizer, settings.max_pages), "key", "left")
    else:
        x = x.withColumn("ocr", F.lit(None).cast("struct<markdown:string,confidence:double,pages:bigint,warnings:array<string>>"))
    layer = F.coalesce("read.markdown", F.lit(""))
    wanted = (image | F.col("scanned")) & F.col("error").isNull()
    longer = F.length(F.trim(F.coalesce("ocr.markdown", F.lit("")))) >= F.length(F.trim(layer))
    use = wanted & F.col("ocr").isNotNull() & (image | longer)
    md = text.normalize_markdown(F.when(use, F.col("ocr.markdown")).otherwise(layer))
    x = x.withColumn("used_ocr", F.coalesce(use, F.lit(False))).withColumn("whole", md).withColumn("markdown", text.cut_output(F.col("whole"), settings.max_output_chars))
    fault = F.lit(None).cast(ERROR_SCHEMA)
    for code in ("timeout", "conversion_failed", "unsupported_format", "corrupt_file"):
        fault = F.when(F.col("read.code") == code, formats.error(code, F.col("read.fault")).cast(ERROR_SCHEMA)).otherwise(fault)
    no_ocr = error(F.col("scanned") & F.lit(recognizer is None) & (F.trim(layer) == ""), "ocr_unavailable", "no recognizer is available")
    x = x.withColumn("error", F.coalesce("error", fault, no_ocr, error(F.col("markdown") == "", "empty_result", "nothing readable came out")))
    if observation is not None:
        n = lambda when, name: F.count_if(F.coalesce(when, F.lit(False))).alias(name)
        x = x.observe(observation, F.count(F.lit(1)).alias("detecting"), n(F.col("read").isNotNull(), "converting"), n(F.col("ocr").isNotNull(), "ocr"), n(F.col("error").isNull(), "finalizing"), n(F.col("error").isNotNull(), "failed"))
    return _results(x, pages, recognizer is not None)


def _results(x: DataFrame, pages: str | None, can_read: bool) -> DataFrame:
    ok, html = F.col("error").isNull(), text.contains_raw_html(F.col("markdown"))
    pdf = F.col("detected") == ".pdf"
    note = lambda when, s: F.when(when, F.array(F.lit(s)))
    none = F.array().cast("array<string>")
    warnings = [
        note(pdf & F.lit(pages is not None and bool(pages.strip())), f"Only pages {pages} were converted, as requested."),
        note(F.col("scanned") & F.lit(not can_read), "This PDF looks scanned, but recognition isn't available, so only its own text was used."),
        F.when(F.col("used_ocr"), F.col("ocr.warnings")),
        note(F.col("scanned") & F.col("ocr").isNotNull() & ~F.col("used_ocr"), "Recognition found less than the document's own text, so that was used."),
        note(F.length("whole") > F.length("markdown"), "The Markdown was longer than the limit and was cut."),
        note(html, "This document held HTML, which a preview must not run."),
    ]
    confidence = F.when(F.col("used_ocr") & (F.col("ocr.confidence") >= 0), F.bround("ocr.confidence", 1))
    metadata = F.struct(
        F.substring("detected", 2, 20).alias("format"), "label", "category", F.coalesce("read.ms", F.lit(0)).alias("duration_ms"), F.col("size").alias("source_bytes"),
        text.word_count(F.col("markdown")).alias("word_count"), text.character_count(F.col("markdown")).alias("character_count"), F.coalesce(F.col("read.pages").cast("long"), F.col("ocr.pages")).alias("pages"),
        F.lit(None).cast("int").alias("sheets"), F.lit(None).cast("int").alias("slides"), F.col("read.title").alias("title"), F.col("used_ocr").alias("ocr_used"), confidence.alias("ocr_confidence"),
        F.when(F.col("used_ocr"), F.col("ocr.pages")).alias("ocr_pages"), html.alias("contains_raw_html"),
    )
    return x.select(
        "file_id", "job_id", "ord", "member_ord", "source_archive", F.col("safe_name").alias("filename"), names.markdown_name(F.col("safe_name")).alias("output_filename"),
        F.when(ok, "completed").otherwise("failed").alias("status"), F.when(ok, F.col("markdown")).alias("markdown"), F.when(ok, metadata).alias("metadata"),
        F.when(ok, F.array_distinct(F.flatten(F.array(*[F.coalesce(w, none) for w in warnings])))).otherwise(none).alias("warnings"), "error",
    )


def metadata_json(metadata: Column) -> Column:
    """Metadata as JSON; fields without a value are left out."""
    return F.to_json(metadata)


