"""Files against the registry: lookups by extension and MIME type, and checks of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.names import canonical_extension, hint_for
from folioforge.registry import ERRORS, formats

HEADER_BYTES = 8192
ZIP_STARTS = ("504B0304", "504B0506", "504B0708")
OLE_START = "D0CF11E0A1B11AE1"


def with_format(files: DataFrame, extension: str = "extension") -> DataFrame:
    """Files with the format of their extension; null where there is none. The registry's 17 rows are broadcast."""
    f = formats(files.sparkSession).withColumnRenamed("extension", "_ext")
    return files.join(F.broadcast(f), F.lower(F.col(extension)) == F.col("_ext"), "left").drop("_ext")


def formats_by_mime(names: DataFrame, mime: str = "mime") -> DataFrame:
    """All formats of a MIME type, written in any case and with parameters."""
    f = formats(names.sparkSession).select(F.col("extension").alias("format"), F.explode("mime_types").alias("_mime"))
    key = F.lower(F.trim(F.substring_index(F.col(mime), ";", 1)))
    return names.join(F.broadcast(f), key == F.col("_mime")).drop("_mime")


def of_no_category(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (category, ...) with a category that isn't among those known (id), so that of the registry's formats there must be none. Rows without one are left out."""
    return rows.where("category is not null").join(F.broadcast(known.select("id")), F.col("category") == F.col("id"), "left_anti")


def labels_by_category(rows: DataFrame) -> DataFrame:
    """category, label, extension, n_files of rows (category, label, extension): distinct labels of a category with the first extension of each."""
    known = rows.where("label is not null")
    return known.groupBy("category", "label").agg(F.min("extension").alias("extension"), F.count(F.lit(1)).alias("n_files"))


def signatures_match(header: Column, signatures: Column) -> Column:
    """Whether all signatures stand at their offsets; a format without any matches."""
    at = lambda s: F.hex(F.substring(header, s["offset"] + 1, (F.length(s["hex"]) / 2).cast("int")))
    return F.forall(signatures, lambda s: at(s) == F.upper(s["hex"]))


def starts_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)).isin(*ZIP_STARTS)


def error(code: str, detail: Column, message: Column | None = None) -> Column:
    text = F.lit(ERRORS[code][1])
    return F.struct(F.lit(code).alias("code"), (F.coalesce(message, text) if message is not None else text).alias("message"), detail.alias("detail"))


def first_problem(ext: Column, known: Column, size: Column, signed: Column, real: Column, text_based: Column, text_problem: Column) -> Column:
    """The first that holds of: unknown extension, empty file, wrong signature, another container inside,
    text that can't be what it claims; null for a sound file. ``real``: what a container is, else null."""
    named = F.when(ext == "", "(none)").otherwise(ext)
    return (
        F.when(~known, error("unsupported_format", F.concat(F.lit("unsupported extension "), named), hint_for(ext)))
        .when(size == 0, error("corrupt_file", F.lit("file is empty")))
        .when(~signed, error("format_mismatch", F.lit("content does not match its format")))
        .when(real.isNotNull() & (real != canonical_extension(ext)), error("format_mismatch", F.concat(F.lit("file is really "), real)))
        .when(text_based & text_problem.isNotNull(), F.when(text_problem == "empty", error("corrupt_file", F.lit("file is empty"))).otherwise(error("format_mismatch", text_problem)))
    )


def text_problem(ext: Column, text: Column) -> Column:
    """What native expressions can tell about text: 'empty', or HTML and XML without markup; else null."""
    return F.when(F.trim(text) == "", "empty").when(canonical_extension(ext).isin(".html") & (F.instr(F.substring(text, 1, 4096), "<") == 0), "no tag within the first 4096 characters").when((ext == ".xml") & ~F.ltrim(text).startswith("<"), "text before the first tag")
