"""Formats, categories, hints and errors as data, and as small DataFrames for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The formats, their MIME types and signatures, category ids, error codes and HTTP statuses are what
# users of such a service rely on, and labels, hints and messages what they are shown, so all of them must be these.
CATEGORIES = (
    ("documents", "Documents", "Word processors, presentations and spreadsheets"),
    ("data", "Data", "Structured and tabular data files"),
    ("web", "Web", "Markup and hypertext"),
    ("technical", "Technical", "Developer and research formats"),
    ("images", "Images", "Raster images, read with OCR"),
    ("archives", "Archives", "Bundles converted file-by-file"),
)

#: extension, label, category, icon, MIME types, signatures (offset, hex), read by recognition.
FORMATS = (
    (".pdf", "PDF", "documents", "file-text", ["application/pdf", "application/x-pdf"], [(0, "25504446")], True),
    (".docx", "Word", "documents", "file-type", ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], [(0, "504b0304")], False),
    (".pptx", "PowerPoint", "documents", "presentation", ["application/vnd.openxmlformats-officedocument.presentationml.presentation"], [(0, "504b0304")], False),
    (".xlsx", "Excel", "documents", "table", ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], [(0, "504b0304")], False),
    (".xls", "Excel (legacy)", "documents", "table", ["application/vnd.ms-excel"], [(0, "d0cf11e0a1b11ae1")], False),
    (".csv", "CSV", "data", "table", ["text/csv", "application/csv"], [], False),
    (".json", "JSON", "data", "braces", ["application/json", "text/json"], [], False),
    (".xml", "XML", "data", "code", ["application/xml", "text/xml"], [], False),
    (".html", "HTML", "web", "globe", ["text/html", "application/xhtml+xml"], [], False),
    (".htm", "HTML", "web", "globe", ["text/html", "application/xhtml+xml"], [], False),
    (".ipynb", "Jupyter Notebook", "technical", "notebook", ["application/x-ipynb+json", "application/json"], [], False),
    (".epub", "EPUB", "technical", "book-open", ["application/epub+zip"], [(0, "504b0304")], False),
    (".png", "PNG", "images", "image", ["image/png"], [(0, "89504e470d0a1a0a")], True),
    (".jpg", "JPEG", "images", "image", ["image/jpeg"], [(0, "ffd8ff")], True),
    (".jpeg", "JPEG", "images", "image", ["image/jpeg"], [(0, "ffd8ff")], True),
    (".webp", "WebP", "images", "image", ["image/webp"], [(0, "52494646"), (8, "57454250")], True),
    (".zip", "ZIP archive", "archives", "folder-archive", ["application/zip", "application/x-zip-compressed"], [(0, "504b0304")], False),
)

#: Spellings of one format.
ALIASES = {".jpeg": ".jpg", ".htm": ".html"}

#: What to do with files that can't be read.
HINTS = {
    ".doc": "Older .doc files aren't supported. Open it in Word and save as .docx, then try again.",
    ".ppt": "Older .ppt files aren't supported. Open it in PowerPoint and save as .pptx, then try again.",
    ".rtf": "RTF isn't supported. Save the document as .docx and try again.",
    ".pages": "Apple Pages files aren't supported. Export as .docx or .pdf.",
    ".key": "Apple Keynote files aren't supported. Export as .pptx or .pdf.",
    ".numbers": "Apple Numbers files aren't supported. Export as .xlsx or .csv.",
    ".odt": "OpenDocument text isn't supported. Save as .docx and try again.",
    ".txt": "Plain text is already readable as-is, so there's nothing to convert.",
    ".md": "This is already Markdown.",
}

#: code: HTTP status, message.
ERRORS = {
    "conversion_failed": (400, "We couldn't convert this file."),
    "unsupported_format": (415, "This file type isn't supported yet."),
    "format_mismatch": (415, "This file's contents don't match its extension."),
    "corrupt_file": (400, "This file appears to be damaged or unreadable."),
    "file_too_large": (413, "This file is larger than the upload limit."),
    "too_many_files": (413, "That's more files than a single job allows."),
    "archive_rejected": (400, "This archive couldn't be processed safely."),
    "timeout": (504, "This file took too long to convert."),
    "cancelled": (409, "This conversion was cancelled."),
    "ocr_unavailable": (503, "This document needs OCR, which isn't available right now."),
    "empty_result": (400, "We couldn't find any readable content in this file."),
    "session_not_found": (404, "This session has expired. Please upload your files again."),
    "not_authorized": (403, "You don't have access to this resource."),
    "rate_limited": (429, "You've made a lot of requests. Please try again shortly."),
}

FORMATS_SCHEMA = "extension string, label string, category string, icon string, mime_types array<string>, signatures array<struct<offset:int,hex:string>>, ocr_capable boolean"
ERROR_SCHEMA = "struct<code:string,message:string,detail:string>"


def formats(spark: SparkSession) -> DataFrame:
    """The 17 formats; the side to broadcast in every lookup by extension or MIME type."""
    return spark.createDataFrame(FORMATS, FORMATS_SCHEMA)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "id string, label string, description string")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ERRORS.items()], "code string, http_status int, message string")
