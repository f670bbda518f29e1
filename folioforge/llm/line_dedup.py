"""Line dedup: drop the lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, cut, hash_pair, left_on_row, texts

#: Stripped at both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """128-bit hashes of the normalised lines of at least ``min_chars`` code points that at least
    ``min_docs`` rows have. A row counts once however often it repeats the line, so the count needs
    no distinct over the corpus; counts are combined before the shuffle, so a hot line costs one row a task."""
    keys = F.array_distinct(F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS))))
    each = docs.select(F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = hash_pair(F.col("key"))
    return each.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key (A-Z lower-cased, blanks stripped at both ends) at least
    ``min_docs`` rows of ``docs`` have, and join the rest by newlines.

    Returns one row for each row of ``docs``: doc_id, text (what stays), n_lines (before dropping),
    n_dropped. A null text is one empty line; an empty key is never dropped while ``min_chars`` is 1
    or more. Each row counts as a document of its own, also where a doc_id repeats or is null; an
    empty table gives an empty result. Other columns are ignored.

    Only hashes and positions of lines are shuffled to find what goes; the texts are shuffled once.
    The frequent keys are checkpointed, so that their join is one between plain shuffles, which AQE
    can split where one line is very common.
    """
    base = texts(docs, id_col, text_col)
    frequent = cut(frequent_lines(base, min_docs, min_chars))
    lines = base.select("doc_id", "_th", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    h1, h2 = hash_pair(F.col("key"))
    lines = lines.select("doc_id", "_th", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "_th", "pos", h1.alias("h1"), h2.alias("h2"))
    gone = lines.join(frequent, ["h1", "h2"]).groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    out = left_on_row(base, gone).select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    n = F.size("lines")
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(n))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("lines", s + 1, e - s)))
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
