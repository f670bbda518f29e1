"""Column helpers, checkpoints and table access that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Byte table: A-Z lower-cased, every other byte as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast byte path of ``lower``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string; together a 128-bit key."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null as empty) alone, so that extra columns can't clash, and ``_th``,
    a hash of the text which with the id identifies a row even where ids repeat or are null."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return out.withColumn("_th", F.xxhash64("text"))


def left_on_row(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on the identity that ``texts`` gives a row; a null id equals itself."""
    found = found.withColumnsRenamed({"doc_id": "_found_id", "_th": "_found_th"})
    same = F.col("doc_id").eqNullSafe(F.col("_found_id")) & (F.col("_th") == F.col("_found_th"))
    return rows.join(found, same, "left").drop("_found_id", "_found_th")


#: Rows at least that a checkpoint file of a small table holds.
ROWS_PER_FILE = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``, which
    all executors share. Where the session has none, a temporary folder is used in local mode, as in tests; on a
    cluster it raises. ``rows``: about how many there are at most, where that is known; small tables then aren't strewn over many files."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    if rows is not None:
        df = df.coalesce(max(sc.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    return df.checkpoint(eager=True)


#: A set of rows to drop of at most so many is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't among ``gone``; nulls equal each other."""
    gone = cut(gone.distinct())
    named = gone.withColumnsRenamed({k: f"_gone{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_gone{i}"))
    return rows.join(F.broadcast(named) if gone.count() <= BROADCAST_ROWS else named, same, "left_anti")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(c: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``: the fold a document belongs to."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
