"""From raw documents to a mixed training corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import cut, small_batches, table, without
from folioforge.llm.decontam import find_contamination
from folioforge.llm.exact_dedup import drop_exact_duplicates
from folioforge.llm.language import fit_languages, identify_languages
from folioforge.llm.mixing import mix_sources
from folioforge.llm.near_dup import near_duplicates

#: A document whose largest language share is below this has no main language.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose largest language share is below LEAST_SHARE; null and
    empty texts go. What stays is unchanged, with all columns of ``docs`` whatever their names. Learns from the labelled
    languages of ``docs`` itself; where there are none every document is rejected. Ids may be null or repeat: each row is
    judged by its text alone, so equal texts share a verdict. An empty table stays empty."""
    small_batches(spark)
    out = identify_languages(docs.toDF(*[f"_in_{c}" for c in docs.columns]), fit_languages(docs), text_col="_in_text")
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row of the largest doc_id stays, and of rows that repeat both,
    one. A null text counts as empty; a null doc_id loses against any other, and of several one stays. All columns of ``docs``
    stay as they are. An empty table stays empty."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the least doc_id stays. Texts without
    a word, null ones among them, are linked with nothing and stay, and so do rows without an id. Rows that share an id are
    one document, and stay or go together. All columns of ``docs`` stay as they are. An empty table stays empty."""
    small_batches(spark, 128)
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id")
    return without(docs, gone, ["doc_id"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in windows of test items go; those without a word stay, null texts
    among them. Each row is judged by its text alone, whatever its id. All columns of ``docs`` stay as they are. An empty table
    stays empty, an empty benchmark drops nothing."""
    small_batches(spark)
    out = find_contamination(docs.toDF(*[f"_in_{c}" for c in docs.columns]), table(spark, sf_dir, "benchmark"), text_col="_in_text")
    return out.where("not contaminated").select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture, with their places in it; none is dropped or repeated. Columns named
    mix_source, block, slot, release, deadline, mix_start or in_mix are replaced by those of the places. A null source is the source ''; null and
    repeated ids have places by the content of their rows. An empty table stays empty."""
    out = mix_sources(docs)
    return out.repartitionByRange("slot", "mix_start").sortWithinPartitions("slot", "mix_start")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Mixture inference isn't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each checkpointed before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
