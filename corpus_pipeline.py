"""The corpus pipeline: quality classifier, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; the last returns the packed pieces.

Defined cases, each that of the stage's operator: a null or empty text is rejected by the classifier; a null doc_id or source
goes through all stages; rows that are equal in doc_id and text are one document from near-dedup on; rows that share a doc_id
and no text are documents each; an empty table gives an empty table; extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import mixing, near_dup, packing, quality, substring_dedup
from pitchlake.llm.common import forget, stash, stashed, table

#: No stage's rows can be written in SQL (EM, consistent sampling, tokenization); tests hold them against brute force.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.score(docs).where("good").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.keep_one(docs)


def dedup_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that an earlier document has in a repeated span; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("removed_bytes") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", dedup_spans),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself, and its input, is deleted once its output is written."""
    docs, since = table(spark, sf_dir, "documents"), stashed()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        forget(spark, since, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
