"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE; each stage writes what it keeps.

Every stage keeps the columns of its input, whatever they are called, and takes an empty table. Rows without doc_id lose no
lines and are no one's copies, but are judged by the other stages as all rows are; null texts have no words and go with the
first stage. Rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from weirflow.llm.common import shuffled, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the compression bands go; so do null and empty texts."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines, or of over 50 words, stay at their first place; a document of which nothing is left goes."""
    shorter = line_dedup.line_dedup(docs, long_words=50).filter("n_removed = 0 or trim(text) != ''")
    count = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return shorter.select(*[count.alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), the smallest doc_id stays; 28 collections miss a pair at 0.8 with probability 8e-6."""
    found = near_dedup.near_duplicates(docs, percent=80, collections=28)
    gone = written(found.filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_h1").alias("__h1"), F.col("text_h2").alias("__h2")).distinct(), "near-duplicates")
    same = (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__h1"]) & (F.xxhash64(F.lit(29), docs["text"]) == gone["__h2"])
    return docs.join(shuffled(gone), same, "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with the check that they decode to the text."""
    return bpe.bpe_round_trip(docs).drop("text")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

#: Compression, similarity and token ids can't be expressed in SQL; tests/llm/test_against_plain.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
