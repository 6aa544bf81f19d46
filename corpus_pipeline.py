"""The corpus pipeline: each stage works on all that the one before kept, written as Parquet in between.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; n_chars is counted
anew where a stage changes the text. A stage keeps rows whose id is null where its operator can judge them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.llm import bpe, decontaminate, neardup, quality, suffixdup
from cinegraph.llm.common import scratch, table

#: SQL can't express suffix sorting, edit matching or BPE: the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.repetition(docs).where("kept").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked."""
    return neardup.keep_one(docs, shingle=5)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a character that loses a byte goes."""
    left = suffixdup.remove(docs, as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the token ids and their number; the decoded ids equal the text."""
    out = bpe.encode(docs, agrees="round_trip")
    return out.select(*docs.columns, "ids", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
