"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; ``run`` writes every stage's result and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneweave.llm.contamination import drop_contaminated
from laneweave.llm.language import keep_identified
from laneweave.llm.packing import pack_documents
from laneweave.llm.queries import tokenizer_path
from laneweave.llm.shared import written
from laneweave.llm.simhash import drop_near_duplicates
from laneweave.llm.substring import remove_repeated_passages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told.

    Texts that are null, without a letter, or that no language machine takes
    go. Nothing is rejected by its score where no label can be learned from.
    """
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest doc_id.

    A null text counts as an empty one; repeated rows are copies.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand earlier go; so do documents of which nothing is left."""
    cut = remove_repeated_passages(docs)
    cut = cut.where("n_removed < n_words or n_removed = 0")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
