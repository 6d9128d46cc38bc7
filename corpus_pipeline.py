"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. ``run`` writes
each stage's rows to the shared folder and reads them back, which also lets a later stage survive lost
executors. Rows that share a doc_id after mixing are the epochs of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import common, langid, mixing, neardup, packing, substring


def _columns_of(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with n_chars, where the table has it, brought up to its text."""
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: those without a letter and those without a leading language go."""
    return langid.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more: the smallest doc_id."""
    return neardup.drop_near_duplicates(docs, percent=80, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 13-word passages that one with a smaller doc_id has; a text may become empty."""
    return _columns_of(docs, substring.remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source weights 3, 1, 2 to 150 % of the words; a document of a short source comes twice."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, placed in sequences of at most 2048 tokens; ``with_ids`` of the operator adds their ids."""
    return packing.pack_documents(common.documents(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the language model nor the packing; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
