"""From raw documents to training sequences in five stages, each one operator on all rows it gets.

The first four return the columns of documents; n_chars follows the text. ORACLE_SQL is None:
SQL cannot express a learned classifier, MinHash components or a tokenizer's merges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import free_name
from pointloom.llm.decontaminate import keep_clean
from pointloom.llm.language import keep_identified, train
from pointloom.llm.lines import dedup_lines
from pointloom.llm.linking import saved
from pointloom.llm.neardup import keep_one
from pointloom.llm.packing import pack
from pointloom.session import bounded_batches, table


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose rows reach Python in batches of bounded bytes: all stages share the same executors."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, docs, sf_dir)

    return run


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; rejects null, letterless and undecided texts."""
    return keep_identified(docs, train(docs, "doc_id", "text", "lang"))


@stage
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that have a near copy elsewhere, and documents of which nothing else was left."""
    removed = F.col(free_name("n_removed", docs.columns))
    out = dedup_lines(docs).where((removed == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return keep_one(docs).select(*docs.columns)


@stage
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence of its own."""
    return pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near-duplicate removal", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each one's rows saved before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = saved(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
