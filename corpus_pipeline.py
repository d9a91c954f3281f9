"""From raw documents to training sequences: quality, repeated lines, near copies, test items, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import decontaminate, line_dedup, packing, quality, simhash
from latticeflow.llm._common import Scratch, free_name, opened
from latticeflow.llm.queries import piece_model, table, word_model

#: The later stages read texts that no SQL can rebuild without the tokenizers and hashes.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the fertility bands keep."""
    return quality.keep_quality(docs, piece_model())


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words and more; ``n_chars`` follows the text."""
    removed = free_name(docs, "removed_lines")
    out = line_dedup.remove_repeated_lines(docs, removed=removed)
    n_chars = F.when(F.size(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: fingerprints within three bits, or five-word shingles with Jaccard 0.8."""
    return simhash.keep_one_of_each(docs, similarity=0.8)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no test item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), short=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, word_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_items),
    ("best_fit_packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; what a stage leaves behind goes then."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with opened() as own:
            docs = scratch.put(stage(spark, docs, sf_dir), name)
            for x in own:
                x.close()
        if before:
            scratch.drop(before)
        before = name
    return docs
