"""A training corpus in five stages, each by one of the operators; counted as part of the subpackage ``llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritile.llm import decontamination, language_id, line_dedup, packing, simhash
from veritile.llm.common import reachable, table
from veritile.stages import discard, materialize, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with some probability, go."""
    reachable(spark)
    return language_id.language_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go but for their first occurrence; a document of which nothing is left goes."""
    reachable(spark)
    return line_dedup.dedup_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8) stays."""
    reachable(spark)
    return simhash.near_dedup_stage(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item, or of an edited one, go."""
    reachable(spark)
    return decontamination.clean_stage(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place."""
    reachable(spark)
    return packing.pack_stage(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", pack),
]

#: No SQL: the stages train a network, hash with a 64-bit function that SQL lacks, and pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # A stage's own tables go when its output is written, and so does its input, unless it is the corpus.
        with temporary() as keep:
            out = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = out
    return docs
