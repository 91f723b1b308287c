"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritile.stages import discard, materialize  # noqa: F401  for the operators of this subpackage

#: ASCII letters, for a lower-casing that touches nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Python workers find this package wherever the session was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inward(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ..., so that no column of the caller meets one of an operator."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def place(docs: DataFrame, column: str) -> str:
    """The name that ``inward`` gives a column."""
    return f"c{[c.lower() for c in docs.columns].index(column.lower())}"


def outward(df: DataFrame, docs: DataFrame, added: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` under their own names, then ``added``, which replace columns of those names."""
    new = {c.lower() for c in added}
    return df.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() not in new), *added)


def heaviest(df: DataFrame, weight: str, most: int) -> DataFrame:
    """The rows from a weight (a positive number) on, so chosen that they are at most ``most``.

    The choice needs one row for each eighth of an octave of weights, so no task and not the driver gets more.
    """
    step = F.floor(8 * F.log2(weight)).cast("int")
    cut, total = None, 0
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    return df.where(step >= cut) if cut is not None else df.where(F.lit(False))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), lambda w: w != "")
