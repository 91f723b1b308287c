"""Timings of the checks as a table in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<!-- timings:start -->", "<!-- timings:end -->"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(analyzer, size, pixels, milliseconds) of a file ``{"generatedAt": ..., "results": [...]}``."""
    whole = spark.read.schema("generatedAt string, results array<struct<analyzer:string,size:string,pixels:long,milliseconds:double>>").json(path, multiLine=True)
    return whole.select(F.explode("results").alias("r")).select("r.*")


def markdown(rows: DataFrame) -> str:
    """A line for each row, by size, then name."""
    line = F.format_string("| %s | %s | %.2f |", "analyzer", "size", "milliseconds")
    lines = [r[0] for r in rows.orderBy("pixels", "analyzer").select(line).collect()]
    return "\n".join(["| Check | Size | ms |", "|---|---|---|", *lines])


def spliced(document: str, table: str) -> str:
    """The document with what is between the two marks replaced; each mark must be there once, in order."""
    if document.count(START) != 1 or document.count(END) != 1 or document.index(START) > document.index(END):
        raise ValueError("the document needs both marks once, in order")
    head, rest = document.split(START)
    return f"{head}{START}\n{table}\n{END}{rest.split(END)[1]}"
