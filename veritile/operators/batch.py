"""Ranking, filtering and naming of the entries of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritile.functions.scalar import csv_field
from veritile.stages import materialize


def ranked(entries: DataFrame) -> DataFrame:
    """Analyzed files by falling score, then skipped ones; the path breaks ties."""
    return entries.orderBy(F.col("score").isNull(), F.desc("score"), F.asc("path"))


def with_rank(entries: DataFrame) -> DataFrame:
    """``entries`` with ``rank``, from 1, in the order of ``ranked``.

    Rows are range-partitioned in that order and written, and only the row counts of the partitions come back, so no task
    sees more than its range.
    """
    order = (F.col("score").isNull(), F.desc("score"), F.asc("path"))
    sorted_ = materialize(entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, 0
    for r in sorted(sorted_.groupBy(part.alias("part")).count().collect()):
        before[r["part"]] = total
        total += r["count"]
    starts = entries.sparkSession.createDataFrame(sorted(before.items()), "_part int, _before long")
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*entries.columns, (F.col("_before") + within + 1).alias("rank"))


def counts(entries: DataFrame) -> DataFrame:
    """One row: all, analyzed and skipped files."""
    return entries.agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("analyzed"), F.count_if(F.col("score").isNull()).alias("skipped"))


def at_least(entries: DataFrame, threshold: float) -> DataFrame:
    return entries.where(F.col("score") >= threshold)


def csv_lines(entries: DataFrame) -> DataFrame:
    """One line of text for each entry: path, status, rounded score, verdict, contributors, reason."""
    text = lambda c: csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")))
    line = F.concat_ws(
        ",",
        text("path"),
        F.when(F.col("score").isNull(), "skipped").otherwise("analyzed"),
        F.coalesce(F.round("score").cast("int").cast("string"), F.lit("")),
        text("verdict"),
        csv_field(F.coalesce(F.array_join("contributors", "; "), F.lit(""))),
        text("reason"),
    )
    return entries.select("path", "score", line.alias("line"))


def report_names(paths: DataFrame, path: str = "path", reserved: tuple[str, ...] = ("index",)) -> DataFrame:
    """(path, name): a safe file name for each path, unique without regard to case; repeats get -2, -3 ... in path order.

    A name that only its number makes equal to the safe name of another path has eight digits of a hash of its path too.
    The windows hold the paths of one safe name, so a long run of equal names is the only thing that gathers.
    """
    base = F.regexp_replace(F.regexp_replace(F.col(path), r"^/+", ""), r"[^A-Za-z0-9._-]", "_")
    named = paths.select(path, base.alias("_base"), F.lower(base).isin(*reserved).cast("int").alias("_held"))
    k = F.row_number().over(Window.partitionBy(F.lower("_base")).orderBy(path)) + F.col("_held")
    numbered = named.select(path, F.concat("_base", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise("")).alias("_name"), (k > 1).alias("_later"))
    met = F.count(F.lit(1)).over(Window.partitionBy(F.lower("_name"))) > 1
    tail = F.when(met & F.col("_later"), F.concat(F.lit("-"), F.substring(F.sha1(F.col(path).cast("binary")), 1, 8))).otherwise("")
    return numbered.select(path, F.concat("_name", tail, F.lit(".html")).alias("name"))
