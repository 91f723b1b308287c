"""Threshold evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = ("tp", "fp", "tn", "fn")


def ratio(a: Column, b: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_metrics(cells: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in CELLS)
    out = cells.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(samples: DataFrame, threshold: float, score: str = "score", tampered: str = "tampered") -> DataFrame:
    """One row: the four cells at one threshold; a score at the threshold is flagged."""
    flagged, t = F.col(score) >= threshold, F.col(tampered)
    return samples.agg(
        F.count_if(flagged & t).alias("tp"), F.count_if(flagged & ~t).alias("fp"), F.count_if(~flagged & ~t).alias("tn"), F.count_if(~flagged & t).alias("fn")
    )


def thresholds(least: float, most: float, step: float) -> list[float]:
    """From ``least`` in steps up to ``most``, to six places; within 0 to 100."""
    if not (step > 0 and 0 <= least <= most <= 100):
        raise ValueError("a sweep needs a positive step and bounds in order from 0 to 100")
    return [round(least + k * step, 6) for k in range(int((most - least) / step + 1e-9) + 1)]


def sweep(samples: DataFrame, at: list[float], score: str = "score", tampered: str = "tampered") -> DataFrame:
    """The cells and metrics at each threshold.

    Each sample falls between two thresholds; the counts of those gaps are partial aggregates, and running sums over
    the thresholds (a bounded list) give the cells.  No sample is paired with every threshold.
    """
    spark = samples.sparkSession
    bounds = sorted(set(at))
    listed = F.array(*[F.lit(float(b)) for b in bounds])
    gap = F.size(F.filter(listed, lambda b: b <= F.col(score)))
    counts = samples.where(F.col(score).isNotNull()).groupBy(gap.cast("int").alias("k")).agg(F.count_if(F.col(tampered)).alias("t"), F.count_if(~F.col(tampered)).alias("a"))
    every = spark.createDataFrame([(k, b) for k, b in enumerate([None, *bounds])], "k int, threshold double")
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    whole = Window.partitionBy(F.lit(0))
    run = (
        every.join(counts, "k", "left")
        .na.fill(0, ["t", "a"])
        .withColumns({"tp": F.sum("t").over(above), "fp": F.sum("a").over(above), "all_t": F.sum("t").over(whole), "all_a": F.sum("a").over(whole)})
        .where("k > 0")
    )
    return with_metrics(run.select("threshold", "tp", "fp", (F.col("all_a") - F.col("fp")).alias("tn"), (F.col("all_t") - F.col("tp")).alias("fn")))


def best(swept: DataFrame) -> DataFrame:
    """The threshold with the best f1, then accuracy, then the lowest."""
    return swept.orderBy(F.desc("f1"), F.desc("accuracy"), F.asc("threshold")).limit(1)


def dataset_counts(results: DataFrame) -> DataFrame:
    """By label: all, analyzed and skipped samples."""
    return results.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score").isNotNull()).alias("analyzed"), F.count_if(F.col("score").isNull()).alias("skipped"))
