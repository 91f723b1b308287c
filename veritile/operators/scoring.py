"""Combination of findings into one score for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritile.functions.scalar import clamp_score, verdict

CORROBORATION = 0.15


def combined_score(score: Column) -> Column:
    """An aggregate: the greatest score, and of the others a share each; 100 at most, 0 for none.

    The sum is a partial aggregate, so an image's findings meet in one row whatever their number.
    """
    return F.coalesce(F.least(F.lit(100.0), F.max(score) + CORROBORATION * (F.sum(score) - F.max(score))), F.lit(0.0))


def combine(findings: DataFrame, image: str = "image_id", score: str = "score") -> DataFrame:
    scored = findings.groupBy(image).agg(combined_score(clamp_score(F.col(score))).alias("overall_score"), F.count(F.lit(1)).alias("n_findings"))
    return scored.withColumn("verdict", verdict(F.col("overall_score")))


def top_contributors(findings: Column, most: int = 3) -> Column:
    """Of an array of (score, analyzer_id): the analyzers with a score, best first, as ``id (rounded)``."""
    kept = F.filter(findings, lambda f: f.score > 0)
    order = F.array_sort(F.transform(kept, lambda f: F.struct((-f.score).alias("s"), f.analyzer_id.alias("id"))))
    return F.transform(F.slice(order, 1, most), lambda f: F.concat(f.id, F.lit(" ("), F.round(-f.s).cast("int").cast("string"), F.lit(")")))


def merge_tiles(tiles: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores of tiles to one: the greatest, and of the others a twentieth each up to 20; 100 at most."""
    best, rest = F.max(score), F.sum(score) - F.max(score)
    return tiles.groupBy(*keys).agg(F.least(F.lit(100.0), best + F.least(F.lit(20.0), 0.05 * rest)).alias("score"), F.count_if(F.col(score) > 0).alias("n_hot"))
