"""Noise levels of blocks and what deviates from the image's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritile.functions.scalar import area_severity_score
from veritile.operators.planes import cells, clipped_share, high_pass

#: From a median absolute deviation to a standard deviation; norm of the high-pass mask.
MAD_TO_SIGMA, MASK_NORM = 1.482602218505602, 6.0
SMOOTH, NOISY, SPREADS, LEAST_NOISE = 0.5, 2.0, 3.0, 0.05
EXPOSURE, EXPLAINED_WEIGHT = 1.5, 0.25


def block_levels(plane: DataFrame, size: int, low: float = 2.5, high: float = 252.5) -> DataFrame:
    """(image_id, by, bx, sigma, mean_luma) of whole blocks of which at most half is clipped.

    A block's border pixels use the pixels around it: the mask runs over the whole image and its results are grouped by
    the block of their centre.
    """
    whole = cells(plane, size).groupBy("image_id", "by", "bx").agg(F.avg("v").alias("mean_luma"), clipped_share(F.col("v"), low, high).alias("_c"), F.count(F.lit(1)).alias("_n"))
    whole = whole.where((F.col("_n") == size * size) & (F.col("_c") <= 0.5)).drop("_c", "_n")
    noise = cells(high_pass(plane), size).groupBy("image_id", "by", "bx").agg((MAD_TO_SIGMA / MASK_NORM * F.median(F.abs("v"))).alias("sigma"))
    return whole.join(noise, ["image_id", "by", "bx"])


def energy_variance(plane: DataFrame, size: int) -> DataFrame:
    """(image_id, by, bx, variance): the mean squared high-pass response of each block over the mask's norm squared.

    It is the noise variance if there is nothing but noise; a few strong edges move it far.  A block without a response
    has no row.
    """
    return cells(high_pass(plane), size).groupBy("image_id", "by", "bx").agg((F.avg(F.col("v") * F.col("v")) / (MASK_NORM * MASK_NORM)).alias("variance"))


def baseline(levels: DataFrame, key: str = "image_id", sigma: str = "sigma") -> DataFrame:
    """(key, typical, spread): the median level, and the spread of the logs of the ratios to it, from their median."""
    typical = levels.groupBy(key).agg(F.median(sigma).alias("typical")).where("typical > 0")
    ratios = levels.join(typical, key).where(F.col(sigma) > 0).select(key, "typical", F.ln(F.col(sigma) / F.col("typical")).alias("_r"))
    centre = ratios.groupBy(key).agg(F.median("_r").alias("_m"))
    return ratios.join(centre, key).groupBy(key).agg(F.first("typical").alias("typical"), (MAD_TO_SIGMA * F.median(F.abs(F.col("_r") - F.col("_m")))).alias("spread"))


def cutoffs(spread: Column, smooth: float = SMOOTH, noisy: float = NOISY) -> tuple[Column, Column]:
    low, high = min(0.99, max(0.01, smooth)), max(1.01, noisy)
    return F.least(F.lit(low), F.exp(-SPREADS * spread)), F.greatest(F.lit(high), F.exp(SPREADS * spread))


def direction(ratio: Column, lower: Column, upper: Column) -> Column:
    return F.when(ratio.isNull() | F.isnan(ratio) | (ratio < 0), F.lit(None)).when(ratio < lower, "tooSmooth").when(ratio > upper, "tooNoisy")


def severity(ratio: Column, lower: Column, upper: Column) -> Column:
    smooth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lower - ratio) / lower))
    noisy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ln(ratio / upper) / F.ln(F.lit(2.0))))
    return F.when(ratio < lower, smooth).when(ratio > upper, noisy).otherwise(0.0)


def exposure_explains(ratio: Column, luma: Column, typical_luma: Column, way: Column) -> Column:
    """Noise grows with the root of the brightness; whether that alone gives the ratio, within a factor."""
    expected = F.sqrt(F.greatest(luma, F.lit(1.0)) / F.greatest(typical_luma, F.lit(1.0)))
    right_way = F.when(way == "tooSmooth", expected < 1).when(way == "tooNoisy", expected > 1).otherwise(False)
    return right_way & (ratio > 0) & (ratio / expected).between(1 / EXPOSURE, EXPOSURE)


def judged(levels: DataFrame, smooth: float = SMOOTH, noisy: float = NOISY) -> DataFrame:
    """``levels`` with ratio, status, severity and whether exposure explains it."""
    luma = levels.groupBy("image_id").agg(F.median("mean_luma").alias("typical_luma"))
    both = levels.join(baseline(levels), "image_id").join(luma, "image_id").where(F.col("typical") >= LEAST_NOISE)
    lower, upper = cutoffs(F.col("spread"), smooth, noisy)
    out = both.withColumns({"ratio": F.col("sigma") / F.col("typical"), "lower": lower, "upper": upper})
    way = direction(F.col("ratio"), F.col("lower"), F.col("upper"))
    return out.withColumns({
        "status": F.coalesce(way, F.lit("consistent")),
        "severity": severity(F.col("ratio"), F.col("lower"), F.col("upper")),
        "explained": F.coalesce(exposure_explains(F.col("ratio"), F.col("mean_luma"), F.col("typical_luma"), way), F.lit(False)),
    })


def image_scores(marked: DataFrame) -> DataFrame:
    """(image_id, reliable, flagged, score): up to 55 for the flagged share and 25 for how far off they are."""
    off = F.col("status") != "consistent"
    weight = F.when(off, F.when(F.col("explained"), EXPLAINED_WEIGHT).otherwise(1.0)).otherwise(0.0)
    sums = marked.groupBy("image_id").agg(F.count(F.lit(1)).alias("reliable"), F.count_if(off).alias("flagged"), F.sum(weight).alias("_w"), F.sum(weight * F.col("severity")).alias("_s"))
    score = area_severity_score(F.col("_w"), F.col("reliable"), F.try_divide("_s", "_w"), 55.0, 25.0)
    return sums.withColumn("score", F.when(F.col("reliable") < 4, 0.0).otherwise(score)).drop("_w", "_s")
