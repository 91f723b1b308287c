"""Traces of a color filter array: phase energies of blocks and their agreement with the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritile.operators import planes

FLOOR, LEAST_SAMPLES, LEAST_ENERGY, LEAST_STRENGTH = 0.01, 16, 0.25, 0.4
#: Values at or beyond these are clipped; a block may have so large a share of them.
CLIP_LOW, CLIP_HIGH, MOST_CLIPPED = 2, 253, 0.5


def phase_energies(errors: DataFrame, size: int) -> DataFrame:
    """(image_id, c, by, bx, e0..e3): median squared prediction error of each 2x2 phase of a block.

    Blocks with too few samples of a phase, or whose greatest energy is too small to measure, go.
    """
    marked = errors.select("image_id", "c", F.expr(f"y div {size}").alias("by"), F.expr(f"x div {size}").alias("bx"), ((F.col("y") % 2) * 2 + F.col("x") % 2).alias("p"), (F.col("e") * F.col("e")).alias("q"))
    each = marked.groupBy("image_id", "c", "by", "bx", "p").agg(F.median("q").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SAMPLES)
    at = lambda k: F.max(F.when(F.col("p") == k, F.col("m"))).alias(f"e{k}")
    whole = each.groupBy("image_id", "c", "by", "bx").agg(*map(at, range(4)), F.count(F.lit(1)).alias("_n")).where("_n = 4").drop("_n")
    return whole.where(F.greatest("e0", "e1", "e2", "e3") >= LEAST_ENERGY)


def usable(blocks: DataFrame, plane: DataFrame, size: int) -> DataFrame:
    """The blocks of a channel that lie whole in ``plane`` (image_id, c, y, x, v) and whose values are not mostly clipped."""
    seen = planes.cells(plane, size).groupBy("image_id", "c", "by", "bx").agg(planes.clipped_share(F.col("v"), CLIP_LOW, CLIP_HIGH).alias("share"), F.count(F.lit(1)).alias("n"))
    return blocks.join(seen.where((F.col("n") == size * size) & (F.col("share") <= MOST_CLIPPED)), ["image_id", "c", "by", "bx"], "left_semi")


def strength(energies: list[Column], recorded: tuple[int, ...]) -> Column:
    """The log of the mean energy of the recorded phases over that of the others."""
    mean = lambda ks: F.greatest(F.lit(FLOOR), sum((energies[k] for k in ks[1:]), energies[ks[0]]) / len(ks))
    others = tuple(k for k in range(4) if k not in recorded)
    return F.ln(mean(recorded) / mean(others))


def votes(blocks: DataFrame) -> DataFrame:
    """(image_id, c, v0..v3): shares of the phases, summed over blocks."""
    total = F.col("e0") + F.col("e1") + F.col("e2") + F.col("e3")
    return blocks.where(total > 0).groupBy("image_id", "c").agg(*[F.sum(F.col(f"e{k}") / total).alias(f"v{k}") for k in range(4)])


def strengths(blocks: DataFrame, green: int = 1) -> DataFrame:
    """``blocks`` with ``s``: for green the better diagonal pair of phases, for others the best phase, counts as recorded."""
    e = [F.col(f"e{k}") for k in range(4)]
    v = [F.col(f"v{k}") for k in range(4)]
    pair = F.when(v[0] + v[3] >= v[1] + v[2], strength(e, (0, 3))).otherwise(strength(e, (1, 2)))
    most = F.greatest(*v)
    single = F.when(v[0] == most, strength(e, (0,))).when(v[1] == most, strength(e, (1,))).when(v[2] == most, strength(e, (2,))).otherwise(strength(e, (3,)))
    return blocks.join(votes(blocks), ["image_id", "c"]).withColumn("s", F.when(F.col("c") == green, pair).otherwise(single)).drop("v0", "v1", "v2", "v3")


def consistency_map(blocks: DataFrame, threshold: float = 0.3, green: int = 1) -> DataFrame:
    """(image_id, by, bx, consistency, status, shifted) for blocks of images with a trace in green.

    A block's strength in each channel with a trace is set against the image's median; green weighs double.
    """
    marked = strengths(blocks, green)
    seen = marked.join(marked.where(F.col("c") == green).select("image_id", "by", "bx"), ["image_id", "by", "bx"], "left_semi")
    medians = seen.groupBy("image_id", "c").agg(F.median("s").alias("typical")).where(F.col("typical") >= LEAST_STRENGTH)
    traced = medians.where(F.col("c") == green).select("image_id")
    weight = F.when(F.col("c") == green, 2.0).otherwise(1.0)
    both = seen.join(medians, ["image_id", "c"]).join(traced, "image_id", "left_semi")
    out = both.groupBy("image_id", "by", "bx").agg(
        (F.sum(weight * F.col("s") / F.col("typical")) / F.sum(weight)).alias("consistency"), F.max(F.when(F.col("c") == green, F.col("s"))).alias("_g")
    )
    return out.select("image_id", "by", "bx", "consistency", F.when(F.col("consistency") < threshold, "inconsistent").otherwise("consistent").alias("status"), (F.col("_g") < -LEAST_STRENGTH).alias("shifted"))
