"""Blocks of 8x8 pixels: cosine transform, recompression, error levels, ghosts and coefficient periodicity.

A block is an array of 64 numbers in one row, so nothing here is shuffled by pixel.  Transforms are matrix products over
Arrow batches of blocks in numpy, some blocks at a time: as higher-order functions, whose inner arrays are evaluated again for each outer
element, they took minutes for 500 blocks.  Everything that follows from coefficients is built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritile.functions import kernels

DIP, LEAST_DIFFERENCE, HISTORY = 0.3, 0.5, 0.5


#: Blocks that a kernel takes at once: a batch from Spark may have ten times as many, and a kernel makes several copies.
CHUNK = 1024


def _chunks(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of a column that are not null, some at a time, with the place of the first among them."""
    held = column.drop_null()
    if not pc.all(pc.equal(pc.list_value_length(held), 64)).as_py():
        raise ValueError("a block has 64 numbers")
    values = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
    for lo in range(0, len(values), CHUNK):
        yield lo, values[lo : lo + CHUNK].astype(float)


def _lists(parts: list[np.ndarray], column: pa.ListArray) -> pa.ListArray:
    """Rows of numbers as lists, with nulls where ``column`` has them."""
    width = parts[0].shape[1] if parts else 1
    there = column.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(there) * width]).astype(np.int32)
    values = pa.array(np.concatenate(parts).ravel() if parts else np.zeros(0), pa.float64())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~there))


def _of_blocks(run):
    """A column function from one on (n, 8, 8) arrays of blocks to the same."""

    def each(column: pa.Array) -> pa.Array:
        return _lists([run(b).reshape(-1, 64) for _, b in _chunks(column)], column)

    return F.arrow_udf(each, "array<double>")


def forward(block: Column) -> Column:
    """The 64 coefficients of a block, rows first; to nine places, so that ties do not depend on the order of sums."""
    return _of_blocks(kernels.dct)(block)


def inverse(coefficients: Column) -> Column:
    return _of_blocks(kernels.inverse_dct)(coefficients)


def recompressed(block: Column, quality: int) -> Column:
    """The block after quantization at a quality: 8-bit values again."""
    return _of_blocks(lambda b: kernels.recompress_blocks(b, quality))(block)


def coefficient(block: Column, row: int, col: int) -> Column:
    """One coefficient as a single weighted sum of built-in functions."""
    c = kernels.COSINE
    weights = F.array(*[F.lit(float(c[row][k // 8] * c[col][k % 8])) for k in range(64)])
    return F.round(F.aggregate(F.zip_with(block, weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)


def mean_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def ghost_curve(block: Column, levels: list[int], first: Column) -> Column:
    """The mean squared differences that recompression at each level makes to a block that was recompressed at ``first`` before.

    One function for the whole curve: the recompressed blocks stay where they are made, and a task has one worker.
    """

    def each(column: pa.Array, before: pa.Array) -> pa.Array:
        out, quality = [], before.filter(column.is_valid()).to_numpy(zero_copy_only=False)
        for lo, b in _chunks(column):
            own = quality[lo : lo + len(b)]
            for q in np.unique(own):
                b[own == q] = kernels.recompress_blocks(b[own == q], int(q))
            out.append(np.stack([((b - kernels.recompress_blocks(b, q)) ** 2).sum((1, 2)) / 64 for q in levels], 1))
        return _lists(out, column)

    return F.arrow_udf(each, "array<double>")(block, first.cast("int"))


def error_levels(errors: Column, threshold: float) -> tuple[Column, Column]:
    """Of an array of errors by quality: the greatest times the share at or over the threshold, and how many are."""
    hot = F.size(F.filter(errors, lambda e: e >= threshold))
    return F.array_max(errors) * hot / F.size(errors), hot


def qualities(low: int, high: int, step: int) -> list[int]:
    """Clamped, in order, and ending at the higher bound."""
    a, b = sorted(max(1, min(100, q)) for q in (low, high))
    levels = list(range(a, b + 1, max(1, step)))
    return levels if levels[-1] == b else [*levels, b]


def ghost_quality(curve: Column, levels: list[int]) -> Column:
    """The lowest quality at which a curve dips well below its neighbours; the last level never counts."""
    at = lambda k: curve[k]
    dips = [
        F.when((at(k) < near) & (at(k) <= (1 - DIP) * near), F.lit(levels[k]))
        for k in range(len(levels) - 1)
        for near in [at(1) if k == 0 else F.least(at(k - 1), at(k + 1))]
    ]
    return F.coalesce(*dips) if dips else F.lit(None).cast("int")


def dominant(blocks: DataFrame, quality: str = "ghost", key: str = "image_id") -> DataFrame:
    """The most frequent quality of an image, the lower of equals."""
    counts = blocks.where(F.col(quality).isNotNull()).groupBy(key, quality).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.max_by(quality, F.struct("_n", -F.col(quality))).alias("dominant"))


def ghost_map(curves: DataFrame, levels: list[int], disagreement: int = 10) -> DataFrame:
    """Blocks (image_id, ..., curve) with ghost, dominant and status.

    A block is measured if some quality changes it enough; an image has a history if half its measured blocks have a
    ghost.
    """
    measured = F.array_max("curve") >= LEAST_DIFFERENCE
    marked = curves.withColumns({"measured": measured, "ghost": F.when(measured, ghost_quality(F.col("curve"), levels))})
    share = marked.groupBy("image_id").agg(F.count_if("measured").alias("n_measured"), F.count("ghost").alias("n_ghost"))
    history = share.where((F.col("n_measured") > 0) & (F.col("n_ghost") >= HISTORY * F.col("n_measured"))).select("image_id")
    named = marked.join(dominant(marked).join(history, "image_id", "left_semi"), "image_id", "left")
    off = F.abs(F.col("ghost") - F.col("dominant"))
    return named.withColumn("status", F.when(off.isNull(), "unreliable").when(off >= disagreement, "inconsistent").otherwise("consistent"))


def histogram(values: DataFrame, value: str, keys: list[str], most: int = 200) -> DataFrame:
    """(keys, bin, n): rounded values, clamped to the range that the largest magnitude gives."""
    span = F.least(F.lit(most), F.greatest(F.lit(4), F.ceil(F.max(F.abs(value))).cast("int")))
    ranges = values.groupBy(*keys).agg(span.alias("_r"))
    bins = values.join(ranges, keys).withColumn("bin", F.greatest(-F.col("_r"), F.least(F.col("_r"), F.round(value).cast("int"))))
    return bins.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def periodicity(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, strength): the largest share of one frequency in the histogram less its moving mean.

    Empty bins do not count; a histogram has at most 401 bins and so a window is small.  Each bin is paired with the
    frequencies of its own histogram only.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    near = order.rowsBetween(-3, 3)
    rest = bins.withColumns({"k": F.row_number().over(order) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "d": F.col("n") - F.avg("n").over(near)}).where("m >= 8")
    waves = rest.withColumn("f", F.explode(F.expr("sequence(1, cast(m div 2 as int))")))
    angle = -2 * math.pi * F.col("f") * F.col("k") / F.col("m")
    spectrum = waves.groupBy(*keys, "f").agg(F.sum(F.col("d") * F.cos(angle)).alias("re"), F.sum(F.col("d") * F.sin(angle)).alias("im"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return spectrum.groupBy(*keys).agg(F.coalesce(F.try_divide(F.max(size), F.sum(size)), F.lit(0.0)).alias("strength"))
