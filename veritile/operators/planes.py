"""Pixel planes as rows (image_id, y, x, v): crops, stencils, box filters, resampling.

Stencils are window functions over rows and columns of an image, not self-joins: two windows do the work of a nine-way
join.  Windows are partitioned by image and line, so a large image is spread over as many tasks as it has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(axis: str, keys: tuple[str, ...]) -> Window:
    line = "y" if axis == "x" else "x"
    return Window.partitionBy(*keys, line).orderBy(axis)


def crop(plane: DataFrame, x: int, y: int, width: int, height: int, size: tuple[int, int] | None = None) -> DataFrame:
    """The part inside the region, with coordinates from its corner.

    The query fails for an image that the region leaves; an image's size is that of its greatest coordinates, a partial
    aggregate that is broadcast or joined as Spark sees fit.  Where all images have one known ``size`` (width, height),
    that is what counts: then pixels may be missing anywhere, and nothing is aggregated or joined.
    """
    if min(x, y) < 0 or min(width, height) < 1:
        raise ValueError("a region begins inside the image and is not empty")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    if size is not None:
        if x + width > size[0] or y + height > size[1]:
            raise ValueError("the region leaves the image")
        return plane.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})
    size_of = plane.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    whole = (F.col("_w") >= x + width) & (F.col("_h") >= y + height)
    fits = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("the region leaves the image")).cast("boolean"))
    out = plane.join(size_of.select("image_id", fits.alias("_fits")), "image_id").where(F.col("_fits") & inside)
    return out.withColumns({"x": F.col("x") - x, "y": F.col("y") - y}).drop("_fits")


def second_difference(plane: DataFrame, axis: str, v: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """1 -2 1 along an axis; positions without both neighbours go."""
    w = _along(axis, keys)
    beside = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lead(axis).over(w) == F.col(axis) + 1)
    out = plane.withColumn("_d", F.when(beside, F.lag(v).over(w) - 2 * F.col(v) + F.lead(v).over(w)))
    return out.where(F.col("_d").isNotNull()).withColumn(v, F.col("_d")).drop("_d")


def high_pass(plane: DataFrame, v: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The 3x3 mask that is the product of two second differences; its norm is 6."""
    return second_difference(second_difference(plane, "x", v, keys), "y", v, keys)


def prediction_errors(plane: DataFrame, v: str = "v", keys: tuple[str, ...] = ("image_id", "c")) -> DataFrame:
    """A value less the mean of its four neighbours, where it has them all."""
    across, down = _along("x", keys), _along("y", keys)
    four = F.lag(v).over(across) + F.lead(v).over(across) + F.lag(v).over(down) + F.lead(v).over(down)
    out = plane.withColumn("e", F.col(v) - 0.25 * four)
    return out.where(F.col("e").isNotNull())


def box_mean(plane: DataFrame, size: int, v: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``m``: the mean of the pixels there are in a square of odd ``size``, by running sums along x, then y.

    Pixels may be missing, at the edges and inside.  A place without a pixel still has a sum along x if a pixel is near,
    as a pixel above or below may need it: such places join the line for the second sum and go after it.
    """
    r = size // 2
    line = _along("x", keys)
    x, before, after = F.col("x"), F.lag("x").over(line), F.lead("x").over(line)
    # Of the missing places between two pixels the first r come with the left one, others within r with the right one.
    left, right = F.coalesce(F.greatest(x - r, before + r + 1), x - r), F.coalesce(F.least(x + r, after - 1), x + r)
    none = F.array().cast(plane.select(F.array("x")).dtypes[0][1])
    beside = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none)
    near = plane.withColumns({"_left": left, "_right": right, "_again": F.coalesce(before == x, F.lit(False))})
    places = F.concat(F.array(x), beside(F.col("_left"), x - 1), beside(x + 1, F.col("_right")))
    full = near.withColumn("_x", F.explode(places)).withColumns({v: F.when(F.col("_x") == x, F.col(v)), "_real": F.col("_x") == x, "x": F.col("_x")})
    rows, cols = line.rangeBetween(-r, r), _along("y", keys).rangeBetween(-r, r)
    # Of several pixels at one place each has a row, and one stands for the place.
    sums = full.withColumns({"_s": F.sum(v).over(rows), "_n": F.count(v).over(rows)})
    once = lambda c: F.sum(F.when(~F.col("_again"), F.col(c))).over(cols)
    return sums.withColumn("m", F.try_divide(once("_s"), once("_n"))).where("_real").drop("_s", "_n", "_x", "_left", "_right", "_again", "_real")


def box_downsample(plane: DataFrame, factor: int, v: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Means of whole squares; what is left at the right and lower edge goes."""
    cell = plane.withColumns({"y": F.expr(f"y div {factor}"), "x": F.expr(f"x div {factor}")})
    return cell.groupBy(*keys, "y", "x").agg(F.avg(v).alias(v), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == factor * factor).drop("_n")


def zero_mean(plane: DataFrame, v: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Columns to mean zero, then rows."""
    down = plane.withColumn(v, F.col(v) - F.avg(v).over(Window.partitionBy(*keys, "x")))
    return down.withColumn(v, F.col(v) - F.avg(v).over(Window.partitionBy(*keys, "y")))


def mirrored(index: Column, size: int) -> Column:
    """The index that a symmetric extension has at a place: edges are repeated, with period twice the size."""
    m = F.pmod(index, F.lit(2 * size))
    return F.when(m < size, m).otherwise(2 * size - 1 - m)


def clipped_share(v: Column, low: float, high: float) -> Column:
    """An aggregate: the share of values at or beyond two bounds."""
    return F.avg(((v <= low) | (v >= high)).cast("double"))


def cells(plane: DataFrame, size: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Adds the row and column of the cell that a pixel lies in."""
    return plane.withColumns({"by": F.expr(f"y div {size}"), "bx": F.expr(f"x div {size}")})


def tile_plan(images: DataFrame, tile: int, halo: int) -> DataFrame:
    """One row for each tile of (image_id, width, height): its core, and the core with a halo cut at the edges."""
    grid = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile))).alias("y")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(tile))).alias("x")
    )
    w, h = F.least(F.lit(tile), F.col("width") - F.col("x")), F.least(F.lit(tile), F.col("height") - F.col("y"))
    x0, y0 = F.greatest(F.lit(0), F.col("x") - halo), F.greatest(F.lit(0), F.col("y") - halo)
    return grid.select(
        "image_id", "x", "y", w.alias("w"), h.alias("h"), x0.alias("ex"), y0.alias("ey"),
        (F.least(F.col("width"), F.col("x") + w + halo) - x0).alias("ew"), (F.least(F.col("height"), F.col("y") + h + halo) - y0).alias("eh"),
    )
