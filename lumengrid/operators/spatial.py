"""Neighbourhood operators over pixels.

Small supports scatter or gather single pixels by joins on (image_id, x, y); box means use separable row and column
windows; wide or ordered supports run per image in Arrow batches (`lumengrid.operators.raster`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.numeric import idiv
from lumengrid.operators import raster
from lumengrid.plans.views import CHANNELS, KEY, RGB, sizes

# 3 x 3 kernels in row-major order.
BLUR = (0.0625, 0.125, 0.0625, 0.125, 0.25, 0.125, 0.0625, 0.125, 0.0625)
SHARPEN = (0.0, -0.25, 0.0, -0.25, 2.0, -0.25, 0.0, -0.25, 0.0)
SOBEL_HORIZONTAL = (1.0, 2.0, 1.0, 0.0, 0.0, 0.0, -1.0, -2.0, -1.0)
SOBEL_VERTICAL = (1.0, 0.0, -1.0, 2.0, 0.0, -2.0, 1.0, 0.0, -1.0)


def _beside(at: str, *across: str):
    """Windows over rows or columns, and the value before and after a pixel in its line; absent ones count 0."""
    line = Window.partitionBy("image_id", *across).orderBy(at)
    before = lambda v: F.when(F.lag(at).over(line) == F.col(at) - 1, F.lag(v).over(line)).otherwise(0)
    after = lambda v: F.when(F.lead(at).over(line) == F.col(at) + 1, F.lead(v).over(line)).otherwise(0)
    return before, after


def apply_kernel(pixels: DataFrame, kernel: tuple[float, ...]) -> DataFrame:
    """3 x 3 correlation of all channels; taps outside the image are left out, without making up for them.

    Images are dense. One window over rows makes each kernel row's sums, one over columns adds the three of them: two shuffles of
    one row for each pixel.
    """
    left, right = _beside("x", "y")
    rows = {f"{c}{k}": left(c) * kernel[3 * k] + F.col(c) * kernel[3 * k + 1] + right(c) * kernel[3 * k + 2] for k in range(3) for c in CHANNELS}
    across = pixels.select(*KEY, *[v.alias(n) for n, v in rows.items()])
    above, below = _beside("y", "x")
    value = lambda c: F.least(F.greatest(F.round(above(f"{c}0") + F.col(f"{c}1") + below(f"{c}2")), F.lit(0.0)), F.lit(255.0)).cast("int")
    return across.select(*KEY, *[value(c).alias(c) for c in CHANNELS])


def smooth(pixels: DataFrame) -> DataFrame:
    """The mean over 3 x 3 with the divisor 9 at the edges too."""
    ones = apply_sums(pixels)
    return ones.select(*KEY, *[F.floor(F.col(c) / 9.0 + 0.5).cast("int").alias(c) for c in CHANNELS])


def apply_sums(pixels: DataFrame) -> DataFrame:
    """Whole-number sums over 3 x 3 of dense images."""
    left, right = _beside("x", "y")
    across = pixels.select(*KEY, *[(left(c) + F.col(c) + right(c)).alias(c) for c in CHANNELS])
    above, below = _beside("y", "x")
    return across.select(*KEY, *[(above(c) + F.col(c) + below(c)).alias(c) for c in CHANNELS])


def _box_pass(pixels: DataFrame, radius: int, along: str, across: str) -> DataFrame:
    """Means of 2 * radius + 1 neighbours along one axis, edges repeated; one window over each row or column."""
    line = Window.partitionBy("image_id", across).orderBy(along)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(along).over(whole)
    before, after = F.greatest(F.lit(radius) - F.col(along), F.lit(0)), F.greatest(F.col(along) + radius - last, F.lit(0))
    mean = lambda c: idiv(F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole), 2 * radius + 1).cast("int")
    return pixels.select(*KEY, *[mean(c).alias(c) for c in CHANNELS])


def box_blur(pixels: DataFrame, radius: int) -> DataFrame:
    """Separable means, truncated after each pass. Rows of an image are shuffled, then columns."""
    if radius <= 0:
        return pixels
    return _box_pass(_box_pass(pixels, radius, "x", "y"), radius, "y", "x")


#: The radius up to which neighbours meet as rows; wider ones would multiply the rows, and are seen in halo tiles.
NEAR = 2


def _surface(image: np.ndarray, radius: int, threshold: int) -> np.ndarray:
    """From each window's counts: how many values lie near the pixel's, and their sum."""
    out, value = image.copy(), np.arange(256)
    for channel in range(3):
        for y, counts in enumerate(raster.histograms(image[..., channel], radius)):
            own = image[y, :, channel].astype(np.int64)
            at, low, high = np.arange(len(own)), np.maximum(own - threshold, 0), np.minimum(own + threshold, 255) + 1
            number, total = (np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(c, axis=1)], axis=1) for c in (counts, counts * value))
            out[y, :, channel] = (total[at, high] - total[at, low]) // (number[at, high] - number[at, low])
    return out


def _extremes(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each window, along rows and then columns, edges repeated."""
    found = []
    for pick in (np.minimum, np.maximum):
        part = np.pad(values, radius, mode="edge")
        for axis in (0, 1):
            n = values.shape[axis]
            taps = [np.take(part, np.arange(k, k + n), axis=axis) for k in range(2 * radius + 1)]
            part = pick.reduce(taps)
        found.append(part)
    return tuple(found)


def _despeckled(image: np.ndarray, radius: int, threshold: float) -> np.ndarray:
    out = image.copy()
    luma = image[..., :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000
    low, high = _extremes(luma, radius)
    middle = np.empty_like(image[..., :3])
    for channel in range(3):
        for y, counts in enumerate(raster.histograms(image[..., channel], radius)):
            middle[y, :, channel] = raster.middles(counts, radius)
    odd = (luma == low) | (luma == high) | (np.abs(image[..., :3] - middle).max(axis=-1) > threshold)
    out[..., :3] = np.where(odd[..., None], middle, image[..., :3])
    return out


def neighbours(pixels: DataFrame, radius: int) -> DataFrame:
    """(image_id, x, y, r, g, b, a, times): the pixels within `radius` of each place, edges repeated.

    A pixel is sent to every place that sees it; `times` is how often, more than once through a repeated edge.
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    rows = pixels.join(sizes(pixels), "image_id")
    spread = rows.select("*", F.explode(reach).alias("dx")).select("*", F.explode(reach).alias("dy"))
    inside = spread.withColumns({"tx": F.col("x") - F.col("dx"), "ty": F.col("y") - F.col("dy")}).where("tx between 0 and width - 1 and ty between 0 and height - 1")

    def seen(at: str, d: str, size: str, target: str):
        """How many taps of the target land on this coordinate: one, or all beyond the edge as well."""
        low = F.when((F.col(at) == 0) & (F.col(target) < radius), F.lit(radius) - F.col(target)).otherwise(0)
        high = F.when((F.col(at) == F.col(size) - 1) & (F.col(target) + radius > F.col(size) - 1), F.col(target) + radius - F.col(size) + 1).otherwise(0)
        return low + high + 1

    times = seen("x", "dx", "width", "tx") * seen("y", "dy", "height", "ty")
    return inside.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *CHANNELS, times.alias("times"))


def median(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """The middle value of each colour channel around a pixel; alpha stays. Beyond a radius of NEAR, by halo tiles."""
    if radius <= 0:
        return pixels
    if radius > NEAR:
        return raster.median_wide(pixels, radius)
    lists = neighbours(pixels, radius).groupBy(*KEY).agg(*[F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col(c), F.col("times").cast("int"))))).alias(c) for c in RGB])
    mid = (2 * radius + 1) ** 2 // 2 + 1
    return lists.select(*KEY, *[F.element_at(c, mid).alias(c) for c in RGB]).join(pixels.select(*KEY, "a"), list(KEY)).select(*KEY, *CHANNELS)


def _luma(p: str = ""):
    return idiv(F.col(f"{p}r") * 299 + F.col(f"{p}g") * 587 + F.col(f"{p}b") * 114, 1000)


def despeckle(pixels: DataFrame, radius: int = 1, threshold: float = 0.0) -> DataFrame:
    """The window's median replaces a pixel that is darkest or brightest in it, or differs by more than `threshold`."""
    if radius > NEAR:
        return raster.per_tile(pixels, lambda image: _despeckled(image, radius, threshold), radius)
    near = neighbours(pixels, radius).withColumn("luma", _luma())
    lists = near.groupBy(*KEY).agg(F.min("luma").alias("low"), F.max("luma").alias("high"), *[F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col(c), F.col("times").cast("int"))))).alias(f"m_{c}") for c in RGB])
    mid = (2 * radius + 1) ** 2 // 2 + 1
    both = pixels.join(lists.select(*KEY, "low", "high", *[F.element_at(f"m_{c}", mid).alias(f"m_{c}") for c in RGB]), list(KEY))
    extreme = (_luma() == F.col("low")) | (_luma() == F.col("high"))
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"m_{c}")) for c in RGB]) > threshold
    return both.select(*KEY, *[F.when(extreme | far, F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in RGB], "a")


def surface_blur(pixels: DataFrame, radius: int, threshold: int) -> DataFrame:
    """For each colour channel, the mean of the neighbours within `threshold` of the pixel; alpha stays."""
    if radius > NEAR:
        return raster.per_tile(pixels, lambda image: _surface(image, radius, threshold), radius)
    own = pixels.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in RGB], F.col("a").alias("o_a"))
    both = neighbours(pixels, radius).join(own, list(KEY))
    close = lambda c: F.abs(F.col(c) - F.col(f"o_{c}")) <= threshold
    sums = both.groupBy(*KEY, "o_a").agg(*[F.sum(F.when(close(c), F.col(c) * F.col("times"))).alias(c) for c in RGB], *[F.sum(F.when(close(c), F.col("times"))).alias(f"n_{c}") for c in RGB])
    return sums.select(*KEY, *[idiv(F.col(c), F.col(f"n_{c}")).cast("int").alias(c) for c in RGB], F.col("o_a").alias("a"))


def spread_alpha(pixels: DataFrame, grow: bool) -> DataFrame:
    """Alpha of the greatest (or smallest) pixel of 3 x 3 inside the image."""
    taps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    rows = pixels.select("image_id", "x", "y", "a", F.explode(taps).alias("t"))
    moved = rows.select("image_id", (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"), "a")
    best = moved.groupBy(*KEY).agg((F.max if grow else F.min)("a").alias("a"))
    return pixels.drop("a").join(best, list(KEY)).select(*KEY, *CHANNELS)
