"""Aggregations over pixels: histograms, clip bounds, levels tables, medians, and the automatic corrections built on them.

Everything aggregates by image with map-side partial sums: no function gathers the pixels of an image in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions import color
from lumengrid.plans.views import CHANNELS, RGB


def histogram(pixels: DataFrame, skip_transparent: bool = False) -> DataFrame:
    """(image_id, channel, bin, cnt): how many pixels of a channel have a value."""
    kept = pixels.where("a <> 0") if skip_transparent else pixels
    rows = kept.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in CHANNELS])).alias("v"))
    return rows.groupBy("image_id", "v.channel", "v.bin").agg(F.count("*").alias("cnt"))


def _running(hist: DataFrame) -> DataFrame:
    """The histogram with counts up to and from each bin, and in all; a channel has 256 bins at most."""
    by = Window.partitionBy("image_id", "channel")
    up = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumns({"upto": F.sum("cnt").over(up), "down": F.sum("cnt").over(down), "total": F.sum("cnt").over(by)})


def clip_bounds(hist: DataFrame, fraction: float) -> DataFrame:
    """(image_id, channel, lo, hi): the bins at which `fraction` of the pixels is cut from either end.

    Where the bounds cross, the first and last bin that is not empty; with nothing to cut, 0 and 255.
    """
    k = F.round(F.col("total") * F.lit(fraction)).cast("long")
    run = _running(hist.where("cnt > 0")).withColumn("k", k)
    found = run.groupBy("image_id", "channel").agg(
        F.min(F.when(F.col("upto") >= F.col("k"), F.col("bin"))).alias("lo"),
        F.max(F.when(F.col("down") >= F.col("k"), F.col("bin"))).alias("hi"),
        F.min("bin").alias("first"),
        F.max("bin").alias("last"),
        F.max("k").alias("k"),
    )
    lo, hi = F.when(F.col("k") == 0, 0).otherwise(F.col("lo")), F.when(F.col("k") == 0, 255).otherwise(F.col("hi"))
    return found.select("image_id", "channel", F.when(lo >= hi, F.col("first")).otherwise(lo).alias("lo"), F.when(lo >= hi, F.col("last")).otherwise(hi).alias("hi"))


def _stretch(v, lo, hi):
    span = F.when(hi > lo, hi - lo).otherwise(1)
    return F.when(v <= lo, 0).when(v >= hi, 255).otherwise(F.floor((v - lo) / span * 255.0 + 0.5).cast("int"))


def levels_lut(bounds: DataFrame) -> DataFrame:
    """(image_id, channel, v_in, v_out): the stretch of lo..hi to 0..255 as 256 rows for each channel."""
    rows = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v_in"))
    return rows.select("image_id", "channel", "v_in", _stretch(F.col("v_in"), F.col("lo"), F.col("hi")).alias("v_out"))


def channel_stats(pixels: DataFrame, skip_transparent: bool = False, center: int = 128, around: int = 32, percentile: float = 0.9) -> DataFrame:
    """(image_id, channel, n, median, mean, weighted, percentile) from the histogram.

    The median is the smallest value with over half of the pixels at or below it; `weighted` is the mean of the values
    within `around` of `center`, or `center`; the percentile is the first value that reaches the share, 0 for a share of 0.
    """
    run = _running(histogram(pixels, skip_transparent))
    v, n = F.col("bin"), F.col("cnt")
    near = F.abs(v - center) <= around
    rank = F.floor(F.col("total") * F.lit(percentile)).cast("long")
    rows = run.groupBy("image_id", "channel").agg(
        F.max("total").alias("n"),
        F.min(F.when(F.col("upto") > F.expr("total div 2"), v)).alias("median"),
        F.sum(v * n).alias("s"),
        F.sum(F.when(near, v * n)).alias("ws"),
        F.sum(F.when(near, n)).alias("wn"),
        F.min(F.when(F.col("upto") >= rank, v)).alias("p"),
        F.max(rank).alias("rank"),
    )
    return rows.select(
        "image_id",
        "channel",
        "n",
        "median",
        F.expr("CAST(s div n AS INT)").alias("mean"),
        F.coalesce(F.expr("CAST(ws div wn AS INT)"), F.lit(center)).alias("weighted"),
        F.when(F.col("rank") == 0, 0).otherwise(F.col("p")).alias("percentile"),
    )


def color_average(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a): whole-number means."""
    sums = pixels.groupBy("image_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHANNELS])
    return sums.select("image_id", *[F.expr(f"CAST({c} div n AS INT)").alias(c) for c in CHANNELS])


def color_mode(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a): the most frequent value of each channel, the smallest of equals."""
    best = histogram(pixels).groupBy("image_id", "channel").agg(F.max_by("bin", F.struct("cnt", -F.col("bin"))).alias("v"))
    return best.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in CHANNELS])


def color_median(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, a): the upper median of each channel."""
    run = _running(histogram(pixels))
    mid = run.groupBy("image_id", "channel").agg(F.min(F.when(F.col("upto") > F.expr("total div 2"), F.col("bin"))).alias("v"))
    return mid.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in CHANNELS])


def color_median_compat(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b): the value at two thirds of the sorted channel, as an older interface has it for RGBA data."""
    run = _running(histogram(pixels))
    at = F.expr("((total * 4) div 3) div 2")
    mid = run.groupBy("image_id", "channel").agg(F.min(F.when(F.col("upto") > at, F.col("bin"))).alias("v"))
    return mid.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in RGB])


def _wide(bounds: DataFrame) -> DataFrame:
    """One row for each image with lo and hi of r, g and b."""
    pick = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{v}_{c}")
    return bounds.groupBy("image_id").agg(*[pick(c, v) for c in RGB for v in ("lo", "hi")])


def _bounds_wide(pixels: DataFrame, fraction: float) -> DataFrame:
    return _wide(clip_bounds(histogram(pixels, skip_transparent=True).where("channel <> 'a'"), fraction))


def _levelled(pixels: DataFrame, wide: DataFrame) -> DataFrame:
    """Pixels or colours with each image's levels stretched, in columns m_r, m_g, m_b. An image without visible pixels keeps its values."""
    both = pixels.join(wide, "image_id", "left")
    stretched = {f"m_{c}": F.coalesce(_stretch(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")), F.col(c)) for c in RGB}
    return both.withColumns(stretched).drop(*[f"{v}_{c}" for c in RGB for v in ("lo", "hi")])


def auto_tone(pixels: DataFrame, fraction: float = 0.005) -> DataFrame:
    """Levels of each channel stretched between the clip bounds of the visible pixels; transparent pixels stay."""
    done = _levelled(pixels, _bounds_wide(pixels, fraction))
    return done.select("image_id", "x", "y", *[F.when(F.col("a") == 0, F.col(c)).otherwise(F.col(f"m_{c}")).alias(c) for c in RGB], "a")


# The share of pixels clipped at either end, the luminances of midtones, and the fewest of them.
CLIP, MID_LOW, MID_HIGH, MID_LEAST = 0.005, 0.3, 0.7, 5


def auto_color(pixels: DataFrame, fraction: float = CLIP, low: float = MID_LOW, high: float = MID_HIGH, least: int = MID_LEAST) -> DataFrame:
    """Levels stretched, then the mean cast of the midtones taken off in Lab, smoothly from `low` to `high` luminance.

    Midtones are visible pixels of middle luminance with no channel at an end; fewer than `least` leave the cast.
    """
    # the visible colours and their numbers: bounds and cast come from them, so pixels are read and levelled once
    seen = pixels.where("a <> 0").groupBy("image_id", *RGB).agg(F.count("*").alias("cnt"))
    parts = seen.select("image_id", "cnt", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("bin")) for c in RGB])).alias("v"))
    hist = parts.groupBy("image_id", "v.channel", "v.bin").agg(F.sum("cnt").alias("cnt"))
    wide = _wide(clip_bounds(hist, fraction))

    def lab_of(rows: DataFrame) -> DataFrame:
        m = [F.col(f"m_{c}") for c in RGB]
        lum = (m[0] * 0.2126 + m[1] * 0.7152 + m[2] * 0.0722) / 255.0
        lit = _levelled(rows, wide).withColumns({f"lin_{c}": color.to_linear(F.col(f"m_{c}") / 255.0) for c in RGB})
        light, a, b = color.linear_to_lab(*[F.col(f"lin_{c}") for c in RGB])
        return lit.withColumns({"lum": lum, "lab_l": light, "lab_a": a, "lab_b": b})

    m = [F.col(f"m_{c}") for c in RGB]
    mid = F.col("lum").between(low, high) & (F.least(*m) > 0) & (F.greatest(*m) < 255)
    sums = lab_of(seen).where(mid).groupBy("image_id").agg(F.sum(F.col("lab_a") * F.col("cnt")).alias("sum_a"), F.sum(F.col("lab_b") * F.col("cnt")).alias("sum_b"), F.sum("cnt").alias("n")).where(F.col("n") >= least)
    cast = sums.select("image_id", (F.col("sum_a") / F.col("n")).alias("mean_a"), (F.col("sum_b") / F.col("n")).alias("mean_b"))
    w = F.greatest(F.least((F.col("lum") - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    w = w * w * (3.0 - w * 2.0)
    off = lambda c: F.col(f"lab_{c}") - F.coalesce(F.col(f"mean_{c}"), F.lit(0.0)) * w
    both = lab_of(pixels).join(cast, "image_id", "left").withColumns({"new_a": off("a"), "new_b": off("b")})
    rgb = color.lab_to_rgb(F.col("lab_l"), F.col("new_a"), F.col("new_b"))
    return both.select("image_id", "x", "y", *[v.alias(c) for c, v in zip(RGB, rgb, strict=True)], "a")
