"""Per-pixel projections and predicates. Each takes a pixel table and returns one with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import color
from lumengrid.functions.color import Gradient
from lumengrid.functions.numeric import clamp, div32, f32, mul32, u8, u8_round
from lumengrid.plans.views import RGB


def _gray() -> Column:
    return f32(F.col("r")) * f32(0.299) + f32(F.col("g")) * f32(0.587) + f32(F.col("b")) * f32(0.114)


def map_rgb(pixels: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """A channel expression over r, g and b."""
    return pixels.withColumns({c: change(F.col(c)) for c in RGB})


def map_lut(pixels: DataFrame, table: Callable[[int], int], channels=RGB) -> DataFrame:
    """A Python function of a channel value, as a table of 256 entries."""
    values = F.array(*[F.lit(int(table(v))) for v in range(256)])
    return pixels.withColumns({c: F.element_at(values, F.col(c) + 1) for c in channels})


def set_pixel(pixels: DataFrame, x: int, y: int, rgba: tuple[int, int, int, int]) -> DataFrame:
    here = (F.col("x") == x) & (F.col("y") == y)
    return pixels.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in zip((*RGB, "a"), rgba, strict=True)})


def get_pixel(pixels: DataFrame, x: int, y: int) -> DataFrame:
    """The pixel at (x, y) of each image; no row where the image has none there."""
    return pixels.where((F.col("x") == x) & (F.col("y") == y))


def clear_color(pixels: DataFrame, rgba: tuple[int, int, int, int]) -> DataFrame:
    return pixels.withColumns({c: F.lit(v) for c, v in zip((*RGB, "a"), rgba, strict=True)})


def add(pixels: DataFrame, k: float) -> DataFrame:
    return map_rgb(pixels, lambda c: u8(f32(c) + f32(k)))


def sub(pixels: DataFrame, k: float) -> DataFrame:
    return map_rgb(pixels, lambda c: u8(f32(c) - f32(k)))


def mul(pixels: DataFrame, k: float) -> DataFrame:
    return map_rgb(pixels, lambda c: u8(f32(c) * f32(k)))


def div(pixels: DataFrame, k: float) -> DataFrame:
    return map_rgb(pixels, lambda c: u8(div32(f32(c), f32(k))))


#: Functions that move or leave out pixels; all others are projections that keep each pixel in its place.
MOVING = ("crop", "flip_horizontal", "flip_vertical", "get_pixel")


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels inside the rectangle, moved to the origin; the filter reaches the scan where x and y are stored."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def flip_horizontal(pixels: DataFrame, width: int | Column) -> DataFrame:
    return pixels.withColumn("x", F.lit(width) - 1 - F.col("x"))


def flip_vertical(pixels: DataFrame, height: int | Column) -> DataFrame:
    return pixels.withColumn("y", F.lit(height) - 1 - F.col("y"))


def opacity(pixels: DataFrame, k: float) -> DataFrame:
    return pixels.withColumn("a", u8(f32(F.col("a")) * f32(min(max(k, 0.0), 1.0))))


def invert(pixels: DataFrame) -> DataFrame:
    return map_rgb(pixels, lambda c: F.lit(255) - c)


def grayscale(pixels: DataFrame) -> DataFrame:
    gray = u8(_gray())
    return pixels.withColumns({c: gray for c in RGB})


def threshold(pixels: DataFrame, t: int) -> DataFrame:
    over = F.when(F.expr("(r + g + b) div 3") > t, 255).otherwise(0)
    return pixels.withColumns({c: over for c in RGB})


def posterize(pixels: DataFrame, levels: int) -> DataFrame:
    top = f32(float(min(max(levels, 2), 255) - 1))
    step = lambda c: F.round(div32(f32(c), f32(255.0)) * top)
    return map_rgb(pixels, lambda c: u8(div32(step(c).cast("float"), top) * f32(255.0)))


def gradient_map(pixels: DataFrame, gradient: Gradient) -> DataFrame:
    at = gradient.color_at(color.luminance(F.col("r"), F.col("g"), F.col("b")))
    return pixels.withColumns({c: at[c] for c in RGB})


def brightness(pixels: DataFrame, amount: int) -> DataFrame:
    factor = div32(f32(float(amount)), f32(100.0)) + f32(1.0)
    return map_rgb(pixels, lambda c: u8(f32(c) * factor))


def contrast(pixels: DataFrame, amount: float) -> DataFrame:
    """Applied to every pixel."""
    a = min(max(amount, -100.0), 100.0)
    factor = div32(f32(259.0) * f32(a + 255.0), f32(255.0) * f32(259.0 - a))
    return map_rgb(pixels, lambda c: u8(factor * (f32(c) - f32(128.0)) + f32(128.0)))


def exposure(pixels: DataFrame, exposure: float, offset: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """In linear light; double precision, within one level of single precision."""
    e, o, g = min(max(exposure, -20.0), 20.0), min(max(offset, -0.5), 0.5), min(max(gamma, 0.01), 9.99)

    def change(c: Column) -> Column:
        lit = F.greatest(F.pow(c / 255.0, F.lit(2.2)) * float(1.4**e) + o, F.lit(0.0))
        return u8_round(clamp(F.pow(F.pow(lit, F.lit(1.0 / g)), F.lit(1.0 / 2.2)), 0.0, 1.0) * 255.0)

    return map_rgb(pixels, change)


def saturation(pixels: DataFrame, amount: float) -> DataFrame:
    k = div32(f32(min(max(float(amount), -100.0), 100.0)), f32(100.0)) + f32(1.0)
    gray = _gray()
    return pixels.withColumns({c: u8(F.round(gray + (f32(F.col(c)) - gray) * k)) for c in RGB})


def vibrance(pixels: DataFrame, vibrance: float, saturation: float = 0.0) -> DataFrame:
    """Double precision, within one level of single precision."""
    unit = [F.col(c) / 255.0 for c in RGB]
    avg = (unit[0] + unit[1] + unit[2]) / 3.0
    factor = clamp((F.greatest(*unit) - avg) * 3.0, 0.0, 1.0) * (vibrance / 100.0) + 1.0
    vivid = [clamp((c - avg) * factor + avg, 0.0, 1.0) for c in unit]
    lum = vivid[0] * 0.2126 + vivid[1] * 0.7152 + vivid[2] * 0.0722
    return pixels.withColumns({c: u8_round(clamp(lum + (v - lum) * (1.0 + saturation / 100.0), 0.0, 1.0) * 255.0) for c, v in zip(RGB, vivid, strict=True)})


# Filter colours by name.
PHOTO_FILTERS = {
    "warming-dark": (255, 101, 0), "warming-light": (236, 138, 0), "cooling-dark": (0, 109, 255), "cooling-light": (0, 181, 255),
    "red": (234, 26, 26), "orange": (243, 132, 23), "yellow": (249, 227, 28), "green": (25, 201, 25), "cyan": (29, 203, 234),
    "blue": (29, 53, 234), "violet": (155, 29, 234), "magenta": (227, 24, 227), "sepia": (172, 122, 51), "deep-red": (255, 0, 0),
    "deep-blue": (0, 34, 205), "deep-emerald": (80, 141, 0), "deep-yellow": (255, 213, 0), "underwater": (0, 194, 177),
}


def _linear(v: int) -> float:
    c = v / 255.0
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def photo_filter_preset(pixels: DataFrame, preset: str, density: float) -> DataFrame:
    """A coloured gel: each channel is dimmed in linear light by the filter's colour."""
    d = min(max(density, 0.0), 1.0)
    gel = {c: (1.0 - d) + d * _linear(v) for c, v in zip(RGB, PHOTO_FILTERS[preset], strict=True)}
    return pixels.withColumns({c: u8_round(clamp(color.from_linear(color.to_linear(F.col(c) / 255.0) * gel[c]), 0.0, 1.0) * 255.0) for c in RGB})


def photo_filter(pixels: DataFrame, rgb: tuple[int, int, int], density: float) -> DataFrame:
    """Hue and saturation of a colour at the pixel's own lightness, mixed in linear light; half the saturation where a channel clips."""
    d = min(max(density, 0.0), 1.0)
    h, s, _ = color.rgb_to_hsl(*(F.lit(float(v)) for v in rgb))
    staged = pixels.withColumn("_l", color.rgb_to_hsl(*[F.col(c) for c in RGB])[2])
    for name, part in (("_f", s), ("_h", s * 0.5)):
        staged = staged.withColumns({f"{name}{c}": v for c, v in zip(RGB, color.hsl_to_rgb(h, part, F.col("_l")), strict=True)})
    clips = (F.least(*[F.col(f"_f{c}") for c in RGB]) == 0) | (F.greatest(*[F.col(f"_f{c}") for c in RGB]) == 255)
    staged = staged.withColumns({f"_t{c}": F.when(clips, F.col(f"_h{c}")).otherwise(F.col(f"_f{c}")) for c in RGB})
    staged = staged.withColumns({f"_m{c}": color.to_linear(F.col(c) / 255.0) * (1.0 - d) + color.to_linear(F.col(f"_t{c}") / 255.0) * d for c in RGB})
    return staged.withColumns({c: u8_round(clamp(color.from_linear(F.col(f"_m{c}")), 0.0, 1.0) * 255.0) for c in RGB}).select(pixels.columns)


# Multipliers of the noise's mix, and what sets its second word apart.
MIX_X, MIX_Y, MIX_W, MIX_OUT = 374761393, 668265263, 2246822519, 1274126177
OTHER_X, OTHER_Y, OTHER_W = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def mixed32(u: Column, v: Column, w: int) -> Column:
    """Three 32-bit words stirred into one, as a long."""
    x = mul32(u, MIX_X).bitwiseXOR(mul32(v, MIX_Y)).bitwiseXOR(F.lit(w * MIX_W & 0xFFFFFFFF))
    x = mul32(x.bitwiseXOR(F.shiftright(x, 13)), MIX_OUT)
    return x.bitwiseXOR(F.shiftright(x, 16))


def noise(pixels: DataFrame, amount: float, gaussian: bool = False) -> DataFrame:
    """The same noise for the same (x, y), uniform or normal."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    one = mixed32(x, y, 0) / 4294967295.0
    if gaussian:
        two = mixed32(x.bitwiseXOR(F.lit(OTHER_X)), y.bitwiseXOR(F.lit(OTHER_Y)), OTHER_W) / 4294967295.0
        n = F.sqrt(F.log(F.greatest(one, F.lit(1e-7))) * -2.0) * F.cos(two * 6.283185307179586)
    else:
        n = one * 2.0 - 1.0
    return map_rgb(pixels, lambda c: u8(c + n * amount * 3.0))


def rotate_hue(pixels: DataFrame, degrees: float) -> DataFrame:
    """An extension: the hue turned by an angle."""
    h, s, light = color.rgb_to_hsl(*[F.col(c) for c in RGB])
    turned = (h + (degrees % 360.0)) % 360.0
    return pixels.withColumns(dict(zip(RGB, color.hsl_to_rgb(turned, s, light), strict=True)))


def copy_channel(pixels: DataFrame, source: DataFrame, of: str, to: str) -> DataFrame:
    """A channel of another image of the same size put in the place of one of these; absent pixels keep theirs."""
    other = source.select("image_id", "x", "y", F.col(of).alias("_from"))
    both = pixels.join(other, ["image_id", "x", "y"], "left")
    return both.withColumn(to, F.coalesce("_from", F.col(to))).select(pixels.columns)
