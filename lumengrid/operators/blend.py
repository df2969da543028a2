"""Blend modes as column expressions, and the pixel-aligned joins that apply them.

In a mode, a is the bottom pixel and b the top one, each a dict of r, g, b, a columns 0..255. `tables` and the functions `_rows` are
for pixels in NumPy arrays: same results, in the same precision and order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.functions import color
from lumengrid.functions.numeric import clamp, div32, f32, idiv, u8
from lumengrid.plans.views import CHANNELS, KEY, RGB

Pixel = dict[str, Column]
Mode = Callable[[Pixel, Pixel], Pixel]


def _each(change: Callable[[Column, Column], Column]) -> Mode:
    """A mode that treats all four channels alike."""

    def mode(a: Pixel, b: Pixel) -> Pixel:
        return {c: change(a[c], b[c]).cast("int") for c in CHANNELS}

    mode.alike = CHANNELS
    return mode


def _rgb(change: Callable[[Column, Column], Column]) -> Mode:
    """A mode over r, g and b that keeps the bottom's alpha."""

    def mode(a: Pixel, b: Pixel) -> Pixel:
        return {c: change(a[c], b[c]).cast("int") for c in RGB} | {"a": a["a"]}

    mode.alike = RGB
    return mode


def _safe(b: Column, bad: int) -> Column:
    return F.when(b == bad, 1 if bad == 0 else 0).otherwise(b)


def _normal(a: Pixel, b: Pixel) -> Pixel:
    unit = lambda v: div32(f32(v), f32(255.0))
    under = unit(a["a"]) * (f32(1.0) - unit(b["a"]))
    over = {c: u8((unit(b[c]) * unit(b["a"]) + unit(a[c]) * unit(a["a"]) * (f32(1.0) - unit(b["a"]))) * f32(255.0)) for c in RGB}
    return over | {"a": u8((unit(b["a"]) + under) * f32(255.0))}


def _burn(a: Column, b: Column) -> Column:
    part = div32(f32(F.lit(255) - a) * f32(255.0), f32(_safe(b, 0)))
    return F.when(b == 0, 0).otherwise(u8(f32(255.0) - part))


def _dodge(a: Column, b: Column) -> Column:
    part = div32(f32(a) * f32(255.0), f32(255.0) - f32(_safe(b, 255)))
    return F.when(b == 255, 255).otherwise(u8(part))


def _double(b: Column) -> Column:
    return F.least(b * 2, F.lit(255))


def _double_above(b: Column) -> Column:
    return F.greatest((b - 128) * 2, F.lit(0))


def _vivid(a: Column, b: Column) -> Column:
    return F.when(b < 128, _burn(a, _double(b))).otherwise(_dodge(a, _double_above(b)))


def _hard(a: Column, b: Column) -> Column:
    dark = div32(f32(2.0) * f32(a) * f32(b), f32(255.0))
    light = f32(255.0) - div32(f32(2.0) * (f32(255.0) - f32(a)) * (f32(255.0) - f32(b)), f32(255.0))
    return F.when(b < 128, dark).otherwise(light)


def _overlay(a: Column, b: Column) -> Column:
    dark = div32(f32(2.0) * f32(a) * f32(b), f32(255.0))
    light = f32(255.0) - div32(f32(2.0) * (f32(255.0) - f32(a)) * (f32(255.0) - f32(b)), f32(255.0))
    return u8(F.round(F.when(a < 128, dark).otherwise(light)))


def _glow(a: Column, b: Column) -> Column:
    return F.when(a == 255, 255).otherwise(u8(div32(f32(b) * f32(b), f32(255.0) - f32(_safe(a, 255)))))


def _reflect(a: Column, b: Column) -> Column:
    return _glow(b, a)


def _divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0).otherwise(u8(F.round(div32(f32(a), f32(_safe(b, 0))) * f32(255.0))))


def _pick(lighter: bool) -> Mode:
    def mode(a: Pixel, b: Pixel) -> Pixel:
        la, lb = (F.greatest(*[p[c] for c in RGB]) + F.least(*[p[c] for c in RGB]) for p in (a, b))  # lightness times 510
        bottom = la > lb if lighter else la < lb
        return {c: F.when(bottom, a[c]).otherwise(b[c]) for c in CHANNELS}

    return mode


def _hsl(h: str, s: str, light: str) -> Mode:
    """Hue, saturation and lightness from "a" or "b"."""

    def mode(a: Pixel, b: Pixel) -> Pixel:
        own = {"a": color.rgb_to_hsl(*[a[c] for c in RGB]), "b": color.rgb_to_hsl(*[b[c] for c in RGB])}
        return dict(zip(RGB, color.hsl_to_rgb(own[h][0], own[s][1], own[light][2]), strict=True)) | {"a": a["a"]}

    return mode


MODES: dict[str, Mode] = {
    "normal": _normal,
    "darken": _each(F.least),
    "darker-color": _pick(False),
    "average": _each(lambda a, b: idiv(a + b, 2)),
    "multiply": _each(lambda a, b: idiv(a * b, 255)),
    "color-burn": _each(_burn),
    "linear-burn": _each(lambda a, b: F.greatest(a + b - 255, F.lit(0))),
    "lighten": _each(F.greatest),
    "lighter-color": _pick(True),
    "screen": _each(lambda a, b: F.lit(255) - idiv((F.lit(255) - a) * (F.lit(255) - b), 255)),
    "color-dodge": _each(_dodge),
    "linear-dodge": _each(lambda a, b: F.least(a + b, F.lit(255))),
    "overlay": _each(_overlay),
    "soft-light": _each(lambda a, b: u8(_hard(a, b) * f32(0.5) + f32(a) * f32(0.5))),
    "hard-light": _each(lambda a, b: u8(_hard(a, b))),
    "vivid-light": _each(_vivid),
    "linear-light": _each(lambda a, b: F.when(b < 128, F.greatest(a + _double(b) - 255, F.lit(0))).otherwise(F.least(a + _double_above(b), F.lit(255)))),
    "pin-light": _each(lambda a, b: F.when(b < 128, F.least(a, b)).otherwise(F.greatest(a, b))),
    "hard-mix": _each(lambda a, b: F.when(_vivid(a, b) < 128, 0).otherwise(255)),
    "difference": _rgb(lambda a, b: F.abs(a - b)),
    "exclusion": _rgb(lambda a, b: a + b - idiv(a * b * 2, 255)),
    "subtract": _rgb(lambda a, b: F.greatest(a - b, F.lit(0))),
    "divide": _rgb(_divide),
    "hue": _hsl("b", "a", "a"),
    "saturation": _hsl("a", "b", "a"),
    "color": _hsl("b", "b", "a"),
    "luminosity": _hsl("a", "a", "b"),
    "reflect": _each(_reflect),
    "glow": _each(_glow),
    "phoenix": _rgb(lambda a, b: u8(f32(a) + f32(b) - div32(f32(2.0) * f32(a) * f32(b), f32(255.0)))),
    "negation": _rgb(lambda a, b: F.lit(255) - F.abs(a - b)),
    "grain-extract": _rgb(lambda a, b: clamp(idiv(a + b - 255, 2) + 128, 0, 255)),
    "grain-merge": _rgb(lambda a, b: clamp(idiv(a + b - 128, 2), 0, 255)),
}


def mode(name: str) -> Mode:
    """A mode by its name; an unknown name is normal."""
    return MODES.get(name, _normal)


def tables(spark: SparkSession, names: list[str]) -> dict[str, tuple[int, np.ndarray]]:
    """For modes that make each channel of its own two values: how many channels they make, and the result at 256 * bottom + top, by their expressions."""
    names = [name for name in names if hasattr(mode(name), "alike")]
    if not names:
        return {}
    a, b = F.expr("CAST(id div 256 AS INT)"), F.expr("CAST(id % 256 AS INT)")
    made = [mode(name)(dict.fromkeys(CHANNELS, a), dict.fromkeys(CHANNELS, b))["r"].alias(str(i)) for i, name in enumerate(names)]
    rows = spark.range(1 << 16).select("id", *made).toArrow()
    order = np.argsort(rows.column("id").to_numpy())
    return {name: (len(mode(name).alike), rows.column(str(i)).to_numpy()[order].astype(np.uint8)) for i, name in enumerate(names)}


#: The single precision 255ths of whole numbers.
UNIT = np.arange(256, dtype=np.float32) / np.float32(255)


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def normal_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normal mode for rows of four channels."""
    one, whole = np.float32(1), np.float32(255)
    ua, ub = UNIT[a], UNIT[b]
    rest = one - ub[:, 3:]
    rgb = (ub[:, :3] * ub[:, 3:] + ua[:, :3] * ua[:, 3:] * rest) * whole
    return _byte(np.concatenate([rgb, (ub[:, 3:] + ua[:, 3:] * rest) * whole], axis=1))


def source_over_rows(a: np.ndarray, b: np.ndarray, opacity: np.ndarray) -> np.ndarray:
    """Rows of b with their alpha times `opacity` over those of a, as `source_over` has it."""
    one, whole = np.float32(1), np.float32(255)
    top, under = UNIT[_byte(b[:, 3] * opacity.astype(np.float32))][:, None], UNIT[a[:, 3:]]
    out = top + under * (one - top)
    rgb = (UNIT[b[:, :3]] * top + UNIT[a[:, :3]] * under * (one - top)) / np.where(out > 0, out, one) * whole
    return _byte(np.concatenate([np.where(out > 0, rgb, np.float32(0)), out * whole], axis=1))


def _pair(bottom: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """Each bottom pixel with the top pixel shifted onto it, if any; both sides hash on the pixel's place."""
    moved = top.select(F.col("image_id"), (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
    return bottom.select(*KEY, *CHANNELS).join(moved, list(KEY), "left")


def _sides() -> tuple[Pixel, Pixel]:
    return {c: F.col(c) for c in CHANNELS}, {c: F.col(f"t_{c}") for c in CHANNELS}


def blend(bottom: DataFrame, top: DataFrame, name: str = "normal", x: int = 0, y: int = 0) -> DataFrame:
    """`top` at (x, y) over `bottom` by a mode; bottom pixels without a partner stay."""
    a, b = _sides()
    mixed = mode(name)(a, b)
    return _pair(bottom, top, x, y).select(*KEY, *[F.when(b["a"].isNull(), a[c]).otherwise(mixed[c]).alias(c) for c in CHANNELS])


def source_over(a: Pixel, b: Pixel, alpha: Column) -> Pixel:
    """b with its alpha replaced, over a; straight alpha, truncated."""
    unit = lambda v: div32(f32(v), f32(255.0))
    top, under = unit(alpha), unit(a["a"])
    out = top + under * (f32(1.0) - top)
    safe = F.when(out > 0, out).otherwise(f32(1.0))
    mixed = {c: F.when(out > 0, u8(div32(unit(b[c]) * top + unit(a[c]) * under * (f32(1.0) - top), safe) * f32(255.0))).otherwise(0) for c in RGB}
    return mixed | {"a": u8(out * f32(255.0))}


def with_opacity(a: Pixel, b: Pixel, name: str, opacity: Column) -> Pixel:
    """The mode's result, its alpha scaled, composited over the bottom once more."""
    mixed = mode(name)(a, b)
    return source_over(a, mixed, u8(f32(mixed["a"]) * opacity))


def blend_opacity(bottom: DataFrame, top: DataFrame, name: str, opacity: float, x: int = 0, y: int = 0) -> DataFrame:
    """`top` at (x, y) over `bottom` by a mode and an opacity. The mode's result and its alpha are columns of their own, made once."""
    a, b = _sides()
    mixed = mode(name)(a, b)
    rows = _pair(bottom, top, x, y).withColumns({f"m_{c}": mixed[c] for c in CHANNELS})
    rows = rows.withColumn("m_alpha", u8(f32(F.col("m_a")) * f32(min(max(opacity, 0.0), 1.0))))
    over = source_over(a, {c: F.col(f"m_{c}") for c in CHANNELS}, F.col("m_alpha"))
    return rows.select(*KEY, *[F.when(b["a"].isNull(), a[c]).otherwise(over[c]).alias(c) for c in CHANNELS])


def draw_at(bottom: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """`top` copied over `bottom`, without blending; what falls outside is clipped."""
    return _pair(bottom, top, x, y).select(*KEY, *[F.coalesce(F.col(f"t_{c}"), F.col(c)).alias(c) for c in CHANNELS])


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """The grey of a mask pixel, in whole numbers."""
    return idiv(r * 299 + g * 587 + b * 114 + 500, 1000).cast("int")


def apply_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha becomes the mask's grey where the mask has a pixel."""
    grey = mask.select(*KEY, gray_of(*[F.col(c) for c in RGB]).alias("m"))
    return pixels.join(grey, list(KEY), "left").select(*KEY, *RGB, F.coalesce("m", "a").alias("a"))


def lerp(original: DataFrame, processed: DataFrame, weight: DataFrame) -> DataFrame:
    """processed * w + original * (1 - w), truncated, where `weight` (image_id, x, y, w) has a positive w."""
    new = processed.select(*KEY, *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
    both = original.join(new, list(KEY), "left").join(weight.where("w > 0").select(*KEY, f32(F.col("w")).alias("w")), list(KEY), "left")
    w = F.col("w")
    mix = lambda c: F.when(w.isNull() | F.col(f"t_{c}").isNull(), F.col(c)).otherwise(u8(f32(F.col(f"t_{c}")) * w + f32(F.col(c)) * (f32(1.0) - w)))
    return both.select(*KEY, *[mix(c).alias(c) for c in CHANNELS])
