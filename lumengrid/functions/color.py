"""Colour as columns: conversions, named colours, gradients. Hue in degrees; s, l, v in 0..1."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumengrid.functions.numeric import clamp, u8, u8_round

# Colours by name as (r, g, b, a).
NAMED = {
    "transparent": (0, 0, 0, 0), "black": (0, 0, 0, 255), "red": (255, 0, 0, 255), "crimson": (220, 20, 60, 255), "ruby": (224, 17, 95, 255), "pink": (255, 192, 203, 255),
    "magenta": (255, 0, 255, 255), "hot_pink": (255, 105, 180, 255), "green": (0, 255, 0, 255), "lime_green": (50, 205, 50, 255), "sea_green": (46, 139, 87, 255),
    "forest_green": (34, 139, 34, 255), "blue": (0, 0, 255, 255), "royal_blue": (65, 105, 225, 255), "sky_blue": (135, 206, 235, 255), "navy_blue": (0, 0, 128, 255),
    "yellow": (255, 255, 0, 255), "orange": (255, 127, 0, 255), "indigo": (75, 0, 130, 255), "violet": (148, 0, 211, 255), "white": (255, 255, 255, 255), "gray": (128, 128, 128, 255),
}


def hex_color(text: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as a struct; a pair that is not hexadecimal is 0, another length is opaque black."""
    body = F.regexp_replace(text, "^#", "")
    pair = lambda k: F.when(F.substring(body, 2 * k + 1, 2).rlike("^[0-9a-fA-F]{2}$"), F.conv(F.substring(body, 2 * k + 1, 2), 16, 10).cast("int")).otherwise(0)
    known = F.length(body).isin(6, 8)
    rgb = [F.when(known, pair(k)).otherwise(0) for k in range(3)]
    return F.struct(*[v.alias(c) for v, c in zip(rgb, "rgb", strict=True)], F.when(F.length(body) == 8, pair(3)).otherwise(255).alias("a"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.299 + g * 0.587 + b * 0.114) / 255.0


def contrast_ratio(one: Column, other: Column) -> Column:
    """Of two luminances."""
    return (F.greatest(one, other) + 0.05) / (F.least(one, other) + 0.05)


def _hue(r: Column, g: Column, b: Column, top: Column, d: Column) -> Column:
    sector = F.when(top == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return F.when(d == 0, 0.0).otherwise(sector * 60.0)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channels 0..255 to (h, s, l)."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2.0
    safe = F.when(d == 0, 1.0).otherwise(d)
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (2.0 - top - low)).otherwise(d / F.when(top + low == 0, 1.0).otherwise(top + low))
    return F.when(d == 0, 0.0).otherwise(_hue(r, g, b, top, safe)), s, light


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d == 0, 1.0).otherwise(d)
    return F.when(d == 0, 0.0).otherwise(_hue(r, g, b, top, safe)), F.when(top == 0, 0.0).otherwise(d / F.when(top == 0, 1.0).otherwise(top)), top


def _sector(h: Column, c: Column, x: Column, m: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    of = lambda *v: F.when(h < 60, v[0]).when(h < 120, v[1]).when(h < 180, v[2]).when(h < 240, v[3]).when(h < 300, v[4]).otherwise(v[5])
    parts = of(c, x, zero, zero, x, c), of(x, c, c, x, zero, zero), of(zero, zero, x, c, c, x)
    return tuple(u8_round((p + m) * 255.0) for p in parts)


def _chroma(h: Column, c: Column) -> Column:
    return c * (1.0 - F.abs(h / 60.0 % 2.0 - 1.0))


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    c = (1.0 - F.abs(light * 2.0 - 1.0)) * s
    return _sector(h, c, _chroma(h, c), light - c / 2.0)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    c = v * s
    return _sector(h, c, _chroma(h, c), v - c)


def hsv_to_hsl(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    light = v * (1.0 - s / 2.0)
    room = F.least(light, 1.0 - light)
    return h, F.when(room == 0, 0.0).otherwise((v - light) / F.when(room == 0, 1.0).otherwise(room)), light


def hsl_to_hsv(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    v = light + s * F.least(light, 1.0 - light)
    return h, F.when(v == 0, 0.0).otherwise(2.0 * (1.0 - light / F.when(v == 0, 1.0).otherwise(v))), v


def to_linear(c: Column) -> Column:
    """An sRGB channel 0..1 in linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    safe = F.greatest(c, F.lit(0.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(safe, F.lit(1.0 / 2.4)) * 1.055 - 0.055)


# sRGB primaries under D65, and the white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return linear_to_lab(*[to_linear(c / 255.0) for c in (r, g, b)])


def linear_to_lab(*lin: Column) -> tuple[Column, Column, Column]:
    """Lab from linear light; give it plain columns where the plan goes on, since each is used often."""
    t = [sum((lin[i] * k for i, k in enumerate(row)), F.lit(0.0)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    fx, fy, fz = (F.when(v > EPSILON, F.pow(F.greatest(v, F.lit(0.0)), F.lit(1.0 / 3.0))).otherwise((v * KAPPA + 16.0) / 116.0) for v in t)
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def lab_to_rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    fy = (light + 16.0) / 116.0
    fx, fz = a / 500.0 + fy, fy - b / 200.0
    cube = lambda f: F.when(f > EPSILON ** (1 / 3), f * f * f).otherwise((f * 116.0 - 16.0) / KAPPA)
    y = F.when(light > KAPPA * EPSILON, fy * fy * fy).otherwise(light / KAPPA)
    xyz = [cube(fx) * WHITE[0], y * WHITE[1], cube(fz) * WHITE[2]]
    return tuple(u8_round(clamp(from_linear(sum((xyz[i] * k for i, k in enumerate(row)), F.lit(0.0))), 0.0, 1.0) * 255.0) for row in FROM_XYZ)


def _once(columns: tuple, change) -> tuple[Column, Column, Column]:
    """A conversion of whole channels that are made once: a lambda's variable stands for them wherever it needs them."""
    packed = F.array(F.struct(*[c.alias(k) for k, c in zip("uvw", columns, strict=True)]))
    made = F.transform(packed, lambda p: F.struct(*[v.alias(k) for k, v in zip("uvw", change(p["u"], p["v"], p["w"]), strict=True)]))[0]
    return made["u"], made["v"], made["w"]


def hsl_to_lab(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    """By way of whole RGB channels, as the other mixed conversions."""
    return _once(hsl_to_rgb(h, s, light), rgb_to_lab)


def hsv_to_lab(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    return _once(hsv_to_rgb(h, s, v), rgb_to_lab)


def lab_to_hsl(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return _once(lab_to_rgb(light, a, b), rgb_to_hsl)


def lab_to_hsv(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return _once(lab_to_rgb(light, a, b), rgb_to_hsv)


def random_color(seed: int) -> tuple[Column, Column, Column]:
    """Channels drawn anew for each row from a seed."""
    return tuple(F.floor(F.rand(seed + k) * 256).cast("int") for k in range(3))


@dataclass(frozen=True)
class Gradient:
    """Colour stops ((r, g, b, a), time) in order of time."""

    stops: tuple = field(default_factory=tuple)
    #: The path along which a fill runs; None is from left to right.
    direction: object = None

    def with_direction(self, path) -> Gradient:
        return replace(self, direction=path)

    @classmethod
    def evenly(cls, *colors):
        last = max(len(colors) - 1, 1)
        return cls(tuple((c, i / last) for i, c in enumerate(colors)))

    @classmethod
    def from_to(cls, one, other):
        return cls.evenly(one, other)

    @classmethod
    def to_black(cls, one):
        return cls.evenly(one, NAMED["black"])

    @classmethod
    def to_white(cls, one):
        return cls.evenly(one, NAMED["white"])

    @classmethod
    def rainbow(cls):
        return cls.evenly(*(NAMED[n] for n in ("red", "orange", "yellow", "green", "blue", "indigo", "violet")))

    @classmethod
    def hue(cls):
        """Full hues from 360 degrees down to 0."""
        return cls.evenly(*(NAMED[n] for n in ("red", "magenta", "blue")), (0, 255, 255, 255), *(NAMED[n] for n in ("green", "yellow", "red")))

    def reverse(self) -> Gradient:
        last = max((t for _, t in self.stops), default=0.0)
        return Gradient(tuple((c, last - t) for c, t in reversed(self.stops)), self.direction)

    def color_at(self, time: Column) -> dict[str, Column]:
        """The channels at a time: between stops in proportion, truncated; clear black before the first, the last after it."""
        out = {}
        for k, channel in enumerate("rgba"):
            value = F.when(time < self.stops[0][1], F.lit(0)) if self.stops else F.when(F.lit(False), F.lit(0))
            for (c0, t0), (c1, t1) in zip(self.stops, self.stops[1:], strict=False):
                share = (time - t0) / (t1 - t0) if t1 > t0 else F.lit(0.0)
                value = value.when(time < t1, u8(F.lit(float(c0[k])) + share * float(c1[k] - c0[k])))
            out[channel] = value.otherwise(F.lit(self.stops[-1][0][k] if self.stops else 0))
        return out
