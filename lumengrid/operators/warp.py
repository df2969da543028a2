"""Resampling and geometric transforms: a target grid that gathers from the source.

Nearest resizing is an equi-join of the target grid with the source. Everything else runs on tiles of the target, to which the
source pixels go that a sample in the tile can reach: by the forward map of a pixel for resizing, affine maps (turns among them)
and radial ones, by a bound of the displacement for waves. No task holds an image whole.
Samples outside the image are transparent; colours are weighted by alpha, and results are rounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.numeric import f32
from lumengrid.operators import raster
from lumengrid.plans.views import CHANNELS, KEY, sizes

ALGORITHMS = ("nearest", "bilinear", "bicubic", "lanczos", "edge-nedi", "edge-edi", "auto")
# The waves' length by size.
RIPPLE_LENGTH = {"small": 50.0, "medium": 30.0, "large": 15.0}


def choose(algorithm: str | None, width: int, height: int, new_width: int, new_height: int) -> str:
    """The sampler for a change of size; "auto" and None go by how the sides change."""
    if algorithm not in (None, "auto"):
        return algorithm
    if new_width < width // 2 or new_height < height // 2:
        return "lanczos"
    if new_width > width or new_height > height:
        return "bicubic"
    return "bilinear" if new_width < width or new_height < height else "bicubic"


def resize_nearest(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Each target pixel takes the source pixel at trunc(x / width * (source width - 1)).

    A source pixel goes to the target pixels that take it, so only the images' sizes are joined: a hash of them, nothing is sorted.
    """
    rows = pixels.join(sizes(pixels).hint("shuffle_hash"), "image_id")
    for c, t, n, size in (("x", "tx", width, F.col("width")), ("y", "ty", height, F.col("height"))):
        step = F.when(size > 1, n / F.greatest(size - 1, F.lit(1))).otherwise(float(n))
        first = F.greatest(F.floor(F.col(c) * step).cast("int") - 1, F.lit(0))
        last = F.least(F.ceil((F.col(c) + 1) * step).cast("int") + 1, F.lit(n - 1))
        rows = rows.withColumn(t, F.explode(F.when(first <= last, F.sequence(first, last)))).where(F.floor(F.col(t) / float(n) * (size - 1)) == F.col(c))
    return rows.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *CHANNELS)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Its outer lobe is positive, other than that of the usual cubic kernel."""
    t = np.abs(t)
    return np.where(t < 1, (t - 2) * t * t + 1, np.where(t < 2, ((t - 5) * t + 8) * t - 4, 0.0))


def _lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


KERNELS = {"bilinear": (1, lambda t: np.maximum(1 - np.abs(t), 0)), "bicubic": (2, _cubic), "lanczos": (3, _lanczos)}


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, algorithm: str) -> np.ndarray:
    """Values at places, weighted by alpha; what lies outside is transparent."""
    h, w = image.shape[:2]
    if algorithm == "nearest":
        xi, yi = np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int)
        inside = (xi >= 0) & (yi >= 0) & (xi < w) & (yi < h)
        return np.where(inside[..., None], image[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)], 0)
    if algorithm.startswith("edge-"):
        return _edge_sample(image, x, y, algorithm)
    reach, kernel = KERNELS[algorithm]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    total, alpha, norm = np.zeros((*x.shape, 3)), np.zeros(x.shape), np.zeros(x.shape)
    for j in range(1 - reach, reach + 1):
        for i in range(1 - reach, reach + 1):
            xi, yi = x0 + i, y0 + j
            weight = kernel(x - xi) * kernel(y - yi)
            inside = (xi >= 0) & (yi >= 0) & (xi < w) & (yi < h)
            got = image[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
            a = np.where(inside, got[..., 3], 0) * weight
            norm += weight
            alpha += a
            total += got[..., :3] * a[..., None]
    safe = np.where(np.abs(alpha) < 1e-6, 1, alpha)
    rgb = np.where(np.abs(alpha)[..., None] < 1e-6, 0, total / safe[..., None])
    return np.floor(np.clip(np.concatenate([rgb, (alpha / np.where(np.abs(norm) < 1e-6, 1, norm))[..., None]], axis=-1), 0, 255) + 0.5)


def _premultiplied(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Colours times alpha, and alpha in 0..1, of whole places; nothing outside."""
    h, w = image.shape[:2]
    inside = (x >= 0) & (y >= 0) & (x < w) & (y < h)
    got = np.where(inside[..., None], image[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 0).astype(np.float64)
    alpha = got[..., 3:] / 255
    return np.concatenate([got[..., :3] * alpha, alpha], axis=-1)


def _bytes(mixed: np.ndarray) -> np.ndarray:
    """Premultiplied sums as rounded straight channels; colours of what is clear are black."""
    alpha = mixed[..., 3:]
    rgb = np.where(alpha > 0, mixed[..., :3] / np.where(alpha > 0, alpha, 1), 0)
    return np.floor(np.clip(np.concatenate([rgb, alpha * 255], axis=-1), 0, 255) + 0.5)


def _linear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    row = lambda dy: _premultiplied(image, x0, y0 + dy) * (1 - fx) + _premultiplied(image, x0 + 1, y0 + dy) * fx
    return row(0) * (1 - fy) + row(1) * fy


def _luma_around(image: np.ndarray, margin: int) -> np.ndarray:
    """Brightness of the visible pixels with a margin of 0 around them, where clear pixels count 0 too."""
    luma = np.where(image[..., 3] > 0, image[..., :3] @ np.array([0.299, 0.587, 0.114]), 0.0)
    return np.pad(luma, margin)


def _edges_by_covariance(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ux, uy, strength, margin) at each pixel and `margin` around: the main axis of the gradients of 5 x 5 pixels, and their spread."""
    margin = 3
    luma = _luma_around(image, margin + 3)
    gx, gy = (luma[1:-1, 2:] - luma[1:-1, :-2]) / 2, (luma[2:, 1:-1] - luma[:-2, 1:-1]) / 2
    near = lambda v: np.lib.stride_tricks.sliding_window_view(v, (5, 5)).mean(axis=(2, 3))
    mean_x, mean_y = near(gx), near(gy)
    a, b, c = near(gx * gx) - mean_x**2, near(gx * gy) - mean_x * mean_y, near(gy * gy) - mean_y**2
    top = (a + c) / 2 + np.sqrt(np.maximum((a + c) ** 2 / 4 - (a * c - b * b), 0))
    vx, vy = top - c, b
    norm = np.hypot(vx, vy)
    turned = np.abs(b) > 1e-6
    ux = np.where(turned & (norm > 0), vx / np.where(norm > 0, norm, 1), np.where(~turned & (c - a > 1e-6), 0.0, 1.0))
    uy = np.where(turned & (norm > 0), vy / np.where(norm > 0, norm, 1), np.where(~turned & (c - a > 1e-6), 1.0, 0.0))
    return ux, uy, np.sqrt(np.maximum(a + c, 0)), margin


def _edges_by_sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(direction 0..3, magnitude, margin): the gradient's angle in eighths of a turn, opposite ones alike."""
    margin = 3
    luma = _luma_around(image, margin + 1)
    part = lambda dy, dx: luma[1 + dy : luma.shape[0] - 1 + dy, 1 + dx : luma.shape[1] - 1 + dx]
    gx = part(-1, 1) + 2 * part(0, 1) + part(1, 1) - part(-1, -1) - 2 * part(0, -1) - part(1, -1)
    gy = part(1, -1) + 2 * part(1, 0) + part(1, 1) - part(-1, -1) - 2 * part(-1, 0) - part(-1, 1)
    angle = np.arctan2(gy, gx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    return np.floor(angle / np.pi * 4 + 0.5).astype(int) % 4, np.hypot(gx, gy), margin


# Strengths from which an edge counts.
STRONG = {"edge-nedi": 5.0, "edge-edi": 10.0}


def _edge_sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, algorithm: str) -> np.ndarray:
    """Two samples along the local edge where it is strong, a smooth sampler elsewhere."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    at = lambda v, margin: v[np.clip(y0, -margin, h - 1 + margin) + margin, np.clip(x0, -margin, w - 1 + margin) + margin]
    if algorithm == "edge-nedi":
        ux, uy, strength, margin = _edges_by_covariance(image)
        ux, uy, strength = at(ux, margin), at(uy, margin), at(strength, margin)
        share = ((fx * ux + fy * uy + 1) / 2)[..., None]
        along = _linear(image, x0 - ux, y0 - uy) * (1 - share) + _linear(image, x0 + ux, y0 + uy) * share
        return np.where((strength > STRONG["edge-nedi"])[..., None], _bytes(along), sample(image, x, y, "bicubic"))
    direction, strength, margin = _edges_by_sobel(image)
    direction, strength = at(direction, margin), at(strength, margin)
    one = _premultiplied(image, x0 + (direction == 3), y0)
    other = _premultiplied(image, x0 + ((direction == 0) | (direction == 1)), y0 + (direction != 0))
    share = np.where(direction == 0, fx, np.where(direction == 2, fy, (fx + fy) / 2))[..., None]
    return np.where((strength > STRONG["edge-edi"])[..., None], _bytes(one * (1 - share) + other * share), _bytes(_linear(image, x, y)))


#: How many pixels around a place its sample can see.
REACH = {"bilinear": 1, "bicubic": 2, "lanczos": 3, "edge-nedi": 5, "edge-edi": 4, "nearest": 1}


@dataclass(frozen=True)
class Window:
    """The part of an image that a target tile needs, and where it lies."""

    image: np.ndarray
    x: int
    y: int

    def sampled(self, x: np.ndarray, y: np.ndarray, algorithm: str) -> np.ndarray:
        return sample(self.image, x - self.x, y - self.y, algorithm)

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The pixels at whole places; places beyond the window give its nearest pixel."""
        h, w = self.image.shape[:2]
        return self.image[np.clip(y - self.y, 0, h - 1).astype(int), np.clip(x - self.x, 0, w - 1).astype(int)]


def _reach(algorithm: str | None) -> int:
    return max(REACH.values()) if algorithm in (None, "auto") else REACH[algorithm]


def gathered(pixels: DataFrame, images: DataFrame, spot: tuple[Column, Column, Column, Column], make: Callable[[Window, np.ndarray, np.ndarray, dict], np.ndarray]) -> DataFrame:
    """New images, tile by tile of the target.

    `images` has a row for each image: image_id, out_w, out_h (the target's size) and whatever `spot` and `make` need. `spot`
    says by a pixel's columns and its image's in which rectangle (low x, high x, low y, high y) of the target samples may see
    it; the pixel goes to the tiles there. `make` (window, x, y, image's columns) gives the tile's values at x, y. Tiles that
    no pixel goes to are made too.
    """
    side, kind = raster.TILE, pixels.schema["image_id"].dataType.simpleString()
    own = [c for c in images.columns if c != "image_id"]

    def among(low: Column, high: Column, target: str) -> Column:
        """The numbers of the tiles of a side between two places, if any."""
        last = F.floor((F.col(target) - 1) / side)
        first, stop = F.greatest(F.floor(low / side), F.lit(0)), F.least(F.floor(high / side), last)
        return F.explode(F.when(first <= stop, F.sequence(first, stop)))

    here = pixels.select(*KEY, *CHANNELS).join(images, "image_id")
    here = here.withColumns({"low_x": spot[0], "high_x": spot[1], "low_y": spot[2], "high_y": spot[3]})
    here = here.withColumn("tile_x", among(F.col("low_x"), F.col("high_x"), "out_w")).withColumn("tile_y", among(F.col("low_y"), F.col("high_y"), "out_h"))
    every = images.withColumn("tile_x", among(F.lit(0), F.col("out_w") - 1, "out_w")).withColumn("tile_y", among(F.lit(0), F.col("out_h") - 1, "out_h"))
    nothing = {c: F.lit(None).cast("int") for c in ("x", "y", *CHANNELS)}
    columns = [*KEY, *CHANNELS, *own, "tile_x", "tile_y"]
    rows = here.select(columns).unionByName(every.withColumns(nothing).select(columns))

    def run(table: pa.Table) -> pa.Table:
        about = {c: table.column(c)[0].as_py() for c in (*own, "tile_x", "tile_y")}
        ids = table.column("image_id")[:1].combine_chunks()
        table = table.filter(table.column("x").is_valid())
        window = Window(np.zeros((1, 1, 4), np.float32), 0, 0)
        if table.num_rows:
            x, y = (table.column(c).to_numpy() for c in ("x", "y"))
            x0, y0 = int(x.min()), int(y.min())
            image = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1, 4), np.float32)
            image[y - y0, x - x0] = np.stack([table.column(c).to_numpy() for c in CHANNELS], axis=1)
            window = Window(image, x0, y0)
        left, top = about["tile_x"] * side, about["tile_y"] * side
        at_y, at_x = np.mgrid[top : min(top + side, about["out_h"]), left : min(left + side, about["out_w"])]
        flat = np.clip(np.nan_to_num(make(window, at_x, at_y, about)), 0, 255).astype(np.int32).reshape(-1, 4)
        ids = ids.take(pa.array(np.zeros(len(flat), np.int64)))
        return pa.table([ids, pa.array(at_x.ravel().astype(np.int32)), pa.array(at_y.ravel().astype(np.int32)), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4))], names=["image_id", "x", "y", *CHANNELS])

    return rows.groupBy("image_id", "tile_x", "tile_y").applyInArrow(run, raster.PIXELS.format(kind=kind))


def resize(pixels: DataFrame, width: int, height: int, algorithm: str | None = None) -> DataFrame:
    """Images of any size brought to one size; pixel centres are aligned. The same size is left as it is."""
    if algorithm == "nearest":
        return resize_nearest(pixels, width, height)
    return _resized(pixels, sizes(pixels).withColumns({"out_w": F.lit(width), "out_h": F.lit(height)}), algorithm)


def resize_each(pixels: DataFrame, targets: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Each image brought to its own size in `targets` (image_id, out_w, out_h); images without one stay out."""
    return _resized(pixels, sizes(pixels).join(targets.select("image_id", "out_w", "out_h"), "image_id"), algorithm)


def _resized(pixels: DataFrame, images: DataFrame, algorithm: str | None) -> DataFrame:
    reach = _reach(algorithm)
    place = lambda at, own, target, d: (F.col(at) + d + 0.5) * F.col(target).cast("double") / F.col(own) - 0.5
    spot = [place(at, own, target, d) for at, own, target in (("x", "width", "out_w"), ("y", "height", "out_h")) for d in (-reach, reach)]

    def make(seen: Window, x: np.ndarray, y: np.ndarray, own: dict) -> np.ndarray:
        w, h, width, height = (own[c] for c in ("width", "height", "out_w", "out_h"))
        if (w, h) == (width, height):
            return seen.at(x, y)
        return seen.sampled((x + 0.5) * w / width - 0.5, (y + 0.5) * h / height - 0.5, choose(algorithm, w, h, width, height))

    return gathered(pixels, images, tuple(spot), make)


def width_size(size: tuple[int, int], width: int) -> tuple[int, int]:
    """A size of the given width, the height in proportion in single precision, 1 at least."""
    return width, max(1, int(np.float32(size[1]) / np.float32(size[0]) * np.float32(width)))


def height_size(size: tuple[int, int], height: int) -> tuple[int, int]:
    return max(1, int(np.float32(size[0]) / np.float32(size[1]) * np.float32(height))), height


def resize_width(pixels: DataFrame, width: int, source: tuple[int, int], algorithm: str | None = None) -> DataFrame:
    return resize(pixels, *width_size(source, width), algorithm)


def resize_height(pixels: DataFrame, height: int, source: tuple[int, int], algorithm: str | None = None) -> DataFrame:
    return resize(pixels, *height_size(source, height), algorithm)


def relative_size(size: tuple[int, int], dx: int = 0, dy: int = 0) -> tuple[int, int]:
    """Wider by dx, or else higher by dy, in proportion."""
    return width_size(size, max(1, size[0] + dx)) if dx or not dy else height_size(size, max(1, size[1] + dy))


def resize_relative(pixels: DataFrame, dx: int, dy: int, source: tuple[int, int], algorithm: str | None = None) -> DataFrame:
    return resize(pixels, *relative_size(source, dx, dy), algorithm)


def scaled_size(size: tuple[int, int], factor: float) -> tuple[int, int]:
    """A size times a factor in single precision, truncated, 1 at least."""
    return tuple(int(max(np.float32(v) * np.float32(factor), np.float32(1.0))) for v in size)


def resize_factor(pixels: DataFrame, factor: float, source: tuple[int, int], algorithm: str | None = None) -> DataFrame:
    """1.0 is the same size; a factor of 0 or less changes nothing."""
    return pixels if factor <= 0 else resize(pixels, *scaled_size(source, factor), algorithm)


#: One degree, in single precision.
DEGREE = np.float32(np.pi) / np.float32(180.0)


def _turn(degrees: float) -> tuple[np.float32, np.float32]:
    """Cosine and sine in single precision."""
    turn = float(np.float32(degrees) * DEGREE)
    return np.float32(math.cos(turn)), np.float32(math.sin(turn))


def rotated_size(width: int, height: int, degrees: float) -> tuple[int, int]:
    """The size that holds a turned image, truncated in single precision; whole quarter turns are exact."""
    rest = np.float32(math.fmod(np.float32(degrees), 180.0))
    rest = rest + np.float32(180.0) if rest < 0 else rest
    if rest >= 90:
        width, height, rest = height, width, rest - np.float32(90.0)
    if rest == 0:
        return max(1, width), max(1, height)
    cos, sin = _turn(rest)
    w, h = np.float32(width), np.float32(height)
    return max(1, int(abs(w * cos + h * sin))), max(1, int(abs(w * sin + h * cos)))


def _rotated_columns(degrees: Column) -> dict[str, Column]:
    """`rotated_size` of the columns width and height."""
    rest = F.pmod(f32(degrees), f32(180.0))
    swapped = rest >= 90
    rest = F.when(swapped, rest - f32(90.0)).otherwise(rest)
    turn = f32(rest * f32(float(DEGREE)))
    cos, sin = f32(F.cos(turn)), f32(F.sin(turn))
    w, h = (f32(F.when(swapped, F.col(b)).otherwise(F.col(a))) for a, b in (("width", "height"), ("height", "width")))
    side = lambda one, other: F.greatest(F.when(rest == 0, one).otherwise(F.abs(one * cos + other * sin)).cast("int"), F.lit(1))
    return {"out_w": side(w, h), "out_h": F.greatest(F.when(rest == 0, h).otherwise(F.abs(w * sin + h * cos)).cast("int"), F.lit(1))}


def rotate(pixels: DataFrame, degrees: float | DataFrame, algorithm: str | None = "bilinear") -> DataFrame:
    """Clockwise; the image grows to hold the turned one. `degrees`: one angle, or rows (image_id, degrees), others staying out.

    Places, not centres of pixels, turn about half the size: whole quarter turns by an angle leave the first row or column clear.
    """
    images = sizes(pixels)
    images = images.join(degrees.select("image_id", F.col("degrees").cast("double")), "image_id") if isinstance(degrees, DataFrame) else images.withColumn("degrees", F.lit(float(degrees)))
    images = images.withColumns(_rotated_columns(F.col("degrees")))
    turn = F.radians("degrees")
    cos, sin, dx, dy = F.cos(turn), F.sin(turn), F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    wide = (F.abs(cos) + F.abs(sin)) * (_reach(algorithm) + 1)
    x, y = dx * cos - dy * sin + F.col("out_w") / 2, dx * sin + dy * cos + F.col("out_h") / 2

    def make(seen: Window, x: np.ndarray, y: np.ndarray, own: dict) -> np.ndarray:
        cos, sin = _turn(own["degrees"])
        half = lambda c: np.float32(own[c]) / np.float32(2.0)
        dx, dy = x.astype(np.float32) - half("out_w"), y.astype(np.float32) - half("out_h")
        sx, sy = dx * cos + dy * sin + half("width"), -dx * sin + dy * cos + half("height")
        by = choose(algorithm, own["width"], own["height"], own["out_w"], own["out_h"])
        aside = 0.5 if by == "nearest" else 0.0  # the nearest pixel is the one that holds the place
        return seen.sampled(sx.astype(np.float64) - aside, sy.astype(np.float64) - aside, by)

    return gathered(pixels, images, (x - wide, x + wide, y - wide, y + wide), make)


@dataclass(frozen=True)
class Affine:
    """x' = a x + c y + e, y' = b x + d y + f. `then` chains maps, so that pixels are sampled once for any number of them."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def then(self, other: Affine) -> Affine:
        x, y = other.linear(self.a, self.b), other.linear(self.c, self.d)
        return Affine(*x, *y, *other.of(self.e, self.f))

    def linear(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y, self.b * x + self.d * y

    def of(self, x, y):
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def inverse(self) -> Affine:
        det = self.a * self.d - self.b * self.c
        if not det:
            raise ValueError("a map onto a line has no inverse")
        a, b, c, d = self.d / det, -self.b / det, -self.c / det, self.a / det
        return Affine(a, b, c, d, -(a * self.e + c * self.f), -(b * self.e + d * self.f))

    def moved(self, dx: float, dy: float) -> Affine:
        return self.then(Affine(e=dx, f=dy))

    def _about(self, other: Affine, origin: tuple[float, float]) -> Affine:
        return self.moved(-origin[0], -origin[1]).then(other).moved(*origin)

    def turned(self, degrees: float, origin: tuple[float, float] = (0.0, 0.0)) -> Affine:
        """Clockwise on the screen; quarter turns are exact."""
        quarter = {0.0: (1.0, 0.0), 90.0: (0.0, 1.0), 180.0: (-1.0, 0.0), 270.0: (0.0, -1.0)}
        cos, sin = quarter.get(degrees % 360.0, (math.cos(math.radians(degrees)), math.sin(math.radians(degrees))))
        return self._about(Affine(cos, sin, -sin, cos), origin)

    def scaled(self, sx: float, sy: float, origin: tuple[float, float] = (0.0, 0.0)) -> Affine:
        return self._about(Affine(a=sx, d=sy), origin)

    def sheared(self, x: float, y: float, origin: tuple[float, float] = (0.0, 0.0)) -> Affine:
        return self._about(Affine(b=y, c=x), origin)

    def box(self, width: float, height: float) -> tuple[int, int, int, int]:
        """(left, top, width, height) of the whole pixels that hold a mapped rectangle."""
        xs, ys = zip(*(self.of(x, y) for x in (0, width) for y in (0, height)), strict=True)
        left, top = math.floor(min(xs) + 1e-9), math.floor(min(ys) + 1e-9)
        return left, top, max(1, math.ceil(max(xs) - 1e-9) - left), max(1, math.ceil(max(ys) - 1e-9) - top)


def affine(pixels: DataFrame, matrix: Affine, box: tuple[int, int, int, int], algorithm: str = "bicubic") -> DataFrame:
    """Images mapped by a matrix and cut to box (left, top, width, height), whose corner becomes the origin. Centres of pixels map."""
    back = matrix.inverse()
    images = pixels.select("image_id").distinct().withColumns({"out_w": F.lit(box[2]), "out_h": F.lit(box[3])})
    wide = _reach(algorithm) + 1
    x, y = matrix.of(F.col("x") + 0.5, F.col("y") + 0.5)
    x, y, ex, ey = x - 0.5 - box[0], y - 0.5 - box[1], (abs(matrix.a) + abs(matrix.c)) * wide, (abs(matrix.b) + abs(matrix.d)) * wide

    def make(seen: Window, x: np.ndarray, y: np.ndarray, own: dict) -> np.ndarray:
        sx, sy = back.of(x + box[0] + 0.5, y + box[1] + 0.5)
        return seen.sampled(sx - 0.5, sy - 0.5, algorithm)

    return gathered(pixels, images, (x - ex, x + ex, y - ey, y + ey), make)


def rotate_quarter(pixels: DataFrame, turns: int) -> DataFrame:
    """Exact clockwise quarter turns, as a projection."""
    rows = pixels.join(sizes(pixels), "image_id")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    to = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns % 4]
    return rows.select("image_id", to[0].alias("x"), to[1].alias("y"), *CHANNELS)


def _radial_spot(low: Callable[[Column], Column], high: Callable[[Column], Column], margin: float, always: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """Where the samples lie that see a pixel, for maps along rays from the image's middle.

    `low` and `high`: the least and greatest target radius for a source radius, in pixels; both grow with it. A sample may lie `margin` beside the pixel:
    the spot is the ray's part between the radii, as wide as the margin is seen from there. `always`: when the pixel's own place counts too.
    """
    dx, dy = F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    d = F.sqrt(dx * dx + dy * dy)
    near, far = low(F.greatest(d - margin, F.lit(0.0))), high(d + margin)
    close = d <= 2 * margin
    beside = F.when(close, far).otherwise(far * (1.2 * margin) / d) + 1
    out = []
    for c, v, size in (("x", dx, "width"), ("y", dy, "height")):
        ends = [F.when(close, 0.0).otherwise(v / d * r) for r in (near, far)]
        first, last = F.least(*ends) - beside + F.col(size) / 2, F.greatest(*ends) + beside + F.col(size) / 2
        if always is not None:
            first, last = F.when(always, F.least(first, F.col(c))).otherwise(first), F.when(always, F.greatest(last, F.col(c))).otherwise(last)
        out += [first, last]
    return tuple(out)


def pinch(pixels: DataFrame, amount: float) -> DataFrame:
    """A radial pull toward (positive) or away from the centre, inside the smaller half side."""
    amount = min(max(amount, -1.0), 1.0)
    power = 1 - amount / 2 if amount >= 0 else 1 + abs(amount) / 2
    images = sizes(pixels).withColumns({"out_w": F.col("width"), "out_h": F.col("height")})
    half = F.least("width", "height") / 2
    radius = lambda r: F.pow(r / half, F.lit(1 / power)) * half
    d = F.sqrt((F.col("x") - F.col("width") / 2) ** 2 + (F.col("y") - F.col("height") / 2) ** 2)

    def make(seen: Window, x: np.ndarray, y: np.ndarray, own: dict) -> np.ndarray:
        w, h = own["width"], own["height"]
        dx, dy = x - w / 2, y - h / 2
        r = np.hypot(dx, dy) / (min(w, h) / 2)
        scale = np.where(r > 0, np.power(np.maximum(r, 1e-9), power) / np.maximum(r, 1e-9), 1.0)
        pulled = seen.sampled(np.clip(w / 2 + dx * scale, 0, w - 1), np.clip(h / 2 + dy * scale, 0, h - 1), "bilinear")
        return np.where((r < 1)[..., None], pulled, seen.at(x, y))

    return gathered(pixels, images, _radial_spot(radius, radius, 4.0, d + 8 >= half), make)


# Multipliers of the hashed displacements.
SCATTER_X, SCATTER_Y, SCATTER = (73856093, 19349663), (83492791, 23911681), 2654435761


def _scatter(x: np.ndarray, y: np.ndarray, keys: tuple[int, int]) -> np.ndarray:
    """A number in -1..1 for each place, in 32-bit arithmetic."""
    mixed = (x.astype(np.uint32) * np.uint32(keys[0])) ^ (y.astype(np.uint32) * np.uint32(keys[1]))
    return (mixed * np.uint32(SCATTER) % np.uint32(2000)).astype(np.float64) / 1000 - 1


# By how much the waves' length, height and drift change, and how slowly.
WAVE_DRIFT = {"length": (0.15, 0.05), "height": (0.08, 0.13), "across": (0.35, 0.03, 0.07)}


def _waves(x: np.ndarray, y: np.ndarray, degrees: float, length: float, reach: float, sign: float) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of waves along an angle: a sine whose length and height drift slowly, and a weak one across it."""
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    along, across = x * sin + y * cos, x * cos - y * sin
    (by_length, slow), (by_height, slower), (share, down, on) = WAVE_DRIFT.values()
    wave = np.sin(along * 2 * np.pi / length / (1 + by_length * np.sin(slow * along)))
    move = wave * reach * (1 + by_height * np.sin(slower * along)) * sign
    drift = share * reach * np.sin(down * across + on * along) * sign
    return move * sin + drift * cos, move * cos - drift * sin


def ripple(pixels: DataFrame, amount: float, size: str = "medium", shape: str | float = "circular") -> DataFrame:
    """Waves: circular, square, random, or along an angle in degrees. Sources beyond an edge are taken from it."""
    length, reach = RIPPLE_LENGTH[size], abs(amount) * 50.0
    if not amount:
        return pixels

    if shape == "square":
        return _square_ripple(pixels, reach * amount, length)
    most = {"random": 1.0, "circular": 1.0}.get(shape, 1.5) * reach * max(abs(amount) if isinstance(shape, str) else 1.0, 0.0)

    def change(image: np.ndarray, size: tuple[int, int], corner: tuple[int, int]) -> np.ndarray:
        w, h = size
        y, x = (np.mgrid[0 : image.shape[0], 0 : image.shape[1]] + np.array(corner[::-1])[:, None, None]).astype(np.float64)
        if shape == "random":
            sx, sy = x + _scatter(x, y, SCATTER_X) * reach * amount, y + _scatter(x, y, SCATTER_Y) * reach * amount
        elif isinstance(shape, str):
            dx, dy = x - w / 2, y - h / 2
            d = np.hypot(dx, dy)
            d = d + np.sin(d / length) * reach * amount
            turn = np.arctan2(dy, dx)
            sx, sy = w / 2 + d * np.cos(turn), h / 2 + d * np.sin(turn)
        else:
            mx, my = _waves(x, y, shape, length, reach, math.copysign(1, amount))
            sx, sy = x + mx, y + my
        return sample(image, np.clip(sx, 0, w - 1) - corner[0], np.clip(sy, 0, h - 1) - corner[1], "bicubic")

    return raster.per_tile(pixels, change, math.ceil(most) + REACH["bicubic"] + 1, sized=True, placed=True)


def _square_ripple(pixels: DataFrame, height: float, length: float) -> DataFrame:
    """Waves by the greater of the distances across and down; places come nearer to the middle beside the axes, so tiles gather along rays."""
    images = sizes(pixels).withColumns({"out_w": F.col("width"), "out_h": F.col("height")})
    dx, dy = F.col("x") - F.col("width") / 2, F.col("y") - F.col("height") / 2
    d = F.sqrt(dx * dx + dy * dy)
    longest = F.when(d > 0, F.greatest(F.abs(dx), F.abs(dy)) / d).otherwise(1.0)  # the longer side's share of the radius

    def make(seen: Window, x: np.ndarray, y: np.ndarray, own: dict) -> np.ndarray:
        w, h = own["width"], own["height"]
        dx, dy = x - w / 2, y - h / 2
        d = np.maximum(np.abs(dx), np.abs(dy))
        d = d + np.sin(d / length) * height
        turn = np.arctan2(dy, dx)
        return seen.sampled(np.clip(w / 2 + d * np.cos(turn), 0, w - 1), np.clip(h / 2 + d * np.sin(turn), 0, h - 1), "bicubic")

    margin = 2 * abs(height) + 2 * REACH["bicubic"] + 2
    turns = F.lit(margin * 1.3) / F.greatest(d, F.lit(margin))  # by how much the share may differ beside the ray
    least, most = F.least(longest + turns, F.lit(1.0)), F.greatest(longest - turns, F.lit(0.7))
    return gathered(pixels, images, _radial_spot(lambda r: F.greatest(r - abs(height), F.lit(0.0)) / least, lambda r: (r + abs(height)) / most, margin), make)
