"""Areas, masks and fills over pixel rows, and per-image functions in Arrow batches for wide or ordered supports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.functions.color import Gradient, rgb_to_hsv
from lumengrid.functions.numeric import f32, u8, u8_round
from lumengrid.operators import blend, geometry, point
from lumengrid.operators.geometry import Path
from lumengrid.plans.views import CHANNELS, KEY, RGB, new_image, sizes

PIXELS = "image_id {kind}, x int, y int, r int, g int, b int, a int"


def apply_in_area(pixels: DataFrame, change: Callable[[DataFrame], DataFrame], areas: list[tuple[Path, int]] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """`change` applied inside each area (path, feather) in turn, weighted by the mask's grey; no area is the whole image.

    The weighted result is truncated and mixed in alpha too. The weight of an area is an expression of x and y. A change that is
    a projection (the functions of `point`) is made beside the old pixels, so only a mask costs a join; any other change meets
    the old pixels by one join on the pixel's place.
    """
    if not areas and mask is None:
        return change(pixels)
    for path, feather in areas or [(None, 0)]:
        weight = geometry.weight_of(path, feather) if path else F.lit(1.0)
        old = pixels.select(*KEY, *CHANNELS, weight.alias("w"))
        if mask is not None:
            grey = mask.select(*KEY, (blend.gray_of(*[F.col(c) for c in RGB]) / 255.0).alias("m"))
            old = old.join(grey, list(KEY), "left").select(*KEY, *CHANNELS, (F.col("w") * F.coalesce("m", F.lit(1.0))).alias("w"))
        if getattr(change, "__module__", "") == point.__name__ and change.__name__ not in point.MOVING:
            # the old pixel travels in image_id, which a projection hands through
            packed = old.withColumn("image_id", F.struct("image_id", *[F.col(c).alias(f"o_{c}") for c in CHANNELS], "w"))
            both = change(packed.select(*KEY, *CHANNELS)).select("image_id.*", "x", "y", *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
        else:
            new = change(pixels).select(*KEY, *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
            both = old.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in CHANNELS], "w").join(new, list(KEY), "left")
        w = f32(F.col("w"))
        mix = lambda c: F.when((F.col("w") <= 0) | F.col(f"t_{c}").isNull(), F.col(f"o_{c}")).otherwise(u8(f32(F.col(f"t_{c}")) * w + f32(F.col(f"o_{c}")) * (f32(1.0) - w)))  # noqa: B023, E731
        pixels = both.select(*KEY, *[mix(c).alias(c) for c in CHANNELS])
    return pixels


def coverage(path: Path, samples: int = 4, rule: str = "non-zero") -> Column:
    """How many of samples x samples points of the pixel (x, y) lie inside."""
    edges, total = path.edges(), F.lit(0)
    for i in range(samples * samples):
        px, py = F.col("x") + (i % samples + 0.5) / samples, F.col("y") + (i // samples + 0.5) / samples
        inside = geometry.winding(px, py, edges) != 0 if rule == "non-zero" else geometry.crosses(px, py, edges) % 2 == 1
        total = total + F.when(inside, 1).otherwise(0)
    return total


def gradient_time(path: Path) -> Column:
    """`gradient_time_at` of the pixel's centre."""
    return gradient_time_at(path, F.col("x") + 0.5, F.col("y") + 0.5)


def gradient_time_at(path: Path, px: Column, py: Column) -> Column:
    """The t in 0..1 of the place on a path that is nearest to (px, py); each piece of its polyline has an equal share."""
    own = path.flatten()
    options = []
    for i, ((xi, yi), (xj, yj)) in enumerate(zip(own, own[1:], strict=False)):
        dx, dy = xj - xi, yj - yi
        norm = dx * dx + dy * dy
        t = F.greatest(F.least(((px - xi) * dx + (py - yi) * dy) / norm, F.lit(1.0)), F.lit(0.0)) if norm else F.lit(0.0)
        d = (px - (t * dx + xi)) ** 2 + (py - (t * dy + yi)) ** 2
        options.append(F.struct(d.alias("d"), F.lit(i).alias("i"), ((t + float(i)) / float(max(len(own) - 1, 1))).alias("t")))
    return F.array_min(F.array(*options))["t"] if options else F.lit(0.0)


def fill(spark: SparkSession, path: Path, paint: tuple[int, int, int, int] | Gradient | DataFrame, samples: int = 4, feather: int = 0, image_id: int = 0, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """A new image of the path's bounding box, filled with a colour, a gradient or an image; edges smoothed.

    A gradient goes along its own direction, else from left to right. An image's pixels lie at `offset`; beyond it is nothing.
    """
    x0, y0, x1, y1 = path.bounds()
    moved = path.mapped(lambda p: (p[0] - x0, p[1] - y0))
    width, height = max(1, math.ceil(x1 - x0)), max(1, math.ceil(y1 - y0))
    grid = new_image(spark, width, height, image_id=image_id).withColumn("cover", coverage(moved, samples))
    if isinstance(paint, Gradient):
        if paint.direction is not None:
            grid = grid.withColumn("t", gradient_time(paint.direction))
            color = paint.color_at(F.col("t"))
        else:
            color = paint.color_at((F.col("x") + 0.5) / float(width))
    elif isinstance(paint, DataFrame):
        under = paint.select((F.col("x") + offset[0]).alias("x"), (F.col("y") + offset[1]).alias("y"), *[F.col(c).alias(f"p_{c}") for c in CHANNELS])
        grid = grid.join(under, ["x", "y"], "left")
        color = {c: F.coalesce(f"p_{c}", F.lit(0)) for c in CHANNELS}
    else:
        color = {c: F.lit(v) for c, v in zip(CHANNELS, paint, strict=True)}
    alpha = color["a"] * F.col("cover") / float(samples * samples)
    if feather:
        alpha = alpha * F.least(geometry.distance(moved) / float(feather), F.lit(1.0))
    hit = F.col("cover") > 0
    return grid.select(*KEY, *[F.when(hit, color[c]).otherwise(0).alias(c) for c in RGB], F.when(hit, u8_round(alpha)).otherwise(0).alias("a"))


def dab(size: float, hardness: float, distance: Column) -> Column:
    """A round brush's strength by distance from its centre, 0 from the rim on.

    Three curves of the distance by radius are mixed: a quadratic one at hardness 0, a line at 0.5, a step at half the radius at 1.
    """
    t = distance / (size / 2.0)
    hardness = min(max(hardness, 0.0), 1.0)
    line = F.lit(1.0) - t
    if hardness < 0.5:
        curve = (F.lit(1.0) - t * t) * (1.0 - 2 * hardness) + line * (2 * hardness)
    else:
        curve = line * (2.0 - 2 * hardness) + F.when(t < 0.5, 1.0).otherwise(0.0) * (2 * hardness - 1.0)
    return F.when(t >= 1, 0.0).otherwise(F.greatest(curve, F.lit(0.0)))


def paint(pixels: DataFrame, x: float, y: float, size: float, color: tuple[int, int, int, int], hardness: float = 1.0, opacity: float = 1.0) -> DataFrame:
    """One brush dab, source over; opacity scales the colour's alpha."""
    color = (*color[:3], int(color[3] * min(max(opacity, 0.0), 1.0)))
    d = F.sqrt((F.col("x") + 0.5 - x) ** 2 + (F.col("y") + 0.5 - y) ** 2)
    return _stroke(pixels, dab(size, hardness, d), color)


def stroke(pixels: DataFrame, path: Path, size: float, color: tuple[int, int, int, int], hardness: float = 1.0) -> DataFrame:
    """A round brush drawn along an open path."""
    own = path.flatten()
    parts = []
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    for (xi, yi), (xj, yj) in zip(own, own[1:], strict=False):
        dx, dy = xj - xi, yj - yi
        norm = dx * dx + dy * dy
        t = F.greatest(F.least(((px - xi) * dx + (py - yi) * dy) / norm, F.lit(1.0)), F.lit(0.0)) if norm else F.lit(0.0)
        parts.append((px - (t * dx + xi)) ** 2 + (py - (t * dy + yi)) ** 2)
    return _stroke(pixels, dab(size, hardness, F.sqrt(F.least(*parts) if len(parts) > 1 else parts[0])), color)


def _stroke(pixels: DataFrame, strength: Column, color: tuple[int, int, int, int]) -> DataFrame:
    a = {c: F.col(c) for c in CHANNELS}
    b = {c: F.lit(v) for c, v in zip(CHANNELS, color, strict=True)}
    mixed = blend.source_over(a, b, u8(f32(F.lit(float(color[3]))) * f32(F.col("strength"))))
    return pixels.withColumn("strength", strength).select(*KEY, *[F.when(F.col("strength") > 0, mixed[c]).otherwise(a[c]).alias(c) for c in CHANNELS])


def new_mask(pixels: DataFrame) -> DataFrame:
    """An all-white mask of the images' size."""
    return pixels.select(*KEY, *[F.lit(255).alias(c) for c in CHANNELS])


def draw_mask_area(mask: DataFrame, path: Path, grey: int, feather: int = 0) -> DataFrame:
    """A grey area drawn into a mask, feathered from its outline."""
    weight = geometry.area_weight(mask, path, feather)
    return blend.lerp(mask, mask.select(*KEY, *[F.lit(grey).alias(c) for c in RGB], F.lit(255).alias("a")), weight)


# --- per-image functions -------------------------------------------------------------------------------------------


def per_image(pixels: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A function of an image array [height, width, 4] of float32, returning one of any size; results are saturated bytes.

    Pixels of an image meet in one task, so this is for images that fit one; larger ones are cut with `tiles.cut` first.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.float32)
        image[y, x] = np.stack([table.column(c).to_numpy() for c in CHANNELS], axis=1)
        out = np.clip(np.nan_to_num(change(image)), 0, 255).astype(np.int32)
        yy, xx = np.divmod(np.arange(out.shape[0] * out.shape[1], dtype=np.int32), np.int32(out.shape[1]))
        ids = pa.array([table.column("image_id")[0].as_py()] * len(xx), table.schema.field("image_id").type)
        flat = out.reshape(-1, 4)
        return pa.table([ids, pa.array(xx, pa.int32()), pa.array(yy, pa.int32()), *(pa.array(flat[:, k], pa.int32()) for k in range(4))], names=["image_id", "x", "y", *CHANNELS])

    return pixels.select(*KEY, *CHANNELS).groupBy("image_id").applyInArrow(run, PIXELS.format(kind=kind))


#: The side of the tiles that a task holds for functions of bounded reach.
TILE = 512


def per_tile(pixels: DataFrame, change: Callable[..., np.ndarray], halo: int, sized: bool = False, placed: bool = False) -> DataFrame:
    """A function of image arrays whose pixels see `halo` neighbours at most, run on tiles of TILE x TILE and their halos.

    A pixel goes to its own tile and, within `halo` of a border, to the neighbours: no task holds an image whole. At the image's
    own edge there is no halo, so the function sees the edge there and nowhere else. `sized`: it also gets (width, height);
    `placed`: and after that the place (x, y) of the array in the image.
    """
    kind, side = pixels.schema["image_id"].dataType.simpleString(), TILE
    rows = pixels.select(*KEY, *CHANNELS)
    if sized:
        rows = rows.join(sizes(pixels), "image_id")
    own = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / side), F.lit(0)), F.floor((F.col(c) + halo) / side))
    rows = rows.withColumn("tile_x", F.explode(own("x"))).withColumn("tile_y", F.explode(own("y")))

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        tile_x, tile_y = table.column("tile_x")[0].as_py(), table.column("tile_y")[0].as_py()
        x0, y0 = int(x.min()), int(y.min())
        image = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1, 4), np.float32)
        image[y - y0, x - x0] = np.stack([table.column(c).to_numpy() for c in CHANNELS], axis=1)
        keep = (x // side == tile_x) & (y // side == tile_y)
        x, y = x[keep], y[keep]
        extra = ((table.column("width")[0].as_py(), table.column("height")[0].as_py()),) if sized else ()
        extra = (*extra, (x0, y0)) if placed else extra
        out = np.clip(np.nan_to_num(change(image, *extra)), 0, 255).astype(np.int32)[y - y0, x - x0] if len(x) else np.zeros((0, 4), np.int32)
        return pa.table([table.column("image_id").filter(pa.array(keep)), pa.array(x), pa.array(y), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(4))], names=["image_id", "x", "y", *CHANNELS])

    return rows.groupBy("image_id", "tile_x", "tile_y").applyInArrow(run, PIXELS.format(kind=kind))


def _lines(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted neighbours along an axis, edges repeated, taps added in order, truncated to bytes."""
    r = len(weights) // 2
    pad = [(0, 0)] * 3
    pad[axis] = (r, r)
    wide = np.pad(image, pad, mode="edge")
    out = np.zeros_like(image)
    for k, w in enumerate(weights.astype(np.float32)):
        out += w * np.take(wide, np.arange(k, k + image.shape[axis]), axis=axis)
    return np.trunc(np.clip(out, 0, 255))


def normal_weights(radius: int) -> np.ndarray:
    at = np.arange(-radius, radius + 1, dtype=np.float64)
    weights = np.exp(-at * at / (2 * (radius / 2.0) ** 2))
    return weights / weights.sum()


def gaussian_blur(pixels: DataFrame, radius: int) -> DataFrame:
    """A separable normal kernel with sigma of half the radius."""
    if radius <= 0:
        return pixels
    weights = normal_weights(radius)
    return per_tile(pixels, lambda image: _lines(_lines(image, weights, 1), weights, 0), radius)


def shifted(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Values at the places (x + dx, y + dy), mixed from four pixels, edges repeated. The shares are those of the shift alone."""

    def along(values: np.ndarray, d: float, axis: int) -> np.ndarray:
        n, whole = values.shape[axis], math.floor(d)
        at = np.arange(n) + whole
        low, high = (np.take(values, np.clip(i, 0, n - 1), axis=axis) for i in (at, at + 1))
        return low + (high - low) * np.float32(d - whole)

    return along(along(image, dx, 1), dy, 0)


def motion_blur(pixels: DataFrame, angle: float, distance: int) -> DataFrame:
    """The mean of `distance` samples along an angle in degrees, centred."""
    n = max(1, distance)
    dx, dy = math.cos(math.radians(angle)), math.sin(math.radians(angle))

    def change(image: np.ndarray) -> np.ndarray:
        return sum(shifted(image, (k - (n - 1) / 2) * dx, (k - (n - 1) / 2) * dy) for k in range(n)) / n

    return per_tile(pixels, change, math.ceil((n - 1) / 2) + 1)


# Weights of a colour's luminance, and the golden ratio's share of a turn.
LUMA = (0.2126, 0.7152, 0.0722)
GOLDEN = 0.61803398875


def iris(radius: int, samples: int, blades: int, curvature: float, rotation: float) -> np.ndarray:
    """Offsets (dx, dy) that fill an iris evenly: a spiral whose reach is that of a polygon, bent toward a circle by `curvature`."""
    k = np.arange(samples)
    turn = 2 * np.pi * (k * GOLDEN % 1.0) + rotation
    sector = 2 * np.pi / blades
    polygon = np.cos(np.pi / blades) * radius / np.cos(np.fmod(turn, sector) - np.pi / blades)
    reach = np.sqrt((k + 0.5) / samples) * (polygon * (1 - curvature) + radius * curvature)
    return np.stack([reach * np.cos(turn), reach * np.sin(turn)], axis=1)


def lens_blur(
    pixels: DataFrame, radius: int = 8, samples: int = 32, blades: int = 6, curvature: float = 0.5, rotation: float = 0.0,
    specular: tuple[float, float] | None = None, noise: float = 0.0, gaussian_noise: bool = False,
) -> DataFrame:
    """The mean over the samples of an iris with 3 to 8 blades, truncated.

    `specular` (brightness, threshold): samples whose luminance in 0..1 is above the threshold count brightness times, once at
    least. `noise`: the strength of the noise put over the result. A radius of 0 leaves the image as it is, without noise too.
    """
    if radius <= 0:
        return pixels
    offsets = iris(int(radius), max(1, samples), min(max(blades, 3), 8), curvature, rotation)

    def change(image: np.ndarray) -> np.ndarray:
        total = np.zeros_like(image)
        for dx, dy in offsets.tolist():
            got = shifted(image, dx, dy)
            if specular is not None:
                bright = got[..., :3] @ np.array(LUMA, np.float32) / 255.0 > specular[1]
                got[..., :3] *= np.where(bright, max(specular[0], 1.0), 1.0)[..., None]
            total += got
        return total / len(offsets)

    done = per_tile(pixels, change, int(radius) + 1)
    return point.noise(done, noise, gaussian=gaussian_noise) if noise > 0 else done


def histograms(values: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """For each row of a channel [height, width] of bytes: the 256 counts of each pixel's window, edges repeated.

    Columns keep the counts of the rows in reach, which gain a row and lose one per step; a running sum over columns gives the
    windows. The work of a pixel is that of 256 counts, whatever the radius.
    """
    wide = np.pad(values.astype(np.int64), radius, mode="edge")
    columns = np.zeros((wide.shape[1], 256), np.int32)
    at = np.arange(wide.shape[1])
    for row in wide[: 2 * radius]:
        columns[at, row] += 1
    for y in range(values.shape[0]):
        columns[at, wide[y + 2 * radius]] += 1
        run = np.cumsum(columns, axis=0)
        run = np.concatenate([np.zeros((1, 256), run.dtype), run])
        yield run[2 * radius + 1 :] - run[: -(2 * radius + 1)]
        columns[at, wide[y]] -= 1


def middles(counts: np.ndarray, radius: int) -> np.ndarray:
    """The middle value of each window's counts."""
    upto = np.cumsum(counts, axis=1)
    return (upto <= (2 * radius + 1) ** 2 // 2).sum(axis=1)


def median_wide(pixels: DataFrame, radius: int) -> DataFrame:
    """The middle value of (2 * radius + 1)^2 neighbours for radii that are too wide for rows, by sliding histograms; alpha stays."""

    def change(image: np.ndarray) -> np.ndarray:
        out = image.copy()
        for channel in range(3):
            for y, counts in enumerate(histograms(image[..., channel], radius)):
                out[y, :, channel] = middles(counts, radius)
        return out

    return per_tile(pixels, change, radius)


# What counts as skin (hue in degrees, saturation, value), and the reach of the mask's feather and of the blur.
SKIN_HUE, SKIN_SATURATION, SKIN_VALUE = (0.0, 50.0), (0.12, 0.68), 0.25
SKIN_FEATHER, SKIN_RADIUS = 5, 8


def skin_mask(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, w): 1 where hue, saturation and value are those of skin."""
    h, s, v = rgb_to_hsv(*[F.col(c) for c in RGB])
    return pixels.select(*KEY, F.when(h.between(*SKIN_HUE) & s.between(*SKIN_SATURATION) & (v >= SKIN_VALUE), 1.0).otherwise(0.0).alias("w"))


def _box(values: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Means of 2 * radius + 1 neighbours along an axis; what lies outside counts as 0."""
    pad = [(0, 0)] * values.ndim
    pad[axis] = (radius + 1, radius)
    run = np.cumsum(np.pad(values.astype(np.float64), pad), axis=axis)
    n = values.shape[axis]
    return (np.take(run, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis=axis) - np.take(run, np.arange(n), axis=axis)) / (2 * radius + 1)


def smooth_skin(pixels: DataFrame, amount: float) -> DataFrame:
    """A soft blur, mixed in by a feathered mask of what looks like skin.

    The mask's feather is a quarter of the longer side, the blur's radius an eighth, both 1 at least and bounded.
    """
    amount = min(max(amount, 0.0), 1.0)
    if not amount:
        return pixels
    hue, saturation, value = rgb_to_hsv(*[F.col(c) for c in RGB])
    skin = hue.between(*SKIN_HUE) & saturation.between(*SKIN_SATURATION) & (value >= SKIN_VALUE)
    # the mask's bit travels in alpha, above its eight bits
    marked = pixels.select(*KEY, *RGB, (F.col("a") + F.when(skin, 256).otherwise(0)).alias("a"))

    def change(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
        longest = max(size)
        mask, own = (image[..., 3] >= 256).astype(np.float32), image.copy()
        own[..., 3] -= 256 * mask
        feather, radius = min(SKIN_FEATHER, max(1, longest // 4)), min(SKIN_RADIUS, max(1, longest // 8))
        grey = np.floor(np.clip(_box(_box(mask, feather, 1), feather, 0), 0, 1) * amount * 255 + 0.5)
        w = (grey / 255).astype(np.float32)[..., None]
        weights = normal_weights(radius)
        soft = _lines(_lines(own, weights, 1), weights, 0)
        return np.where(w > 0, np.trunc(soft * w + own * (1 - w)), own)

    return per_tile(marked, change, max(SKIN_FEATHER, SKIN_RADIUS), sized=True)


def focus_blur(pixels: DataFrame, radius: int = 25, lens: bool = False) -> DataFrame:
    return lens_blur(pixels, radius) if lens else gaussian_blur(pixels, radius)
