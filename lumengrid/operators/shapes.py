"""Ready-made outlines, points along paths, grid lines, outlines of strokes, and planes of channels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import geometry
from lumengrid.operators.geometry import Path, Point
from lumengrid.plans.views import CHANNELS, RGB

# The control ratio of a quarter circle, a star in 100 x 100, a heart in 100 x 120.
QUARTER = 0.5522847498
STAR_POINTS = ((50.0, 0.0), (61.8, 35.1), (100.0, 38.2), (69.1, 61.8), (80.9, 100.0), (50.0, 76.4), (19.1, 100.0), (30.9, 61.8), (0.0, 38.2), (38.2, 35.1))
HEART_START = (50.0, 15.0)
HEART_CURVES = (
    ((35.0, 0.0), (0.0, 0.0), (0.0, 37.5)), ((0.0, 75.0), (25.0, 95.0), (50.0, 120.0)),
    ((75.0, 95.0), (100.0, 75.0), (100.0, 37.5)), ((100.0, 0.0), (65.0, 0.0), (50.0, 15.0)),
)


def star() -> Path:
    return Path.polygon(*STAR_POINTS)


def heart() -> Path:
    return Path(HEART_START, tuple(("cubic", *curve) for curve in HEART_CURVES))


def ellipse(cx: float, cy: float, width: float, height: float) -> Path:
    """Four quarter curves, clockwise from the top."""
    unit = [((0, -1), (1, 0)), ((1, 0), (0, 1)), ((0, 1), (-1, 0)), ((-1, 0), (0, -1))]
    to = lambda x, y: (cx + x * width / 2, cy + y * height / 2)
    curves = [("cubic", to(ax + bx * QUARTER, ay + by * QUARTER), to(bx + ax * QUARTER, by + ay * QUARTER), to(bx, by)) for (ax, ay), (bx, by) in unit]
    return Path(to(0, -1), tuple(curves))


def circle(cx: float, cy: float, radius: float) -> Path:
    return ellipse(cx, cy, 2 * radius, 2 * radius)


def polygon(sides: int, radius: float = 50.0) -> Path:
    """A regular polygon about (radius, radius), its first corner at the top."""
    if sides < 3:
        raise ValueError("a polygon has at least 3 sides")
    angles = [math.radians(360.0 * i / sides - 90.0) for i in range(sides)]
    return Path.polygon(*[(radius * math.cos(a) + radius, radius * math.sin(a) + radius) for a in angles])


def samples(path: Path, spacing: float) -> list[Point]:
    """Points at every `spacing` of the path's parameter, start and end included; a spacing of 0 gives the start only."""
    spacing = min(max(spacing, 0.0), 1.0)
    if not path.segments or not spacing:
        return [path.start]
    inner = math.ceil(1 / spacing - 1e-9) - 1
    return [path.start, *(path.point_at(k * spacing) for k in range(1, inner + 1)), path.point_at(1.0)]


#: Pieces of an arc at a round corner or end.
ARC = 12


def outline(path: Path, width: float, cap: str = "butt", join: str = "miter", tolerance: float = 0.125) -> Path:
    """The closed outline of a path drawn with a pen: both sides at half the width, each point aside of the piece that follows it.

    Ends are "butt", "square" (a tip half the width ahead) or "round"; corners are left as the sides have them, or "round".
    """
    line = path.flatten(tolerance)
    own = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    if len(own) < 2:
        return Path.polygon(*own * 3)
    half, last = width / 2, len(own) - 1
    normals = [_normal(a, b) for a, b in zip(own, own[1:], strict=False)]
    aside = lambda i, u, side: (own[i][0] + side * u[0] * half, own[i][1] + side * u[1] * half)
    left, right = [], []
    for i in range(last + 1):
        u, v = normals[max(i - 1, 0)], normals[min(i, last - 1)]
        corner = join == "round" and 0 < i < last
        outer = u[0] * v[1] - u[1] * v[0] > 0
        left += _arc(own[i], aside(i, u, 1), aside(i, v, 1)) if corner and outer else [aside(i, v, 1)]
        right += _arc(own[i], aside(i, u, -1), aside(i, v, -1)) if corner else [aside(i, v, -1)]
    ends = [_cap(own[last], normals[-1], half, cap, left[-1], right[-1]), _cap(own[0], (-normals[0][0], -normals[0][1]), half, cap, right[0], left[0])]
    return Path.polygon(*left, *ends[0], *reversed(right), *ends[1])


def area_outline(path: Path, width: float) -> Path:
    """The outline of an area drawn with a pen: its corners moved out and in along the mean of their two normals, as two rings."""
    own = path.flatten()
    own = [p for i, p in enumerate(own) if i == 0 or p != own[i - 1]]
    own = own[:-1] if own[0] == own[-1] else own
    if len(own) < 3:
        return Path()
    normals = [_normal(a, b) for a, b in zip(own, [*own[1:], own[0]], strict=True)]
    outer, inner = [], []
    for i, (x, y) in enumerate(own):
        mx, my = normals[i - 1][0] + normals[i][0], normals[i - 1][1] + normals[i][1]
        size = max(math.hypot(mx, my) / 2, 0.001) * 2
        outer.append((x + mx / size * width / 2, y + my / size * width / 2))
        inner.append((x - mx / size * width / 2, y - my / size * width / 2))
    return Path.polygon(*outer, *reversed(inner))


def _normal(a: Point, b: Point) -> Point:
    """The unit vector across a piece."""
    d = math.dist(a, b)
    return -(b[1] - a[1]) / d, (b[0] - a[0]) / d


def _arc(center: Point, start: Point, stop: Point, through: Point | None = None) -> list[Point]:
    """ARC pieces around a centre, the short way, or by the side of a direction where both ways are as long."""
    radius, first = math.dist(center, start), math.atan2(start[1] - center[1], start[0] - center[0])
    turn = (math.atan2(stop[1] - center[1], stop[0] - center[0]) - first + math.pi) % (2 * math.pi) - math.pi
    if through is not None and math.cos(first + turn / 2) * through[0] + math.sin(first + turn / 2) * through[1] < 0:
        turn -= math.copysign(2 * math.pi, turn)
    return [(center[0] + radius * math.cos(first + turn * k / ARC), center[1] + radius * math.sin(first + turn * k / ARC)) for k in range(ARC + 1)]


def _cap(end: Point, across: Point, half: float, cap: str, one: Point, other: Point) -> list[Point]:
    """The points between the two sides at an end; `across` is turned from the direction outward."""
    ahead = (across[1], -across[0])
    if cap == "square":
        return [(end[0] + ahead[0] * half, end[1] + ahead[1] * half)]
    return _arc(end, one, other, ahead)[1:-1] if cap == "round" else []


def grid_lines(lines: DataFrame) -> DataFrame:
    """(id, i, x, y): the whole-number points from (x0, y0) to (x1, y1), both included; a tie takes the side step early."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    rows = lines.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("i"))
    safe = F.greatest(F.col("n"), F.lit(1))
    at = lambda start, d: (F.col(start) + F.signum(d).cast("int") * F.call_function("div", F.col("i") * F.abs(d) * 2 + safe, safe * 2)).cast("int")
    return rows.select("id", "i", at("x0", dx).alias("x"), at("y0", dy).alias("y"))


def dab_centers(path: Path, size: float) -> tuple[list[Point], float]:
    """(centres, radius) of the dabs that fill an area: a grid a third of the radius apart, of the dabs that meet it.

    A dab meets the area if its centre or one of eight points of its rim lies inside. The brush is at least a quarter of the
    area's longer side wide, so that centres are at most some thousands.
    """
    x0, y0, x1, y1 = path.bounds()
    radius = max(size, max(x1 - x0, y1 - y0) / 4, 1.0) / 2
    step = max(radius / 3, 1.0)
    grid = lambda low, high: [math.floor(low - radius) + k * step for k in range(int((math.ceil(high + radius) - math.floor(low - radius)) / step) + 1)]
    x, y = np.meshgrid(grid(x0, x1), grid(y0, y1))
    rim = [(0.0, 0.0)] + [(radius * math.cos(math.pi / 4 * k), radius * math.sin(math.pi / 4 * k)) for k in range(8)]
    meets = np.zeros(x.shape, bool)
    for dx, dy in rim:
        meets |= _inside(path, x + dx, y + dy)
    return list(zip(x[meets].tolist(), y[meets].tolist(), strict=True)), radius


def _inside(path: Path, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which places have a winding number that is not 0."""
    total = np.zeros(x.shape, int)
    for ax, ay, bx, by in ((e[0], e[1], e[2], e[3]) for e in path.edges()):
        side = (y - ay) * (bx - ax) - (x - ax) * (by - ay)
        total += ((ay <= y) & (by > y) & (side < 0)).astype(int) - ((ay > y) & (by <= y) & (side > 0)).astype(int)
    return total != 0


def _adding(px, py, size: float, hardness: float):
    """A fold that adds the strengths of dabs at a place."""
    from lumengrid.operators import raster

    return lambda total, c: total + raster.dab(size, hardness, F.sqrt((px - c["x"]) ** 2 + (py - c["y"]) ** 2))


def fill_with_dabs(pixels: DataFrame, path: Path, size: float, color: tuple[int, int, int, int], hardness: float = 1.0) -> DataFrame:
    """An area filled by overlapping brush dabs: at each of 2 x 2 points of a pixel their strengths add up, as far as opaque."""
    from lumengrid.operators import raster

    centers, radius = dab_centers(path, size)
    if not centers:
        return pixels
    dots = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in centers])
    alpha = F.lit(0.0)
    for k in range(4):
        px, py = F.col("x") + (k % 2 + 0.5) / 2, F.col("y") + (k // 2 + 0.5) / 2
        sum_at = F.aggregate("dots", F.lit(0.0), _adding(px, py, 2 * radius, hardness))
        here = F.floor(F.least(sum_at * float(color[3]), F.lit(255.0)))
        inside = geometry.winding(px, py, path.edges()) != 0
        alpha = alpha + F.when(inside, here).otherwise(0.0)
    x0, y0, x1, y1 = path.bounds()
    near = F.col("x").between(math.floor(x0), math.ceil(x1)) & F.col("y").between(math.floor(y0), math.ceil(y1))
    strength = F.when(near, alpha / 4.0 / float(max(color[3], 1))).otherwise(0.0)
    return raster._stroke(pixels.withColumn("dots", dots), strength, color)


def to_planes(pixels: DataFrame) -> DataFrame:
    """(image_id, channel, values): r, g and b as arrays of 0..1 in row-major order, a model's input planes."""
    rows = pixels.select("image_id", "x", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), (F.col(c) / 255.0).alias("v")) for c in RGB])).alias("c"))
    lists = rows.groupBy("image_id", "c.channel").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("c.v").alias("v")))).alias("px"))
    return lists.select("image_id", "channel", F.transform("px", lambda p: p["v"]).alias("values"))


def from_planes(planes: DataFrame, width: int) -> DataFrame:
    """Opaque pixels from planes of 0..1, clamped and truncated."""
    rows = planes.select("image_id", "channel", F.posexplode("values").alias("p", "v"))
    value = lambda c: F.floor(F.least(F.greatest(F.max(F.when(F.col("channel") == c, F.col("v"))), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")
    wide = rows.groupBy("image_id", "p").agg(*[value(c).alias(c) for c in RGB])
    return wide.select("image_id", (F.col("p") % width).alias("x"), F.call_function("div", F.col("p"), F.lit(width)).cast("int").alias("y"), *RGB, F.lit(255).alias("a"))


def from_indexed(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels from (image_id, x, y, idx) and palettes (image_id, idx, r, g, b); an index without a colour is opaque black."""
    both = indexed.join(palette, ["image_id", "idx"], "left")
    return both.select("image_id", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in RGB], F.lit(255).alias("a")).select("image_id", "x", "y", *CHANNELS)
