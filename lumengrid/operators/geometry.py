"""Paths and areas: flattening, lengths, closest points, view boxes, and which pixels lie inside.

A path is a list of points on the driver (it parametrises a plan); `flatten_table` flattens tables of segments instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Point = tuple[float, float]


@dataclass(frozen=True)
class Path:
    """A start and segments: ("line", to), ("quad", ctrl, to) or ("cubic", ctrl1, ctrl2, to)."""

    start: Point = (0.0, 0.0)
    segments: tuple = field(default_factory=tuple)

    @classmethod
    def line(cls, a: Point, b: Point) -> Path:
        return cls(a, (("line", b),))

    @classmethod
    def polygon(cls, *points: Point) -> Path:
        return cls(points[0], tuple(("line", p) for p in (*points[1:], points[0])))

    @classmethod
    def rect(cls, x: float, y: float, width: float, height: float) -> Path:
        return cls.polygon((x, y), (x + width, y), (x + width, y + height), (x, y + height))

    def move_to(self, start: Point) -> Path:
        return replace(self, start=start)

    def line_to(self, to: Point) -> Path:
        return replace(self, segments=(*self.segments, ("line", to)))

    def quad_to(self, ctrl: Point, to: Point) -> Path:
        return replace(self, segments=(*self.segments, ("quad", ctrl, to)))

    def cubic_to(self, one: Point, two: Point, to: Point) -> Path:
        return replace(self, segments=(*self.segments, ("cubic", one, two, to)))

    @property
    def end(self) -> Point:
        return self.segments[-1][-1] if self.segments else self.start

    @property
    def points(self) -> list[Point]:
        return [self.start, *(s[-1] for s in self.segments)]

    def point_at(self, t: float) -> Point:
        """The point at t in 0..1, each segment taking an equal share."""
        if not self.segments:
            return self.start
        at = min(max(t, 0.0), 1.0) * len(self.segments)
        i = min(int(at), len(self.segments) - 1)
        return _bezier([self.points[i], *self.segments[i][1:]], at - i)

    def flatten(self, tolerance: float = 0.5) -> list[Point]:
        """A polyline: a curve becomes ceil(control polygon's length / tolerance) pieces, two at least."""
        out = [self.start]
        for segment in self.segments:
            hull = [out[-1], *segment[1:]]
            if segment[0] == "line":
                out.append(segment[1])
                continue
            n = max(2, math.ceil(sum(math.dist(a, b) for a, b in zip(hull, hull[1:], strict=False)) / tolerance))
            out += [_bezier(hull, i / n) for i in range(1, n + 1)]
        return out

    def length(self, tolerance: float = 0.5) -> float:
        own = self.flatten(tolerance)
        return sum(math.dist(a, b) for a, b in zip(own, own[1:], strict=False))

    def bounds(self, tolerance: float = 0.5) -> tuple[float, float, float, float]:
        own = self.flatten(tolerance)
        return min(p[0] for p in own), min(p[1] for p in own), max(p[0] for p in own), max(p[1] for p in own)

    def edges(self, tolerance: float = 0.5) -> list[tuple[float, float, float, float]]:
        """The closed polygon's edges (xi, yi, xj, yj)."""
        own = self.flatten(tolerance)
        if own[0] == own[-1]:
            own = own[:-1]
        return [(*p, *q) for p, q in zip(own, [own[-1], *own[:-1]], strict=True)]

    def mapped(self, change) -> Path:
        return Path(change(self.start), tuple((s[0], *map(change, s[1:])) for s in self.segments))

    def to_viewbox(self) -> tuple[float, float, float, float]:
        """The bounding box as a view box (x, y, width, height)."""
        x0, y0, x1, y1 = self.bounds()
        return x0, y0, x1 - x0, y1 - y0

    def fit(self, width: float, height: float, mode: str = "meet", align: tuple[str, str] = ("mid", "mid")) -> Path:
        """The path's bounding box mapped to a viewport: "meet", "slice" or "none" (stretched)."""
        x0, y0, x1, y1 = self.bounds()
        return self.mapped(lambda p: view_point(p, (x0, y0, x1 - x0, y1 - y0), width, height, mode, align))


def _bezier(hull: list[Point], t: float) -> Point:
    while len(hull) > 1:
        hull = [(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t) for a, b in zip(hull, hull[1:], strict=False)]
    return hull[0]


def aspect_ratio(box: tuple[float, float, float, float]) -> float:
    """Width by height of a view box; 1 for one without height."""
    return box[2] / box[3] if box[3] else 1.0


def view_point(p: Point, box: tuple[float, float, float, float], width: float, height: float, mode: str = "meet", align: tuple[str, str] = ("mid", "mid")) -> Point:
    """A point of a view box in a viewport."""
    x, y, w, h = box
    sx, sy = width / w if w else 1.0, height / h if h else 1.0
    if mode != "none":
        sx = sy = min(sx, sy) if mode == "meet" else max(sx, sy)
    share = {"min": 0.0, "mid": 0.5, "max": 1.0}
    return (p[0] - x) * sx + (width - w * sx) * share[align[0]], (p[1] - y) * sy + (height - h * sy) * share[align[1]]


def crosses(px: Column, py: Column, edges: list[tuple[float, float, float, float]]) -> Column:
    """How many edges a ray from (px, py) crosses: the even-odd rule takes odd numbers as inside."""
    total = F.lit(0)
    for xi, yi, xj, yj in edges:
        hit = ((F.lit(yi) > py) != (F.lit(yj) > py)) & (px < (py - yi) * (xj - xi) / (yj - yi + 0.00001) + xi)
        total = total + F.when(hit, 1).otherwise(0)
    return total


def winding(px: Column, py: Column, edges: list[tuple[float, float, float, float]]) -> Column:
    """The winding number by the edges right of the place: the non-zero rule takes anything but 0 as inside."""
    total = F.lit(0)
    for xi, yi, xj, yj in edges:
        side = (py - yi) * (xj - xi) - (px - xi) * (yj - yi)
        total = total + F.when((F.lit(yi) <= py) & (F.lit(yj) > py) & (side > 0), 1).when((F.lit(yi) > py) & (F.lit(yj) <= py) & (side < 0), -1).otherwise(0)
    return total


def contains(path: Path, rule: str = "even-odd") -> Column:
    """Whether the centre of the pixel (x, y) lies inside the path."""
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    return crosses(px, py, path.edges()) % 2 == 1 if rule == "even-odd" else winding(px, py, path.edges()) != 0


def in_area(pixels: DataFrame, path: Path) -> DataFrame:
    """The pixels whose centres lie inside; the bounding box filters first."""
    x0, y0, x1, y1 = path.bounds()
    return pixels.where(F.col("x").between(math.floor(x0), math.ceil(x1)) & F.col("y").between(math.floor(y0), math.ceil(y1)) & contains(path))


def distance(path: Path) -> Column:
    """The distance of the pixel's centre to the closed outline."""
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    parts = []
    for xi, yi, xj, yj in path.edges():
        dx, dy = xj - xi, yj - yi
        norm = dx * dx + dy * dy
        t = F.greatest(F.least(((px - xi) * dx + (py - yi) * dy) / norm, F.lit(1.0)), F.lit(0.0)) if norm else F.lit(0.0)
        parts.append((px - (t * dx + xi)) * (px - (t * dx + xi)) + (py - (t * dy + yi)) * (py - (t * dy + yi)))
    return F.sqrt(F.least(*parts) if len(parts) > 1 else parts[0])


def weight_of(path: Path, feather: int = 0) -> Column:
    """1 inside, rising over `feather` pixels from the outline, 0 outside; the bounding box is asked first."""
    x0, y0, x1, y1 = path.bounds()
    w = F.least(F.greatest(distance(path) / float(feather), F.lit(0.0)), F.lit(1.0)) if feather else F.lit(1.0)
    near = F.col("x").between(math.floor(x0), math.ceil(x1)) & F.col("y").between(math.floor(y0), math.ceil(y1))
    return F.when(near & contains(path), w).otherwise(0.0)


def area_weight(pixels: DataFrame, path: Path, feather: int = 0) -> DataFrame:
    """(image_id, x, y, w): 1 inside, rising over `feather` pixels from the outline."""
    w = F.least(F.greatest(distance(path) / float(feather), F.lit(0.0)), F.lit(1.0)) if feather else F.lit(1.0)
    return in_area(pixels, path).select("image_id", "x", "y", w.alias("w"))


def flatten_table(segments: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(path_id, seq, i, px, py) of segments (path_id, seq, x0, y0, x1, y1, x2, y2): quadratic curves as points, start left out."""
    hull = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2) + F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    rows = segments.withColumn("n", F.greatest(F.lit(2), F.ceil(hull / tolerance).cast("int"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("i") / F.col("n")
    at = lambda c: (1 - t) * (1 - t) * F.col(f"{c}0") + 2 * (1 - t) * t * F.col(f"{c}1") + t * t * F.col(f"{c}2")
    return rows.select("path_id", "seq", "i", at("x").alias("px"), at("y").alias("py"))


def path_stats(points: DataFrame) -> DataFrame:
    """(path_id, length, x_min, y_min, x_max, y_max) of polylines (path_id, seq, px, py)."""
    line = Window.partitionBy("path_id").orderBy("seq")
    step = F.sqrt((F.col("px") - F.lag("px").over(line)) ** 2 + (F.col("py") - F.lag("py").over(line)) ** 2)
    return points.withColumn("d", step).groupBy("path_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"), F.min("px").alias("x_min"), F.min("py").alias("y_min"), F.max("px").alias("x_max"), F.max("py").alias("y_max"))


def closest(points: DataFrame, path: Path) -> DataFrame:
    """`points` (id, px, py) with the nearest place (cx, cy) on the path, its t in 0..1 and the distance; the first of equals."""
    own = path.flatten()
    n = len(own) - 1
    options = []
    for i, ((xi, yi), (xj, yj)) in enumerate(zip(own, own[1:], strict=False)):
        dx, dy = xj - xi, yj - yi
        norm = dx * dx + dy * dy
        t = F.greatest(F.least(((F.col("px") - xi) * dx + (F.col("py") - yi) * dy) / norm, F.lit(1.0)), F.lit(0.0)) if norm else F.lit(0.0)
        cx, cy = t * dx + xi, t * dy + yi
        options.append(F.struct(F.sqrt((F.col("px") - cx) ** 2 + (F.col("py") - cy) ** 2).alias("distance"), F.lit(i).alias("i"), ((t + float(i)) / float(n)).alias("t"), cx.alias("cx"), cy.alias("cy")))
    best = F.array_min(F.array(*options))
    return points.withColumn("best", best).select("id", "px", "py", "best.cx", "best.cy", "best.t", "best.distance")


def points_table(spark: SparkSession, path: Path, path_id: int = 0) -> DataFrame:
    """A path's polyline as rows (path_id, seq, px, py)."""
    return spark.createDataFrame([(path_id, i, float(x), float(y)) for i, (x, y) in enumerate(path.flatten())], "path_id int, seq int, px double, py double")
