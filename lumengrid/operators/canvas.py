"""Layers and canvases: the layer table's algebra and the ordered composite.

A layer table has (canvas_id, layer_id, name, z, image_id, x, y, width, height, opacity, blend_mode, visible, anchor); z
counts from 0 at the bottom without gaps in each canvas.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.numeric import div32, f32, u8
from lumengrid.operators import areas, blend, point, spatial, warp
from lumengrid.operators.raster import gaussian_blur
from lumengrid.operators.warp import Affine
from lumengrid.plans.views import CHANNELS, KEY, RGB, sizes

ANCHORS = ("top-left", "top-center", "top-right", "center-left", "center", "center-right", "bottom-left", "bottom-center", "bottom-right")
LAYER = "canvas_id int, layer_id string, name string, z int, image_id int, x int, y int, width int, height int, opacity double, blend_mode string, visible boolean, anchor string"


def anchored(layers: DataFrame, width: int, height: int) -> DataFrame:
    """x and y of layers with an anchor, from the canvas's and the layer's size; halves truncate toward zero."""
    row, col = F.split("anchor", "-"), F.element_at(F.split("anchor", "-"), -1)
    across = F.when(col == "left", 0).when(col == "right", F.lit(width) - F.col("width")).otherwise(F.call_function("div", F.lit(width) - F.col("width"), F.lit(2)))
    down = F.when(row[0] == "top", 0).when(row[0] == "bottom", F.lit(height) - F.col("height")).otherwise(F.call_function("div", F.lit(height) - F.col("height"), F.lit(2)))
    has = F.col("anchor").isin(*ANCHORS)
    return layers.withColumns({"x": F.when(has, across).otherwise(F.col("x")).cast("int"), "y": F.when(has, down).otherwise(F.col("y")).cast("int")})


def _renumber(layers: DataFrame, order: list) -> DataFrame:
    """z without gaps, by an order within each canvas."""
    return layers.withColumn("z", (F.row_number().over(Window.partitionBy("canvas_id").orderBy(*order)) - 1).cast("int"))


def add(layers: DataFrame, new: DataFrame) -> DataFrame:
    """New layers on top, in their own order."""
    return _renumber(layers.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1))), [F.col("_late"), F.col("z")]).drop("_late")


def delete(layers: DataFrame, layer_id: str) -> DataFrame:
    return _renumber(layers.where(F.col("layer_id") != layer_id), [F.col("z")])


def duplicate(layers: DataFrame, layer_id: str) -> DataFrame:
    """A copy right above the layer, named with " clone" after it."""
    copy = layers.where(F.col("layer_id") == layer_id).withColumns({"layer_id": F.concat("layer_id", F.lit("-clone")), "name": F.concat("name", F.lit(" clone")), "_up": F.lit(1)})
    return _renumber(layers.withColumn("_up", F.lit(0)).unionByName(copy), [F.col("z"), F.col("_up")]).drop("_up")


def reorder(layers: DataFrame, top_first: list[str]) -> DataFrame:
    """The order of a list of ids, the top first; layers that it leaves out go, repeats count once."""
    place = {k: i for i, k in reversed(list(enumerate(top_first)))}
    at = F.create_map(*[F.lit(v) for k, i in place.items() for v in (k, -i)])[F.col("layer_id")]
    return _renumber(layers.where(F.col("layer_id").isin(*place)), [at])


def move_to(layers: DataFrame, layer_id: str, index: int) -> DataFrame:
    """A layer moved to a position; positions beyond the ends are the ends."""
    own = F.max(F.when(F.col("layer_id") == layer_id, F.col("z"))).over(Window.partitionBy("canvas_id"))
    mine = F.col("layer_id") == layer_id
    key = F.when(mine, F.lit(index) + F.when(F.lit(index) > own, 0.5).otherwise(-0.5)).otherwise(F.col("z"))
    return _renumber(layers.withColumn("_at", key), [F.col("_at")]).drop("_at")


def move_by(layers: DataFrame, layer_id: str, steps: int) -> DataFrame:
    """A layer moved up (positive) or down."""
    key = F.when(F.col("layer_id") == layer_id, F.col("z") + steps + (0.5 if steps > 0 else -0.5)).otherwise(F.col("z").cast("double"))
    return _renumber(layers.withColumn("_at", key), [F.col("_at")]).drop("_at")


def set_columns(layers: DataFrame, layer_id: str, **values) -> DataFrame:
    """New values of a layer's columns; opacity is held to 0..1."""
    if "opacity" in values:
        values["opacity"] = min(max(values["opacity"], 0.0), 1.0)
    mine = F.col("layer_id") == layer_id
    return layers.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def crop(layers: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Each layer's rectangle met with the crop and moved to its origin; a layer outside becomes 0 x 0."""
    left, top = F.greatest(F.col("x"), F.lit(x)), F.greatest(F.col("y"), F.lit(y))
    right, bottom = F.least(F.col("x") + F.col("width"), F.lit(x + width)), F.least(F.col("y") + F.col("height"), F.lit(y + height))
    meets = (right > left) & (bottom > top)
    return layers.withColumns({"x": F.when(meets, left - x).otherwise(0), "y": F.when(meets, top - y).otherwise(0), "width": F.when(meets, right - left).otherwise(0), "height": F.when(meets, bottom - top).otherwise(0)})


def resize(layers: DataFrame, factor: float) -> DataFrame:
    """Places and sizes of layers scaled and rounded."""
    return layers.withColumns({c: F.round(F.col(c) * float(factor)).cast("int") for c in ("x", "y", "width", "height")})


@dataclass(frozen=True)
class Layer:
    """One layer of the composite, for every canvas at once: its pixels' image_id is the canvas's.

    `size` (width, height) is needed by transforms and anchors only. `effects` are (function, parameters) pairs of EFFECTS,
    applied in their order before the layer is drawn. `matrix` is a chain of maps from the layer's own places, whose origin
    lies at (x, y): the layer is sampled once, by `sampler`, when it is drawn, however long the chain.
    """

    pixels: DataFrame
    blend_mode: str = "normal"
    opacity: float = 1.0
    x: int = 0
    y: int = 0
    visible: bool = True
    size: tuple[int, int] | None = None
    anchor: str | None = None
    effects: tuple = ()
    name: str = ""
    matrix: Affine | None = None
    sampler: str = "bicubic"

    def transformed(self, change: Affine) -> Layer:
        """A map more in the chain."""
        return replace(self, matrix=(self.matrix or Affine()).then(change))

    def spun(self, degrees: float, origin: str | tuple[float, float] = "center") -> Layer:
        """A turn about an origin of the layer, in the chain."""
        return self.transformed(Affine().turned(degrees, origin_place(origin, self.size)))

    def stretched(self, sx: float, sy: float, origin: str | tuple[float, float] = "center") -> Layer:
        return self.transformed(Affine().scaled(sx, sy, origin_place(origin, self.size)))

    def sampled(self) -> Layer:
        """The layer with its chain carried out."""
        if self.matrix is None:
            return self
        box = self.matrix.box(*self.size)
        return replace(self, pixels=warp.affine(self.pixels, self.matrix, box, self.sampler), size=box[2:], x=self.x + box[0], y=self.y + box[1], matrix=None)

    def with_image(self, pixels: DataFrame, size: tuple[int, int] | None = None) -> Layer:
        return replace(self, pixels=pixels, size=size)

    def rotated(self, degrees: float, algorithm: str | None = None) -> Layer:
        """The layer's image turned; its place stays."""
        size = warp.rotated_size(*self.size, degrees) if self.size else None
        return replace(self, pixels=warp.rotate(self.pixels, degrees, algorithm), size=size)

    def flipped(self, axis: str = "x") -> Layer:
        width, height = self.size
        return replace(self, pixels=point.flip_horizontal(self.pixels, width) if axis == "x" else point.flip_vertical(self.pixels, height))

    def resized(self, width: int, height: int, algorithm: str | None = None) -> Layer:
        return replace(self, pixels=warp.resize(self.pixels, width, height, algorithm), size=(width, height))

    def resized_by(self, factor: float, algorithm: str | None = None) -> Layer:
        """A factor of 0 or less changes nothing."""
        return self if factor <= 0 else self.resized(*warp.scaled_size(self.size, factor), algorithm)

    def resized_width(self, width: int, algorithm: str | None = None) -> Layer:
        return self.resized(*warp.width_size(self.size, width), algorithm)

    def resized_height(self, height: int, algorithm: str | None = None) -> Layer:
        return self.resized(*warp.height_size(self.size, height), algorithm)

    def widened(self, dx: int, algorithm: str | None = None) -> Layer:
        return self.resized(*warp.relative_size(self.size, dx=dx), algorithm)

    def heightened(self, dy: int, algorithm: str | None = None) -> Layer:
        return self.resized(*warp.relative_size(self.size, dy=dy), algorithm)

    def cropped(self, x: int, y: int, width: int, height: int) -> Layer:
        """The part of the layer's image inside a rectangle of its own places; the layer's place stays."""
        left, top = max(x, 0), max(y, 0)
        wide, high = max(0, min(x + width, self.size[0]) - left), max(0, min(y + height, self.size[1]) - top)
        return replace(self, pixels=point.crop(self.pixels, left, top, wide, high), size=(wide, high))


@dataclass(frozen=True)
class Canvas:
    """A canvas of clear or coloured `pixels` of the size (width, height), child canvases below its own layers.

    A child is flattened, turned and blended as a whole; one that passes through and is not turned draws into its parent.
    """

    pixels: DataFrame
    size: tuple[int, int]
    layers: tuple[Layer, ...] = ()
    children: tuple[Canvas, ...] = ()
    x: int = 0
    y: int = 0
    opacity: float = 1.0
    blend_mode: str = "normal"
    rotation: float | None = None
    pass_through: bool = False
    effects: tuple = ()
    name: str = ""
    origin: str | tuple[float, float] = "center"

    @classmethod
    def blank(cls, images: DataFrame, width: int, height: int, name: str = "") -> Canvas:
        """A clear canvas for each image_id of a table."""
        ids = images.select("image_id").distinct().withColumns({"width": F.lit(width), "height": F.lit(height)})
        return cls(areas.blank(ids), (width, height), name=name)

    @classmethod
    def of(cls, pixels: DataFrame, width: int, height: int, name: str = "") -> Canvas:
        """A canvas of an image's size with the image as its only layer."""
        return cls.blank(pixels, width, height, name).add_layer(Layer(pixels, size=(width, height), name=name))

    def add_layer(self, layer: Layer) -> Canvas:
        return replace(self, layers=(*self.layers, layer))

    def add_canvas(self, child: Canvas, x: int | None = None, y: int | None = None, rotation: float | None = None) -> Canvas:
        child = replace(child, x=child.x if x is None else x, y=child.y if y is None else y, rotation=child.rotation if rotation is None else rotation)
        return replace(self, children=(*self.children, child))

    def positioned(self, x: int, y: int) -> Canvas:
        return replace(self, x=x, y=y)

    def anchored(self, anchor: str, width: int, height: int) -> Canvas:
        """Placed in a parent of that size."""
        x, y = anchor_place(anchor, (width, height), self.size)
        return replace(self, x=x, y=y)

    def rotated(self, degrees: float | None) -> Canvas:
        return replace(self, rotation=degrees)

    def blended(self, mode: str) -> Canvas:
        return replace(self, blend_mode=mode)

    def faded(self, opacity: float) -> Canvas:
        return replace(self, opacity=min(max(opacity, 0.0), 1.0))

    def passing_through(self, on: bool = True) -> Canvas:
        return replace(self, pass_through=on)

    def flattened(self) -> Canvas:
        """One layer with the canvas's result, without children."""
        return replace(self, layers=(Layer(render(self), size=self.size, name=self.name),), children=(), effects=())

    def resized(self, width: int, height: int, algorithm: str | None = None) -> Canvas:
        """All layers scaled in size and place, each rounded; the same size changes nothing."""
        if (width, height) == self.size:
            return self
        return self._scaled(_ratio(width, self.size[0]), _ratio(height, self.size[1]), (width, height), algorithm)

    def resized_by(self, factor: float, algorithm: str | None = None) -> Canvas:
        return self.resized(*warp.scaled_size(self.size, factor), algorithm)

    def resized_width(self, width: int, algorithm: str | None = None) -> Canvas:
        """Across only; the canvas takes the size of its lowest layer."""
        return self._scaled(_ratio(width, self.size[0]), None, None, algorithm)

    def resized_height(self, height: int, algorithm: str | None = None) -> Canvas:
        return self._scaled(None, _ratio(height, self.size[1]), None, algorithm)

    def widened(self, dx: int, algorithm: str | None = None) -> Canvas:
        """Each layer wider by dx in proportion, the canvas of the lowest layer's size, layers centred across."""
        return self._stretched(dx, 0, algorithm)

    def heightened(self, dy: int, algorithm: str | None = None) -> Canvas:
        return self._stretched(0, dy, algorithm)

    def with_origin(self, origin: str | tuple[float, float]) -> Canvas:
        """The place that `spun` turns about: a name as of an anchor, or shares of width and height."""
        return replace(self, origin=origin)

    def spun(self, degrees: float) -> Canvas:
        """All layers turned about the canvas's origin, each by its chain."""
        about = Affine().turned(degrees, origin_place(self.origin, self.size))
        return replace(self, layers=tuple(layer.transformed(Affine(e=layer.x, f=layer.y).then(about).moved(-layer.x, -layer.y)) for layer in self.layers))

    def cropped(self, x: int, y: int, width: int, height: int) -> Canvas:
        """Every layer cut to a rectangle and moved to its corner; a layer outside has no pixels. Children stay as they are."""

        def one(layer: Layer) -> Layer:
            layer = layer.sampled()
            meets = layer.x < x + width and layer.x + layer.size[0] > x and layer.y < y + height and layer.y + layer.size[1] > y
            cut = layer.cropped(x - layer.x, y - layer.y, width, height) if meets else layer.cropped(0, 0, 0, 0)
            return replace(cut, x=max(layer.x - x, 0) if meets else 0, y=max(layer.y - y, 0) if meets else 0)

        return self._sized(tuple(map(one, self.layers)), (width, height))

    def turned(self, degrees: float, algorithm: str | None = None) -> Canvas:
        """Every layer's image turned in its place."""
        return replace(self, layers=tuple(layer.rotated(degrees, algorithm) for layer in self.layers))

    def flipped(self, axis: str = "x") -> Canvas:
        return replace(self, layers=tuple(layer.flipped(axis) for layer in self.layers))

    def _sized(self, layers: tuple[Layer, ...], size: tuple[int, int] | None) -> Canvas:
        size = size or (layers[0].size if layers else self.size)
        return replace(self, layers=layers, size=size, pixels=Canvas.blank(self.pixels, *size).pixels)

    def _scaled(self, sx: np.float32 | None, sy: np.float32 | None, size: tuple[int, int] | None, algorithm: str | None) -> Canvas:
        def one(layer: Layer) -> Layer:
            width, height = (v if k is None else _half_up(float(np.float32(v) * k)) for v, k in zip(layer.size, (sx, sy), strict=True))
            x, y = (v if k is None else _half_up(float(np.float32(v) * k)) for v, k in ((layer.x, sx), (layer.y, sy)))
            return replace(layer.resized(width, height, algorithm), x=x, y=y)

        return self._sized(tuple(map(one, self.layers)), size)

    def _stretched(self, dx: int, dy: int, algorithm: str | None) -> Canvas:
        grown = [layer.widened(dx, algorithm) if dx else layer.heightened(dy, algorithm) for layer in self.layers]
        width, height = grown[0].size if grown else self.size
        middle = lambda outer, inner: int((outer - inner) / 2)
        placed = [replace(g, x=middle(width, g.size[0])) if dx else replace(g, y=middle(height, g.size[1])) for g in grown]
        return self._sized(tuple(placed), None)


def _ratio(new: int, old: int) -> np.float32:
    """A change of size in single precision."""
    return np.float32(new) / np.float32(old) if old else np.float32(1.0)


def _half_up(v: float) -> int:
    """Rounded, halves away from zero."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def anchor_place(anchor: str, outer: tuple[int, int], inner: tuple[int, int]) -> tuple[int, int]:
    """(x, y) of an inner rectangle at an anchor of an outer one; halves truncate toward zero."""
    row, col = anchor.split("-")[0], anchor.split("-")[-1]
    share = {"left": 0.0, "top": 0.0, "center": 0.5, "right": 1.0, "bottom": 1.0}
    return int((outer[0] - inner[0]) * share[col]), int((outer[1] - inner[1]) * share[row])


def origin_place(origin: str | tuple[float, float], size: tuple[int, int]) -> tuple[int, int]:
    """The place of an origin in a size: by a name as of an anchor, halves truncated, or by shares of width and height."""
    if not isinstance(origin, str):
        return tuple(int(np.float32(v) * np.float32(k)) for v, k in zip(size, origin, strict=True))
    return anchor_place(origin, size, (0, 0))


def render(canvas: Canvas) -> DataFrame:
    """The canvas's pixels with its children and layers drawn, and its effects applied within its own bounds."""
    return _drawn(canvas, canvas.pixels, 0, 0)


def _drawn(canvas: Canvas, onto: DataFrame, dx: int, dy: int) -> DataFrame:
    for child in canvas.children:
        if 0 in child.size:
            continue
        x, y = dx + child.x, dy + child.y
        if child.pass_through and child.rotation is None:
            onto = _drawn(child, onto, x, y)
            continue
        flat = render(child)
        if child.effects:
            flat, (left, top) = with_effects(flat, child.effects, child.size)
            x, y = x - left, y - top
        if child.rotation is not None:
            flat = warp.rotate(flat, child.rotation, None)
        onto = blend.blend_opacity(onto, flat, child.blend_mode, child.opacity, x, y)
    lowest = not canvas.children
    for layer in canvas.layers:
        if not layer.visible:
            continue
        layer = layer.sampled()
        x, y = anchor_place(layer.anchor, canvas.size, layer.size) if layer.anchor else (layer.x, layer.y)
        pixels = layer.pixels
        if layer.effects:
            pixels, (left, top) = with_effects(pixels, layer.effects, layer.size)
            x, y = x - left, y - top
        # nothing lies below the lowest layer of a canvas without children: it is drawn normally
        onto = blend.blend_opacity(onto, pixels, "normal" if lowest else layer.blend_mode, layer.opacity, dx + x, dy + y)
        lowest = False
    return onto


def composite(canvas: DataFrame, layers: list[Layer], children: list[Canvas] | None = None) -> DataFrame:
    """The layers, lowest first, folded over the canvas's pixels. Each is one join on the pixel's place, in the same partitioning."""
    return render(Canvas(canvas, (0, 0), tuple(layers), tuple(children or ())))


def stroke_rect(pixels: DataFrame, size: int, color: tuple[int, int, int, int], width: int | None = None, height: int | None = None) -> DataFrame:
    """The image's rectangle outlined inside with half the size; without width and height, each image's own."""
    half = size / 2.0
    if width is None or height is None:
        pixels = pixels.join(sizes(pixels), "image_id")
        width, height = F.col("width"), F.col("height")
    edge = (F.col("x") < half) | (F.col("y") < half) | (F.col("x") >= width - half) | (F.col("y") >= height - half)
    return pixels.select(*KEY, *[F.when(edge, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip(CHANNELS, color, strict=True)])


def spread(pixels: DataFrame, amount: float) -> DataFrame:
    """A shadow's alpha grown (above 0.5) or shrunk (below) by one pixel; 0.5 and 0 leave it."""
    if amount <= 0 or amount == 0.5:
        return pixels
    return spatial.spread_alpha(pixels, amount > 0.5)


def shadow_padding(angle: float, distance: float, size: float) -> tuple[tuple[int, int], tuple[int, int, int, int]]:
    """((dx, dy), (left, top, right, bottom)): a shadow's offset, and by how much the image grows to hold it."""
    dx, dy = (_half_up(distance * v) for v in (math.cos(math.radians(angle)), math.sin(math.radians(angle))))
    blur = int(size)
    return (dx, dy), (max(-dx, 0) + blur, max(-dy, 0) + blur, max(dx, 0) + blur, max(dy, 0) + blur)


def drop_shadow(
    pixels: DataFrame, size_of: tuple[int, int] | None = None, color: tuple[int, int, int] = (0, 0, 0), opacity: float = 0.35,
    angle: float = 45.0, distance: float = 5.0, spread_by: float = 0.0, size: float = 5.0, mode: str = "normal",
) -> DataFrame:
    """Images of the size `size_of`, or each its own, on a coloured, moved and blurred copy of their opaque part; the image grows to hold it.

    The copy is drawn by `mode`, blurred by `size`, and its alpha scaled once more. A size of 0 leaves the image unchanged.
    """
    if size <= 0:
        return pixels
    (dx, dy), (left, top, right, bottom) = shadow_padding(angle, distance, size)
    solid = F.when(F.col("a") > 128, 255).otherwise(F.col("a"))
    shape = spread(pixels.select(*KEY, *[F.lit(v).alias(c) for c, v in zip(RGB, color, strict=True)], solid.alias("a")), spread_by)
    if size_of is None:
        ground = areas.blank(sizes(pixels).withColumns({"width": F.col("width") + left + right, "height": F.col("height") + top + bottom}))
    else:
        ground = Canvas.blank(pixels, size_of[0] + left + right, size_of[1] + top + bottom).pixels
    drawn = blend.blend_opacity(ground, shape, mode, 1.0, left + dx, top + dy)
    soft = gaussian_blur(drawn, int(size)).withColumn("a", u8(f32(F.col("a")) * f32(opacity)))
    return blend.blend_opacity(soft, pixels, "normal", 1.0, left, top)


def _shadowed(pixels: DataFrame, own: tuple[int, int] | None, **options) -> tuple[DataFrame, tuple[int, int], tuple[int, int] | None]:
    blur = options.get("size", 5.0)
    if blur <= 0:
        return pixels, (0, 0), own
    _, (left, top, right, bottom) = shadow_padding(options.get("angle", 45.0), options.get("distance", 5.0), blur)
    return drop_shadow(pixels, own, **options), (left, top), own and (own[0] + left + right, own[1] + top + bottom)


def _outlined(pixels: DataFrame, own: tuple[int, int] | None, width: int = 1, color: tuple[int, int, int, int] = (0, 0, 0, 255)) -> tuple[DataFrame, tuple[int, int], tuple[int, int] | None]:
    return stroke_rect(pixels, width, color, *(own or (None, None))), (0, 0), own


#: Effects by name: (pixels, own size, **options) -> (pixels, how far the content moved, new size).
EFFECTS = {"stroke": _outlined, "drop_shadow": _shadowed}


def with_effects(pixels: DataFrame, effects: tuple, size: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    """The effects (name, options), strokes before shadows, and how far to the right and down the content has moved. Without a size, images have each its own."""
    left = top = 0
    for name, options in sorted(effects, key=lambda e: list(EFFECTS).index(e[0])):
        pixels, (dx, dy), size = EFFECTS[name](pixels, size, **options)
        left, top = left + dx, top + dy
    return pixels, (left, top)


#: Neighbouring ids that are numbered together.
BUCKET = 4096


def ranked(images: DataFrame) -> DataFrame:
    """(image_id, n): whole-number ids of a table numbered from 0 in their order.

    Ids are numbered within buckets of BUCKET neighbouring ids; only the buckets' counts meet in one task.
    """
    rows = images.select("image_id", F.floor(F.col("image_id") / F.lit(BUCKET)).alias("bucket"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    n = F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("image_id")) - 1
    return rows.join(starts, "bucket").select("image_id", n.alias("n"))


def grid_layout(images: DataFrame, columns: int, cell: tuple[int, int]) -> DataFrame:
    """(image_id, col, row, x, y): images of a table in reading order of their ids."""
    cells = ranked(images).select("image_id", (F.col("n") % columns).cast("int").alias("col"), F.call_function("div", F.col("n"), F.lit(columns)).cast("int").alias("row"))
    return cells.withColumns({"x": F.col("col") * cell[0], "y": F.col("row") * cell[1]})


def visible(layers: DataFrame) -> DataFrame:
    return layers.where("visible")


def move_to_top(layers: DataFrame, layer_id: str) -> DataFrame:
    return move_to(layers, layer_id, 1 << 30)


def move_to_bottom(layers: DataFrame, layer_id: str) -> DataFrame:
    return move_to(layers, layer_id, -1)


def find(layers: DataFrame, **wanted) -> DataFrame:
    """The layers with the given columns, such as z=1, layer_id="a" or name="b"; the lowest of each canvas if several have them."""
    for column, value in wanted.items():
        layers = layers.where(F.col(column) == value)
    rest = [c for c in layers.columns if c != "canvas_id"]
    return layers.groupBy("canvas_id").agg(F.min_by(F.struct(*rest), "z").alias("v")).select("canvas_id", "v.*")


def count(layers: DataFrame) -> DataFrame:
    return layers.groupBy("canvas_id").agg(F.count("*").alias("n"))


def place_relative(layers: DataFrame, layer_id: str, other: str, x: int, y: int) -> DataFrame:
    """A layer placed at (x, y) from another layer of its canvas; without that other layer it stays."""
    whole = Window.partitionBy("canvas_id")
    mine = F.col("layer_id") == layer_id
    at = {c: F.max(F.when(F.col("layer_id") == other, F.col(c))).over(whole) + d for c, d in (("x", x), ("y", y))}
    return layers.select(*[F.when(mine & at[c].isNotNull(), at[c]).otherwise(F.col(c)).alias(c) if c in at else F.col(c) for c in layers.columns])


def recenter(layers: DataFrame, size: int, axis: str = "x") -> DataFrame:
    """Layers centred on one axis of a canvas of that size; halves truncate toward zero."""
    side = "width" if axis == "x" else "height"
    return layers.withColumn(axis, F.call_function("div", F.lit(size) - F.col(side), F.lit(2)).cast("int"))


def fit_layers(layers: DataFrame, rule: str, width: int, height: int) -> DataFrame:
    """Sizes by a rule: "maintain", "contain" or "cover" a canvas of width x height, "specific" (that size), "percentage" (width is a factor)."""
    if rule == "maintain":
        return layers
    if rule == "specific":
        return layers.withColumns({"width": F.lit(width), "height": F.lit(height)})
    if rule == "percentage":
        scale = f32(float(width))
    else:
        ratios = [div32(f32(float(to)), f32(F.col(c))) for to, c in ((width, "width"), (height, "height"))]
        scale = F.least(*ratios) if rule == "contain" else F.greatest(*ratios)
    return layers.withColumns({c: F.floor(f32(F.col(c)) * scale).cast("int") for c in ("width", "height")})


def adjustment(layers: DataFrame, layer_id: str, kind: str) -> DataFrame:
    """A 1 x 1 placeholder on top of each canvas, named by its kind; it has no visual effect."""
    made = {"layer_id": F.lit(layer_id), "name": F.lit(kind), "image_id": F.lit(None).cast("int"), "x": F.lit(0), "y": F.lit(0), "width": F.lit(1), "height": F.lit(1), "opacity": F.lit(1.0), "blend_mode": F.lit("normal"), "visible": F.lit(True), "anchor": F.lit(None).cast("string"), "z": F.lit(0)}
    return add(layers, layers.select("canvas_id").distinct().withColumns(made).select(layers.columns))


def _drawn_number(seed: int, what: str, low, high, *keys: str):
    """A number in low..high by a hash of the keys, so that a repeated run draws the same."""
    unit = F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(what)), F.lit(1 << 40)) / float(1 << 40)
    return low + unit * (high - low)


def random_layout(images: DataFrame, width: int, height: int, seed: int, rotation: tuple[float, float] = (0.0, 360.0), scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(image_id, x, y, rotation, scale) for images (image_id, width, height): anywhere in the canvas less the scaled image."""
    rows = images.withColumns({"scale": _drawn_number(seed, "scale", *map(float, scale), "image_id"), "rotation": _drawn_number(seed, "rotation", *map(float, rotation), "image_id")})
    room = lambda side, own: F.greatest(F.lit(side) - F.floor(F.col(own) * F.col("scale")), F.lit(0)) + 1
    place = lambda what, side, own: F.floor(_drawn_number(seed, what, 0.0, room(side, own), "image_id")).cast("int")
    return rows.select("image_id", place("x", width, "width").alias("x"), place("y", height, "height").alias("y"), "rotation", "scale")


def project_metadata(layers: DataFrame) -> DataFrame:
    """(canvas_id, n_layers, n_active, names): a summary of each canvas's layers, the lowest first."""
    order = F.array_sort(F.collect_list(F.struct("z", "name")))
    return layers.groupBy("canvas_id").agg(F.count("*").alias("n_layers"), F.sum(F.col("visible").cast("long")).alias("n_active"), F.transform(order, lambda v: v["name"]).alias("names"))
