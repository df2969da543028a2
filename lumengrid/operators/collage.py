"""Collages: seeded draws of images, sized to cover their cells, turned, and drawn into one canvas by one plan.

Each cell is a canvas of its own, a child of the collage, so that a turned cell is drawn with its grown corner at its place.
What the driver holds is a row for each cell.

- "grid": columns x rows cells laid out by the whole root of their number; an image is turned, then covers its cell from the top.
- "layered": cells by columns and rows, drawn in a shuffled order; an image covers its scaled cell from the middle, and the cell is turned.
- "random": `columns` images (rows is not used), anywhere within the canvas less their scaled size, each turned.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators import areas, canvas, trees, warp
from lumengrid.plans.views import CHANNELS, KEY, sizes
from lumengrid.sources.staging import staged

STYLES = ("grid", "layered", "random")
#: Ids of the collage's own canvas and of its background; cells count from 0.
ROOT, GROUND = -1, -2


@dataclass(frozen=True)
class Cell:
    """One image of a collage: its place, the size of its cell, its turn and its order."""

    cell: int
    image_id: int
    seq: int
    x: int
    y: int
    width: int
    height: int
    rotation: float
    turn_image: float


def drawn(images: DataFrame, count: int, seed: int) -> list:
    """`count` image_ids, each once in a hashed order before any comes again."""
    ids = images.select("image_id").distinct()
    total = ids.count()
    found: list = []
    while total and len(found) < count:
        order = F.xxhash64("image_id", F.lit(seed), F.lit(len(found) // total))
        found += [r[0] for r in ids.orderBy(order, "image_id").limit(count - len(found)).collect()]  # of the number of cells
    return found


def _scaled(size: tuple[int, int], scale: float) -> tuple[int, int]:
    return tuple(int(np.float32(v) * np.float32(scale)) for v in size)


def plan(images: DataFrame, style: str, columns: int, rows: int, size: tuple[int, int], seed: int, rotation: tuple[float, float] = (0.0, 0.0), scale: tuple[float, float] = (1.0, 1.0)) -> list[Cell]:
    """The cells of a collage of images (image_id, width, height)."""
    if style not in STYLES:
        raise ValueError(f"a collage is one of {', '.join(STYLES)}")
    draw, count = random.Random(seed), max(1, columns) if style == "random" else columns * rows
    ids = drawn(images, count, seed)
    if style == "grid":
        side = int(np.sqrt(np.float32(count)))
        width, height = size[0] // side, size[1] // side
        return [Cell(i, image, i, i % side * width, i // side * height, width, height, 0.0, draw.uniform(*rotation)) for i, image in enumerate(ids)]
    if style == "layered":
        own, places = (size[0] // columns, size[1] // rows), list(range(count))
        draw.shuffle(places)
        return [Cell(i, image, i, places[i] % columns * own[0], places[i] // columns * own[1], *_scaled(own, draw.uniform(*scale)), draw.uniform(*rotation), 0.0) for i, image in enumerate(ids)]
    chosen = images.sparkSession.createDataFrame([(i,) for i in set(ids)], images.select("image_id").schema)
    known = {r.image_id: (r.width, r.height) for r in images.join(F.broadcast(chosen), "image_id").select("image_id", "width", "height").collect()}
    cells = []
    for i, image in enumerate(ids):
        turn, own = draw.uniform(*rotation), _scaled(known[image], draw.uniform(*scale))
        x, y = (draw.randint(0, max(0, side - part)) for side, part in zip(size, own, strict=True))
        cells.append(Cell(i, image, i, x, y, *own, turn, 0.0))
    return cells


def render(
    pixels: DataFrame, cells: list[Cell], size: tuple[int, int], style: str = "grid", background: tuple[int, int, int, int] | DataFrame | None = None,
    effects: tuple = (), algorithm: str | None = None,
) -> DataFrame:
    """One image (image_id 0) of the cells over the background: a colour, or the pixels of one image that is made to cover it.

    `effects` (name, options) are put on the cells of a layered collage and on the images of a random one.
    """
    spark = pixels.sparkSession
    live = [c for c in cells if c.width > 0 and c.height > 0]
    table = spark.createDataFrame([(c.cell, c.image_id, c.seq, c.x, c.y, c.width, c.height, c.rotation, c.turn_image) for c in live], "cell long, image_id long, seq long, x int, y int, width int, height int, rotation double, turn_image double")
    shown = pixels.join(F.broadcast(table.select("cell", "image_id")), "image_id").select(F.col("cell").alias("image_id"), "x", "y", *CHANNELS)
    if style == "grid" and any(c.turn_image for c in live):
        shown = warp.rotate(staged(shown), table.select(F.col("cell").alias("image_id"), F.col("turn_image").alias("degrees")), algorithm)
    shown = covering(staged(shown), table.select(F.col("cell").alias("image_id"), "width", "height"), algorithm)
    if style == "random" and effects:
        shown, moved = with_effects(shown, effects)
    else:
        moved = (0, 0)
    anchor = {"grid": "top-center", "layered": "center"}.get(style)
    canvases = table.select(F.col("cell").alias("canvas_id"), F.lit(ROOT).cast("long").alias("parent_id"), "seq", "width", "height", "x", "y", F.when(F.col("rotation") != 0, F.col("rotation")).alias("rotation"))
    root = spark.createDataFrame([(ROOT, None, 0, *size, 0, 0, None), (GROUND, ROOT, -1, *size, 0, 0, None)], "canvas_id long, parent_id long, seq long, width int, height int, x int, y int, rotation double")
    canvases = root.unionByName(canvases).withColumns({"opacity": F.lit(1.0), "blend_mode": F.lit("normal"), "pass_through": F.lit(False), "anchor": F.lit(None).cast("string")})
    ground = spark.createDataFrame([(GROUND, *size)], "image_id long, width int, height int")
    if isinstance(background, DataFrame):
        under = covering(background.select(F.lit(GROUND).cast("long").alias("image_id"), "x", "y", *CHANNELS), ground, algorithm)
    else:
        under = areas.blank(ground, background or (0, 0, 0, 0))
    shown = staged(shown.select(*KEY, *CHANNELS).unionByName(under.select(*KEY, *CHANNELS)))
    layers = sizes(shown).select(F.col("image_id").alias("canvas_id"), F.lit(0).alias("z"), "image_id", F.lit(-moved[0]).alias("x"), F.lit(-moved[1]).alias("y"), "width", "height", F.lit(1.0).alias("opacity"), F.lit("normal").alias("blend_mode"), F.lit(True).alias("visible"), F.when(F.col("image_id") >= 0, F.lit(anchor)).alias("anchor"))
    finish = (lambda flat: with_effects(flat, effects)[0]) if style == "layered" and effects else None
    return trees.render(canvases, layers, shown, finish, GROUND).withColumn("image_id", F.lit(0))


def covering(pixels: DataFrame, cells: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Images made as large as it takes to cover a cell (image_id, width, height), sizes truncated in single precision."""
    f = lambda c: F.col(c).cast("float")
    own = sizes(pixels).withColumnsRenamed({"width": "sw", "height": "sh"}).join(F.broadcast(cells), "image_id")
    k = F.greatest((f("width") / f("sw")).cast("float"), (f("height") / f("sh")).cast("float"))
    target = own.select("image_id", *[F.greatest(F.floor((f(c) * k).cast("float")).cast("int"), F.lit(1)).alias(t) for c, t in (("sw", "out_w"), ("sh", "out_h"))])
    return warp.resize_each(pixels, target, algorithm)


def with_effects(pixels: DataFrame, effects: tuple) -> tuple[DataFrame, tuple[int, int]]:
    """Effects on images of any sizes, and how far their content moves."""
    return canvas.with_effects(pixels, effects, None)


def collage(pixels: DataFrame, style: str, columns: int, rows: int, size: tuple[int, int], seed: int, rotation: tuple[float, float] = (0.0, 0.0), scale: tuple[float, float] = (1.0, 1.0), background=None, effects: tuple = (), algorithm: str | None = None) -> DataFrame:
    """A collage of a table of images, from the draw to the pixels."""
    return render(pixels, plan(sizes(pixels), style, columns, rows, size, seed, rotation, scale), size, style, background, effects, algorithm)
