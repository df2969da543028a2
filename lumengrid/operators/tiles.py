"""Overlapping tiles: cutting images, running a function on each tile, merging what the tiles say of a pixel."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.plans.views import CHANNELS, KEY, RGB, sizes


def _count(size: Column, tile: int, overlap: int) -> Column:
    """How many tiles a side has: one for each step begun, so that the last ones may share their place."""
    return F.greatest(F.ceil(size / float(max(1, tile - overlap))).cast("int"), F.lit(1))


def _start(i: Column, size: Column, tile: int, overlap: int) -> Column:
    """Where tile i of a side begins; tiles that would reach over the edge of a side longer than a tile move inward."""
    at = i * max(1, tile - overlap)
    return F.when((at + tile > size) & (size > tile), size - tile).otherwise(at).cast("int")


def generate(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(image_id, idx, x, y, width, height, total) for images (image_id, width, height), in row-major order.

    Tiles advance by tile - overlap. On a side no longer than a tile, a second one has what is left.
    """
    n = images.withColumns({"nx": _count(F.col("width"), tile, overlap), "ny": _count(F.col("height"), tile, overlap)})
    rows = n.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)))
    x, y = _start(F.col("idx") % F.col("nx"), F.col("width"), tile, overlap), _start(F.expr("idx div nx"), F.col("height"), tile, overlap)
    placed = rows.withColumns({"x": x, "y": y})
    left = lambda c, size: F.least(F.lit(tile), F.col(size) - F.col(c)).cast("int")
    return placed.select("image_id", "idx", "x", "y", left("x", "width").alias("width"), left("y", "height").alias("height"), (F.col("nx") * F.col("ny")).alias("total"))


def _covering(at: str, size: str, count: str, tile: int, overlap: int) -> Column:
    """The numbers of the tiles of a side that hold a coordinate, by arithmetic: at most tile / step and those moved inward."""
    step = max(1, tile - overlap)
    first = F.greatest(F.ceil((F.col(at) - tile + 1) / float(step)).cast("int"), F.lit(0))
    last = F.when(F.col(at) >= F.col(size) - tile, F.col(count) - 1).otherwise(F.least(F.floor(F.col(at) / float(step)).cast("int"), F.col(count) - 1))

    def holds(i: Column) -> Column:
        start = _start(i, F.col(size), tile, overlap)
        return (start <= F.col(at)) & (F.col(at) < start + tile)

    return F.filter(F.sequence(F.least(first, last), last), holds)


def cut(pixels: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Each pixel once for each tile that holds it: (image_id, idx, tx, ty, x, y, r, g, b, a), tx and ty inside the tile."""
    counts = sizes(pixels).withColumns({"nx": _count(F.col("width"), tile, overlap), "ny": _count(F.col("height"), tile, overlap)})
    both = pixels.join(counts, "image_id")
    both = both.withColumn("ix", F.explode(_covering("x", "width", "nx", tile, overlap))).withColumn("iy", F.explode(_covering("y", "height", "ny", tile, overlap)))
    tx, ty = F.col("x") - _start(F.col("ix"), F.col("width"), tile, overlap), F.col("y") - _start(F.col("iy"), F.col("height"), tile, overlap)
    return both.select("image_id", (F.col("iy") * F.col("nx") + F.col("ix")).alias("idx"), tx.alias("tx"), ty.alias("ty"), "x", "y", *CHANNELS)


def merge(parts: DataFrame) -> DataFrame:
    """The mean of what tiles say of a pixel (channels 0..1), times 255 and truncated; opaque. Partial sums are made map-side."""
    sums = parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in RGB], F.count("*").alias("n"))
    value = lambda c: F.floor(F.least(F.greatest(F.col(c) / F.col("n"), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")
    return sums.select(*KEY, *[value(c).alias(c) for c in RGB], F.lit(255).alias("a"))


def process(pixels: DataFrame, tile: int, overlap: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A function of a tile [height, width, 3] of float32 in 0..1, run on every tile, merged. A task holds one tile."""
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        tx, ty = (table.column(c).to_numpy() for c in ("tx", "ty"))
        own = np.zeros((int(ty.max()) + 1, int(tx.max()) + 1, 3), np.float32)
        own[ty, tx] = np.stack([table.column(c).to_numpy() for c in RGB], axis=1) / 255.0
        out = change(own)[ty, tx]
        return pa.table([table.column("image_id"), table.column("x"), table.column("y"), *(pa.array(out[:, k].astype(np.float64)) for k in range(3))], names=[*KEY, *RGB])

    parts = cut(pixels, tile, overlap).groupBy("image_id", "idx").applyInArrow(run, f"image_id {kind}, x int, y int, r double, g double, b double")
    return merge(parts)


@lru_cache(maxsize=1)
def _session(model: bytes):
    import onnxruntime

    return onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])


def run_model(pixels: DataFrame, model: bytes, tile: int = 256, overlap: int = 16) -> DataFrame:
    """An ONNX model (bytes, image in and out as NCHW of 0..1 at the same size) run on every tile; a worker keeps its session."""

    def change(own: np.ndarray) -> np.ndarray:
        session = _session(model)
        out = session.run(None, {session.get_inputs()[0].name: own.transpose(2, 0, 1)[None]})[0]
        return out[0].transpose(1, 2, 0)

    return process(pixels, tile, overlap, change)
