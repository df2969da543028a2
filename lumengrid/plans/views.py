"""Pixels as rows: views over the input tables, and conversions between pixel rows and image rows.

A pixel table has (image_id, x, y, r, g, b, a), channels 0..255; an image table has (image_id, width, height, rgba).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
RGB = ("r", "g", "b")
KEY = ("image_id", "x", "y")
#: Sides of the images of pixels_base and pixels_top.
SIDE = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10 images, one for every 100 events."""
    return read(spark, sf_dir, "events").select(
        F.expr("CAST(event_id div 100 AS INT)").alias("image_id"),
        F.expr("CAST(event_id % 10 AS INT)").alias("x"),
        F.expr("CAST((event_id div 10) % 10 AS INT)").alias("y"),
        F.expr("CAST(user_id * 37 % 256 AS INT)").alias("r"),
        F.expr("CAST(CAST(floor(value * 100) AS BIGINT) % 256 AS INT)").alias("g"),
        F.expr("CAST(event_id * 73 % 256 AS INT)").alias("b"),
        F.expr("CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 255 - event_id % 64 END AS INT)").alias("a"),
    )


def pixels_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10 images, one for every 100 orders; more images than pixels_base has."""
    return read(spark, sf_dir, "orders").select(
        F.expr("CAST(o_orderkey div 100 AS INT)").alias("image_id"),
        F.expr("CAST(o_orderkey % 10 AS INT)").alias("x"),
        F.expr("CAST((o_orderkey div 10) % 10 AS INT)").alias("y"),
        F.expr("CAST(o_custkey * 29 % 256 AS INT)").alias("r"),
        F.expr("CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT)").alias("g"),
        F.expr("CAST(o_orderkey * 61 % 256 AS INT)").alias("b"),
        F.expr("CAST(255 - o_orderkey % 128 AS INT)").alias("a"),
    )


#: The width of the images of pixels_large, and their pixels.
WIDE, LARGE = 1250, 100_000


def pixels_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 1250 wide and up to 80 high, one for every 100,000 events: wider than two tiles."""
    at = f"CAST(event_id % {LARGE} AS INT)"
    return read(spark, sf_dir, "events").select(
        F.expr(f"CAST(event_id div {LARGE} AS INT)").alias("image_id"),
        F.expr(f"{at} % {WIDE}").alias("x"),
        F.expr(f"CAST({at} div {WIDE} AS INT)").alias("y"),
        F.expr("CAST(user_id * 37 % 256 AS INT)").alias("r"),
        F.expr("CAST(CAST(floor(value * 100) AS BIGINT) % 256 AS INT)").alias("g"),
        F.expr("CAST(event_id * 73 % 256 AS INT)").alias("b"),
        F.expr("CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 255 - event_id % 64 END AS INT)").alias("a"),
    )


def pixels_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 images, one for every vector; each of the first 64 components is a byte, made in the components' own precision.

    Components that a vector lacks are null; rows of one vec_id give the greatest.
    """
    table = read(spark, sf_dir, "embeddings")
    kind = table.schema["embedding"].dataType.elementType
    byte = lambda i: F.floor((F.get("embedding", i) + F.lit(1).cast(kind)) * F.lit(127.5).cast(kind)).cast("int")
    rows = table.select(F.col("vec_id").alias("image_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    grouped = rows.groupBy("image_id", "p").agg(*[F.max(byte(F.col("p") * 4 + k)).alias(c) for k, c in enumerate(CHANNELS)])
    return grouped.select("image_id", (F.col("p") % 4).alias("x"), F.expr("CAST(p div 4 AS INT)").alias("y"), *CHANNELS)


#: The same views as DuckDB text.
SQL = {
    "px": """SELECT CAST(event_id // 100 AS INT) AS image_id, CAST(event_id % 10 AS INT) AS x, CAST((event_id // 10) % 10 AS INT) AS y,
      CAST(user_id * 37 % 256 AS INT) AS r, CAST(CAST(floor(value * 100) AS BIGINT) % 256 AS INT) AS g, CAST(event_id * 73 % 256 AS INT) AS b,
      CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 255 - event_id % 64 END AS INT) AS a FROM events""",
    "pl": """SELECT CAST(event_id // 100000 AS INT) AS image_id, CAST(event_id % 100000 % 1250 AS INT) AS x, CAST(event_id % 100000 // 1250 AS INT) AS y,
      CAST(user_id * 37 % 256 AS INT) AS r, CAST(CAST(floor(value * 100) AS BIGINT) % 256 AS INT) AS g, CAST(event_id * 73 % 256 AS INT) AS b,
      CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 255 - event_id % 64 END AS INT) AS a FROM events""",
    "pt": """SELECT CAST(o_orderkey // 100 AS INT) AS image_id, CAST(o_orderkey % 10 AS INT) AS x, CAST((o_orderkey // 10) % 10 AS INT) AS y,
      CAST(o_custkey * 29 % 256 AS INT) AS r, CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS g, CAST(o_orderkey * 61 % 256 AS INT) AS b,
      CAST(255 - o_orderkey % 128 AS INT) AS a FROM orders""",
    "pe": """SELECT image_id, CAST(p % 4 AS INT) AS x, CAST(p // 4 AS INT) AS y, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) AS a
      FROM (SELECT vec_id AS image_id, i // 4 AS p, i % 4 AS c, CAST(floor((embedding[i + 1] + 1) * 127.5) AS INT) AS v FROM embeddings, range(64) t(i)) GROUP BY image_id, p""",
}


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) from the pixels' greatest coordinates."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


#: Pixels that an Arrow batch of pixel rows holds.
PIXELS_AT_ONCE = 1 << 16


def to_images(pixels: DataFrame) -> DataFrame:
    """One row for each image; pixels in row-major order, absent ones clear black. An image must fit a task, as its row holds it whole."""
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        width, height = int(x.max()) + 1, int(y.max()) + 1
        image = np.zeros((height, width, 4), np.uint8)
        image[y, x] = np.stack([table.column(c).to_numpy().astype(np.uint8) for c in CHANNELS], axis=1)
        row = [table.column("image_id")[:1].combine_chunks(), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([image.tobytes()], pa.binary())]
        return pa.table(row, names=["image_id", "width", "height", "rgba"])

    return pixels.select(*KEY, *CHANNELS).groupBy("image_id").applyInArrow(run, f"image_id {kind}, width int, height int, rgba binary")


def to_pixels(images: DataFrame) -> DataFrame:
    """One row for each pixel of image rows, in batches of PIXELS_AT_ONCE."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = np.frombuffer(batch.column(2)[i].as_py() or b"", np.uint8).reshape(-1, 4)
                width = batch.column(1)[i].as_py()
                for at in range(0, len(flat), PIXELS_AT_ONCE):
                    part = flat[at : at + PIXELS_AT_ONCE].astype(np.int32)
                    y, x = np.divmod(np.arange(at, at + len(part), dtype=np.int32), np.int32(width))
                    ids = batch.column(0).take(pa.array(np.full(len(part), i)))
                    yield pa.record_batch([ids, pa.array(x), pa.array(y), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(4))], ["image_id", "x", "y", *CHANNELS])

    return images.select("image_id", "width", "rgba").mapInArrow(run, f"image_id {kind}, x int, y int, r int, g int, b int, a int")


def from_rgb(images: DataFrame) -> DataFrame:
    """Image rows (image_id, width, height, rgba) of rows with rgb bytes; all pixels are opaque."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgba = []
            for data in batch.column(3).to_pylist():
                flat = np.frombuffer(data, np.uint8).reshape(-1, 3)
                rgba.append(np.concatenate([flat, np.full((len(flat), 1), 255, np.uint8)], axis=1).tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(rgba, pa.binary())], ["image_id", "width", "height", "rgba"])

    return images.select("image_id", "width", "height", "rgb").mapInArrow(run, f"image_id {kind}, width int, height int, rgba binary")


def new_image(spark: SparkSession, width: int, height: int, color: tuple[int, int, int, int] = (0, 0, 0, 0), image_id: int = 0) -> DataFrame:
    """A constant image; transparent black by default."""
    p = F.col("id")
    return spark.range(width * height).select(F.lit(image_id).alias("image_id"), (p % width).cast("int").alias("x"), F.expr(f"CAST(id div {width} AS INT)").alias("y"), *[F.lit(v).alias(c) for c, v in zip(CHANNELS, color, strict=True)])


def checkerboard(spark: SparkSession, width: int, height: int, checker: int, image_id: int = 0) -> DataFrame:
    """Light (200) and dark (100) opaque squares; light at the origin."""
    even = F.expr(f"(x div {checker} + y div {checker}) % 2 = 0")
    base = new_image(spark, width, height, (0, 0, 0, 255), image_id)
    return base.withColumns({c: F.when(even, 200).otherwise(100) for c in RGB})
