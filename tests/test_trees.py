"""Canvas trees and collages held as rows against canvases held as objects and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import canvas, collage, trees, warp
from lumengrid.plans import tree_queries
from lumengrid.plans.views import CHANNELS
from tests.test_image_models import frame_of
from tests.test_operators import array
from tests.test_turns import noise, plain_rotate

CANVASES = "canvas_id long, parent_id long, seq long, width int, height int, x int, y int, opacity double, blend_mode string, rotation double, pass_through boolean, anchor string"
LAYERS = "canvas_id long, z int, image_id int, x int, y int, width int, height int, opacity double, blend_mode string, visible boolean, anchor string"


@pytest.fixture(scope="module")
def pictures(spark):
    parts = [frame_of(spark, noise(8 - i, 5 + i, i)).withColumn("image_id", F.lit(i)) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).cache()


def of(pictures, i):
    return pictures.where(F.col("image_id") == i).withColumn("image_id", F.lit(0))


def test_trees_are_canvases(spark, pictures):
    """One tree with all kinds of children, and a plain one beside it."""
    nodes = [
        (10, None, 0, 14, 12, 5, 5, 0.3, "screen", 40.0, True, None),  # of a root, size alone counts
        (11, 10, 1, 9, 8, 2, 1, 0.7, "multiply", None, False, None),
        (12, 10, 0, 8, 7, 0, 0, 1.0, "normal", None, False, "bottom-right"),
        (13, 11, 5, 6, 6, -2, 3, 1.0, "darken", None, True, None),
        (14, 11, 4, 7, 5, 1, 1, 0.5, "screen", 30.0, True, None),
        (15, 13, 0, 4, 4, 1, -1, 0.9, "difference", None, False, "center"),
        (16, 10, 2, 0, 5, 0, 0, 1.0, "normal", None, False, None),
        (17, 16, 0, 5, 5, 0, 0, 1.0, "normal", None, False, None),
        (20, None, 0, 5, 4, 0, 0, 1.0, "normal", None, False, None),
        (30, 31, 0, 5, 5, 0, 0, 1.0, "normal", None, False, None),
        (31, 30, 0, 5, 5, 0, 0, 1.0, "normal", None, False, None),
    ]
    rows = [
        (10, 0, 0, 1, 1, 8, 5, 1.0, "screen", True, None), (10, 1, 1, 5, 4, 7, 6, 0.4, "darken", True, "top-center"), (11, 0, 2, 0, 0, 6, 7, 1.0, "multiply", True, None),
        (12, 0, 1, -2, 0, 7, 6, 1.0, "multiply", False, None), (12, 1, 0, 0, 1, 8, 5, 0.8, "screen", True, None), (13, 0, 0, 1, 1, 8, 5, 1.0, "multiply", True, None), (13, 1, 2, 0, 0, 6, 7, 0.5, "lighten", True, "center"),
        (14, 0, 2, 0, 0, 6, 7, 1.0, "normal", True, None), (15, 0, 1, 0, 0, 7, 6, 1.0, "normal", True, None), (17, 0, 1, 0, 0, 7, 6, 1.0, "normal", True, None), (20, 0, 0, 0, 0, 8, 5, 0.5, "multiply", True, None), (30, 0, 0, 0, 0, 8, 5, 1.0, "normal", True, None),
    ]
    got = trees.render(spark.createDataFrame(nodes, CANVASES), spark.createDataFrame(rows, LAYERS), pictures)
    assert {r.image_id for r in got.select("image_id").distinct().collect()} == {10, 20}

    def built(i):
        node = next(n for n in nodes if n[0] == i)
        own = canvas.Canvas.blank(of(pictures, 0), node[3], node[4])
        for c in sorted((n for n in nodes if n[1] == i), key=lambda n: (n[2], n[0])):
            child = built(c[0]).positioned(c[5], c[6]).faded(c[7]).blended(c[8]).rotated(c[9]).passing_through(c[10])
            own = own.add_canvas(child.anchored(c[11], node[3], node[4]) if c[11] else child)
        for r in sorted(r for r in rows if r[0] == i):
            own = own.add_layer(canvas.Layer(of(pictures, r[2]), r[8], r[7], r[3], r[4], r[9], (r[5], r[6]), r[10]))
        return own

    for i in (10, 20):
        assert (array(got.where(F.col("image_id") == i)) == array(canvas.render(built(i)))).all()


def test_trees_of_nothing(spark, pictures):
    canvases, layers = spark.createDataFrame([(1, None, 0, 3, 2, 0, 0, 1.0, "normal", None, False, None)], CANVASES), spark.createDataFrame([], LAYERS)
    assert not array(trees.render(canvases, layers, pictures))[..., 3].any()
    assert trees.render(canvases.where("false"), layers, pictures).count() == 0


def test_shapes_of_the_trees_differ(spark, sf_dir):
    nodes = trees.resolved(tree_queries.tree_tables(spark, sf_dir)[0])
    shapes = nodes.groupBy("root_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).select("n", "d").distinct().collect()
    assert len(shapes) > 6 and max(s.d for s in shapes) >= 3


def over(under, top):
    """A normal blend composited once more by its own alpha."""
    from tests.test_turns import source_over

    return np.trunc(np.clip(source_over(under, top), 0, 255))


def pasted(under, top, x, y):
    h, w = under.shape[:2]
    for j in range(top.shape[0]):
        for i in range(top.shape[1]):
            if 0 <= y + j < h and 0 <= x + i < w:
                under[y + j, x + i] = over(under[y + j, x + i], top[j, i])


@pytest.mark.parametrize("style", collage.STYLES)
def test_collages_by_numpy(spark, pictures, style):
    images = {i: array(of(pictures, i)) for i in range(3)}
    own = spark.createDataFrame([(i, images[i].shape[1], images[i].shape[0]) for i in range(3)], "image_id int, width int, height int")
    cells = collage.plan(own, style, 3, 2, (30, 24), 4, (-25.0, 25.0), (1.0, 1.5))
    assert len(cells) == (3 if style == "random" else 6) and cells == collage.plan(own, style, 3, 2, (30, 24), 4, (-25.0, 25.0), (1.0, 1.5))
    counts = [sum(c.image_id == i for c in cells) for i in range(3)]
    assert max(counts) - min(counts) <= 1  # every image once before any comes again
    got = array(collage.render(pictures, cells, (30, 24), style, (9, 60, 90, 255)))
    want = np.zeros((24, 30, 4))
    pasted(want, np.broadcast_to(np.array([9, 60, 90, 255]), (24, 30, 4)), 0, 0)
    for c in sorted(cells, key=lambda c: c.seq):
        image = plain_rotate(images[c.image_id], c.turn_image, "bicubic") if c.turn_image else images[c.image_id]
        h, w = image.shape[:2]
        k = max(np.float32(c.width) / np.float32(w), np.float32(c.height) / np.float32(h))
        wide, high = int(np.float32(w) * k), int(np.float32(h) * k)
        big = array(warp.resize(frame_of(spark, image), wide, high))
        x, y = {"grid": (int((c.width - wide) / 2), 0), "layered": (int((c.width - wide) / 2), int((c.height - high) / 2)), "random": (0, 0)}[style]
        flat = np.zeros((c.height, c.width, 4))
        pasted(flat, big, x, y)
        pasted(want, plain_rotate(flat, c.rotation, "bicubic") if c.rotation else flat, c.x, c.y)
    off = np.abs(got - want).max(axis=-1)
    assert got.shape == want.shape and (off > 2).mean() < 0.02


def test_collage_effects_and_backgrounds(spark, pictures):
    cells = collage.plan(pictures.select("image_id").distinct().withColumns({"width": F.lit(6), "height": F.lit(6)}), "layered", 2, 1, (20, 10), 1)
    framed = array(collage.render(pictures, cells, (20, 10), "layered", None, (("stroke", {"width": 2, "color": (255, 0, 0, 255)}),)))
    assert (framed[0, :] == [255, 0, 0, 255]).all() and (framed[:, 0] == [255, 0, 0, 255]).all()
    grown = array(collage.render(pictures, cells, (20, 10), "layered", (0, 0, 0, 255), (("drop_shadow", {"distance": 0.0, "size": 2.0}),)))
    assert (grown[:1] == [0, 0, 0, 255]).all() and not (grown[2:] == [0, 0, 0, 255]).all()  # the grown image's corner lies at the cell's place
    covered = array(collage.render(pictures, [], (20, 10), "grid", of(pictures, 0)))
    assert covered.shape == (10, 20, 4) and covered[..., 3].any()
    random = array(collage.collage(pictures, "random", 2, 1, (20, 16), 3, effects=(("stroke", {"width": 1, "color": (1, 2, 3, 255)}),)))
    assert random.shape == (16, 20, 4) and (random[..., :3] == [1, 2, 3]).all(axis=-1).any()
    with pytest.raises(ValueError):
        collage.plan(pictures, "pile", 1, 1, (5, 5), 0)
    assert collage.drawn(pictures.where("false"), 4, 1) == []
    assert set(pictures.columns) >= set(CHANNELS)
