"""Turns, affine chains, radial maps and waves against loops over target pixels, whole and by tiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import canvas, raster, warp
from lumengrid.operators.warp import Affine
from tests.test_image_models import frame_of, plain_bicubic
from tests.test_operators import array, random_pixels


def noise(width, height, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4))


def plain_bilinear(image, x, y):
    h, w = image.shape[:2]
    total = np.zeros(4)
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        u, v = math.floor(x) + i, math.floor(y) + j
        if 0 <= u < w and 0 <= v < h:
            a = image[v, u, 3] / 255
            total += (1 - abs(x - u)) * (1 - abs(y - v)) * np.array([*image[v, u, :3] * a, a])
    rgb = total[:3] / total[3] if total[3] > 0 else np.zeros(3)
    return np.floor(np.clip([*rgb, total[3] * 255], 0, 255) + 0.5)


PLAIN = {"bilinear": plain_bilinear, "bicubic": plain_bicubic}


def plain_rotate(image, degrees, sampler):
    h, w = image.shape[:2]
    width, height = warp.rotated_size(w, h, degrees)
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.zeros((height, width, 4))
    for y in range(height):
        for x in range(width):
            dx, dy = x - width / 2, y - height / 2
            out[y, x] = PLAIN[sampler](image, dx * cos + dy * sin + w / 2, -dx * sin + dy * cos + h / 2)
    return out


def close(got, want, share=0.01):
    """Equal but for roundings at a half: single precision of places against double."""
    assert got.shape == want.shape
    visible = (got[..., 3] > 2) & (want[..., 3] > 2)  # colours of what is all but clear are quotients of next to nothing
    off = np.abs(got - want).max(axis=-1)
    assert (off[visible] > 1).mean() <= share and np.abs(got[..., 3] - want[..., 3]).max() <= 1


@pytest.mark.parametrize("degrees", [30.0, 45.0, 90.0, 200.0, -75.0])
@pytest.mark.parametrize("sampler", ["bilinear", "bicubic"])
def test_rotation_is_that_of_every_pixel(spark, monkeypatch, degrees, sampler):
    image = noise(13, 9)
    want = plain_rotate(image, degrees, sampler)
    if degrees == 90.0:  # cosines of quarter turns are not 0 in single precision, so samples at the border differ
        want[0], want[:, 0] = 0, 0
        got = array(warp.rotate(frame_of(spark, image), degrees, sampler))
        return close(got[1:-1, 1:-1], want[1:-1, 1:-1])
    for tile in (512, 5):
        monkeypatch.setattr(raster, "TILE", tile)
        close(array(warp.rotate(frame_of(spark, image), degrees, sampler)), want)


def test_rotated_sizes(spark):
    """In single precision, as columns and as numbers."""
    assert warp.rotated_size(85, 120, 36.87) == (139, 147) or warp.rotated_size(85, 120, 36.87) == (140, 147)
    assert [warp.rotated_size(10, 4, a) for a in (0, 90, 180, 270, -90, 45)] == [(10, 4), (4, 10), (10, 4), (4, 10), (4, 10), (9, 9)]
    cases = [(w, h, a) for w in (1, 7, 85, 300) for h in (1, 50, 120) for a in (0.0, 12.5, 36.87, 90.0, 123.4, -33.3, 359.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, width int, height int, a double")
    got = {r.i: (r.out_w, r.out_h) for r in rows.select("i", *[c.alias(k) for k, c in warp._rotated_columns(F.col("a")).items()]).collect()}
    assert got == {i: warp.rotated_size(*c) for i, c in enumerate(cases)}


def test_each_image_by_its_own_angle(spark):
    px = frame_of(spark, noise(8, 6)).unionByName(frame_of(spark, noise(5, 9, 2)).withColumn("image_id", F.lit(4)))
    angles = spark.createDataFrame([(0, 20.0), (4, 110.0), (9, 1.0)], "image_id int, degrees double")
    both = warp.rotate(px, angles, None)
    for i, image, a in ((0, noise(8, 6), 20.0), (4, noise(5, 9, 2), 110.0)):
        assert (array(both.where(F.col("image_id") == i)) == array(warp.rotate(frame_of(spark, image), a, None))).all()


def test_turned_canvases_are_turned_images(spark):
    image, under = noise(10, 8), noise(12, 12, 3)
    px = frame_of(spark, image)
    turned = canvas.render(canvas.Canvas.of(px, 10, 8).turned(30.0, "bilinear"))
    model = plain_rotate(image, 30.0, "bilinear")[:8, :10]
    over = lambda a, b: np.trunc(np.clip(source_over(a, b), 0, 255))
    close(array(turned), over(np.zeros((8, 10, 4)), model), 0.05)
    child = canvas.Canvas.of(px, 10, 8).rotated(45.0).positioned(-1, 2)
    got = array(canvas.render(canvas.Canvas(frame_of(spark, under), (12, 12)).add_canvas(child)))
    flat = plain_rotate(np.trunc(source_over(np.zeros((8, 10, 4)), image)), 45.0, "bicubic")
    want = under.astype(float)
    for y in range(12):
        for x in range(12):
            if 0 <= y - 2 < flat.shape[0] and 0 <= x + 1 < flat.shape[1]:
                want[y, x] = over(want[y, x], flat[y - 2, x + 1])
    close(got, want, 0.1)


def source_over(a, b):
    """A normal blend, composited once more by its own alpha, as layers are drawn."""
    ua, ub = a[..., 3:] / 255, b[..., 3:] / 255
    mixed = np.trunc(np.concatenate([(b[..., :3] / 255 * ub + a[..., :3] / 255 * ua * (1 - ub)) * 255, (ub + ua * (1 - ub)) * 255], axis=-1) + 1e-4)
    top = mixed[..., 3:] / 255
    out = top + ua * (1 - top)
    rgb = np.where(out > 0, (mixed[..., :3] * top + a[..., :3] * ua * (1 - top)) / np.where(out > 0, out, 1), 0)
    return np.concatenate([rgb, out * 255], axis=-1) + 1e-4


@pytest.mark.parametrize("amount", [0.8, -0.6, 1.0])
def test_pinch_is_that_of_every_pixel(spark, monkeypatch, amount):
    image = noise(31, 24)
    h, w = image.shape[:2]
    want = image.astype(float)
    power = 1 - amount / 2
    for y in range(h):
        for x in range(w):
            dx, dy = x - w / 2, y - h / 2
            r = math.hypot(dx, dy) / 12
            if r < 1:
                k = r**power / r if r else 1
                want[y, x] = plain_bilinear(image, min(max(w / 2 + dx * k, 0), w - 1), min(max(h / 2 + dy * k, 0), h - 1))
    for tile in (512, 6):
        monkeypatch.setattr(raster, "TILE", tile)
        close(array(warp.pinch(frame_of(spark, image), amount)), want)


@pytest.mark.parametrize("shape", ["circular", "square", "random", 35.0])
@pytest.mark.parametrize("amount", [0.2, -0.5])
def test_tiles_of_ripples_change_nothing(spark, monkeypatch, shape, amount):
    px = random_pixels(spark, 41, 33, seed=4)
    whole = array(warp.ripple(px, amount, "small", shape))
    monkeypatch.setattr(raster, "TILE", 8)
    assert (array(warp.ripple(px, amount, "small", shape)) == whole).all()


def test_images_wider_than_a_tile(spark):
    """700 x 600 turned and pinched over tile borders of 512: smooth images stay smooth."""
    y, x = np.mgrid[0:600, 0:700]
    image = np.stack([x * 255 // 700, y * 255 // 600, (x + y) * 255 // 1300, np.full_like(x, 255)], axis=-1)
    px = frame_of(spark, image)
    turned = array(warp.rotate(px, 30.0))
    cos, sin = math.cos(math.radians(30)), math.sin(math.radians(30))
    height, width = turned.shape[:2]
    assert (width, height) == warp.rotated_size(700, 600, 30.0)
    for ty, tx in ((height // 2, width // 2), (511, 511), (512, 512), (300, 512), (512, 400)):
        dx, dy = tx - width / 2, ty - height / 2
        assert np.abs(turned[ty, tx] - plain_bilinear(image, dx * cos + dy * sin + 350, -dx * sin + dy * cos + 300)).max() <= 1
    pulled = array(warp.pinch(px, 0.9))
    assert pulled.shape == image.shape
    for ty, tx in ((300, 511), (300, 512), (511, 350), (512, 350), (511, 511), (100, 120), (301, 352)):
        r = math.hypot(tx - 350, ty - 300) / 300
        k = r**0.55 / r
        assert np.abs(pulled[ty, tx] - plain_bilinear(image, 350 + (tx - 350) * k, 300 + (ty - 300) * k)).max() <= 1


def test_chains_are_sampled_once(spark):
    """Two turns are one of their sum, and there and back is nothing, whatever comes between."""
    px = frame_of(spark, noise(11, 8))
    layer = canvas.Layer(px, size=(11, 8))
    key = lambda own: ((own.x, own.y, own.size), array(own.pixels))
    one, two = key(layer.spun(45.0).sampled()), key(layer.spun(30.0).spun(15.0).sampled())
    assert one[0] == two[0] and np.abs(one[1] - two[1]).max() <= 1
    back = layer.spun(33.0).stretched(2.0, 0.5).stretched(0.5, 2.0).spun(-33.0).sampled()
    assert (back.x, back.y, back.size) == (0, 0, (11, 8)) and (array(back.pixels) == array(px)).all()
    quarter = layer.spun(90.0, "top-left").sampled()
    assert (quarter.x, quarter.y, quarter.size) == (-8, 0, (8, 11)) and (array(quarter.pixels) == np.rot90(array(px), -1)).all()


def test_affine_is_that_of_every_pixel(spark, monkeypatch):
    image = noise(12, 9)
    matrix = Affine().turned(25.0, (6, 4)).sheared(0.3, -0.1).scaled(1.4, 0.8).moved(2.5, -1.25)
    left, top, width, height = box = matrix.box(12, 9)
    back = np.linalg.inv(np.array([[matrix.a, matrix.c, matrix.e], [matrix.b, matrix.d, matrix.f], [0, 0, 1]]))
    want = np.zeros((height, width, 4))
    for y in range(height):
        for x in range(width):
            sx, sy, _ = back @ [x + left + 0.5, y + top + 0.5, 1]
            want[y, x] = plain_bicubic(image, sx - 0.5, sy - 0.5)
    for tile in (512, 5):
        monkeypatch.setattr(raster, "TILE", tile)
        close(array(warp.affine(frame_of(spark, image), matrix, box)), want)
    with pytest.raises(ValueError):
        Affine(a=0.0).inverse()


def test_canvas_turns_about_its_origin(spark):
    px = frame_of(spark, noise(6, 4))
    own = canvas.Canvas.blank(px, 20, 20).add_layer(canvas.Layer(px, size=(6, 4), x=2, y=3))
    assert canvas.origin_place("center", (7, 5)) == (3, 2) and canvas.origin_place("bottom-right", (7, 5)) == (7, 5) and canvas.origin_place((0.25, 0.5), (8, 6)) == (2, 3)
    spun = array(canvas.render(own.with_origin("center").spun(90.0)))
    want = np.zeros((20, 20, 4))
    want[2:8, 13:17] = np.rot90(array(canvas.render(own))[3:7, 2:8], -1)
    assert (spun == want).all()
    twice = array(canvas.render(own.spun(50.0).spun(40.0)))
    assert np.abs(twice - want).max() <= 1


def test_sizes_in_single_precision(spark):
    assert [warp.scaled_size((100, 100), k)[0] for k in (0.29, 0.53, 0.57, 0.58, 0.59)] == [29, 52, 57, 58, 58]  # doubles give 28, 53, 56, 57, 59
    assert warp.width_size((100, 60), 33) == (33, 19) and warp.height_size((100, 60), 33) == (55, 33)
    assert warp.relative_size((100, 60), dx=-10) == (90, 54) and warp.relative_size((100, 60), dy=-200) == (1, 1) and warp.relative_size((9, 9)) == (9, 9)
    px = frame_of(spark, noise(10, 6))
    layer = canvas.Layer(px, size=(10, 6))
    sizes = [own.size for own in (layer.resized_by(0.5), layer.resized_by(0), layer.resized_width(5), layer.resized_height(3), layer.widened(10), layer.heightened(-3))]
    assert sizes == [(5, 3), (10, 6), (5, 3), (5, 3), (20, 12), (5, 3)]
    assert array(layer.resized_width(5).pixels).shape == (3, 5, 4)


def test_crops_cut_pixels(spark):
    image = noise(10, 8)
    px = frame_of(spark, image)
    assert (array(canvas.Layer(px, size=(10, 8)).cropped(2, 3, 5, 4).pixels) == image[3:7, 2:7]).all()
    own = canvas.Canvas.of(px, 10, 8).add_layer(canvas.Layer(px, "multiply", x=20, y=1, size=(10, 8))).add_layer(canvas.Layer(px, x=-3, y=4, size=(10, 8)))
    cut = own.cropped(4, 2, 5, 4)
    assert [(c.x, c.y, c.size) for c in cut.layers] == [(0, 0, (5, 4)), (0, 0, (0, 0)), (0, 2, (3, 2))] and cut.size == (5, 4)
    assert (array(canvas.render(cut)) == array(canvas.render(own))[2:6, 4:9]).all()


def test_empty_canvases_are_skipped(spark):
    px = frame_of(spark, noise(5, 4))
    empty = canvas.Canvas.blank(px, 0, 7).add_layer(canvas.Layer(px))
    assert (array(canvas.render(canvas.Canvas(px, (5, 4)).add_canvas(empty))) == array(px)).all()
    assert canvas.Canvas.blank(px, 0, 7).pixels.count() == 0
