"""Image operators against plain models: loops over pixels, and figures worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions.color import Gradient
from lumengrid.operators import canvas, point, raster, shapes, spatial, tiles, warp
from lumengrid.operators.geometry import Path, aspect_ratio
from lumengrid.plans.views import CHANNELS, new_image, to_images, to_pixels
from lumengrid.sources import images
from tests.test_operators import array, random_pixels


def frame_of(spark, image):
    h, w = image.shape[:2]
    rows = spark.createDataFrame([(0, w, h, bytearray(image.astype(np.uint8).tobytes()))], "image_id int, width int, height int, rgba binary")
    return to_pixels(rows)


def test_large_images_become_rows_and_back(spark):
    """A million pixels, both ways."""
    image = np.random.default_rng(1).integers(0, 256, (1000, 1000, 4)).astype(np.uint8)
    rows = spark.createDataFrame([("a", 1000, 1000, bytearray(image.tobytes()))], "image_id string, width int, height int, rgba binary")
    assert to_pixels(rows).agg(F.count("*"), F.sum("r")).first() == (10**6, int(image[..., 0].sum()))
    back = to_images(to_pixels(rows)).first()
    assert (back.image_id, back.width, back.height) == ("a", 1000, 1000) and bytes(back.rgba) == image.tobytes()


@pytest.mark.parametrize("size, tile, overlap, starts", [(490, 256, 16, [0, 234, 234]), (250, 256, 16, [0, 240]), (256, 256, 16, [0, 240]), (10, 6, 2, [0, 4, 4]), (5, 6, 2, [0, 4]), (1, 6, 2, [0])])
def test_tile_starts(spark, size, tile, overlap, starts):
    rows = spark.createDataFrame([(0, size, 1)], "image_id int, width int, height int")
    got = tiles.generate(rows, tile, overlap).orderBy("idx").collect()
    want = [s if s + tile <= size or size <= tile else size - tile for s in starts]
    assert [r.x for r in got] == want and [r.width for r in got] == [min(tile, size - s) for s in want] and {r.total for r in got} == {len(starts)}


def test_cut_is_generate(spark):
    """Each pixel lies in the tiles whose rectangle holds it."""
    px = random_pixels(spark, 13, 9)
    sizes = spark.createDataFrame([(0, 13, 9)], "image_id int, width int, height int")
    want = {(t.idx, x, y, x - t.x, y - t.y) for t in tiles.generate(sizes, 6, 2).collect() for x in range(t.x, t.x + t.width) for y in range(t.y, t.y + t.height)}
    got = [(r.idx, r.x, r.y, r.tx, r.ty) for r in tiles.cut(px, 6, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("algorithm", ["bilinear", "bicubic", "lanczos", "edge-nedi", "edge-edi", None])
@pytest.mark.parametrize("size", [(31, 40), (11, 9), (23, 17)])
def test_target_tiles_change_nothing(spark, monkeypatch, algorithm, size):
    px = random_pixels(spark, 23, 17, seed=4)
    whole = array(warp.resize(px, *size, algorithm))
    monkeypatch.setattr(raster, "TILE", 7)
    assert np.abs(array(warp.resize(px, *size, algorithm)) - whole).max() <= 1 and whole.shape == (size[1], size[0], 4)


@pytest.mark.parametrize("make", [
    lambda p: raster.gaussian_blur(p, 3), lambda p: raster.motion_blur(p, 30.0, 5), lambda p: raster.lens_blur(p, 2), lambda p: raster.median_wide(p, 2),
    lambda p: raster.smooth_skin(p, 0.8), lambda p: spatial.surface_blur(p, 3, 40), lambda p: spatial.despeckle(p, 3, 20.0),
])
def test_halo_tiles_change_nothing(spark, monkeypatch, make):
    px = random_pixels(spark, 23, 17, seed=4)
    whole = array(make(px))
    monkeypatch.setattr(raster, "TILE", 7)
    assert (array(make(px)) == whole).all()


def test_wide_neighbourhoods_equal_rows(spark, monkeypatch):
    px = random_pixels(spark, 12, 9, seed=5)
    monkeypatch.setattr(spatial, "NEAR", 3)
    rows = [array(f) for f in (spatial.median(px, 3), spatial.surface_blur(px, 3, 60), spatial.despeckle(px, 3, 30.0))]
    monkeypatch.setattr(spatial, "NEAR", 2)
    for a, b in zip(rows, (spatial.median(px, 3), spatial.surface_blur(px, 3, 60), spatial.despeckle(px, 3, 30.0)), strict=True):
        assert (a == array(b)).all()


def test_skin_mask_is_feathered(spark):
    """A lone skin pixel of a 9 x 1 image: the mask's feather is 2, so a fifth of a fifth of it reaches two places away."""
    image = np.zeros((1, 9, 4))
    image[..., 3] = 255
    image[0, 4, :3] = (230, 190, 150)
    got = array(raster.smooth_skin(frame_of(spark, image), 1.0))
    grey = math.floor(255 / 5 / 5 + 0.5)
    kernel = raster.normal_weights(1)
    soft = [int(230 * kernel[2]), int(230 * kernel[1]), int(230 * kernel[0])]
    want = [int(np.float32(s) * np.float32(grey / 255) + np.float32(o) * np.float32(1 - grey / 255)) for s, o in zip(soft, (0, 230, 0), strict=True)]
    assert abs(got[0, 3:6, 0] - np.array(want)).max() <= 1 and got[0, 4, 0] < 230 and got[0, 0, 0] == 0


def test_lens_offsets_by_hand():
    """The first sample of a hexagon with half curvature lies on the spiral's angle 0."""
    own = raster.iris(8, 32, 6, 0.5, 0.0)
    reach = math.sqrt(0.5 / 32) * (0.5 * 8 * math.cos(math.pi / 6) / math.cos(-math.pi / 6) + 0.5 * 8)
    assert np.allclose(own[0], (reach, 0))
    turn = 2 * math.pi * raster.GOLDEN
    polygon = 8 * math.cos(math.pi / 6) / math.cos(math.fmod(turn, math.pi / 3) - math.pi / 6)
    reach = math.sqrt(1.5 / 32) * (0.5 * polygon + 4)
    assert np.allclose(own[1], (reach * math.cos(turn), reach * math.sin(turn)))
    assert np.hypot(*own.T).max() <= 8


def plain_bicubic(image, x, y):
    def weight(t):
        t = abs(t)
        return 1 - 2 * t * t + t**3 if t < 1 else -4 + 8 * t - 5 * t * t + t**3 if t < 2 else 0.0

    h, w = image.shape[:2]
    total, norm = np.zeros(4), 0.0
    for j in range(math.floor(y) - 1, math.floor(y) + 3):
        for i in range(math.floor(x) - 1, math.floor(x) + 3):
            k = weight(x - i) * weight(y - j)
            norm += k
            if 0 <= i < w and 0 <= j < h:
                a = image[j, i, 3] / 255
                total += k * np.array([*image[j, i, :3] * a, a])
    a = total[3] / norm if norm else 0.0
    rgb = total[:3] / total[3] if total[3] > 1e-9 else np.zeros(3)
    return np.floor(np.clip([*rgb, a * 255], 0, 255) + 0.5)


@pytest.mark.parametrize("shape", ["circular", "square", "random", 30.0])
def test_ripple_sources(spark, shape):
    image = np.random.default_rng(3).integers(0, 256, (9, 11, 4)).astype(float)
    image[..., 3] = 255
    got = array(warp.ripple(frame_of(spark, image), 0.2, "large", shape))
    h, w = image.shape[:2]
    bad = 0
    for y in range(h):
        for x in range(w):
            dx, dy, reach = x - w / 2, y - h / 2, 0.2 * 50
            if shape == "random":
                sx = ((((x * 73856093) ^ (y * 19349663)) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) % 2000 / 1000 - 1
                sy = ((((x * 83492791) ^ (y * 23911681)) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) % 2000 / 1000 - 1
                px, py = x + sx * reach * 0.2, y + sy * reach * 0.2
            elif shape == 30.0:
                c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
                u, v = x * s + y * c, x * c - y * s
                wave = math.sin(u * 2 * math.pi / 15 / (1 + math.sin(u * 0.05) * 0.15)) * reach * (1 + math.sin(u * 0.13) * 0.08)
                drift = math.sin(v * 0.03 + u * 0.07) * reach * 0.35
                px, py = x + wave * s + drift * c, y + wave * c - drift * s
            else:
                d = max(abs(dx), abs(dy)) if shape == "square" else math.hypot(dx, dy)
                r = d + math.sin(d / 15) * reach * 0.2
                px, py = w / 2 + r * math.cos(math.atan2(dy, dx)), h / 2 + r * math.sin(math.atan2(dy, dx))
            want = plain_bicubic(image, min(max(px, 0), w - 1), min(max(py, 0), h - 1))
            bad += np.abs(got[y, x] - want).max() > 1
    assert bad == 0


def test_pinch_has_solid_edges(spark):
    image = np.full((8, 8, 4), 255.0)
    for amount in (0.9, -0.9):
        assert (array(warp.pinch(frame_of(spark, image), amount)) == 255).all()


@pytest.mark.parametrize("before, after, name", [((5, 5), (2, 2), "bilinear"), ((5, 5), (1, 2), "lanczos"), ((6, 6), (3, 3), "bilinear"), ((6, 6), (2, 3), "lanczos"), ((5, 5), (7, 5), "bicubic"), ((5, 5), (5, 5), "bicubic")])
def test_choice_of_samplers(before, after, name):
    assert warp.choose("auto", *before, *after) == name


def plain_edges(image, x, y, algorithm):
    """One place by loops: the axis of the gradients around it, or one of four directions."""
    h, w = image.shape[:2]

    def pixel(i, j):
        if not (0 <= i < w and 0 <= j < h):
            return np.zeros(4)
        a = image[j, i, 3] / 255
        return np.array([*image[j, i, :3] * a, a])

    def luma(i, j):
        p = pixel(i, j)
        return (0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]) / p[3] if p[3] > 0 else 0.0

    def line(sx, sy):
        i, j = math.floor(sx), math.floor(sy)
        u, v = sx - i, sy - j
        return (pixel(i, j) * (1 - u) + pixel(i + 1, j) * u) * (1 - v) + (pixel(i, j + 1) * (1 - u) + pixel(i + 1, j + 1) * u) * v

    def straight(p):
        return np.floor(np.clip([*(p[:3] / p[3] if p[3] > 0 else (0, 0, 0)), p[3] * 255], 0, 255) + 0.5)

    i, j = math.floor(x), math.floor(y)
    u, v = x - i, y - j
    if algorithm == "edge-nedi":
        g = np.array([((luma(i + p + 1, j + q) - luma(i + p - 1, j + q)) / 2, (luma(i + p, j + q + 1) - luma(i + p, j + q - 1)) / 2) for q in range(-2, 3) for p in range(-2, 3)])
        cov = np.cov(g.T, bias=True)
        if math.sqrt(np.trace(cov)) <= 5:
            return plain_bicubic(image, x, y)
        values, vectors = np.linalg.eigh(cov)
        axis = vectors[:, 1]
        axis = axis * (1 if abs(cov[0, 1]) <= 1e-6 or axis[1] * cov[0, 1] > 0 else -1)
        t = (u * axis[0] + v * axis[1] + 1) / 2
        return straight(line(i - axis[0], j - axis[1]) * (1 - t) + line(i + axis[0], j + axis[1]) * t)
    around = np.array([[luma(i + p, j + q) for p in (-1, 0, 1)] for q in (-1, 0, 1)])
    sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    gx, gy = (around * sobel).sum(), (around * sobel.T).sum()
    if math.hypot(gx, gy) <= 10:
        return straight(line(x, y))
    angle = math.atan2(gy, gx) % math.pi if math.atan2(gy, gx) < 0 else math.atan2(gy, gx)
    direction = math.floor(angle / math.pi * 4 + 0.5) % 4
    pairs = {0: ((i, j), (i + 1, j), u), 1: ((i, j), (i + 1, j + 1), (u + v) / 2), 2: ((i, j), (i, j + 1), v), 3: ((i + 1, j), (i, j + 1), (u + v) / 2)}
    a, b, t = pairs[direction]
    return straight(pixel(*a) * (1 - t) + pixel(*b) * t)


@pytest.mark.parametrize("algorithm", ["edge-nedi", "edge-edi"])
def test_edge_directed_resize(spark, algorithm):
    image = np.random.default_rng(8).integers(0, 256, (7, 6, 4)).astype(float)
    image[2:4, 2:5] = (100, 120, 90, 255)
    image[..., 3] = np.where(image[..., 3] < 60, 0, 255)
    got = array(warp.resize(frame_of(spark, image), 11, 13, algorithm))
    off = [np.abs(got[y, x] - plain_edges(image, (x + 0.5) * 6 / 11 - 0.5, (y + 0.5) * 7 / 13 - 0.5, algorithm)).max() for y in range(13) for x in range(11)]
    assert np.mean(np.array(off) <= 1) > 0.97  # axes of equal spread may turn either way


@pytest.mark.parametrize("hardness, t, strength", [(0.0, 0.5, 0.75), (0.25, 0.5, 0.625), (0.5, 0.25, 0.75), (0.75, 0.25, 0.875), (1.0, 0.49, 1.0), (1.0, 0.5, 0.0), (0.3, 1.0, 0.0)])
def test_dab_curve(spark, hardness, t, strength):
    got = spark.range(1).select(raster.dab(8.0, hardness, F.lit(4.0 * t))).first()[0]
    assert got == pytest.approx(strength)


def test_dabs_add_up(spark):
    """A pixel's alpha is the mean over its four points of the clamped sum over all dabs."""
    area = Path.rect(1.0, 1.0, 6.0, 4.0)
    px = new_image(spark, 9, 7)
    got = array(shapes.fill_with_dabs(px, area, 2.0, (10, 20, 30, 200), 0.2))
    centers, radius = shapes.dab_centers(area, 2.0)
    assert radius == 1.0 and len(centers) > 20

    def curve(d):
        t = d / radius
        return max((1 - t * t) * 0.6 + (1 - t) * 0.4, 0) if t < 1 else 0.0

    for x, y in ((1, 1), (3, 2), (6, 4), (0, 0), (8, 3)):
        total = 0
        for k in range(4):
            sx, sy = x + (k % 2 + 0.5) / 2, y + (k // 2 + 0.5) / 2
            if 1 < sx < 7 and 1 < sy < 5:
                total += math.floor(min(sum(curve(math.dist((sx, sy), c)) for c in centers) * 200, 255))
        assert abs(int(got[y, x, 3]) - int(total / 4)) <= 2, (x, y)


def test_outlines_by_hand():
    line = Path((0.0, 0.0)).line_to((10.0, 0.0))
    assert shapes.outline(line, 2.0).points[:4] == [(0.0, 1.0), (10.0, 1.0), (10.0, -1.0), (0.0, -1.0)]
    assert shapes.outline(line, 2.0, "square").bounds() == (-1.0, -1.0, 11.0, 1.0)
    assert shapes.outline(line, 2.0, "round").bounds() == pytest.approx((-1.0, -1.0, 11.0, 1.0))
    corner = Path((0.0, 0.0)).line_to((10.0, 0.0)).line_to((10.0, 10.0))
    assert shapes.outline(corner, 2.0).points[1] == (9.0, 0.0) and len(shapes.outline(corner, 2.0, join="round").points) > 20
    ring = shapes.area_outline(Path.rect(0.0, 0.0, 10.0, 10.0), 2.0)
    assert len(ring.points) == 9 and {round(math.dist(p, min(((0, 0), (10, 0), (10, 10), (0, 10)), key=lambda c: math.dist(p, c))), 6) for p in ring.points} == {1.0}
    assert Path.rect(1.0, 2.0, 4.0, 3.0).to_viewbox() == (1.0, 2.0, 4.0, 3.0) and aspect_ratio((0, 0, 4, 3)) == 4 / 3 and aspect_ratio((0, 0, 4, 0)) == 1


def test_lowest_layer_is_normal(spark):
    under, top = random_pixels(spark, 5, 4, seed=6), random_pixels(spark, 5, 4, seed=7).withColumn("a", F.lit(255))
    got = array(canvas.composite(under, [canvas.Layer(top, "multiply", visible=False), canvas.Layer(top, "multiply")]))
    assert (got[..., :3] == array(top)[..., :3]).all()


def test_gradient_runs_along_its_path(spark):
    along = Gradient.from_to((0, 0, 0, 255), (200, 0, 0, 255)).with_direction(Path((0.0, 0.0)).line_to((0.0, 10.0)))
    got = array(raster.fill(spark, Path.rect(0.0, 0.0, 6.0, 10.0), along))
    assert (got[:, :, 0] == np.array([int(200 * (y + 0.5) / 10) for y in range(10)])[:, None]).all()


@pytest.mark.parametrize("change", [point.invert, point.grayscale, lambda p: point.invert(p), point.flip_horizontal])
def test_areas_mix_in_place(spark, change):
    """Projections beside the old pixel and joins by place give the same."""
    px = random_pixels(spark, 10, 8, seed=9)
    area = Path.polygon((1.0, 1.0), (9.0, 2.0), (4.0, 7.0))
    own = (lambda p: point.flip_horizontal(p, 10)) if change is point.flip_horizontal else change
    got = array(raster.apply_in_area(px, own, [(area, 2)]))
    inside = array(px.withColumn("a", F.round(raster.geometry.weight_of(area, 2) * 1000).cast("int")))[..., 3] / 1000
    old, new = array(px), array(own(px))
    want = np.where(inside[..., None] > 0, np.trunc(new * inside[..., None] + old * (1 - inside[..., None])), old)
    assert np.abs(got - want).max() <= 1


def test_images_of_three_channels(spark):
    from lumengrid.plans.views import from_rgb

    rows = spark.createDataFrame([(1, 2, 1, bytearray([1, 2, 3, 4, 5, 6]))], "image_id int, width int, height int, rgb binary")
    assert array(to_pixels(from_rgb(rows))).tolist() == [[[1, 2, 3, 255], [4, 5, 6, 255]]]


def test_gif_files(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (20, 30, 4)).astype(np.uint8)
    image[..., :2] //= 64
    image[..., 2], image[..., 3] = 7, 255
    rows = spark.createDataFrame([(3, 30, 20, bytearray(image.tobytes()))], "image_id int, width int, height int, rgba binary")
    images.write_images(rows, f"file://{tmp_path}", "gif")
    (tmp_path / "broken.gif").write_bytes(b"GIF89a but no more")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert bytes(got["3.gif"].rgba) == image.tobytes() and got["broken.gif"].rgba is None and got["broken.gif"].error
    found = images.read_images(spark, str(tmp_path))
    assert images.first_of(found).first().path.endswith("3.gif") and images.numbered(found, 1).first().path.endswith("broken.gif") and images.numbered(found, 2).count() == 0
    many = np.zeros((1, 300, 4), np.uint8)
    many[0, :, 0], many[0, :, 1], many[..., 3] = np.arange(300) % 256, np.arange(300) // 256 * 3, 255
    _, _, back = images.decode_gif(images.encode_gif(many.tobytes(), 300, 1))
    back = np.frombuffer(back, np.uint8).reshape(300, 4)
    assert (back[:256] == many[0, :256]).all() and (back[256:, 0] == many[0, 256:, 0]).all() and (back[256:, 1] == 0).all()


def test_canvas_transforms_of_sizes(spark):
    own = canvas.Canvas.of(random_pixels(spark, 8, 6), 8, 6).add_layer(canvas.Layer(random_pixels(spark, 4, 3), x=3, y=1, size=(4, 3)))
    wide = own.resized(12, 12)
    assert wide.size == (12, 12) and [(v.size, v.x, v.y) for v in wide.layers] == [((12, 12), 0, 0), ((6, 6), 5, 2)]
    assert own.resized_by(0.5).size == (4, 3) and own.resized(8, 6) is own
    across = own.resized_width(16)
    assert across.size == (16, 6) and [(v.size, v.x) for v in across.layers] == [((16, 6), 0), ((8, 3), 6)]
    grown = own.heightened(4)
    assert grown.size == (13, 10) and [(v.size, v.y) for v in grown.layers] == [((13, 10), 0), ((9, 7), 1)]  # in proportion
    assert own.turned(90.0).layers[1].size == (3, 4)
    assert array(canvas.render(own.flipped("y"))).shape == (6, 8, 4)


def test_last_rows_of_a_stream(spark, tmp_path):
    from lumengrid.streaming import subjects

    rows = [(k, i, float(i * 10 + k)) for i in range(7) for k in (1, 2)]
    made = spark.createDataFrame(rows, "user long, t int, value double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")

    def all_of(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = all_of(subjects.replay_stream(stream(), "user", "ts", "value", 3), "replayed", "update")
    assert sorted((r.user, r.n, r.value) for r in got) == sorted((k, n, float((7 - n) * 10 + k)) for k in (1, 2) for n in (1, 2, 3))
    got = all_of(subjects.history_stream(stream(), "user", "ts", "value"), "numbered", "append")
    assert sorted((r.user, r["index"], r.value) for r in got) == sorted((k, i, float(i * 10 + k)) for i in range(7) for k in (1, 2))
