"""Small hand-made images with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid import ImageFrame, plugin
from lumengrid.functions.color import NAMED, Gradient, hex_color, rgb_to_lab
from lumengrid.operators import blend, canvas, geometry, point, raster, spatial, stats, tiles, warp
from lumengrid.operators.geometry import Path
from lumengrid.plans.views import checkerboard, new_image, to_images, to_pixels
from lumengrid.sources import images


def frame(spark, rows, image_id=1):
    """Pixels from rows (x, y, r, g, b, a)."""
    return spark.createDataFrame([(image_id, *r) for r in rows], "image_id int, x int, y int, r int, g int, b int, a int")


def at(df, x, y):
    return tuple(df.where((F.col("x") == x) & (F.col("y") == y)).select("r", "g", "b", "a").first())


def array(df):
    own = df.toPandas()
    out = np.zeros((own.y.max() + 1, own.x.max() + 1, 4), int)
    out[own.y, own.x] = own[["r", "g", "b", "a"]].to_numpy()
    return out


def random_pixels(spark, width=9, height=7, seed=1):
    r = np.random.default_rng(seed)
    return frame(spark, [(int(x), int(y), *map(int, r.integers(0, 256, 4))) for x in range(width) for y in range(height)])


def test_histogram_skips_transparent(spark):
    px = [(10, 20, 30, 255), (10, 20, 30, 0), (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (10, 20, 30, 255)]
    got = {(r.channel, r.bin): r.cnt for r in stats.histogram(frame(spark, [(i, 0, *p) for i, p in enumerate(px)]), True).collect()}
    assert sum(v for (c, _), v in got.items() if c == "r") == 5
    assert (got["r", 10], got["r", 255], got["g", 255], got["b", 255], got.get(("a", 0), 0)) == (2, 1, 1, 1, 0)


@pytest.mark.parametrize(
    ("bins", "fraction", "want"),
    [({10: 2, 200: 3}, 0.0, (0, 255)), ({50: 42}, 0.05, (50, 50)), ({10: 5, 200: 30, 240: 5}, 0.125, (10, 240))],
)
def test_clip_bounds(spark, bins, fraction, want):
    hist = spark.createDataFrame([(1, "r", b, n) for b, n in bins.items()], "image_id int, channel string, bin int, cnt long")
    row = stats.clip_bounds(hist, fraction).first()
    assert (row.lo, row.hi) == want


def test_levels_lut(spark):
    hist = spark.createDataFrame([(1, "r", 10, 5), (1, "r", 200, 30), (1, "r", 240, 5)], "image_id int, channel string, bin int, cnt long")
    lut = {r.v_in: r.v_out for r in stats.levels_lut(stats.clip_bounds(hist, 0.125)).collect()}
    assert (lut[10], lut[240]) == (0, 255) and abs(lut[125] - 128) <= 1 and len(lut) == 256


def test_auto_tone_stretches(spark):
    px = frame(spark, [(x, y, *([10 if y < 5 else 200] * 3), 255) for x in range(10) for y in range(10)])
    got = array(stats.auto_tone(px))
    assert got[0, 0, 0] <= 5 and got[9, 9, 0] >= 250


def test_auto_color_keeps_dark(spark):
    got = array(stats.auto_color(frame(spark, [(x, y, 6, 4, 5, 255) for x in range(5) for y in range(5)])))
    assert got[..., :3].max() <= 12


def test_area_rect_and_order(spark):
    px = frame(spark, [(x, y, x, y, 0, 255) for x in range(4) for y in range(3)])
    got = geometry.in_area(px, Path.rect(1, 1, 2, 2)).orderBy("y", "x").select("x", "y").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 1), (1, 2), (2, 2)]


def test_feather_weight(spark):
    w = {(r.x, r.y): r.w for r in geometry.area_weight(frame(spark, [(x, y, 255, 255, 255, 255) for x in range(16) for y in range(16)]), Path.rect(2, 2, 8, 8), 4).collect()}
    assert w[6, 6] > 0.8 and 0 < w[3, 3] < 1 and (12, 12) not in w


def test_outside_of_area_is_unchanged(spark):
    px = frame(spark, [(x, y, 255 if (x, y) == (3, 3) else 0, 0, 0, 255) for x in range(8) for y in range(8)])
    got = array(raster.apply_in_area(px, lambda p: raster.gaussian_blur(p, 2), [(Path.rect(2, 2, 4, 4), 0)]))
    assert got[0, 0, 0] == 0 and got[7, 7, 0] == 0 and 0 < got[3, 3, 0] < 255


def test_despeckle_removes_a_speck(spark):
    px = frame(spark, [(x, y, *([255 if (x, y) == (2, 2) else 0] * 3), 255) for x in range(5) for y in range(5)])
    assert at(spatial.despeckle(px, 1, 13), 2, 2) == (0, 0, 0, 255)


def test_contrast_and_brightness(spark):
    assert all(v < 100 for v in at(point.contrast(frame(spark, [(0, 0, 100, 100, 100, 255)]), 50), 0, 0)[:3])
    assert at(point.brightness(frame(spark, [(0, 0, 100, 0, 0, 255)]), 50), 0, 0)[0] == 150


def test_photo_filter(spark):
    got = at(point.photo_filter_preset(frame(spark, [(0, 0, 136, 109, 79, 255)]), "warming-dark", 0.25), 0, 0)[:3]
    lab = frame(spark, [(0, 0, *got, 255), (1, 0, 131, 99, 67, 255)]).orderBy("x").select(*rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert sum((a - b) ** 2 for a, b in zip(*lab, strict=True)) ** 0.5 <= 5


@pytest.mark.parametrize("preset", sorted(point.PHOTO_FILTERS))
def test_photo_filter_presets_follow_their_formula(spark, preset):
    """Linear light times (1 - density) + density * filter; the figure listed for warming-light at 0.8 disagrees with it."""
    linear = lambda v: v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4
    gamma = lambda v: 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
    want = [255 * gamma(linear(v) * (0.2 + 0.8 * linear(f))) for v, f in zip((136, 109, 79), point.PHOTO_FILTERS[preset], strict=True)]
    got = at(point.photo_filter_preset(frame(spark, [(0, 0, 136, 109, 79, 255)]), preset, 0.8), 0, 0)[:3]
    assert all(abs(g - w) <= 0.51 for g, w in zip(got, want, strict=True))


def test_mask_alpha(spark):
    px, mask = frame(spark, [(0, 0, 1, 2, 3, 255), (1, 0, 1, 2, 3, 255)]), frame(spark, [(0, 0, 0, 0, 0, 255), (1, 0, 255, 255, 255, 255)])
    assert array(blend.apply_mask(px, mask))[0, :, 3].tolist() == [0, 255]


def test_skin_mask(spark):
    px = frame(spark, [(x, 0, *((230, 190, 150) if x == 4 else (0, 0, 0)), 255) for x in range(9)])
    assert [r.w for r in raster.skin_mask(px).orderBy("x").collect()] == [0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_box_blur_and_median_against_numpy(spark):
    px = random_pixels(spark)
    own = array(px)
    wide = np.pad(own, ((0, 0), (2, 2), (0, 0)), mode="edge")
    rows = sum(wide[:, k : k + own.shape[1]] for k in range(5)) // 5
    wide = np.pad(rows, ((2, 2), (0, 0), (0, 0)), mode="edge")
    assert (array(spatial.box_blur(px, 2)) == sum(wide[k : k + own.shape[0]] for k in range(5)) // 5).all()
    near = np.lib.stride_tricks.sliding_window_view(np.pad(own, ((2, 2), (2, 2), (0, 0)), mode="edge"), (5, 5), axis=(0, 1)).reshape(*own.shape, 25)
    want = np.sort(near, axis=-1)[..., 12]
    want[..., 3] = own[..., 3]
    assert (array(spatial.median(px, 2)) == want).all()
    assert (array(raster.median_wide(px, 2)) == want).all()


def test_constant_image_survives_filters(spark):
    px = new_image(spark, 12, 9, (80, 90, 100, 255))
    for change in (lambda p: spatial.box_blur(p, 3), lambda p: spatial.median(p, 1), lambda p: raster.motion_blur(p, 20, 4), lambda p: spatial.surface_blur(p, 1, 5), lambda p: warp.resize(p, 12, 9)):
        assert (array(change(px)) == [80, 90, 100, 255]).all()
    assert np.abs(array(raster.gaussian_blur(px, 3)) - [80, 90, 100, 255]).max() <= 2  # weights sum to just below one


@pytest.mark.parametrize("algorithm", ["bilinear", "bicubic", "lanczos", "edge-nedi", "edge-edi"])
def test_resize_keeps_a_constant_inside(spark, algorithm):
    got = array(warp.resize(new_image(spark, 8, 8, (50, 60, 70, 255)), 16, 16, algorithm))
    assert got.shape[:2] == (16, 16) and np.abs(got[6:10, 6:10] - [50, 60, 70, 255]).max() <= 1


def test_choose_algorithm():
    assert warp.choose(None, 100, 100, 40, 100) == "lanczos" and warp.choose("auto", 100, 100, 120, 90) == "bicubic"
    assert warp.choose(None, 100, 100, 90, 100) == "bilinear" and warp.choose("nearest", 1, 1, 9, 9) == "nearest"


def test_rotations(spark):
    px = random_pixels(spark)
    own = array(px)
    assert (array(warp.rotate_quarter(px, 1)) == np.rot90(own, -1)).all() and (array(warp.rotate_quarter(px, 3)) == np.rot90(own, 1)).all()
    assert array(warp.rotate(px, 45)).shape[0] > own.shape[0]
    half = array(warp.rotate(px, 180, "bilinear"))[..., 3]  # places turn, not centres: the first row and column are clear
    assert np.abs(half[1:, 1:] - own[::-1, ::-1, 3][:-1, :-1]).max() <= 1 and not half[0].any() and not half[:, 0].any()


def test_tiles_cover_every_pixel(spark):
    size = spark.createDataFrame([(1, 100, 80), (2, 64, 48), (3, 5, 5)], "image_id int, width int, height int")
    for image_id, own in tiles.generate(size, 32, 8).toPandas().groupby("image_id"):
        width, height = {1: (100, 80), 2: (64, 48), 3: (5, 5)}[image_id]
        seen = np.zeros((height, width), int)
        for t in own.itertuples():
            seen[t.y : t.y + t.height, t.x : t.x + t.width] += 1
        assert seen.min() >= 1 and (own.total == len(own)).all()


def test_tile_process(spark):
    px = random_pixels(spark)
    want = array(px)
    assert np.abs(array(tiles.process(px, 5, 2, lambda t: t))[..., :3] - want[..., :3]).max() <= 1


def test_png_files(spark, tmp_path):
    px = random_pixels(spark).unionByName(frame(spark, [(0, 0, 1, 2, 3, 4)], 2))
    images.write_images(to_images(px), f"file://{tmp_path}/out")
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    rows = images.read_images(spark, f"{tmp_path}/out")
    assert rows.where("error is not null").count() == 1
    back = to_pixels(rows.where("error is null").withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png", 1).cast("int")))
    assert sorted(map(tuple, back.select("image_id", "x", "y", "r", "g", "b", "a").collect())) == sorted(map(tuple, px.collect()))


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_row_filters(kind):
    import struct
    import zlib

    own = np.random.default_rng(kind).integers(0, 256, (4, 5, 4)).astype(np.int32)
    left, up = np.pad(own, ((0, 0), (1, 0), (0, 0)))[:, :-1], np.pad(own, ((1, 0), (0, 0), (0, 0)))[:-1]
    corner = np.pad(own, ((1, 0), (1, 0), (0, 0)))[:-1, :-1]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
    raw = b"".join(bytes([kind]) + row.tobytes() for row in ((own - guess) & 255).astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert images.decode_png(data) == (5, 4, own.astype(np.uint8).tobytes())


def test_gradients(spark):
    g = Gradient.from_to(NAMED["black"], NAMED["white"])
    times = spark.createDataFrame([(-0.1,), (0.0,), (0.5,), (1.0,), (2.0,)], "t double")
    assert [r.r for r in times.select(g.color_at(F.col("t"))["r"].alias("r")).collect()] == [0, 0, 127, 255, 255]
    assert g.reverse().stops[0][0] == NAMED["white"] and Gradient.evenly(*[NAMED["red"]] * 3).stops[1][1] == 0.5


def test_hex(spark):
    rows = spark.createDataFrame([("#ff8000",), ("ff800040",), ("#12",), ("#zz0001",)], "h string").select(hex_color(F.col("h")).alias("c")).collect()
    assert [tuple(r.c) for r in rows] == [(255, 128, 0, 255), (255, 128, 0, 64), (0, 0, 0, 255), (0, 0, 1, 255)]


def test_paths():
    assert Path.line((0, 0), (3, 4)).length() == 5 and Path.line((0, 0), (2, 0)).point_at(0.5) == (1, 0)
    fitted = Path.rect(0, 0, 10, 5).fit(20, 20)
    assert fitted.bounds() == (0, 5, 20, 15) and Path.rect(0, 0, 10, 5).fit(20, 20, "none").bounds() == (0, 0, 20, 20)
    assert Path((0, 0)).cubic_to((0, 4), (4, 4), (4, 0)).end == (4, 0)


def test_unknown_blend_mode_is_normal(spark):
    a, b = random_pixels(spark, seed=2), random_pixels(spark, seed=3)
    assert array(blend.blend(a, b, "no-such-mode")).tolist() == array(blend.blend(a, b, "normal")).tolist()


def test_shadow_and_checker(spark):
    px = new_image(spark, 6, 6).withColumn("a", F.when((F.col("x") == 1) & (F.col("y") == 1), 255).otherwise(0))
    got = array(canvas.drop_shadow(px, (6, 6), (9, 9, 9), 0.5, angle=0.0, distance=3.0, size=1.0))
    assert got.shape == (8, 11, 4) and got[2, 2].tolist() == [0, 0, 0, 255]  # a pixel more on each side, and three to the right
    assert 0 < got[2, 5, 0] <= 9 and 0 < got[2, 5, 3] < 160 and got[2, 5, 3] > got[1, 4, 3] > 0
    assert array(canvas.drop_shadow(px, (6, 6), size=0.0)).tolist() == array(px).tolist()
    assert array(checkerboard(spark, 4, 4, 2))[0, 0, 0] == 200


def test_frame_chains_and_plugins(spark):
    @plugin("twice-inverted")
    def twice(own, **_):
        return own.invert().invert()

    own = ImageFrame.from_pixels(random_pixels(spark))
    assert array(own.apply("twice-inverted").pixels).tolist() == array(own.pixels).tolist()
    assert own.grayscale().box_blur(1).blend(own, "screen", 0.5).within(lambda f: f.invert(), [(Path.rect(0, 0, 3, 3), 1)]).pixels.count() == 63


def test_streams(spark, tmp_path):
    from lumengrid.streaming import subjects

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:01", 1.0), (1, "2024-01-01 00:00:03", 3.0), (2, "2024-01-01 00:00:02", 2.0)], "k long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(folder)
    stream = spark.readStream.schema("k long, ts timestamp, value double").parquet(folder)
    seen = []
    subjects.multicast(stream, [lambda b, e: seen.append(b.count())], str(tmp_path / "ck1")).awaitTermination(60)
    assert seen == [3]
    q = subjects.latest_stream(stream, "k", "ts", "value").writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.value) for r in spark.table("latest").collect()) == [(1, 3.0), (2, 2.0)]
    q = subjects.windows(stream, "ts", "1 minute", "1 minute").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("win").first().n == 3
