"""Every image query without a DuckDB text, run over the smallest tables, against a model of plain loops and formulas over each image."""

import colorsys
import math

import numpy as np
import pytest

from lumengrid.operators import collage, shapes, warp
from lumengrid.operators.geometry import Path
from lumengrid.plans import area_queries, pixel_queries, scene_queries, tree_queries
from lumengrid.plans.views import CHANNELS, pixels_base, pixels_large, pixels_top, sizes
from tests.test_areas import away, wound
from tests.test_image_models import plain_bicubic
from tests.test_turns import plain_bilinear, plain_rotate, source_over

QUERIES = {**pixel_queries.QUERIES, **scene_queries.QUERIES, **area_queries.QUERIES, **tree_queries.QUERIES}
SQL = {**pixel_queries.SQL, **scene_queries.SQL, **area_queries.SQL, **tree_queries.SQL}


def images_of(df):
    """Each image as an array [height, width, 4] of floats; absent pixels are clear."""
    rows = df.select("image_id", "x", "y", *CHANNELS).toPandas()
    out = {}
    for i, own in rows.groupby("image_id"):
        image = np.zeros((own.y.max() + 1, own.x.max() + 1, 4))
        image[own.y, own.x] = own[list(CHANNELS)].to_numpy()
        out[i] = image
    return out


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return images_of(pixels_base(spark, sf_dir))


@pytest.fixture(scope="module")
def top(spark, sf_dir):
    return images_of(pixels_top(spark, sf_dir))


@pytest.fixture(scope="module")
def large(spark, sf_dir):
    return images_of(pixels_large(spark, sf_dir))


def places(image):
    return [(x, y) for y in range(image.shape[0]) for x in range(image.shape[1])]


def over_all(image, value):
    """value(x, y) at each place."""
    out = np.zeros_like(image)
    for x, y in places(image):
        out[y, x] = value(x, y)
    return out


def clamp(v):
    return np.clip(v, 0, 255)


def at(image, x, y):
    return image[min(max(y, 0), image.shape[0] - 1), min(max(x, 0), image.shape[1] - 1)]


# --- blurs ---------------------------------------------------------------------------------------------------------


def gauss(image, radius):
    own = [math.exp(-k * k / (2 * (radius / 2) ** 2)) for k in range(-radius, radius + 1)]
    own = [w / sum(own) for w in own]
    rows = over_all(image, lambda x, y: np.trunc(clamp(sum(w * at(image, x + k - radius, y) for k, w in enumerate(own)) + 1e-5)))
    return over_all(image, lambda x, y: np.trunc(clamp(sum(w * at(rows, x, y + k - radius) for k, w in enumerate(own)) + 1e-5)))


def mixed(image, x, y):
    """Between four pixels, edges repeated."""
    u, v = math.floor(x), math.floor(y)
    fx, fy = x - u, y - v
    return (at(image, u, v) * (1 - fx) + at(image, u + 1, v) * fx) * (1 - fy) + (at(image, u, v + 1) * (1 - fx) + at(image, u + 1, v + 1) * fx) * fy


def motion(image):
    dx, dy = math.cos(math.radians(30)), math.sin(math.radians(30))
    return over_all(image, lambda x, y: np.trunc(sum(mixed(image, x + k * dx, y + k * dy) for k in range(-2, 3)) / 5))


def lens(image):
    spots = []
    for k in range(32):
        turn = 2 * math.pi * (k * 0.61803398875 % 1.0)
        flat = 2 * math.cos(math.pi / 6) / math.cos(math.fmod(turn, math.pi / 3) - math.pi / 6)
        reach = math.sqrt((k + 0.5) / 32) * (flat * 0.5 + 2 * 0.5)
        spots.append((reach * math.cos(turn), reach * math.sin(turn)))
    return over_all(image, lambda x, y: np.trunc(sum(mixed(image, x + dx, y + dy) for dx, dy in spots) / 32))


def skin(image):
    h, w = image.shape[:2]
    mask = np.zeros((h, w))
    for x, y in places(image):
        hue, s, v = colorsys.rgb_to_hsv(*image[y, x, :3] / 255)
        mask[y, x] = 0 <= hue * 360 <= 50 and 0.12 <= s <= 0.68 and v >= 0.25
    feather, radius = min(5, max(1, max(w, h) // 4)), min(8, max(1, max(w, h) // 8))
    wide = np.pad(mask, feather)
    grey = np.array([[math.floor(min(wide[y : y + 2 * feather + 1, x : x + 2 * feather + 1].sum() / (2 * feather + 1) ** 2, 1) * 0.8 * 255 + 0.5) for x in range(w)] for y in range(h)])
    soft, k = gauss(image, radius), (grey / 255)[..., None]
    return np.where(k > 0, np.trunc(soft * k + image * (1 - k) + 1e-4), image)


# --- brushes and areas ---------------------------------------------------------------------------------------------


def dab(size, hardness, d):
    t = d / (size / 2)
    if t >= 1:
        return 0.0
    line = 1 - t
    if hardness < 0.5:
        return max((1 - t * t) * (1 - 2 * hardness) + line * 2 * hardness, 0)
    return max(line * (2 - 2 * hardness) + (t < 0.5) * (2 * hardness - 1), 0)


def brushed(image, strength, color):
    """A colour drawn over by a strength at each place."""

    def value(x, y):
        s = strength(x, y)
        alpha = math.floor(color[3] * s + 1e-5) / 255
        if s <= 0:
            return image[y, x]
        under = image[y, x, 3] / 255
        out = alpha + under * (1 - alpha)
        rgb = (np.array(color[:3]) * alpha + image[y, x, :3] * under * (1 - alpha)) / out if out > 0 else np.zeros(3)
        return np.trunc(clamp(np.array([*rgb, out * 255]) + 1e-4))

    return over_all(image, value)


TRIANGLE = [(1.0, 1.0), (8.0, 2.0), (4.0, 9.0)]
CURVE = Path((1.0, 1.0)).quad_to((9.0, 1.0), (9.0, 9.0)).flatten()


def dabs(image):
    centers, radius = shapes.dab_centers(Path.polygon(*TRIANGLE), 3.0)

    def strength(x, y):
        total = 0
        for k in range(4):
            px, py = x + (k % 2 + 0.5) / 2, y + (k // 2 + 0.5) / 2
            if wound(TRIANGLE, px, py):
                total += math.floor(min(sum(dab(2 * radius, 1.0, math.hypot(px - cx, py - cy)) for cx, cy in centers) * 255, 255))
        return total / 4 / 255 if 1 <= x <= 8 and 1 <= y <= 9 else 0

    return brushed(image, strength, (9, 8, 7, 255))


def masked(image):
    box = [(2.0, 2.0), (8.0, 2.0), (8.0, 7.0), (2.0, 7.0)]

    def value(x, y):
        w = min(away(box, x + 0.5, y + 0.5) / 2, 1) if 2 <= x <= 7 and 2 <= y <= 6 else 0
        return [math.floor(255 * (1 - w) + 1e-4)] * 3 + [255]

    return over_all(image, value)


def stroked_areas(spark, sf_dir, base):
    lines = {}
    for r in area_queries.shapes(spark, sf_dir).orderBy("area_id", "seq").collect():
        lines.setdefault(r.area_id // 2, {}).setdefault(r.area_id, []).append((r.px, r.py))
    out = {}
    for i, image in base.items():
        near = lambda x, y, own=lines.get(i, {}): dab(3.0, 0.7, min((away(v, x + 0.5, y + 0.5, False) for v in own.values()), default=99))
        out[i] = brushed(image, near, (250, 10, 60, 200))
    return out


# --- resampling ----------------------------------------------------------------------------------------------------


def plain_lanczos(image, x, y):
    def weight(t):
        return 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3) if abs(t) < 3 else 0.0

    h, w = image.shape[:2]
    total, norm = np.zeros(4), 0.0
    for v in range(math.floor(y) - 2, math.floor(y) + 4):
        for u in range(math.floor(x) - 2, math.floor(x) + 4):
            k = weight(x - u) * weight(y - v)
            norm += k
            if 0 <= u < w and 0 <= v < h:
                a = image[v, u, 3] / 255
                total += k * np.array([*image[v, u, :3] * a, a])
    a = total[3] / norm if abs(norm) > 1e-6 else 0.0
    rgb = total[:3] / total[3] if abs(total[3]) > 1e-9 else np.zeros(3)
    return np.floor(clamp(np.array([*rgb, a * 255])) + 0.5)


def resized(image, width, height, sampler):
    h, w = image.shape[:2]
    return over_all(np.zeros((height, width, 4)), lambda x, y: sampler(image, (x + 0.5) * w / width - 0.5, (y + 0.5) * h / height - 0.5))


def pinched(image):
    h, w = image.shape[:2]

    def value(x, y):
        dx, dy = x - w / 2, y - h / 2
        r = math.hypot(dx, dy) / (min(w, h) / 2)
        if r >= 1:
            return image[y, x]
        k = r**0.75 / r if r else 1
        return plain_bilinear(image, min(max(w / 2 + dx * k, 0), w - 1), min(max(h / 2 + dy * k, 0), h - 1))

    return over_all(image, value)


def rippled(image):
    h, w = image.shape[:2]

    def value(x, y):
        dx, dy = x - w / 2, y - h / 2
        d = math.hypot(dx, dy)
        d += math.sin(d / 50) * 5.0 * 0.1
        turn = math.atan2(dy, dx)
        return plain_bicubic(image, min(max(w / 2 + d * math.cos(turn), 0), w - 1), min(max(h / 2 + d * math.sin(turn), 0), h - 1))

    return over_all(image, value)


# --- canvases ------------------------------------------------------------------------------------------------------


def drawn(under, image, x, y, mode="normal", opacity=1.0):
    out = under.copy()
    for u, v in places(image):
        if 0 <= x + u < under.shape[1] and 0 <= y + v < under.shape[0]:
            a, b = out[y + v, x + u], image[v, u]
            if mode == "normal" and opacity == 1.0:
                out[y + v, x + u] = np.trunc(clamp(source_over(a, b)))
                continue
            m = np.trunc(a * b / 255) if mode == "multiply" else np.trunc(255 - np.trunc((255 - a) * (255 - b) / 255)) if mode == "screen" else np.trunc(clamp(source_over(a, b)))
            alpha, ua = math.floor(m[3] * np.float32(opacity) + 1e-5) / 255, a[3] / 255
            full = alpha + ua * (1 - alpha)
            rgb = (m[:3] * alpha + a[:3] * ua * (1 - alpha)) / full if full > 0 else np.zeros(3)
            out[y + v, x + u] = np.trunc(clamp(np.array([*rgb, full * 255]) + 1e-4))
    return out


def simple(lower, upper, size, at_):
    under = np.zeros((size[1], size[0], 4))
    under = drawn(under, lower, 0, 0)
    return drawn(under, upper, *at_, "multiply", 0.6) if upper is not None else under


def scaled(image, width, height):
    sampler = {"lanczos": plain_lanczos, "bicubic": plain_bicubic, "bilinear": plain_bilinear}[warp.choose(None, image.shape[1], image.shape[0], width, height)]
    return resized(image, width, height, sampler)


def shadow(image, color, opacity, angle, distance, size):
    h, w = image.shape[:2]
    dx, dy = (math.floor(distance * f(math.radians(angle)) + 0.5) for f in (math.cos, math.sin))
    left, top = max(-dx, 0) + size, max(-dy, 0) + size
    ground = np.zeros((h + top + max(dy, 0) + size, w + left + max(dx, 0) + size, 4))
    shape = np.zeros_like(image)
    shape[..., :3], shape[..., 3] = color, np.where(image[..., 3] > 128, 255, image[..., 3])
    soft = gauss(drawn(ground, shape, left + dx, top + dy), size)
    soft[..., 3] = np.trunc(soft[..., 3] * np.float32(opacity) + 1e-5)
    return drawn(soft, image, left, top), (left, top)


def effects(base_image, top_image):
    framed = base_image.copy()
    framed[0, :] = framed[:, 0] = framed[9, :] = framed[:, 9] = (1, 2, 3, 255)
    made, (left, top) = shadow(framed, (0, 0, 0), 0.35, 45.0, 3.0, 2)
    return drawn(top_image, made, -left, -top)


# --- colours -------------------------------------------------------------------------------------------------------


def linear(c):
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def encoded(c):
    return c * 12.92 if c <= 0.0031308 else 1.055 * max(c, 0) ** (1 / 2.4) - 0.055


def hsl(h, s, light):
    return np.floor(np.array(colorsys.hls_to_rgb(h, light, s)) * 255 + 0.5)


def filtered(image):
    gel_h, _, gel_s = colorsys.rgb_to_hls(236 / 255, 138 / 255, 0)

    def value(x, y):
        own = image[y, x, :3] / 255
        light = colorsys.rgb_to_hls(*own)[1]
        tint = hsl(gel_h, gel_s, light)
        if tint.min() == 0 or tint.max() == 255:
            tint = hsl(gel_h, gel_s / 2, light)
        rgb = [encoded(linear(a) * 0.5 + linear(b / 255) * 0.5) for a, b in zip(own, tint, strict=True)]
        return [*np.floor(clamp(np.array(rgb) * 255) + 0.5), image[y, x, 3]]

    return over_all(image, value)


def turned_hue(image):
    def value(x, y):
        h, light, s = colorsys.rgb_to_hls(*image[y, x, :3] / 255)
        return [*hsl((h + 0.25) % 1, s, light), image[y, x, 3]]

    return over_all(image, value)


def noisy(image):
    m = 0xFFFFFFFF

    def word(u, v, w):
        x = (u * 374761393 ^ v * 668265263 ^ w * 2246822519) & m
        x = ((x & m) ^ (x >> 13)) * 1274126177 & m
        return (x ^ x >> 16) / 4294967295

    def value(x, y):
        one, two = word(x, y, 0), word(x ^ 0x9E3779B9, y ^ 0x85EBCA6B, 0xC2B2AE35)
        n = math.sqrt(-2 * math.log(max(one, 1e-7))) * math.cos(2 * math.pi * two)
        return [*np.trunc(clamp(image[y, x, :3] + n * 36.0)), image[y, x, 3]]

    return over_all(image, value)


XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def lab(rgb):
    t = XYZ @ [linear(c / 255) for c in rgb] / WHITE
    f = [v ** (1 / 3) if v > 216 / 24389 else (24389 / 27 * v + 16) / 116 for v in t]
    return np.array([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])])


def unlab(light, a, b):
    fy = (light + 16) / 116
    fx, fz = fy + a / 500, fy - b / 200
    cube = lambda f: f**3 if f**3 > 216 / 24389 else (116 * f - 16) / (24389 / 27)
    y = fy**3 if light > 8 else light / (24389 / 27)
    lin = np.linalg.inv(XYZ) @ (np.array([cube(fx), y, cube(fz)]) * WHITE)
    return np.floor(clamp(np.array([encoded(v) for v in lin]) * 255) + 0.5)


def levels(image, fraction=0.005):
    """Each channel stretched between its clip bounds of visible pixels."""
    seen, out = image[image[..., 3] > 0], image.copy()
    for c in range(3):
        v = np.sort(seen[:, c])
        k = math.floor(len(v) * fraction + 0.5)
        lo, hi = (0, 255) if not k else (v[k - 1], v[-k])
        lo, hi = (v[0], v[-1]) if lo >= hi else (lo, hi)
        out[..., c] = np.where(image[..., c] <= lo, 0, np.where(image[..., c] >= hi, 255, np.floor((image[..., c] - lo) / max(hi - lo, 1) * 255 + 0.5)))
    return out


def balanced(image):
    if not (image[..., 3] > 0).any():
        return None
    own = levels(image)
    lum = own[..., :3] @ [0.2126, 0.7152, 0.0722] / 255
    mid = (image[..., 3] > 0) & (lum >= 0.3) & (lum <= 0.7) & (own[..., :3].min(axis=-1) > 0) & (own[..., :3].max(axis=-1) < 255)
    cast = np.mean([lab(p)[1:] for p in own[mid][:, :3]], axis=0) if mid.sum() >= 5 else np.zeros(2)

    def value(x, y):
        light, a, b = lab(own[y, x, :3])
        w = min(max((lum[y, x] - 0.3) / 0.4, 0), 1)
        w = w * w * (3 - 2 * w)
        return [*unlab(light, a - cast[0] * w, b - cast[1] * w), image[y, x, 3]]

    return over_all(image, value)


def graded(colors):
    """The gradient's colour at the pixel's brightness."""
    colors = np.array(colors, float)

    def change(image):
        def value(x, y):
            t = image[y, x, :3] @ [0.299, 0.587, 0.114] / 255
            place = t * (len(colors) - 1)
            i = min(int(place), len(colors) - 2)
            rgb = colors[-1] if t >= 1 else np.trunc(colors[i] + (place - i) * (colors[i + 1] - colors[i]) + 1e-9)
            return [*rgb, image[y, x, 3]]

        return over_all(image, value)

    return change


RAINBOW = [(255, 0, 0), (255, 127, 0), (255, 255, 0), (0, 255, 0), (0, 0, 255), (75, 0, 130), (148, 0, 211)]
HUES = [(255, 0, 0), (255, 0, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)]


def toned(image, above):
    blur = over_all(image, lambda x, y: np.trunc(sum(at(image, x + k, y) for k in (-1, 0, 1)) / 3))
    blur = over_all(image, lambda x, y: np.trunc(sum(at(blur, x, y + k) for k in (-1, 0, 1)) / 3))
    lit = np.where(blur[..., 3:] == 0, blur, levels(blur))
    grey = np.trunc(above[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) + 1e-4)
    over = np.stack([grey, grey, grey, above[..., 3]], axis=-1)
    return 255 - np.trunc((255 - lit) * (255 - over) / 255)


#: Each query's model: of one image of pixels_base, of two images (base, top), or of one of pixels_large.
ONE = {
    "gaussian_blur": lambda p: gauss(p, 2), "focus_blur": lambda p: gauss(p, 3), "motion_blur": motion, "lens_blur": lens, "smooth_skin": skin,
    "paint_brush": lambda p: brushed(p, lambda x, y: dab(6.0, 0.5, math.hypot(x + 0.5 - 5, y + 0.5 - 5)), (255, 0, 0, 255)),
    "stroke_path": lambda p: brushed(p, lambda x, y: dab(2.0, 1.0, away(CURVE, x + 0.5, y + 0.5, False)), (0, 0, 255, 255)),
    "brush_fill": dabs, "mask_area": masked, "tile_process": lambda p: np.concatenate([np.trunc((1 - p[..., :3] / 255) * 255 + 1e-4), np.full_like(p[..., 3:], 255)], axis=-1),
    "resize_bilinear": lambda p: resized(p, 15, 6, plain_bilinear), "resize_bicubic": lambda p: resized(p, 15, 6, plain_bicubic), "resize_lanczos": lambda p: resized(p, 15, 6, plain_lanczos),
    "rotate_30": lambda p: plain_rotate(p, 30.0, "bilinear"), "pinch": pinched, "ripple": rippled, "photo_filter": filtered, "rotate_hue": turned_hue, "add_noise_gaussian": noisy, "auto_color": balanced,
    "gradient_rainbow": graded(RAINBOW), "gradient_hue_reversed": graded(HUES[::-1]), "drop_shadow": lambda p: shadow(p, (0, 0, 0), 0.5, 45.0, 3.0, 2)[0],
}
TWO = {
    "canvas_resize": lambda p, t: simple(scaled(p, 15, 8), scaled(t, 15, 8), (15, 8), (3, 1)),
    "canvas_resize_width": lambda p, t: simple(scaled(p, 15, 10), scaled(t, 15, 10), (15, 10), (3, 1)),
    "canvas_widen": lambda p, t: simple(scaled(p, 14, 14), scaled(t, 14, 14), (14, 14), (0, 1)),
    "canvas_turn": lambda p, t: simple(plain_rotate(p, 30.0, "bicubic"), plain_rotate(t, 30.0, "bicubic"), (10, 10), (2, 1)),
    "canvas_rotated_child": lambda p, t: drawn(t, plain_rotate(simple(p, t, (10, 10), (2, 1)), 45.0, "bicubic"), -1, 2),
    "layer_effects": lambda p, t: effects(p, t), "tone_then_blend": toned,
}
LARGE = {"large_gaussian": lambda p: gauss(p, 8), "large_resize": lambda p: resized(p, 600, 150, plain_bicubic), "large_auto_color": balanced}


def close(name, got, want, share):
    assert got.shape == want.shape, name
    seen = (got[..., 3] > 2) & (want[..., 3] > 2)  # colours of what is all but clear are quotients of next to nothing
    off = np.abs(got - want).max(axis=-1)
    assert (off[seen] > 1).mean() <= share and np.abs(got[..., 3] - want[..., 3]).max() <= 2, (name, off.max())


@pytest.mark.parametrize("name", sorted(ONE))
def test_one_image(name, spark, sf_dir, base):
    got = images_of(QUERIES[name](spark, sf_dir))
    for i in sorted(base)[:4]:
        close(name, got[i], ONE[name](base[i]), 0.02)
    assert set(got) == set(base)


@pytest.mark.parametrize("name", sorted(TWO))
def test_two_images(name, spark, sf_dir, base, top):
    got = images_of(QUERIES[name](spark, sf_dir))
    for i in sorted(set(base) & set(top))[:3]:
        close(name, got[i], TWO[name](base[i], top[i]), 0.06)


@pytest.mark.parametrize("name", sorted(LARGE))
def test_large_images(name, spark, sf_dir, large):
    got = images_of(QUERIES[name](spark, sf_dir))
    for i, image in large.items():
        if name == "large_resize":  # a few rows
            want = LARGE[name](image)
            close(name, got[i], want, 0.02)
        else:
            close(name, got[i], LARGE[name](image), 0.02)


def test_strokes_along_areas(spark, sf_dir, base):
    got, want = images_of(QUERIES["areas_stroke"](spark, sf_dir)), stroked_areas(spark, sf_dir, base)
    for i in base:
        close("areas_stroke", got[i], want[i], 0.02)


def test_large_median(spark, sf_dir, large):
    got = images_of(QUERIES["large_median"](spark, sf_dir))
    for i, image in large.items():
        for x in range(0, image.shape[1], 7):
            for y in range(image.shape[0]):
                window = np.array([at(image, x + u, y + v)[:3] for v in range(-4, 5) for u in range(-4, 5)])
                assert (got[i][y, x] == [*np.sort(window, axis=0)[40], image[y, x, 3]]).all()


def test_lab_values(spark, sf_dir):
    for r in QUERIES["rgb_to_lab"](spark, sf_dir).limit(60).join(pixels_base(spark, sf_dir).withColumnsRenamed({c: f"in_{c}" for c in CHANNELS}), ["image_id", "x", "y"]).collect():
        values = [v for k, v in r.asDict().items() if k not in ("image_id", "x", "y") and not k.startswith("in_")]
        assert np.allclose(values[:3], lab((r.in_r, r.in_g, r.in_b)), atol=1e-4)


def test_random_layouts(spark, sf_dir, base):
    rows = QUERIES["random_layout"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["random_layout"](spark, sf_dir).collect())) and len(rows) == len(base)
    assert all(0 <= r.x <= 640 - 10 and 0 <= r.y <= 480 - 10 and 0 <= r.rotation <= 360 and r.scale == 1 for r in rows) and len({(r.x, r.y) for r in rows}) > 1


@pytest.mark.parametrize("name", ["collage_grid", "collage_layered", "collage_random"])
def test_collages_show_their_plan(name, spark, sf_dir, base):
    """Where a cell is not turned, its middle shows the image that the plan names; NumPy models of whole collages are in test_trees."""
    options = {"collage_grid": ("grid", 4, 4, (48, 40), 5), "collage_layered": ("layered", 4, 3, (48, 36), 5, (-20.0, 20.0), (1.0, 1.4)), "collage_random": ("random", 40, 1, (200, 160), 3, (-30.0, 30.0), (1.0, 2.0))}
    cells = collage.plan(sizes(pixels_base(spark, sf_dir)), *options[name])
    (image,) = images_of(QUERIES[name](spark, sf_dir)).values()
    assert image.shape[:2] == options[name][3][::-1] and len(cells) == {"collage_grid": 16, "collage_layered": 12, "collage_random": 40}[name]
    assert {c.image_id for c in cells} <= set(base)
    if name == "collage_grid":
        for c in cells:
            flat = drawn(np.zeros((c.height, c.width, 4)), scaled(base[c.image_id], 12, 12), 0, 0)
            close(name, image[c.y : c.y + c.height, c.x : c.x + c.width], drawn(np.zeros_like(flat), flat, 0, 0), 0.1)


def test_every_query_has_sql_or_a_model():
    """Those named here are held by tests of their own: edge-directed sampling in test_image_models, PNG files by their round trip."""
    own = {"areas_stroke", "large_median", "rgb_to_lab", "random_layout", "collage_grid", "collage_layered", "collage_random", "resize_edge_nedi", "resize_edge_edi"}
    assert set(QUERIES) - set(SQL) <= set(ONE) | set(TWO) | set(LARGE) | own
