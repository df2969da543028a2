"""Queries of the pixel operators over the input tables, each with the DuckDB text of its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumengrid.functions import color
from lumengrid.functions.color import NAMED, Gradient
from lumengrid.operators import blend, point, spatial, stats
from lumengrid.plans.sqltext import d, f, hsl, hsl_rgb, rgb, u8, u8r, views
from lumengrid.plans.sqltext import blend as blend_sql
from lumengrid.plans.views import CHANNELS, RGB, pixels_base, pixels_emb, pixels_top

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def base(change):
    """A query that changes pixels_base."""
    return lambda spark, d: change(pixels_base(spark, d))


GRAY = f"({f('r')} * {f(0.299)} + {f('g')} * {f(0.587)} + {f('b')} * {f(0.114)})"

# views
add("pixels_base", lambda spark, d: pixels_base(spark, d), f"{views('px')} SELECT * FROM px")
add("pixels_top", lambda spark, d: pixels_top(spark, d), f"{views('pt')} SELECT * FROM pt")
add("pixels_emb", lambda spark, d: pixels_emb(spark, d), f"{views('pe')} SELECT image_id, x, y, r, g, b, a FROM pe")

# projections
add("grayscale", base(point.grayscale), rgb(u8(GRAY)))
add("invert", base(point.invert), rgb("255 - $"))
add("threshold", base(lambda p: point.threshold(p, 120)), rgb("CASE WHEN (r + g + b) // 3 > 120 THEN 255 ELSE 0 END"))
add("posterize", base(lambda p: point.posterize(p, 5)), rgb(u8(f(f"{f(f'round({f(f(chr(36)) + chr(47) + f(255))} * {f(4)})')} / {f(4)}") + f" * {f(255)}")))
add("brightness", base(lambda p: point.brightness(p, 50)), rgb(u8(f"{f('$')} * {f(1.5)}")))
_K = f(f"({f(259.0)} * {f(305.0)}) / ({f(255.0)} * {f(209.0)})")
add("contrast", base(lambda p: point.contrast(p, 50)), rgb(u8(f"{_K} * ({f('$')} - {f(128)}) + {f(128)}")))
add("saturation", base(lambda p: point.saturation(p, 40)), rgb(u8(f"round({GRAY} + ({f('$')} - {GRAY}) * ({f(f(40) + '/' + f(100))} + {f(1)}))")))
add("opacity", base(lambda p: point.opacity(p, 0.4)), rgb("$", alpha=u8(f"{f('a')} * {f(0.4)}")))
add("channel_add", base(lambda p: point.add(p, 30.5)), rgb(u8(f"{f('$')} + {f(30.5)}")))
add("channel_sub", base(lambda p: point.sub(p, 30.5)), rgb(u8(f"{f('$')} - {f(30.5)}")))
add("channel_mul", base(lambda p: point.mul(p, 1.3)), rgb(u8(f"{f('$')} * {f(1.3)}")))
add("channel_div", base(lambda p: point.div(p, 1.7)), rgb(u8(f"{f('$')} / {f(1.7)}")))
add("map_lut", base(lambda p: point.map_lut(p, lambda v: (v * v) // 255)), rgb("CAST($ * $ // 255 AS INT)"))
add("set_pixel", base(lambda p: point.set_pixel(p, 3, 4, (1, 2, 3, 4))), rgb("CASE WHEN x = 3 AND y = 4 THEN CASE '$' WHEN 'r' THEN 1 WHEN 'g' THEN 2 ELSE 3 END ELSE $ END", alpha="CASE WHEN x = 3 AND y = 4 THEN 4 ELSE a END"))
add("get_pixel", base(lambda p: point.get_pixel(p, 3, 4)), f"{views('px')} SELECT * FROM px WHERE x = 3 AND y = 4")
add("clear_color", base(lambda p: point.clear_color(p, (9, 8, 7, 6))), f"{views('px')} SELECT image_id, x, y, 9 AS r, 8 AS g, 7 AS b, 6 AS a FROM px")
add("crop", base(lambda p: point.crop(p, 2, 3, 5, 4)), f"{views('px')} SELECT image_id, x - 2 AS x, y - 3 AS y, r, g, b, a FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 6")
add("flip_h", base(lambda p: point.flip_horizontal(p, 10)), f"{views('px')} SELECT image_id, 9 - x AS x, y, r, g, b, a FROM px")
add("flip_v", base(lambda p: point.flip_vertical(p, 10)), f"{views('px')} SELECT image_id, x, 9 - y AS y, r, g, b, a FROM px")
_EXP = lambda e, o: u8r(f"least(greatest(pow(pow(greatest(pow({d('$')} / 255, {d(2.2)}) * {d(repr(float(1.4**e)))} + {d(o)}, 0), {d(1.0)}), {d(repr(1.0 / 2.2))}), 0), 1) * 255")
add("exposure", base(lambda p: point.exposure(p, 1.0, 0.01)), rgb(_EXP(1.0, 0.01)))
add("exposure_minus_two", base(lambda p: point.exposure(p, -2.0)), rgb(_EXP(-2.0, 0.0)))
_GRAD = Gradient((((10, 20, 30, 255), 0.1), ((200, 100, 50, 255), 0.5), ((255, 255, 255, 255), 0.9)))
_T = "((r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255)"
_G = {"r": (10, 200, 255), "g": (20, 100, 255), "b": (30, 50, 255)}
_gcol = ", ".join(f"CASE WHEN {_T} < 0.1::DOUBLE THEN 0 WHEN {_T} < 0.5::DOUBLE THEN {u8(f'{v[0]}::DOUBLE + ({_T} - 0.1::DOUBLE) / (0.5::DOUBLE - 0.1::DOUBLE) * {v[1] - v[0]}')} WHEN {_T} < 0.9::DOUBLE THEN {u8(f'{v[1]}::DOUBLE + ({_T} - 0.5::DOUBLE) / (0.9::DOUBLE - 0.5::DOUBLE) * {v[2] - v[1]}')} ELSE {v[2]} END AS {c}" for c, v in _G.items())
add("gradient_map", base(lambda p: point.gradient_map(p, _GRAD)), f"{views('px')} SELECT image_id, x, y, {_gcol}, a FROM px")
_VIB = f"""{views('px')}, u AS (SELECT image_id, x, y, a, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
m AS (SELECT *, (r + g + b) / 3 AS av, greatest(r, g, b) AS mx FROM u), k AS (SELECT *, least(greatest((mx - av) * 3, 0), 1) * 0.6::DOUBLE + 1 AS fa FROM m),
v AS (SELECT image_id, x, y, a, least(greatest((r - av) * fa + av, 0), 1) AS r, least(greatest((g - av) * fa + av, 0), 1) AS g, least(greatest((b - av) * fa + av, 0), 1) AS b FROM k),
l AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS lum FROM v)
SELECT image_id, x, y, {', '.join(f"{u8r(f'least(greatest(lum + ({c} - lum) * 1.2::DOUBLE, 0), 1) * 255')} AS {c}" for c in RGB)}, a FROM l"""
add("vibrance", base(lambda p: point.vibrance(p, 60.0, 20.0)), _VIB)
_lin = lambda c: f"(CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_gam = lambda c: f"(CASE WHEN {c} <= 0.0031308::DOUBLE THEN {c} * 12.92::DOUBLE ELSE pow({c}, {1.0 / 2.4!r}::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END)"
_gel = {c: 0.2 + 0.8 * point._linear(v) for c, v in zip(RGB, point.PHOTO_FILTERS["warming-light"], strict=True)}
_pf = ", ".join(f"{u8r('least(greatest(' + _gam('(' + _lin(f'({c} / 255.0::DOUBLE)') + f' * {g!r}::DOUBLE)') + ', 0), 1) * 255')} AS {c}" for c, g in _gel.items())
add("photo_filter_preset", base(lambda p: point.photo_filter_preset(p, "warming-light", 0.8)), f"{views('px')} SELECT image_id, x, y, {_pf}, a FROM px")
add("photo_filter", base(lambda p: point.photo_filter(p, (236, 138, 0), 0.5)))
_m32 = lambda x, k: f"CAST((CAST({x} AS HUGEINT) * {k}) % 4294967296 AS BIGINT)"
_NOISE = f"""{views('px')}, h AS (SELECT *, xor({_m32('x', 374761393)}, {_m32('y', 668265263)}) AS h0 FROM px), i AS (SELECT *, xor(h0, h0 >> 13) AS h1 FROM h),
j AS (SELECT *, {_m32('h1', 1274126177)} AS h2 FROM i), n AS (SELECT *, ((xor(h2, h2 >> 16) / 4294967295.0::DOUBLE) * 2 - 1) * 12 * 3 AS n FROM j)
SELECT image_id, x, y, {', '.join(f"{u8(f'{c} + n')} AS {c}" for c in RGB)}, a FROM n"""
add("add_noise_uniform", base(lambda p: point.noise(p, 12.0)), _NOISE)
add("add_noise_gaussian", base(lambda p: point.noise(p, 12.0, gaussian=True)))
add("rotate_hue", base(lambda p: point.rotate_hue(p, 90.0)))

# colour scalars
_three = lambda kind: lambda spark, d: pixels_base(spark, d).select("image_id", "x", "y", *[F.round(v, 6).alias(n) for n, v in zip(("c0", "c1", "c2"), kind(F.col("r"), F.col("g"), F.col("b")), strict=True)])
_h, _s, _l = hsl("r", "g", "b")
add("rgb_to_hsl", _three(color.rgb_to_hsl), f"{views('px')} SELECT image_id, x, y, round({_h}, 6) AS c0, round({_s}, 6) AS c1, round({_l}, 6) AS c2 FROM px")
_top, _low = "(greatest(r, g, b) / 255.0::DOUBLE)", "(least(r, g, b) / 255.0::DOUBLE)"
add("rgb_to_hsv", _three(color.rgb_to_hsv), f"{views('px')} SELECT image_id, x, y, round({_h}, 6) AS c0, round(CASE WHEN {_top} = 0 THEN 0 ELSE ({_top} - {_low}) / {_top} END, 6) AS c1, round({_top}, 6) AS c2 FROM px")
add("rgb_to_lab", _three(color.rgb_to_lab))
add("hsl_round_trip", base(lambda p: p.withColumns(dict(zip(RGB, color.hsl_to_rgb(*color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))), strict=True)))), f"{views('px')} SELECT image_id, x, y, {', '.join(f'{v} AS {c}' for c, v in hsl_rgb(_h, _s, _l).items())}, a FROM px")
add("hsv_round_trip", base(lambda p: p.withColumns(dict(zip(RGB, color.hsv_to_rgb(*color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))), strict=True)))), f"{views('px')} SELECT * FROM px")
add("lab_round_trip", base(lambda p: p.withColumns(dict(zip(RGB, color.lab_to_rgb(*color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))), strict=True)))), f"{views('px')} SELECT * FROM px")
add("luminance", lambda spark, d: pixels_base(spark, d).select("image_id", "x", "y", F.round(color.luminance(F.col("r"), F.col("g"), F.col("b")), 9).alias("lum")), f"{views('px')} SELECT image_id, x, y, round((r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255, 9) AS lum FROM px")
add("hex_color", lambda spark, d: pixels_base(spark, d).select("image_id", "x", "y", color.hex_color(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in CHANNELS])).alias("c")).select("image_id", "x", "y", "c.*"), f"{views('px')} SELECT * FROM px")

# blends
_A, _B = "p.$", "t.$"
_HL = f"CASE WHEN t.$ < 128 THEN {f(f(2) + ' * ' + f('p.$') + ' * ' + f('t.$') + ' / ' + f(255))} ELSE {f(255)} - {f(f(2) + ' * (' + f(255) + ' - ' + f('p.$') + ') * (' + f(255) + ' - ' + f('t.$') + ') / ' + f(255))} END"
_OV = _HL.replace("CASE WHEN t.$ < 128", "CASE WHEN p.$ < 128")
_BURN = lambda b: f"(CASE WHEN {b} = 0 THEN 0 ELSE {u8(f'{f(255)} - ' + f(f'{f(255 - 0)} * {f(f(255) + ' - ' + f('p.$'))} / nullif({f(b)}, 0)'))} END)"
_DODGE = lambda b: f"(CASE WHEN {b} = 255 THEN 255 ELSE {u8(f(f'{f('p.$')} * {f(255)} / nullif({f(255)} - {f(b)}, 0)'))} END)"
_VIVID = f"(CASE WHEN t.$ < 128 THEN {_BURN('least(t.$ * 2, 255)')} ELSE {_DODGE('greatest((t.$ - 128) * 2, 0)')} END)"
EACH = {
    "darken": "least(p.$, t.$)", "average": "CAST((p.$ + t.$) // 2 AS INT)", "multiply": "CAST(p.$ * t.$ // 255 AS INT)", "color-burn": _BURN("t.$"),
    "linear-burn": "greatest(p.$ + t.$ - 255, 0)", "lighten": "greatest(p.$, t.$)", "screen": "CAST(255 - (255 - p.$) * (255 - t.$) // 255 AS INT)",
    "color-dodge": _DODGE("t.$"), "linear-dodge": "least(p.$ + t.$, 255)", "overlay": u8(f"round({_OV})"), "soft-light": u8(f"({_HL}) * {f(0.5)} + {f('p.$')} * {f(0.5)}"),
    "hard-light": u8(_HL), "vivid-light": _VIVID,
    "linear-light": "CASE WHEN t.$ < 128 THEN greatest(p.$ + least(t.$ * 2, 255) - 255, 0) ELSE least(p.$ + greatest((t.$ - 128) * 2, 0), 255) END",
    "pin-light": "CASE WHEN t.$ < 128 THEN least(p.$, t.$) ELSE greatest(p.$, t.$) END", "hard-mix": f"CASE WHEN {_VIVID} < 128 THEN 0 ELSE 255 END",
    "reflect": f"CASE WHEN t.$ = 255 THEN 255 ELSE {u8(f(f('p.$') + ' * ' + f('p.$') + f' / nullif({f(255)} - {f('t.$')}, 0)'))} END",
    "glow": f"CASE WHEN p.$ = 255 THEN 255 ELSE {u8(f(f('t.$') + ' * ' + f('t.$') + f' / nullif({f(255)} - {f('p.$')}, 0)'))} END",
}
KEEP = {
    "difference": "abs(p.$ - t.$)", "exclusion": "CAST(p.$ + t.$ - 2 * p.$ * t.$ // 255 AS INT)", "subtract": "greatest(p.$ - t.$, 0)",
    "divide": f"CASE WHEN t.$ = 0 THEN 0 ELSE {u8(f'round({f(f('p.$') + f' / nullif({f('t.$')}, 0)')} * {f(255)})')} END",
    "phoenix": u8(f"{f('p.$')} + {f('t.$')} - {f(f(2) + ' * ' + f('p.$') + ' * ' + f('t.$') + ' / ' + f(255))}"), "negation": "255 - abs(p.$ - t.$)",
    "grain-extract": "CAST(least(greatest((p.$ + t.$ - 255) // 2 + 128, 0), 255) AS INT)", "grain-merge": "CAST(least(greatest((p.$ + t.$ - 128) // 2, 0), 255) AS INT)",
}
_u = lambda v: f(f"{f(v)} / {f(255)}")
_NORMAL = {c: u8(f"({_u(f't.{c}')} * {_u('t.a')} + {_u(f'p.{c}')} * {_u('p.a')} * ({f(1)} - {_u('t.a')})) * {f(255)}") for c in RGB} | {"a": u8(f"({_u('t.a')} + {_u('p.a')} * ({f(1)} - {_u('t.a')})) * {f(255)}")}
MODE_SQL = {k: {c: v.replace("$", c) for c in CHANNELS} for k, v in EACH.items()} | {k: {c: v.replace("$", c) for c in RGB} | {"a": "p.a"} for k, v in KEEP.items()} | {"normal": _NORMAL}
for _name, _sign in (("darker-color", "<"), ("lighter-color", ">")):
    _lp, _lt = (f"(greatest({q}.r, {q}.g, {q}.b) + least({q}.r, {q}.g, {q}.b))" for q in "pt")
    MODE_SQL[_name] = {c: f"CASE WHEN {_lp} {_sign} {_lt} THEN p.{c} ELSE t.{c} END" for c in CHANNELS}
_hp, _ht = hsl("p.r", "p.g", "p.b"), hsl("t.r", "t.g", "t.b")
for _name, _pick in (("hue", (_ht[0], _hp[1], _hp[2])), ("saturation", (_hp[0], _ht[1], _hp[2])), ("color", (_ht[0], _ht[1], _hp[2])), ("luminosity", (_hp[0], _hp[1], _ht[2]))):
    MODE_SQL[_name] = hsl_rgb(*_pick) | {"a": "p.a"}
for _name in blend.MODES:
    add("blend_" + _name.replace("-", "_"), lambda spark, d, m=_name: blend.blend(pixels_base(spark, d), pixels_top(spark, d), m), blend_sql(MODE_SQL[_name]))
add("blend_offset", lambda spark, d: blend.blend(pixels_base(spark, d), pixels_top(spark, d), "multiply", 3, -2), blend_sql(MODE_SQL["multiply"], 3, -2))


def faded(mixed: dict[str, str], opacity: float) -> dict[str, str]:
    """The text of a mode's result composited over p with an opacity."""
    alpha = u8(f"{f(mixed['a'])} * {f(opacity)}")
    out = f"({_u(alpha)} + {_u('p.a')} * ({f(1)} - {_u(alpha)}))"
    return {c: f"(CASE WHEN {out} > 0 THEN {u8(f(f'({_u(mixed[c])} * {_u(alpha)} + {_u(f'p.{c}')} * {_u('p.a')} * ({f(1)} - {_u(alpha)})) / nullif({out}, 0)') + f' * {f(255)}')} ELSE 0 END)" for c in RGB} | {"a": u8(f"{out} * {f(255)}")}


_so = faded({c: f"(CAST(p.{c} * t.{c} // 255 AS INT))" for c in CHANNELS}, 0.6)
add("blend_opacity", lambda spark, d: blend.blend_opacity(pixels_base(spark, d), pixels_top(spark, d), "multiply", 0.6), blend_sql(_so))
add("draw_image_at", lambda spark, d: blend.draw_at(pixels_base(spark, d), pixels_top(spark, d), 4, 5), blend_sql({c: f"t.{c}" for c in CHANNELS}, 4, 5))
add("apply_mask", lambda spark, d: blend.apply_mask(pixels_base(spark, d), pixels_top(spark, d)), blend_sql({c: f"p.{c}" for c in RGB} | {"a": "CAST((t.r * 299 + t.g * 587 + t.b * 114 + 500) // 1000 AS INT)"}))

# aggregations
_HIST = lambda where="": f"hist AS (SELECT image_id, channel, bin, count(*) AS cnt FROM (SELECT image_id, unnest(['r', 'g', 'b', 'a']) AS channel, unnest([r, g, b, a]) AS bin FROM px {where}) GROUP BY ALL)"
_RUN = "run AS (SELECT *, sum(cnt) OVER (PARTITION BY image_id, channel ORDER BY bin) AS upto, sum(cnt) OVER (PARTITION BY image_id, channel ORDER BY bin DESC) AS down, sum(cnt) OVER (PARTITION BY image_id, channel) AS total FROM hist)"
_BOUNDS = lambda k: f"""bd AS (SELECT image_id, channel, min(bin) FILTER (upto >= k) AS lo0, max(bin) FILTER (down >= k) AS hi0, min(bin) AS first, max(bin) AS last, max(k) AS k
  FROM (SELECT *, CAST(round(total * {k}::DOUBLE) AS BIGINT) AS k FROM run) GROUP BY image_id, channel),
bounds AS (SELECT image_id, channel, CASE WHEN lo >= hi THEN first ELSE lo END AS lo, CASE WHEN lo >= hi THEN last ELSE hi END AS hi
  FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE lo0 END AS lo, CASE WHEN k = 0 THEN 255 ELSE hi0 END AS hi FROM bd))"""  # noqa: E731
_ST = lambda v, lo, hi: f"CASE WHEN {v} <= {lo} THEN 0 WHEN {v} >= {hi} THEN 255 ELSE CAST(floor(({v} - {lo}) / CAST({hi} - {lo} AS DOUBLE) * 255 + 0.5::DOUBLE) AS INT) END"
add("histogram", base(stats.histogram), f"{views('px')}, {_HIST()} SELECT image_id, channel, bin, cnt FROM hist")
add("histogram_skip_transparent", base(lambda p: stats.histogram(p, True)), f"{views('px')}, {_HIST('WHERE a <> 0')} SELECT image_id, channel, bin, cnt FROM hist")
add("clip_bounds", base(lambda p: stats.clip_bounds(stats.histogram(p), 0.05)), f"{views('px')}, {_HIST()}, {_RUN}, {_BOUNDS(0.05)} SELECT * FROM bounds")
add("levels_lut", base(lambda p: stats.levels_lut(stats.clip_bounds(stats.histogram(p), 0.05))), f"{views('px')}, {_HIST()}, {_RUN}, {_BOUNDS(0.05)} SELECT image_id, channel, CAST(v AS INT) AS v_in, {_ST('v', 'lo', 'hi')} AS v_out FROM bounds, range(256) t(v)")
add("channel_stats", base(stats.channel_stats), f"""{views('px')}, {_HIST()}, {_RUN} SELECT image_id, channel, CAST(max(total) AS BIGINT) AS n, min(bin) FILTER (upto > total // 2) AS median, CAST(sum(bin * cnt) // sum(cnt) AS INT) AS mean,
  coalesce(CAST(sum(bin * cnt) FILTER (abs(bin - 128) <= 32) // sum(cnt) FILTER (abs(bin - 128) <= 32) AS INT), 128) AS weighted, min(bin) FILTER (upto >= floor(total * 0.9::DOUBLE)) AS percentile FROM run GROUP BY image_id, channel""")
add("color_average", base(stats.color_average), f"{views('px')} SELECT image_id, {', '.join(f'CAST(sum({c}) // count(*) AS INT) AS {c}' for c in CHANNELS)} FROM px GROUP BY image_id")
_RANKED = "k AS (SELECT image_id, channel, bin, row_number() OVER (PARTITION BY image_id, channel ORDER BY cnt DESC, bin) AS n FROM hist)"
add("color_mode", base(stats.color_mode), f"{views('px')}, {_HIST()}, {_RANKED} SELECT image_id, {', '.join(f"max(bin) FILTER (channel = '{c}') AS {c}" for c in CHANNELS)} FROM k WHERE n = 1 GROUP BY image_id")
add("color_median", base(stats.color_median), f"{views('px')} SELECT image_id, {', '.join(f'list_sort(list({c}))[count(*) // 2 + 1] AS {c}' for c in CHANNELS)} FROM px GROUP BY image_id")
add("color_median_compat", base(stats.color_median_compat), f"{views('px')} SELECT image_id, {', '.join(f'list_sort(list({c}))[(count(*) * 4 // 3) // 2 + 1] AS {c}' for c in RGB)} FROM px GROUP BY image_id")
_WIDE = "wide AS (SELECT image_id, " + ", ".join(f"max({v}) FILTER (channel = '{c}') AS {v}_{c}" for c in RGB for v in ("lo", "hi")) + " FROM bounds GROUP BY image_id)"
add("auto_tone", base(stats.auto_tone), f"{views('px')}, {_HIST('WHERE a <> 0')}, {_RUN}, {_BOUNDS(0.005)}, {_WIDE} SELECT px.image_id, x, y, {', '.join(f'CASE WHEN a = 0 THEN {c} ELSE {_ST(c, f'lo_{c}', f'hi_{c}')} END AS {c}' for c in RGB)}, a FROM px JOIN wide ON wide.image_id = px.image_id")
add("auto_color", base(stats.auto_color))

# neighbourhoods
def _kernel_sql(k) -> str:
    taps = ", ".join(f"({i % 3 - 1}, {i // 3 - 1}, {w}::DOUBLE)" for i, w in enumerate(k) if w)
    cols = ", ".join(f"CAST(least(greatest(round(coalesce(sum(n.{c} * o.w), 0)), 0), 255) AS INT) AS {c}" for c in CHANNELS)
    return f"{views('px')}, o(dx, dy, w) AS (VALUES {taps}) SELECT p.image_id, p.x, p.y, {cols} FROM px p CROSS JOIN o LEFT JOIN px n ON n.image_id = p.image_id AND n.x = p.x + o.dx AND n.y = p.y + o.dy GROUP BY p.image_id, p.x, p.y"


for _name, _k in (("blur3", spatial.BLUR), ("sharpen", spatial.SHARPEN), ("sobel_h", spatial.SOBEL_HORIZONTAL), ("sobel_v", spatial.SOBEL_VERTICAL)):
    add(_name, base(lambda p, k=_k: spatial.apply_kernel(p, k)), _kernel_sql(_k))
_OFF = lambda r: f"o AS (SELECT a.v AS dx, b.v AS dy FROM (SELECT unnest(range(-{r}, {r} + 1)) AS v) a, (SELECT unnest(range(-{r}, {r} + 1)) AS v) b)"
_CLAMP = "px p CROSS JOIN o JOIN px n ON n.image_id = p.image_id AND n.x = least(9, greatest(0, p.x + o.dx)) AND n.y = least(9, greatest(0, p.y + o.dy))"
add("smooth3", base(spatial.smooth), f"{views('px')}, {_OFF(1)} SELECT p.image_id, p.x, p.y, {', '.join(f'CAST(floor(sum(n.{c}) / 9.0::DOUBLE + 0.5::DOUBLE) AS INT) AS {c}' for c in CHANNELS)} FROM px p CROSS JOIN o JOIN px n ON n.image_id = p.image_id AND n.x = p.x + o.dx AND n.y = p.y + o.dy GROUP BY p.image_id, p.x, p.y")
_box = lambda src, dx, dy: f"SELECT p.image_id, p.x, p.y, {', '.join(f'CAST(sum(n.{c}) // 5 AS INT) AS {c}' for c in CHANNELS)} FROM {src} p CROSS JOIN (SELECT unnest(range(-2, 3)) AS d) o JOIN {src} n ON n.image_id = p.image_id AND n.x = least(9, greatest(0, p.x + {dx})) AND n.y = least(9, greatest(0, p.y + {dy})) GROUP BY p.image_id, p.x, p.y"
add("box_blur_r2", base(lambda p: spatial.box_blur(p, 2)), f"{views('px')}, hx AS ({_box('px', 'o.d', '0')}) {_box('hx', '0', 'o.d')}")
_med = ", ".join(f"list_sort(list(n.{c}))[count(*) // 2 + 1] AS {c}" for c in RGB)
add("median_r1", base(lambda p: spatial.median(p, 1)), f"{views('px')}, {_OFF(1)} SELECT p.image_id, p.x, p.y, {_med}, max(p.a) AS a FROM {_CLAMP} GROUP BY p.image_id, p.x, p.y")
_lu = lambda q: f"(({q}.r * 299 + {q}.g * 587 + {q}.b * 114) // 1000)"
_DES = f"""{views('px')}, {_OFF(1)}, w AS (SELECT p.image_id, p.x, p.y, min({_lu('n')}) AS lo, max({_lu('n')}) AS hi, max({_lu('p')}) AS own, max(p.a) AS a, {', '.join(f'max(p.{c}) AS {c}, list_sort(list(n.{c}))[count(*) // 2 + 1] AS m_{c}' for c in RGB)} FROM {_CLAMP} GROUP BY p.image_id, p.x, p.y)
SELECT image_id, x, y, {', '.join(f'CASE WHEN own = lo OR own = hi OR greatest(abs(r - m_r), abs(g - m_g), abs(b - m_b)) > 90 THEN m_{c} ELSE {c} END AS {c}' for c in RGB)}, a FROM w"""
add("despeckle", base(lambda p: spatial.despeckle(p, 1, 90)), _DES)
add("surface_blur", base(lambda p: spatial.surface_blur(p, 2, 40)), f"{views('px')}, {_OFF(2)} SELECT p.image_id, p.x, p.y, {', '.join(f'CAST(sum(n.{c}) FILTER (abs(n.{c} - p.{c}) <= 40) // count(*) FILTER (abs(n.{c} - p.{c}) <= 40) AS INT) AS {c}' for c in RGB)}, max(p.a) AS a FROM {_CLAMP} GROUP BY p.image_id, p.x, p.y")
add("spread_alpha", base(lambda p: spatial.spread_alpha(p, True)), f"{views('px')}, {_OFF(1)} SELECT p.image_id, p.x, p.y, max(p.r) AS r, max(p.g) AS g, max(p.b) AS b, max(n.a) AS a FROM {_CLAMP} GROUP BY p.image_id, p.x, p.y")
