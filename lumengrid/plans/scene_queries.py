"""Queries of areas, fills, transforms, layers, tiles, streams and files, each with the DuckDB text of its result where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumengrid.functions import color
from lumengrid.operators import blend, canvas, collage, geometry, point, raster, shapes, spatial, stats, tiles, warp
from lumengrid.operators.geometry import Path
from lumengrid.plans.pixel_queries import MODE_SQL, base, faded
from lumengrid.plans.sqltext import f, u8, u8r, views
from lumengrid.plans.views import CHANNELS, RGB, pixels_base, pixels_large, pixels_top, read, sizes, to_images, to_pixels
from lumengrid.sources import images
from lumengrid.streaming import subjects

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# areas
TRIANGLE = Path.polygon((1.0, 1.0), (8.0, 2.0), (4.0, 9.0))
STAR = Path.polygon((5.0, 0.0), (8.0, 9.5), (0.0, 3.5), (10.0, 3.5), (2.0, 9.5))
RECT = Path.rect(2.0, 2.0, 6.0, 5.0)


def _edges(path: Path) -> str:
    return "e(xi, yi, xj, yj) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in e) + ")" for e in path.edges()) + ")"


_EVEN = "(SELECT sum(CASE WHEN (yi > {y}) <> (yj > {y}) AND {x} < ({y} - yi) * (xj - xi) / (yj - yi + 0.00001::DOUBLE) + xi THEN 1 ELSE 0 END) FROM e) % 2 = 1"
_WIND = "(SELECT sum(CASE WHEN yi <= {y} AND yj > {y} AND ({y} - yi) * (xj - xi) - ({x} - xi) * (yj - yi) < 0 THEN 1 WHEN yi > {y} AND yj <= {y} AND ({y} - yi) * (xj - xi) - ({x} - xi) * (yj - yi) > 0 THEN -1 ELSE 0 END) FROM e) <> 0"
_C = {"x": "(px.x + 0.5::DOUBLE)", "y": "(px.y + 0.5::DOUBLE)"}
add("point_in_polygon", base(lambda p: geometry.in_area(p, TRIANGLE)), f"{views('px')}, {_edges(TRIANGLE)} SELECT * FROM px WHERE {_EVEN.format(**_C)}")
add("point_in_star_even_odd", base(lambda p: p.where(geometry.contains(STAR)).select("image_id", "x", "y")), f"{views('px')}, {_edges(STAR)} SELECT image_id, x, y FROM px WHERE {_EVEN.format(**_C)}")
add("point_in_star_non_zero", base(lambda p: p.where(geometry.contains(STAR, "non-zero")).select("image_id", "x", "y")), f"{views('px')}, {_edges(STAR)} SELECT image_id, x, y FROM px WHERE {_WIND.format(**_C)}")
add("area_rect", base(lambda p: geometry.in_area(p, RECT)), f"{views('px')} SELECT * FROM px WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 6")
add("apply_area_invert", base(lambda p: raster.apply_in_area(p, point.invert, [(TRIANGLE, 0)])), f"{views('px')}, {_edges(TRIANGLE)} SELECT image_id, x, y, {', '.join(f'CASE WHEN {_EVEN.format(**_C)} THEN 255 - {c} ELSE {c} END AS {c}' for c in RGB)}, a FROM px")
_dist = "least(" + ", ".join(f"abs({v})" for v in ("px.x + 0.5::DOUBLE - 2", "px.x + 0.5::DOUBLE - 8", "px.y + 0.5::DOUBLE - 2", "px.y + 0.5::DOUBLE - 7")) + ")"
_W = f"CASE WHEN x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 6 THEN least({_dist} / 2, 1) ELSE 0 END"
add("apply_area_feather", base(lambda p: raster.apply_in_area(p, point.invert, [(RECT, 2)])), f"{views('px')}, w AS (SELECT *, {f(_W)} AS w FROM px) SELECT image_id, x, y, {', '.join(f'CASE WHEN w > 0 THEN {u8(f"{f(f'255 - {c}')} * w + {f(c)} * ({f(1)} - w)")} ELSE {c} END AS {c}' for c in RGB)}, CASE WHEN w > 0 THEN {u8(f'{f("a")} * w + {f("a")} * ({f(1)} - w)')} ELSE a END AS a FROM w")
add("apply_mask_invert", lambda spark, d: raster.apply_in_area(pixels_base(spark, d), point.invert, mask=pixels_top(spark, d)), f"""{views('px', 'pt')}, w AS (SELECT px.*, {f("coalesce(((pt.r * 299 + pt.g * 587 + pt.b * 114 + 500) // 1000) / 255.0::DOUBLE, 1.0::DOUBLE)")} AS w FROM px LEFT JOIN pt ON pt.image_id = px.image_id AND pt.x = px.x AND pt.y = px.y)
SELECT image_id, x, y, {', '.join(f'CASE WHEN w > 0 THEN {u8(f"{f(f'255 - {c}')} * w + {f(c)} * ({f(1)} - w)")} ELSE {c} END AS {c}' for c in RGB)}, CASE WHEN w > 0 THEN {u8(f'{f("a")} * w + {f("a")} * ({f(1)} - w)')} ELSE a END AS a FROM w""")
add("paint_brush", base(lambda p: raster.paint(p, 5.0, 5.0, 6.0, (255, 0, 0, 255), 0.5)))
add("stroke_path", base(lambda p: raster.stroke(p, Path((1.0, 1.0)).quad_to((9.0, 1.0), (9.0, 9.0)), 2.0, (0, 0, 255, 255))))
add("mask_area", base(lambda p: raster.draw_mask_area(raster.new_mask(p), RECT, 0, 2)))
_SEG = "SELECT CAST(s_suppkey AS INT) AS path_id, 0 AS seq, CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(s_suppkey % 7 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(s_suppkey % 5 AS DOUBLE) AS x2, CAST(s_suppkey % 11 AS DOUBLE) AS y2 FROM {t}"


def _segments(spark, d):
    read(spark, d, "supplier").createOrReplaceTempView("lumengrid_supplier")
    return spark.sql(_SEG.format(t="lumengrid_supplier"))


add("flatten_curves", lambda spark, d: geometry.flatten_table(_segments(spark, d)).select("path_id", "seq", "i", F.round("px", 9).alias("px"), F.round("py", 9).alias("py")), f"""WITH s AS ({_SEG.format(t='supplier')}), n AS (SELECT *, greatest(2, CAST(ceil((sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) + sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) / 0.5::DOUBLE) AS INT)) AS n FROM s),
r AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INT) AS i FROM n) SELECT path_id, seq, i, round((1 - i / n::DOUBLE) * (1 - i / n::DOUBLE) * x0 + 2 * (1 - i / n::DOUBLE) * (i / n::DOUBLE) * x1 + (i / n::DOUBLE) * (i / n::DOUBLE) * x2, 9) AS px, round((1 - i / n::DOUBLE) * (1 - i / n::DOUBLE) * y0 + 2 * (1 - i / n::DOUBLE) * (i / n::DOUBLE) * y1 + (i / n::DOUBLE) * (i / n::DOUBLE) * y2, 9) AS py FROM r""")


def _places(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 0.25).alias("px"), (F.col("p_partkey") % 13).cast("double").alias("py"))


add("closest_point", lambda spark, d: geometry.closest(_places(spark, d), Path((0.0, 0.0)).line_to((10.0, 0.0)).line_to((10.0, 12.0))).select("id", "px", "py", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), F.round("t", 9).alias("t"), F.round("distance", 9).alias("distance")), """WITH q AS (SELECT p_partkey AS id, p_size * 0.25::DOUBLE AS px, CAST(p_partkey % 13 AS DOUBLE) AS py FROM part), c AS (
SELECT id, px, py, 0 AS i, least(greatest(px * 10 / 100, 0), 1) AS t FROM q UNION ALL SELECT id, px, py, 1, least(greatest(py * 12 / 144, 0), 1) FROM q),
k AS (SELECT *, CASE WHEN i = 0 THEN t * 10 ELSE 10 END AS cx, CASE WHEN i = 0 THEN 0 ELSE t * 12 END AS cy FROM c), m AS (SELECT *, sqrt(pow(px - cx, 2) + pow(py - cy, 2)) AS d FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS n FROM m) SELECT id, px, py, round(CAST(cx AS DOUBLE), 9) AS cx, round(CAST(cy AS DOUBLE), 9) AS cy, round((t + i) / 2, 9) AS t, round(d, 9) AS distance FROM w WHERE n = 1""")

# transforms
add("resize_nearest", base(lambda p: warp.resize_nearest(p, 7, 13)), f"{views('px')}, g AS (SELECT DISTINCT image_id FROM px), q AS (SELECT image_id, CAST(p % 7 AS INT) AS tx, CAST(p // 7 AS INT) AS ty FROM g, range(91) t(p)) SELECT q.image_id, tx AS x, ty AS y, r, g, b, a FROM q JOIN px ON px.image_id = q.image_id AND px.x = CAST(floor(tx / 7.0::DOUBLE * 9) AS INT) AND px.y = CAST(floor(ty / 13.0::DOUBLE * 9) AS INT)")
for _n, _t, _xy in (("rotate_90", 1, "9 - y AS x, x AS y"), ("rotate_180", 2, "9 - x AS x, 9 - y AS y"), ("rotate_90_ccw", 3, "y AS x, 9 - x AS y")):
    add(_n, base(lambda p, t=_t: warp.rotate_quarter(p, t)), f"{views('px')} SELECT image_id, {_xy}, r, g, b, a FROM px")
for _n in ("bilinear", "bicubic", "lanczos", "edge-nedi", "edge-edi"):
    add("resize_" + _n.replace("-", "_"), base(lambda p, n=_n: warp.resize(p, 15, 6, n)))
add("rotate_30", base(lambda p: warp.rotate(p, 30.0)))
add("pinch", base(lambda p: warp.pinch(p, 0.5)))
add("ripple", base(lambda p: warp.ripple(p, 0.1, "small", "circular")))
add("gaussian_blur", base(lambda p: raster.gaussian_blur(p, 2)))
add("motion_blur", base(lambda p: raster.motion_blur(p, 30.0, 5)))
add("lens_blur", base(lambda p: raster.lens_blur(p, 2.0)))
_MED = f"{views('px')}, o AS (SELECT a.v AS dx, b.v AS dy FROM (SELECT unnest(range(-2, 3)) AS v) a, (SELECT unnest(range(-2, 3)) AS v) b) SELECT p.image_id, p.x, p.y, {', '.join(f'list_sort(list(n.{c}))[count(*) // 2 + 1] AS {c}' for c in RGB)}, max(p.a) AS a FROM px p CROSS JOIN o JOIN px n ON n.image_id = p.image_id AND n.x = least(9, greatest(0, p.x + o.dx)) AND n.y = least(9, greatest(0, p.y + o.dy)) GROUP BY p.image_id, p.x, p.y"
add("median_wide", base(lambda p: raster.median_wide(p, 2)), _MED)
add("smooth_skin", base(lambda p: raster.smooth_skin(p, 0.8)))
add("focus_blur", base(lambda p: raster.focus_blur(p, 3)))
add("image_round_trip", base(lambda p: to_pixels(to_images(p))), f"{views('px')} SELECT * FROM px")

# layers
_LAYERS = """SELECT CAST(o_orderkey {div} 4 AS INT) AS canvas_id, concat('L', CAST(o_orderkey % 4 AS STRING)) AS layer_id, concat('layer ', CAST(o_orderkey AS STRING)) AS name, CAST(o_orderkey % 4 AS INT) AS z, CAST(o_orderkey AS INT) AS image_id,
CAST(o_custkey % 40 AS INT) AS x, CAST(o_orderkey * 7 % 30 AS INT) AS y, CAST(10 + o_custkey % 20 AS INT) AS width, CAST(5 + o_orderkey % 30 AS INT) AS height, CAST(1 - (o_orderkey % 4) / {ten} AS DOUBLE) AS opacity,
CASE o_orderkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'multiply' ELSE 'screen' END AS blend_mode, o_orderkey % 5 <> 0 AS visible, CASE o_orderkey % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'bottom-right' WHEN 2 THEN 'top-center' ELSE NULL END AS anchor FROM {t}"""
_LSQL = "l AS (" + _LAYERS.format(div="//", ten="10.0::DOUBLE", t="orders").replace("STRING", "VARCHAR") + ")"


def layers(spark, d):
    """Every order as a layer, four to a canvas."""
    read(spark, d, "orders").createOrReplaceTempView("lumengrid_orders")
    return spark.sql(_LAYERS.format(div="div", ten="10D", t="lumengrid_orders"))


def _all(z: str, where: str = "", **new) -> str:
    cols = [f"{new.get(c, c)} AS {c}" for c in ("canvas_id", "layer_id", "name")] + [f"CAST({z} AS INT) AS z", "image_id"] + [f"{new.get(c, c)} AS {c}" for c in ("x", "y", "width", "height", "opacity", "blend_mode", "visible", "anchor")]
    return f"WITH {_LSQL} SELECT {', '.join(cols)} FROM l {where}"


_rn = lambda key: f"row_number() OVER (PARTITION BY canvas_id ORDER BY {key}) - 1"
add("layer_table", layers, _all("z"))
add("layer_visible", lambda spark, d: canvas.visible(layers(spark, d)), _all("z", "WHERE visible"))
add("layer_delete", lambda spark, d: canvas.delete(layers(spark, d), "L1"), _all(_rn("z"), "WHERE layer_id <> 'L1'"))
add("layer_reorder", lambda spark, d: canvas.reorder(layers(spark, d), ["L3", "L0", "L2", "L0"]), _all(_rn("CASE layer_id WHEN 'L2' THEN 0 WHEN 'L0' THEN 1 ELSE 2 END"), "WHERE layer_id IN ('L3', 'L0', 'L2')"))
add("layer_move_to", lambda spark, d: canvas.move_to(layers(spark, d), "L0", 2), _all("CASE layer_id WHEN 'L1' THEN 0 WHEN 'L2' THEN 1 WHEN 'L0' THEN 2 ELSE 3 END"))
add("layer_move_up", lambda spark, d: canvas.move_by(layers(spark, d), "L1", 1), _all("CASE layer_id WHEN 'L0' THEN 0 WHEN 'L2' THEN 1 WHEN 'L1' THEN 2 ELSE 3 END"))
add("layer_move_down", lambda spark, d: canvas.move_by(layers(spark, d), "L1", -1), _all("CASE layer_id WHEN 'L1' THEN 0 WHEN 'L0' THEN 1 WHEN 'L2' THEN 2 ELSE 3 END"))
add("layer_set", lambda spark, d: canvas.set_columns(layers(spark, d), "L2", opacity=1.5, visible=False, blend_mode="darken"), _all("z", opacity="CASE WHEN layer_id = 'L2' THEN 1.0::DOUBLE ELSE opacity END", visible="CASE WHEN layer_id = 'L2' THEN false ELSE visible END", blend_mode="CASE WHEN layer_id = 'L2' THEN 'darken' ELSE blend_mode END"))
add("layer_duplicate", lambda spark, d: canvas.duplicate(layers(spark, d), "L1"), f"WITH {_LSQL}, u AS (SELECT *, 0 AS up FROM l UNION ALL SELECT * REPLACE (layer_id || '-clone' AS layer_id, name || ' clone' AS name), 1 AS up FROM l WHERE layer_id = 'L1') SELECT canvas_id, layer_id, name, CAST({_rn('z, up')} AS INT) AS z, image_id, x, y, width, height, opacity, blend_mode, visible, anchor FROM u")
add("layer_add", lambda spark, d: canvas.add(layers(spark, d), layers(spark, d).where("layer_id = 'L0'").withColumn("layer_id", F.lit("N0"))), f"WITH {_LSQL}, u AS (SELECT * FROM l UNION ALL SELECT * REPLACE ('N0' AS layer_id, 4 AS z) FROM l WHERE layer_id = 'L0') SELECT * FROM u")
add("anchor_position", lambda spark, d: canvas.anchored(layers(spark, d), 101, 77), _all("z", x="CAST(CASE anchor WHEN 'center' THEN (101 - width) // 2 WHEN 'bottom-right' THEN 101 - width WHEN 'top-center' THEN (101 - width) // 2 ELSE x END AS INT)", y="CAST(CASE anchor WHEN 'center' THEN (77 - height) // 2 WHEN 'bottom-right' THEN 77 - height WHEN 'top-center' THEN 0 ELSE y END AS INT)"))
_m = "(least(x + width, 40) > greatest(x, 10) AND least(y + height, 25) > greatest(y, 5))"
add("layer_crop", lambda spark, d: canvas.crop(layers(spark, d), 10, 5, 30, 20), _all("z", x=f"CASE WHEN {_m} THEN greatest(x, 10) - 10 ELSE 0 END", y=f"CASE WHEN {_m} THEN greatest(y, 5) - 5 ELSE 0 END", width=f"CASE WHEN {_m} THEN least(x + width, 40) - greatest(x, 10) ELSE 0 END", height=f"CASE WHEN {_m} THEN least(y + height, 25) - greatest(y, 5) ELSE 0 END"))
add("layer_resize", lambda spark, d: canvas.resize(layers(spark, d), 1.5), _all("z", **{c: f"CAST(round({c} * 1.5::DOUBLE) AS INT)" for c in ("x", "y", "width", "height")}))


def _over(under: str, mode: str, opacity: float, dx: int, dy: int, top: str = "pt") -> str:
    cols = ", ".join(f"CASE WHEN t.a IS NULL THEN p.{c} ELSE {v} END AS {c}" for c, v in faded(MODE_SQL[mode], opacity).items())
    return f"SELECT p.image_id, p.x, p.y, {cols} FROM {under} p LEFT JOIN {top} t ON t.image_id = p.image_id AND t.x + {dx} = p.x AND t.y + {dy} = p.y"


# the lowest visible layer of a canvas without children is drawn normally
add("canvas_composite", lambda spark, d: canvas.composite(pixels_base(spark, d), [canvas.Layer(pixels_top(spark, d), "multiply", 0.6, 0, 0), canvas.Layer(pixels_top(spark, d), "normal", visible=False), canvas.Layer(pixels_top(spark, d), "multiply", 0.6, 2, 1)]), f"{views('px', 'pt')}, one AS ({_over('px', 'normal', 0.6, 0, 0)}) {_over('one', 'multiply', 0.6, 2, 1)}")
_BLANK = "(SELECT image_id, x, y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM px)"


def _nested(spark, d, through: bool):
    """A child with two layers below a parent's layer: flattened and screened at half opacity, or passing through."""
    px, pt = pixels_base(spark, d), pixels_top(spark, d)
    child = canvas.Canvas.blank(px, 10, 10).add_layer(canvas.Layer(px, "screen")).add_layer(canvas.Layer(pt, "multiply", 0.6, 1, 1))
    child = child.positioned(2, 3).faded(0.5).blended("screen").passing_through(through)
    return canvas.render(canvas.Canvas(px, (10, 10)).add_canvas(child).add_layer(canvas.Layer(pt, "darken", 0.6, 1, 0)))


add("canvas_nested", lambda spark, d: _nested(spark, d, False), f"{views('px', 'pt')}, e AS {_BLANK}, c1 AS ({_over('e', 'normal', 1.0, 0, 0, 'px')}), c2 AS ({_over('c1', 'multiply', 0.6, 1, 1)}), one AS ({_over('px', 'screen', 0.5, 2, 3, 'c2')}) {_over('one', 'darken', 0.6, 1, 0)}")
add("canvas_pass_through", lambda spark, d: _nested(spark, d, True), f"{views('px', 'pt')}, c1 AS ({_over('px', 'normal', 1.0, 2, 3, 'px')}), c2 AS ({_over('c1', 'multiply', 0.6, 3, 4)}) {_over('c2', 'darken', 0.6, 1, 0)}")


def _simple(spark, d):
    return canvas.Canvas.of(pixels_base(spark, d), 10, 10).add_layer(canvas.Layer(pixels_top(spark, d), "multiply", 0.6, 2, 1, size=(10, 10)))


def _flat(lower: str, upper: str) -> str:
    """The text of _simple's layers drawn, after changes of the two images."""
    return f"{views('px', 'pt')}, e AS {_BLANK}, lo AS ({lower}), up AS ({upper}), one AS ({_over('e', 'normal', 1.0, 0, 0, 'lo')}) {_over('one', 'multiply', 0.6, 2, 1, 'up')}"


add("canvas_flatten", lambda spark, d: canvas.render(_simple(spark, d).flattened()), f"{views('px', 'pt')}, e AS {_BLANK}, one AS ({_over('e', 'normal', 1.0, 0, 0, 'px')}), two AS ({_over('one', 'multiply', 0.6, 2, 1)}) {_over('e', 'normal', 1.0, 0, 0, 'two')}")
_flip = lambda t: f"SELECT image_id, 9 - x AS x, y, r, g, b, a FROM {t}"
add("canvas_flip", lambda spark, d: canvas.render(_simple(spark, d).flipped("x")), _flat(_flip("px"), _flip("pt")))
add("canvas_resize", lambda spark, d: canvas.render(_simple(spark, d).resized(15, 8)))
add("canvas_resize_width", lambda spark, d: canvas.render(_simple(spark, d).resized_width(15)))
add("canvas_widen", lambda spark, d: canvas.render(_simple(spark, d).widened(4)))
add("canvas_turn", lambda spark, d: canvas.render(_simple(spark, d).turned(30.0)))
add("canvas_rotated_child", lambda spark, d: canvas.render(canvas.Canvas(pixels_top(spark, d), (10, 10)).add_canvas(_simple(spark, d).rotated(45.0).positioned(-1, 2))))
add("canvas_anchored_child", lambda spark, d: canvas.render(canvas.Canvas(pixels_top(spark, d), (10, 10)).add_canvas(_simple(spark, d).anchored("bottom-right", 14, 13))), f"{views('px', 'pt')}, e AS {_BLANK}, one AS ({_over('e', 'normal', 1.0, 0, 0, 'px')}), two AS ({_over('one', 'multiply', 0.6, 2, 1)}) {_over('pt', 'normal', 1.0, 4, 3, 'two')}")
add("layer_effects", lambda spark, d: canvas.render(canvas.Canvas(pixels_top(spark, d), (10, 10)).add_layer(canvas.Layer(pixels_base(spark, d), size=(10, 10), effects=(("drop_shadow", {"distance": 3.0, "size": 2.0}), ("stroke", {"width": 2, "color": (1, 2, 3, 255)}))))))
add("project_metadata", lambda spark, d: canvas.project_metadata(layers(spark, d)).withColumn("names", F.concat_ws(",", "names")), f"WITH {_LSQL} SELECT canvas_id, count(*) AS n_layers, count(*) FILTER (visible) AS n_active, string_agg(name, ',' ORDER BY z) AS names FROM l GROUP BY canvas_id")
add("drop_shadow", base(lambda p: canvas.drop_shadow(p, (10, 10), (0, 0, 0), 0.5, 45.0, 3.0, 0.0, 2.0)))
_ed = "(x < 1.5::DOUBLE OR y < 1.5::DOUBLE OR x >= 8.5::DOUBLE OR y >= 8.5::DOUBLE)"
add("stroke_rect", base(lambda p: canvas.stroke_rect(p, 3, (1, 2, 3, 255), 10, 10)), f"{views('px')} SELECT image_id, x, y, CASE WHEN {_ed} THEN 1 ELSE r END AS r, CASE WHEN {_ed} THEN 2 ELSE g END AS g, CASE WHEN {_ed} THEN 3 ELSE b END AS b, CASE WHEN {_ed} THEN 255 ELSE a END AS a FROM px")
add("grid_layout", base(lambda p: canvas.grid_layout(p.select("image_id").distinct(), 7, (12, 15))), f"{views('px')}, n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS n FROM (SELECT DISTINCT image_id FROM px)) SELECT image_id, CAST(n % 7 AS INT) AS col, CAST(n // 7 AS INT) AS row, CAST(n % 7 * 12 AS INT) AS x, CAST(n // 7 * 15 AS INT) AS y FROM n")

# tiles
_IMG = "SELECT CAST(p_partkey AS INT) AS image_id, CAST(1 + p_partkey * 37 % 900 AS INT) AS width, CAST(1 + p_partkey * 53 % 700 AS INT) AS height FROM {t}"


def _image_sizes(spark, d):
    read(spark, d, "part").createOrReplaceTempView("lumengrid_part")
    return spark.sql(_IMG.format(t="lumengrid_part"))


_at = lambda i, s: f"CASE WHEN {i} * 240 + 256 > {s} AND {s} > 256 THEN {s} - 256 ELSE {i} * 240 END"
add("generate_tiles", lambda spark, d: tiles.generate(_image_sizes(spark, d), 256, 16), f"WITH s AS ({_IMG.format(t='part')}), n AS (SELECT *, (width + 239) // 240 AS nx, (height + 239) // 240 AS ny FROM s), t AS (SELECT *, unnest(range(nx * ny)) AS i FROM n), q AS (SELECT *, {_at('(i % nx)', 'width')} AS x, {_at('(i // nx)', 'height')} AS y FROM t) SELECT image_id, CAST(i AS INT) AS idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(least(256, width - x) AS INT) AS width, CAST(least(256, height - y) AS INT) AS height, CAST(nx * ny AS INT) AS total FROM q")
add("tile_merge", base(lambda p: tiles.merge(tiles.cut(p, 6, 2).withColumns({c: F.col(c) / 256.0 for c in RGB}))), f"{views('px')} SELECT image_id, x, y, {', '.join(f'CAST(floor({c} / 256.0::DOUBLE * 255) AS INT) AS {c}' for c in RGB)}, 255 AS a FROM px")
add("tile_process", base(lambda p: tiles.process(p, 6, 2, lambda own: 1 - own)))

# streams, batch forms
_EV = ["ts", "event_id"]
_cols = "event_id, ts, event_type, value"
events = lambda spark, d: read(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
add("latest_value", lambda spark, d: subjects.latest_value(events(spark, d), "user_id", _EV), f"SELECT user_id, {_cols} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
add("replay_last_n", lambda spark, d: subjects.replay_last(events(spark, d), "user_id", _EV, 3), f"SELECT user_id, {_cols}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS n FROM events QUALIFY n <= 3")
add("event_bus", lambda spark, d: subjects.of_type(events(spark, d), "click"), f"SELECT user_id, {_cols} FROM events WHERE event_type = 'click'")
add("history_log", lambda spark, d: subjects.history(events(spark, d), "user_id", _EV), f"SELECT user_id, {_cols}, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS index FROM events")
add("event_windows", lambda spark, d: subjects.windows(events(spark, d), "ts", "1 hour", "10 minutes", "event_type").select("start", "event_type", "n", F.round("total", 4).alias("total")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")

# palettes
_PAL = "pal AS (SELECT image_id, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY seen) - 1 AS idx FROM (SELECT image_id, r, g, b, min(y * 1000 + x) AS seen FROM px GROUP BY ALL))"
add("palette", base(lambda p: images.palette(p, 16)), f"{views('px')}, {_PAL} SELECT image_id, CAST(idx AS INT) AS idx, r, g, b FROM pal WHERE idx < 16")
add("indexed_colors", base(lambda p: images.indexed(p, 16)), f"{views('px')}, {_PAL} SELECT px.image_id, x, y, CAST(arg_min(idx, pow(px.r - pal.r, 2) * 1000 + pow(px.g - pal.g, 2) * 1000 + pow(px.b - pal.b, 2) * 1000 + idx) AS INT) AS idx FROM px JOIN pal ON pal.image_id = px.image_id AND idx < 16 GROUP BY px.image_id, x, y")
add("png_round_trip", base(lambda p: to_pixels(images.decoded(images.encoded(to_images(p))))), f"{views('px')} SELECT * FROM px")
add("gif_round_trip", base(lambda p: to_pixels(images.decoded(images.encoded(to_images(p), "gif"), "gif"))), f"{views('px')} SELECT image_id, x, y, r, g, b, 255 AS a FROM px")
add("image_sizes", base(sizes), f"{views('px')} SELECT image_id, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height FROM px GROUP BY image_id")


def flagship(spark, d):
    """The grey histogram of each image: scan, projection, aggregation."""
    grey = point.grayscale(pixels_base(spark, d)).select("image_id", F.col("r").alias("gray"))
    return grey.groupBy("image_id", "gray").agg(F.count("*").alias("cnt"))


_GRAY = u8(f"({f('r')} * {f(0.299)} + {f('g')} * {f(0.587)} + {f('b')} * {f(0.114)})")
add("gray_histogram", flagship, f"{views('px')} SELECT image_id, {_GRAY} AS gray, count(*) AS cnt FROM px GROUP BY ALL")
add("tone_then_blend", lambda spark, d: blend.blend(stats.auto_tone(spatial.box_blur(pixels_base(spark, d), 1)), point.grayscale(pixels_top(spark, d)), "screen"))

# ready-made outlines, lines, planes
for _n, _shape in (("star", shapes.star()), ("heart", shapes.heart()), ("ellipse", shapes.ellipse(5.0, 5.0, 9.0, 6.0)), ("hexagon", shapes.polygon(6)), ("pen_outline", shapes.outline(Path((1.0, 1.0)).line_to((8.0, 3.0)).line_to((4.0, 9.0)), 2.0, "square"))):
    _fitted = _shape.fit(10.0, 10.0) if _n != "pen_outline" else _shape
    add("area_" + _n, base(lambda p, s=_fitted: geometry.in_area(p, s)), f"{views('px')}, {_edges(_fitted)} SELECT * FROM px WHERE {_EVEN.format(**_C)}")
_LINE = "SELECT CAST(s_suppkey AS INT) AS id, CAST(s_suppkey % 5 AS INT) AS x0, CAST(s_suppkey % 7 AS INT) AS y0, CAST(s_suppkey % 23 AS INT) AS x1, CAST(s_suppkey % 17 AS INT) AS y1 FROM {t}"


def _lines(spark, d):
    read(spark, d, "supplier").createOrReplaceTempView("lumengrid_supplier")
    return spark.sql(_LINE.format(t="lumengrid_supplier"))


_step = lambda a, b: f"CAST({a} + sign({b} - {a}) * ((i * abs({b} - {a}) * 2 + greatest(n, 1)) // (greatest(n, 1) * 2)) AS INT)"
add("grid_lines", lambda spark, d: shapes.grid_lines(_lines(spark, d)), f"WITH l AS ({_LINE.format(t='supplier')}), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM l), i AS (SELECT *, CAST(unnest(range(n + 1)) AS INT) AS i FROM n) SELECT id, i, {_step('x0', 'x1')} AS x, {_step('y0', 'y1')} AS y FROM i")
add("planes_round_trip", base(lambda p: shapes.from_planes(shapes.to_planes(p).withColumn("values", F.transform("values", lambda v: 1 - v)), 10)), f"{views('px')} SELECT image_id, x, y, {', '.join(f'CAST(floor((1 - {c} / 255.0::DOUBLE) * 255.0::DOUBLE) AS INT) AS {c}' for c in RGB)}, 255 AS a FROM px")
add("indexed_round_trip", base(lambda p: shapes.from_indexed(images.indexed(p, 256), images.palette(p, 256))), f"{views('px')} SELECT image_id, x, y, r, g, b, 255 AS a FROM px")
add("brush_fill", base(lambda p: shapes.fill_with_dabs(p, TRIANGLE, 3.0, (9, 8, 7, 255))))
_lum = lambda t: f"(({t}.r * 0.299::DOUBLE + {t}.g * 0.587::DOUBLE + {t}.b * 0.114::DOUBLE) / 255)"
add("contrast_ratio", base(lambda p: p.select("image_id", "x", "y", F.round(color.contrast_ratio(color.luminance(F.col("r"), F.col("g"), F.col("b")), F.lit(0.5)), 9).alias("ratio"))), f"{views('px')} SELECT image_id, x, y, round((greatest({_lum('px')}, 0.5::DOUBLE) + 0.05::DOUBLE) / (least({_lum('px')}, 0.5::DOUBLE) + 0.05::DOUBLE), 9) AS ratio FROM px")


def _turned(p, *steps):
    """Conversions one after the other, each a projection of its own, so that no expression is repeated."""
    at = RGB
    for step in steps:
        p = p.withColumns(dict(zip(("_1", "_2", "_3"), step(*[F.col(c) for c in at]), strict=True)))
        at = ("_1", "_2", "_3")
    return p.select("image_id", "x", "y", *[F.col(a).alias(c) for a, c in zip(at, RGB, strict=True)], "a")


add("hsv_by_hsl_round_trip", base(lambda p: _turned(p, color.rgb_to_hsv, color.hsv_to_hsl, color.hsl_to_rgb)), f"{views('px')} SELECT * FROM px")
_LAB = (("lab_by_hsl", color.rgb_to_hsl, color.hsl_to_lab, color.lab_to_rgb), ("lab_by_hsv", color.rgb_to_hsv, color.hsv_to_lab, color.lab_to_rgb), ("hsl_by_lab", color.rgb_to_lab, color.lab_to_hsl, color.hsl_to_rgb), ("hsv_by_lab", color.rgb_to_lab, color.lab_to_hsv, color.hsv_to_rgb))
for _n, *_steps in _LAB:
    add(_n + "_round_trip", base(lambda p, s=tuple(_steps): _turned(p, *s)), f"{views('px')} SELECT * FROM px")
add("hsl_by_hsv_round_trip", base(lambda p: _turned(p, color.rgb_to_hsl, color.hsl_to_hsv, color.hsv_to_rgb)), f"{views('px')} SELECT * FROM px")
add("gradient_rainbow", base(lambda p: point.gradient_map(p, color.Gradient.rainbow())))
add("gradient_hue_reversed", base(lambda p: point.gradient_map(p, color.Gradient.hue().reverse())))

# large images: the functions that work by tiles, row windows or batches
large = lambda change: lambda spark, d: change(pixels_large(spark, d))
add("large_round_trip", large(lambda p: to_pixels(to_images(p))), f"{views('pl')} SELECT * FROM pl")
add("large_invert_in_area", large(lambda p: raster.apply_in_area(p, point.invert, [(Path.rect(20.0, 1.0, 200.0, 30.0), 0)])), f"{views('pl')} SELECT image_id, x, y, {', '.join(f'CASE WHEN x BETWEEN 20 AND 219 AND y BETWEEN 1 AND 30 THEN 255 - {c} ELSE {c} END AS {c}' for c in RGB)}, a FROM pl")
add("large_tile_merge", large(lambda p: tiles.merge(tiles.cut(p, 64, 8).withColumns({c: F.col(c) / 256.0 for c in RGB}))), f"{views('pl')} SELECT image_id, x, y, {', '.join(f'CAST(floor({c} / 256.0::DOUBLE * 255) AS INT) AS {c}' for c in RGB)}, 255 AS a FROM pl")
_TAP = lambda c: f"CAST(least(greatest(round({' + '.join(f'coalesce(n{i}.{c}, 0) * {w}::DOUBLE' for i, w in enumerate(spatial.SHARPEN) if w)}), 0), 255) AS INT) AS {c}"
add("large_sharpen", large(lambda p: spatial.apply_kernel(p, spatial.SHARPEN)), f"{views('pl')} SELECT p.image_id, p.x, p.y, {', '.join(map(_TAP, CHANNELS))} FROM pl p " + " ".join(f"LEFT JOIN pl n{i} ON n{i}.image_id = p.image_id AND n{i}.x = p.x + {i % 3 - 1} AND n{i}.y = p.y + {i // 3 - 1}" for i, w in enumerate(spatial.SHARPEN) if w))
add("large_gaussian", large(lambda p: raster.gaussian_blur(p, 8)))
add("large_median", large(lambda p: spatial.median(p, 4)))
add("large_resize", large(lambda p: warp.resize(p, 600, 150, "bicubic")))
add("large_auto_color", large(stats.auto_color))

add("copy_channel", lambda spark, d: point.copy_channel(pixels_base(spark, d), pixels_top(spark, d), "g", "r"), f"{views('px', 'pt')} SELECT px.image_id, px.x, px.y, coalesce(pt.g, px.r) AS r, px.g, px.b, px.a FROM px LEFT JOIN pt ON pt.image_id = px.image_id AND pt.x = px.x AND pt.y = px.y")

# more of the layer algebra
add("layer_to_top", lambda spark, d: canvas.move_to_top(layers(spark, d), "L1"), _all("CASE layer_id WHEN 'L0' THEN 0 WHEN 'L2' THEN 1 WHEN 'L3' THEN 2 ELSE 3 END"))
add("layer_to_bottom", lambda spark, d: canvas.move_to_bottom(layers(spark, d), "L2"), _all("CASE layer_id WHEN 'L2' THEN 0 WHEN 'L0' THEN 1 WHEN 'L1' THEN 2 ELSE 3 END"))
add("layer_find", lambda spark, d: canvas.find(layers(spark, d), blend_mode="screen"), f"WITH {_LSQL} SELECT * FROM l WHERE blend_mode = 'screen' QUALIFY row_number() OVER (PARTITION BY canvas_id ORDER BY z) = 1")
add("layer_count", lambda spark, d: canvas.count(layers(spark, d)), f"WITH {_LSQL} SELECT canvas_id, count(*) AS n FROM l GROUP BY canvas_id")
add("layer_place_relative", lambda spark, d: canvas.place_relative(layers(spark, d), "L1", "L3", 5, -4), _all("z", x="CASE WHEN layer_id = 'L1' THEN coalesce(max(CASE WHEN layer_id = 'L3' THEN x END) OVER (PARTITION BY canvas_id) + 5, x) ELSE x END", y="CASE WHEN layer_id = 'L1' THEN coalesce(max(CASE WHEN layer_id = 'L3' THEN y END) OVER (PARTITION BY canvas_id) - 4, y) ELSE y END"))
add("layer_recenter", lambda spark, d: canvas.recenter(layers(spark, d), 21, "y"), _all("z", y="CAST(trunc((21 - height) / 2.0::DOUBLE) AS INT)"))
_ratio = lambda pick: f"{pick}({f(f('40') + ' / ' + f('width'))}, {f(f('30') + ' / ' + f('height'))})"
for _rule, _pick in (("contain", "least"), ("cover", "greatest")):
    add("layer_" + _rule, lambda spark, d, r=_rule: canvas.fit_layers(layers(spark, d), r, 40, 30), _all("z", **{c: f"CAST(floor({f(f(c) + ' * ' + _ratio(_pick))}) AS INT)" for c in ("width", "height")}))
add("layer_adjustment", lambda spark, d: canvas.adjustment(layers(spark, d), "adj", "levels"), f"WITH {_LSQL}, n AS (SELECT canvas_id, CAST(max(z) + 1 AS INT) AS z FROM l GROUP BY canvas_id) SELECT * FROM l UNION ALL SELECT canvas_id, 'adj', 'levels', z, NULL, 0, 0, 1, 1, 1.0, 'normal', true, NULL FROM n")
add("random_layout", base(lambda p: canvas.random_layout(sizes(p), 640, 480, 7)))
add("collage_grid", lambda spark, d: collage.collage(pixels_base(spark, d), "grid", 4, 4, (48, 40), 5))
add("collage_layered", lambda spark, d: collage.collage(pixels_base(spark, d), "layered", 4, 3, (48, 36), 5, (-20.0, 20.0), (1.0, 1.4), (20, 40, 60, 255), (("stroke", {"width": 2}),)))
add("collage_random", lambda spark, d: collage.collage(pixels_base(spark, d), "random", 40, 1, (200, 160), 3, (-30.0, 30.0), (1.0, 2.0)))
