"""Queries of areas and paths held as rows, over shapes that the input tables give, each with the DuckDB text of its result.

The texts test every sample against every edge, which the queries do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.functions.color import Gradient
from lumengrid.operators import areas, geometry, point
from lumengrid.plans.sqltext import f, u8, u8r, views
from lumengrid.plans.views import CHANNELS, RGB, pixels_base, read, sizes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def shapes(spark, d) -> DataFrame:
    """A polygon of 3 to 7 corners for each supplier; most cross themselves."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.explode(F.expr("sequence(0, 2 + s_suppkey % 5)")).alias("i"))
    return rows.selectExpr("s AS area_id", "CAST(i AS INT) AS seq", "((s * 37 + i * 53 + i * i * 11) % 29) * 0.75D AS px", "((s * 17 + i * 71 + i * i * 7) % 23) * 0.5D AS py")


def rings(spark, d) -> DataFrame:
    """A polygon for each user, with a corner for each of their events in order of time."""
    rows = read(spark, d, "events").selectExpr("user_id AS area_id", "ts", "event_id", "floor(value) % 60 + 0.25D * (event_id % 4) AS px", "event_id * 73 % 50 + 0.5D * (event_id % 3) AS py")
    return areas.numbered(rows, "ts", "event_id").select("area_id", "seq", "px", "py")


_PTS = """pts AS (SELECT s AS area_id, CAST(i AS INT) AS seq, ((s * 37 + i * 53 + i * i * 11) % 29) * 0.75::DOUBLE AS px, ((s * 17 + i * 71 + i * i * 7) % 23) * 0.5::DOUBLE AS py
  FROM (SELECT s_suppkey AS s, unnest(range(3 + s_suppkey % 5)) AS i FROM supplier))"""
_RINGS = """pts AS (SELECT user_id AS area_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  CAST(CAST(floor(value) AS BIGINT) % 60 + 0.25::DOUBLE * (event_id % 4) AS DOUBLE) AS px, CAST(event_id * 73 % 50 + 0.5::DOUBLE * (event_id % 3) AS DOUBLE) AS py FROM events)"""
#: A point's predecessor, the last one's for the first; `open` edges leave that out.
_EDGES = """e AS (SELECT area_id, seq, px AS xi, py AS yi, coalesce(lag(px) OVER w, last_value(px) OVER (PARTITION BY area_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS xj,
  coalesce(lag(py) OVER w, last_value(py) OVER (PARTITION BY area_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS yj FROM {pts} WINDOW w AS (PARTITION BY area_id ORDER BY seq))"""
_MOVED = "box AS (SELECT area_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1, CAST(ceil(max(px) - min(px)) AS INT) AS w, CAST(ceil(max(py) - min(py)) AS INT) AS h FROM pts GROUP BY area_id), moved AS (SELECT area_id, seq, px - x0 AS px, py - y0 AS py FROM pts JOIN box USING (area_id))"


def _grid(n: int, source: str) -> str:
    """All sample places of each area's box, n to a pixel's side."""
    return f"g AS (SELECT area_id, c, l, (c + 0.5::DOUBLE) / {n} AS qx, (l + 0.5::DOUBLE) / {n} AS qy FROM (SELECT area_id, c, unnest(range(h * {n})) AS l FROM (SELECT area_id, h, unnest(range(w * {n})) AS c FROM {source})))"


_SIDE = "(xj - xi) * (qy - yi) - (qx - xi) * (yj - yi)"
_WOUND = f"sum(CASE WHEN yi <= qy AND yj > qy AND {_SIDE} > 0 THEN 1 WHEN yi > qy AND yj <= qy AND {_SIDE} < 0 THEN -1 ELSE 0 END) <> 0"
_ODD = "sum(CASE WHEN (yi > qy) <> (yj > qy) AND qx < (xj - xi) * (qy - yi) / (yj - yi + 0.00001::DOUBLE) + xi THEN 1 ELSE 0 END) % 2 = 1"
_T = "(CASE WHEN (xj - xi) * (xj - xi) + (yj - yi) * (yj - yi) > 0 THEN greatest(least(((qx - xi) * (xj - xi) + (qy - yi) * (yj - yi)) / ((xj - xi) * (xj - xi) + (yj - yi) * (yj - yi)), 1), 0) ELSE 0 END)"
_DIST = f"sqrt(min((qx - ({_T} * (xj - xi) + xi)) * (qx - ({_T} * (xj - xi) + xi)) + (qy - ({_T} * (yj - yi) + yi)) * (qy - ({_T} * (yj - yi) + yi))))"
_IN = f"k AS (SELECT area_id, c, l, qx, qy FROM g JOIN e USING (area_id) GROUP BY ALL HAVING {_WOUND})"
_WHOLE = "box AS (SELECT area_id, CAST(ceil(max(px)) AS INT) + 4 AS w, CAST(ceil(max(py)) AS INT) + 4 AS h FROM pts GROUP BY area_id)"

add("areas_cover", lambda spark, d: areas.coverage(shapes(spark, d)), f"WITH {_PTS}, {_EDGES.format(pts='pts')}, {_WHOLE}, {_grid(4, 'box')}, {_IN} SELECT area_id, CAST(c // 4 AS INT) AS x, CAST(l // 4 AS INT) AS y, CAST(count(*) AS INT) AS cover FROM k GROUP BY ALL")
for _rule, _test in (("even-odd", _ODD), ("non-zero", _WOUND)):
    add("areas_inside_" + _rule.replace("-", "_"), lambda spark, d, r=_rule: areas.inside(rings(spark, d), r), f"WITH {_RINGS}, {_EDGES.format(pts='pts')}, {_WHOLE}, {_grid(1, 'box')} SELECT area_id, CAST(c AS INT) AS x, CAST(l AS INT) AS y FROM g JOIN e USING (area_id) GROUP BY area_id, c, l, qx, qy HAVING {_test}")
add("areas_distance", lambda spark, d: areas.near(shapes(spark, d), 3.0).select("area_id", "line", "column", F.round("d", 9).alias("d")), f"WITH {_PTS}, {_EDGES.format(pts='pts')}, {_WHOLE}, {_grid(1, 'box')}, m AS (SELECT area_id, c, l, {_DIST} AS d FROM g JOIN e USING (area_id) GROUP BY area_id, c, l) SELECT area_id, CAST(l AS BIGINT) AS line, CAST(c AS BIGINT) AS column, round(d, 9) AS d FROM m WHERE d <= 3")


def _places(spark, d) -> DataFrame:
    return read(spark, d, "part").selectExpr("p_partkey AS id", "p_size * 0.45D AS px", "p_partkey % 12 + 0.3D AS py")


add("areas_containing", lambda spark, d: areas.containing(shapes(spark, d), _places(spark, d)), f"WITH {_PTS}, {_EDGES.format(pts='pts')}, q AS (SELECT p_partkey AS id, p_size * 0.45::DOUBLE AS qx, p_partkey % 12 + 0.3::DOUBLE AS qy FROM part) SELECT id, area_id FROM q, e GROUP BY id, area_id HAVING {_ODD}")

# fills of each shape's box
_FILL = f"WITH {_PTS}, {_MOVED}, {_EDGES.format(pts='moved')}, {_grid(4, 'box')}, {_IN}"
_OUT = f"""p AS (SELECT area_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT area_id, x, unnest(range(h)) AS y FROM (SELECT area_id, h, unnest(range(w)) AS x FROM box WHERE w > 0 AND h > 0)) UNION ALL SELECT area_id, 0, 0 FROM box WHERE w <= 0 OR h <= 0),
m AS (SELECT area_id, CAST(c // 4 AS INT) AS x, CAST(l // 4 AS INT) AS y, count(*) AS cover, {', '.join(f'CAST(floor(sum({c}) / count(*)) AS INT) AS {c}' for c in CHANNELS)} FROM z GROUP BY ALL),
o AS (SELECT p.*, r, g, b, {f(f('a') + ' / ' + f('255'))} * {f('cover / 16.0::DOUBLE')} AS src FROM p LEFT JOIN m USING (area_id, x, y))
SELECT area_id AS image_id, x, y, {', '.join(f'CASE WHEN src > 0 THEN {c} ELSE 0 END AS {c}' for c in RGB)}, CASE WHEN src > 0 THEN {u8r(f'src * {f(255)}')} ELSE 0 END AS a FROM o"""
add("fill_polygon", lambda spark, d: areas.fill(shapes(spark, d), read(spark, d, "supplier").selectExpr("s_suppkey AS area_id", "CAST(s_suppkey * 7 % 256 AS INT) AS r", "CAST(s_nationkey * 10 AS INT) AS g", "30 AS b", "CAST(255 - s_suppkey % 100 AS INT) AS a")), f"{_FILL}, z AS (SELECT k.*, s_suppkey * 7 % 256 AS r, s_nationkey * 10 AS g, 30 AS b, 255 - s_suppkey % 100 AS a FROM k JOIN supplier ON s_suppkey = area_id), {_OUT}")


def _shade(time: str, one: tuple, other: tuple) -> str:
    """The truncated colour between two at a time in 0..1."""
    return ", ".join(f"CASE WHEN {time} < 1 THEN {u8(f'{a}::DOUBLE + {time} * {b - a}::DOUBLE')} ELSE {b} END AS {c}" for c, a, b in zip(CHANNELS, one, other, strict=True))


_COLD, _WARM = (0, 40, 90, 255), (255, 200, 100, 155)
_TIME = "(CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0 THEN greatest(least(((qx - ax) * (bx - ax) + (qy - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 1), 0) ELSE 0 END)"
_NEAR = f"n AS (SELECT area_id, c, l, least({_DIST} / 2, 1) AS s FROM g JOIN e USING (area_id) GROUP BY area_id, c, l)"
add("fill_gradient", lambda spark, d: areas.fill(shapes(spark, d), Gradient.from_to(_COLD, _WARM), feather=2), f"{_FILL}, {_NEAR}, t AS (SELECT k.*, s, {_TIME} AS t FROM k JOIN n USING (area_id, c, l) JOIN (SELECT area_id, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM box) USING (area_id)), u AS (SELECT area_id, c, l, s, {_shade('t', _COLD, _WARM)} FROM t), z AS (SELECT area_id, c, l, r, g, b, {u8(f'{f("a")} * {f("s")}')} AS a FROM u), {_OUT}")


def _lines_of(spark, d) -> DataFrame:
    return read(spark, d, "supplier").selectExpr("s_suppkey AS area_id", "CAST(s_suppkey % 4 AS DOUBLE) AS ax", "1.0D AS ay", "CAST(s_suppkey % 4 + s_suppkey % 9 AS DOUBLE) AS bx", "CAST(1 + s_suppkey % 6 AS DOUBLE) AS by")


add("fill_gradient_along", lambda spark, d: areas.fill(shapes(spark, d), Gradient.from_to(_COLD, _WARM), directions=_lines_of(spark, d)), f"{_FILL}, t AS (SELECT k.*, {_TIME} AS t FROM k JOIN (SELECT s_suppkey AS area_id, CAST(s_suppkey % 4 AS DOUBLE) AS ax, 1.0::DOUBLE AS ay, CAST(s_suppkey % 4 + s_suppkey % 9 AS DOUBLE) AS bx, CAST(1 + s_suppkey % 6 AS DOUBLE) AS by_ FROM supplier) USING (area_id)), z AS (SELECT area_id, c, l, {_shade('t', _COLD, _WARM)} FROM t), {_OUT}")
add("fill_image", lambda spark, d: areas.fill(shapes(spark, d), read(spark, d, "supplier").selectExpr("s_suppkey AS area_id", "CAST(s_suppkey % 10 AS INT) AS image_id"), texture=pixels_base(spark, d)), f"{_FILL.replace('WITH', views('px') + ',', 1)}, z AS (SELECT k.area_id, c, l, {', '.join(f'coalesce(px.{c}, 0) AS {c}' for c in CHANNELS)} FROM k LEFT JOIN px ON px.image_id = k.area_id % 10 AND px.x = c // 4 AND px.y = l // 4), {_OUT}")


# areas of images: two shapes for each of pixels_base, clipped to it, one after the other
def _image_shapes(spark, d) -> DataFrame:
    return shapes(spark, d).withColumns({"image_id": F.expr("CAST(area_id div 2 AS INT)"), "width": F.lit(10), "height": F.lit(10)})


_W = f"w AS (SELECT CAST(area_id // 2 AS INT) AS image_id, area_id % 2 AS turn, c AS x, l AS y, least({_DIST} / 2, 1) AS w FROM g JOIN e USING (area_id) GROUP BY area_id, c, l, qx, qy HAVING {_ODD})"


def _round(source: str, turn: int) -> str:
    w = f("w")
    return f"SELECT q.image_id, q.x, q.y, {', '.join(f'CASE WHEN coalesce(w, 0) > 0 THEN {u8(f"{f(new)} * {w} + {f(f"q.{c}")} * ({f(1)} - {w})")} ELSE q.{c} END AS {c}' for c, new in (('r', '255 - q.r'), ('g', '255 - q.g'), ('b', '255 - q.b'), ('a', 'q.a')))} FROM {source} q LEFT JOIN w ON w.image_id = q.image_id AND w.x = q.x AND w.y = q.y AND w.turn = {turn}"


add("areas_apply", lambda spark, d: areas.apply_in_areas(pixels_base(spark, d), _image_shapes(spark, d), point.invert, 2), f"{views('px')}, {_PTS}, {_EDGES.format(pts='pts')}, box AS (SELECT DISTINCT area_id, 10 AS w, 10 AS h FROM pts), {_grid(1, 'box')}, {_W}, one AS ({_round('px', 0)}) {_round('one', 1)}")
add("areas_stroke", lambda spark, d: areas.stroke(pixels_base(spark, d), _image_shapes(spark, d), 3.0, (250, 10, 60, 200), 0.7))

# paths
_SEG = "VALUES (0, 'line', 0.0{d}, 0.0{d}, s % 7 * 1.0{d}, s % 3 * 1.0{d}, 0.0{d}, 0.0{d}, 0.0{d}, 0.0{d}), (1, 'quad', s % 7 * 1.0{d}, s % 3 * 1.0{d}, s % 11 * 1.0{d}, 2.0{d}, s % 13 * 1.0{d}, s % 5 * 1.0{d}, 0.0{d}, 0.0{d}), (2, 'cubic', s % 13 * 1.0{d}, s % 5 * 1.0{d}, 1.0{d}, s % 9 * 1.0{d}, s % 8 * 1.0{d}, 7.0{d}, 3.0{d}, 4.0{d})"


def _segments(spark, d) -> DataFrame:
    rows = _SEG.format(d="D").removeprefix("VALUES ").replace("(", "struct(").replace("), struct", "), struct")
    parts = read(spark, d, "supplier").select(F.col("s_suppkey").alias("s")).select(F.col("s").alias("area_id"), F.explode(F.expr(f"array({rows})")).alias("v"))
    return parts.select("area_id", *[F.col(f"v.col{i + 1}").alias(c) for i, c in enumerate(("n", "kind", "x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"))])


def _curve(c: str) -> str:
    u = "(1 - i / n::DOUBLE)"
    t = "(i / n::DOUBLE)"
    return f"round(CASE WHEN i = 0 THEN {c}0 WHEN kind = 'line' THEN {c}1 WHEN kind = 'quad' THEN {u} * {u} * {c}0 + 2 * {u} * {t} * {c}1 + {t} * {t} * {c}2 ELSE {u} * {u} * {u} * {c}0 + 3 * {u} * {u} * {t} * {c}1 + 3 * {u} * {t} * {t} * {c}2 + {t} * {t} * {t} * {c}3 END, 9)"


_d = lambda a, b: f"sqrt(pow(x{b} - x{a}, 2) + pow(y{b} - y{a}, 2))"
add("path_flatten", lambda spark, d: areas.flattened(_segments(spark, d)).select("area_id", "seq", F.round("px", 9).alias("px"), F.round("py", 9).alias("py")), f"""WITH v AS (SELECT s_suppkey AS area_id, t.* FROM (SELECT s_suppkey, s_suppkey AS s FROM supplier) q, LATERAL ({_SEG.format(d='::DOUBLE')}) t(k, kind, x0, y0, x1, y1, x2, y2, x3, y3)),
p AS (SELECT *, CASE WHEN kind = 'line' THEN 1 ELSE greatest(2, CAST(ceil(({_d(0, 1)} + {_d(1, 2)} + CASE WHEN kind = 'cubic' THEN {_d(2, 3)} ELSE 0 END) / 0.5::DOUBLE) AS INT)) END AS n FROM v),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY area_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM p),
i AS (SELECT *, unnest(range(CASE WHEN k = 0 THEN 0 ELSE 1 END, n + 1)) AS i FROM b) SELECT area_id, CAST(began + i AS INT) AS seq, {_curve('x')} AS px, {_curve('y')} AS py FROM i""")
add("path_stats", lambda spark, d: geometry.path_stats(shapes(spark, d).withColumnRenamed("area_id", "path_id")).withColumn("length", F.round("length", 9)), f"WITH {_PTS}, l AS (SELECT *, sqrt(pow(px - lag(px) OVER w, 2) + pow(py - lag(py) OVER w, 2)) AS d FROM pts WINDOW w AS (PARTITION BY area_id ORDER BY seq)) SELECT area_id AS path_id, round(sum(d), 9) AS length, min(px) AS x_min, min(py) AS y_min, max(px) AS x_max, max(py) AS y_max FROM l GROUP BY area_id")

# blank images
_NEW = "p_partkey AS image_id, CAST(1 + p_size % 7 AS INT) AS width, CAST(1 + p_partkey % 5 AS INT) AS height, CAST(p_size AS INT) AS r, CAST(p_partkey % 256 AS INT) AS g, 7 AS b, CAST(255 - p_partkey % 9 AS INT) AS a"
add("new_image", lambda spark, d: areas.blank(read(spark, d, "part").selectExpr(*_NEW.split(", "))), f"WITH i AS (SELECT {_NEW} FROM part) SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a FROM (SELECT *, unnest(range(height)) AS y FROM (SELECT *, unnest(range(width)) AS x FROM i))")
_CH = "CASE WHEN (x // 3 + y // 3) % 2 = 0 THEN 200 ELSE 100 END"
add("checkerboard", lambda spark, d: areas.checkered(sizes(pixels_base(spark, d)), 3), f"{views('px')} SELECT image_id, x, y, {_CH} AS r, {_CH} AS g, {_CH} AS b, 255 AS a FROM px")
