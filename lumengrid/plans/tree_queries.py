"""Queries of canvas trees held as rows: a tree of its own shape for every six orders, and the DuckDB text that folds each pixel."""

from __future__ import annotations

from lumengrid.operators import trees
from lumengrid.plans.pixel_queries import MODE_SQL, faded
from lumengrid.plans.sqltext import views
from lumengrid.plans.views import CHANNELS, pixels_base, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CANVAS = """o_orderkey AS canvas_id, CASE WHEN o_orderkey % 6 > 0 THEN {project} * 6 + o_custkey % (o_orderkey % 6) END AS parent_id, o_custkey % 5 AS seq,
CAST(CASE WHEN o_custkey % 17 = 0 AND o_orderkey % 6 > 0 THEN 0 ELSE 4 + o_custkey % 4 END AS INT) AS width, CAST(3 + o_orderkey % 3 AS INT) AS height, CAST(o_custkey % 5 - 1 AS INT) AS x, CAST(o_orderkey % 4 - 1 AS INT) AS y,
CAST(1 - (o_custkey % 3) / {five} AS DOUBLE) AS opacity, CASE o_custkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'multiply' ELSE 'screen' END AS blend_mode, CAST(NULL AS DOUBLE) AS rotation, o_custkey % 4 = 1 AS pass_through,
CASE o_orderkey % 7 WHEN 3 THEN 'center' WHEN 5 THEN 'bottom-right' END AS anchor"""
_LAYER = """SELECT o_orderkey AS canvas_id, 0 AS z, CAST(o_orderkey % 10 AS INT) AS image_id, CAST(-(o_custkey % 3) AS INT) AS x, CAST(o_custkey % 2 AS INT) AS y, 10 AS width, 10 AS height, CAST(1.0 AS DOUBLE) AS opacity, 'darken' AS blend_mode, o_custkey % 11 <> 0 AS visible, CAST(NULL AS {text}) AS anchor FROM {t}
UNION ALL SELECT o_orderkey, 1, CAST((o_custkey + 3) % 10 AS INT), 1, 1, 10, 10, CAST(0.6 AS DOUBLE), CASE WHEN o_custkey % 2 = 0 THEN 'screen' ELSE 'difference' END, true, CASE WHEN o_custkey % 3 = 0 THEN 'top-right' END FROM {t} WHERE o_orderkey % 2 = 0"""


def tree_tables(spark, d):
    """(canvases, layers): orders as nodes, each under one of the earlier ones of its six."""
    orders = read(spark, d, "orders")
    canvases = orders.selectExpr(*_split(_CANVAS.format(project="(o_orderkey div 6)", five="5D")))
    orders.createOrReplaceTempView("lumengrid_orders")
    return canvases, spark.sql(_LAYER.format(text="STRING", t="lumengrid_orders"))


def _split(columns: str) -> list[str]:
    """The expressions of a select list; those in brackets hold no comma that separates them."""
    out, depth, last = [], 0, 0
    for i, sign in enumerate(columns):
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth:
            out.append(columns[last:i].strip())
            last = i + 1
    return [*out, columns[last:].strip()]


def _mixed() -> dict[str, str]:
    used = ("multiply", "screen", "difference", "darken")
    text = {c: f"CASE t.mode {' '.join(f'''WHEN '{m}' THEN {MODE_SQL[m][c]}''' for m in used)} ELSE {MODE_SQL['normal'][c]} END" for c in CHANNELS}
    return faded(text, "t.op")


def _sql() -> str:
    place = lambda v, room, first, last: f"CASE WHEN a IS NULL THEN {v} WHEN a LIKE '{first}' THEN 0 WHEN a LIKE '{last}' THEN {room} ELSE CAST(trunc(({room}) / 2.0::DOUBLE) AS INT) END"
    at = lambda pw, ph: (place("x", f"{pw} - width", "%left", "%right"), place("y", f"{ph} - height", "top%", "bottom%"))
    cx, cy = at("pw", "ph")
    fold = ", ".join(f"{c} := {v}" for c, v in _mixed().items())
    thing = "struct_pack(r := r, g := g, b := b, a := a, mode := mode, op := op)"
    zero = "struct_pack(r := 0, g := 0, b := 0, a := 0, mode := '', op := CAST(0 AS DOUBLE))"
    levels = []
    for d in range(5, -1, -1):
        above = f" UNION ALL SELECT n.above_id, n.above_x + f.x, n.above_y + f.y, n.above_path, n.blend_mode, n.opacity, f.r, f.g, f.b, f.a FROM f{d + 1} f JOIN n ON n.canvas_id = f.id" if d < 5 else ""
        levels.append(f"""i{d} AS (SELECT target_id, m.x + px.x AS x, m.y + px.y AS y, path, mode, op, r, g, b, a FROM m JOIN px USING (image_id) WHERE depth = {d}{above}),
g{d} AS (SELECT canvas_id AS id, x, unnest(range(height)) AS y FROM (SELECT canvas_id, height, unnest(range(width)) AS x FROM n WHERE depth = {d} AND flat)),
s{d} AS (SELECT g.id, g.x, g.y, list({thing} ORDER BY path) FILTER (path IS NOT NULL) AS stack FROM g{d} g LEFT JOIN i{d} i ON i.target_id = g.id AND i.x = g.x AND i.y = g.y GROUP BY ALL),
f{d} AS (SELECT id, x, y, v.r AS r, v.g AS g, v.b AS b, v.a AS a FROM (SELECT id, x, y, coalesce(list_reduce(stack, lambda p, t: struct_pack({fold}, mode := '', op := CAST(0 AS DOUBLE)), {zero}), {zero}) AS v FROM s{d}))""")
    canvas = _CANVAS.format(project="(o_orderkey // 6)", five="5.0::DOUBLE")
    layer = _LAYER.format(text="VARCHAR", t="orders")
    lx, ly = at("pw", "ph")
    return f"""{views('px').replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT * FROM (SELECT {canvas} FROM orders) WHERE width > 0 AND height > 0),
n AS (
  SELECT canvas_id, width, height, blend_mode, opacity, true AS flat, canvas_id AS target_id, 0 AS depth, 0 AS dx, 0 AS dy, CAST([] AS BIGINT[]) AS path, CAST(NULL AS BIGINT) AS above_id, 0 AS above_x, 0 AS above_y, CAST(NULL AS BIGINT[]) AS above_path FROM c WHERE parent_id IS NULL
  UNION ALL SELECT canvas_id, width, height, blend_mode, opacity, flat, CASE WHEN flat THEN canvas_id ELSE target_id END, CASE WHEN flat THEN depth + 1 ELSE depth END, CASE WHEN flat THEN 0 ELSE dx + ax END, CASE WHEN flat THEN 0 ELSE dy + ay END,
    CASE WHEN flat THEN CAST([] AS BIGINT[]) ELSE here END, CASE WHEN flat THEN target_id END, dx + ax, dy + ay, here
  FROM (SELECT *, {cx} AS ax, {cy} AS ay FROM (SELECT c.*, c.anchor AS a, NOT c.pass_through AS flat, n.width AS pw, n.height AS ph, n.target_id, n.depth, n.dx, n.dy, list_concat(n.path, [0, c.seq, c.canvas_id]) AS here FROM c JOIN n ON c.parent_id = n.canvas_id))
),
l AS ({layer}),
v AS (SELECT l.*, row_number() OVER (PARTITION BY canvas_id ORDER BY z) AS low, EXISTS (SELECT 1 FROM c JOIN n u ON u.canvas_id = c.parent_id WHERE c.parent_id = l.canvas_id) AS children FROM l WHERE visible),
m AS (SELECT target_id, depth, list_concat(path, [1, z, 0]) AS path, image_id, dx + ax AS x, dy + ay AS y, CASE WHEN low = 1 AND NOT children THEN 'normal' ELSE mode END AS mode, op
  FROM (SELECT *, {lx} AS ax, {ly} AS ay FROM (SELECT v.*, v.anchor AS a, v.blend_mode AS mode, v.opacity AS op, n.width AS pw, n.height AS ph, n.target_id, n.depth, n.dx, n.dy, n.path FROM v JOIN n USING (canvas_id)))),
{", ".join(levels)}
SELECT id AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a FROM f0"""


QUERIES["canvas_trees"] = lambda spark, d: trees.render(*tree_tables(spark, d), pixels_base(spark, d))
SQL["canvas_trees"] = _sql()
