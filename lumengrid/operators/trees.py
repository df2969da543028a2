"""Canvas trees held as rows: any number of projects, each with a tree of its own shape, rendered by one job per depth.

- canvases: (canvas_id, parent_id, seq, width, height, x, y, opacity, blend_mode, rotation, pass_through, anchor); a root has no
  parent, children lie below the layers of their parent in the order of seq, then canvas_id.
- layers: (canvas_id, z, image_id, x, y, width, height, opacity, blend_mode, visible, anchor), and the images' pixels.

Where a child passes through and is not turned, what it holds is drawn into the canvas that it passes into, at the child's turn.
So every drawn thing has a target, a canvas that is flattened by itself, a place in it, and an order: the path to it in the tree,
as an array that sorts as drawing does. Targets are flattened from the deepest up: what covers a tile of one is cut to it, in blocks
of packed pixels, sorted and folded over its pixels; then the flat canvas, turned if it is to be, is one more thing that its own
target draws. So one row is shuffled for each thing on a tile, not for each pixel of it, and nothing of what lies outside a target. Tiles are
folded in NumPy, many at once; modes that mix channels (by colour, hue, saturation or lightness) are folded by expressions.

Canvases without width or height, and all they hold, are not drawn. A parent_id that no canvas has, or a ring of parents, hangs
on no root and is not drawn either. Anchors place a child or a layer in its parent; halves truncate toward zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.numeric import f32, u8
from lumengrid.operators import areas, blend, warp
from lumengrid.operators.canvas import ANCHORS
from lumengrid.plans.views import CHANNELS
from lumengrid.sources.staging import staged

#: Pixels and targets meet in blocks of so many pixels to a side.
BLOCK = 16
#: Things that a task folds at once; each covers a tile at most.
AT_ONCE = 2000
PATH = "array<struct<kind:int,n:long,id:long>>"


def _placed(anchor: Column, outer: tuple[Column, Column], inner: tuple[Column, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """x and y, or the anchor's place of an inner size in an outer one."""
    middle = lambda room: F.call_function("div", room, F.lit(2)).cast("int")
    rooms = [o - i for o, i in zip(outer, inner, strict=True)]
    col, row = F.element_at(F.split(anchor, "-"), -1), F.split(anchor, "-")[0]
    at_x = F.when(col == "left", 0).when(col == "right", rooms[0]).otherwise(middle(rooms[0]))
    at_y = F.when(row == "top", 0).when(row == "bottom", rooms[1]).otherwise(middle(rooms[1]))
    has = anchor.isin(*ANCHORS)
    return F.when(has, at_x).otherwise(x).cast("int"), F.when(has, at_y).otherwise(y).cast("int")


def resolved(canvases: DataFrame) -> DataFrame:
    """The canvases that hang on a root, with root_id, target_id (what their content is drawn into), its depth, and dx, dy, path within it.

    `flat`: the canvas is flattened by itself, and is its own content's target; above_id, above_x, above_y and above_path then say
    where its flat image is drawn. One join of the table with itself for each level of the trees.
    """
    own = canvases.where("width > 0 and height > 0").withColumns({"x": F.coalesce("x", F.lit(0)), "y": F.coalesce("y", F.lit(0)), "flat": ~(F.coalesce("pass_through", F.lit(False)) & F.col("rotation").isNull())})
    none = F.lit(None)
    empty = F.array().cast(PATH)
    level = own.where("parent_id is null").withColumns({
        "flat": F.lit(True), "root_id": F.col("canvas_id"), "target_id": F.col("canvas_id"), "depth": F.lit(0), "dx": F.lit(0), "dy": F.lit(0), "path": empty,
        "above_id": none.cast("long"), "above_x": none.cast("int"), "above_y": none.cast("int"), "above_path": none.cast(PATH),
    })
    found, shape = level, level.columns
    while True:
        up = level.select(F.col("canvas_id").alias("parent_id"), F.col("width").alias("pw"), F.col("height").alias("ph"), "root_id", "target_id", "depth", "dx", "dy", "path")
        below = own.join(up, "parent_id")
        x, y = _placed(F.col("anchor"), (F.col("pw"), F.col("ph")), (F.col("width"), F.col("height")), F.col("x"), F.col("y"))
        below = below.withColumns({"at_x": (F.col("dx") + x).cast("int"), "at_y": (F.col("dy") + y).cast("int"), "here": F.concat("path", F.array(F.struct(F.lit(0).alias("kind"), F.col("seq").cast("long").alias("n"), F.col("canvas_id").cast("long").alias("id"))))})
        flat = lambda yes, no: F.when(F.col("flat"), yes).otherwise(no)
        moved = {
            "above_id": flat(F.col("target_id"), none), "above_x": flat(F.col("at_x"), none), "above_y": flat(F.col("at_y"), none), "above_path": flat(F.col("here"), none),
            "target_id": flat(F.col("canvas_id"), F.col("target_id")), "depth": flat(F.col("depth") + 1, F.col("depth")), "dx": flat(F.lit(0), F.col("at_x")), "dy": flat(F.lit(0), F.col("at_y")), "path": flat(empty, F.col("here")),
        }
        level = staged(below.withColumns(moved).select(shape))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def _items(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """(target_id, depth, path, image_id, x, y, mode, opacity): each visible layer as a thing drawn into a target.

    The lowest visible layer of a canvas without children has nothing below it and is drawn normally.
    """
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("canvas_id")).distinct().withColumn("children", F.lit(True))
    about = nodes.select("canvas_id", F.col("width").alias("pw"), F.col("height").alias("ph"), "target_id", "depth", "dx", "dy", "path").join(parents, "canvas_id", "left")
    rows = layers.where("visible").join(about, "canvas_id")
    x, y = _placed(F.col("anchor"), (F.col("pw"), F.col("ph")), (F.col("width"), F.col("height")), F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
    lowest = F.row_number().over(Window.partitionBy("canvas_id").orderBy("z")) == 1
    mode = F.when(lowest & F.col("children").isNull(), "normal").otherwise(F.coalesce("blend_mode", F.lit("normal")))
    path = F.concat("path", F.array(F.struct(F.lit(1).alias("kind"), F.col("z").cast("long").alias("n"), F.lit(0).cast("long").alias("id"))))
    return rows.select("target_id", "depth", path.alias("path"), "image_id", (F.col("dx") + x).alias("x"), (F.col("dy") + y).alias("y"), mode.alias("mode"), F.coalesce("opacity", F.lit(1.0)).alias("opacity"))


def _blocks(pixels: DataFrame) -> DataFrame:
    """(image_id, x0, y0, w, h, data): images in blocks of BLOCK by BLOCK, each cut to its pixels' bounds; `data` has a packed pixel, or null, for each place (the first of a place's)."""
    x, y = F.floor(F.col("x") / BLOCK).alias("bx"), F.floor(F.col("y") / BLOCK).alias("by")
    packed = _packed({c: F.col(c) for c in CHANNELS}).alias("v")
    cells = pixels.groupBy("image_id", x, y).agg(F.array_sort(F.collect_list(F.struct("y", "x", packed))).alias("cells"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    places = F.transform("cells", lambda p: (p["y"] - F.col("y0")) * F.col("w") + p["x"] - F.col("x0"))
    whole = (F.size("cells") == F.col("w") * F.col("h")) & (F.size(F.array_distinct(places)) == F.size("cells"))
    gaps = F.expr("transform(sequence(0, w * h - 1), i -> get(filter(cells, p -> p.y = y0 + i div w AND p.x = x0 + i % w), 0).v)")
    data = F.when(whole, F.col("cells.v")).otherwise(gaps)
    return cells.select("image_id", "x0", "y0", "w", "h", data.alias("data"))


def _packed(pixel: dict[str, Column]) -> Column:
    """Four channels in the bytes of an int."""
    return sum((F.shiftleft(pixel[c].cast("int"), 8 * k) for k, c in enumerate(CHANNELS)), F.lit(0))


def _dealt(things: DataFrame) -> DataFrame:
    """Blocks (x0, y0, w, h, data) on targets of tw by th cut to the targets' tiles tx, ty; what lies beyond a target is left out."""
    own = things.withColumns({"ax": F.greatest("x0", F.lit(0)), "bx": F.least(F.col("x0") + F.col("w"), "tw") - 1, "ay": F.greatest("y0", F.lit(0)), "by": F.least(F.col("y0") + F.col("h"), "th") - 1}).where("ax <= bx and ay <= by")
    own = own.withColumn("tx", F.explode(F.expr(f"sequence(ax div {BLOCK}, bx div {BLOCK})"))).withColumn("ty", F.explode(F.expr(f"sequence(ay div {BLOCK}, by div {BLOCK})")))
    own = own.selectExpr("*", *[f"CAST(greatest(a{c}, t{c} * {BLOCK}) AS INT) AS c{c}" for c in "xy"], *[f"CAST(least(b{c}, t{c} * {BLOCK} + {BLOCK - 1}) - greatest(a{c}, t{c} * {BLOCK}) + 1 AS INT) AS n{c}" for c in "xy"])
    data = F.expr("CASE WHEN nx = w AND ny = h THEN data ELSE flatten(transform(sequence(0, ny - 1), j -> slice(data, CAST((cy - y0 + j) * w + cx - x0 + 1 AS INT), nx))) END")
    return own.select("target_id", "tx", "ty", "tw", "th", "path", "mode", "opacity", "cx", "cy", "nx", "ny", data.alias("data"))


def _tiles(things: DataFrame, ground: DataFrame) -> DataFrame:
    """The things and the ground, which has a row for each tile, with px, py, pw, ph: the tile's place in its target, and its size."""
    rows = things.unionByName(ground.withColumn("path", F.array().cast(PATH)), allowMissingColumns=True)
    return rows.selectExpr("*", *[f"CAST(t{c} * {BLOCK} AS INT) AS p{c}" for c in "xy"], *[f"CAST(least({BLOCK}, t{n} - t{c} * {BLOCK}) AS INT) AS p{n}" for c, n in (("x", "w"), ("y", "h"))])


def _stacked(rows: DataFrame, modes: list[str]) -> DataFrame:
    """(target_id, px, py, pw, ph, data): tiles whose things are drawn one over the other by expressions, whatever the modes."""
    thing = F.when(F.col("mode").isNotNull(), F.struct("path", "mode", "opacity", "cx", "cy", "nx", "ny", "data"))
    stacks = rows.groupBy("target_id", "px", "py", "pw", "ph").agg(F.array_sort(F.collect_list(thing)).alias("stack"))
    return stacks.select("target_id", "px", "py", "pw", "ph", F.transform(_folded(modes), lambda p: _packed({c: p[c] for c in CHANNELS})).alias("data"))


def _painted(rows: DataFrame, tables: dict[str, tuple[int, np.ndarray]]) -> DataFrame:
    """(target_id, px, py, pw, ph, data): tiles whose things are drawn one over the other in NumPy, by the modes of `tables` and the normal one.

    Rows come sorted by tile and path, the ground first. The last tile of a batch stays open, as its things may go on in the next.
    """
    names = list(tables)
    kind = F.coalesce(*[F.when(F.col("mode") == name, i) for i, name in enumerate(names)], F.lit(-1)).cast("int").alias("kind")
    tile = ["target_id", "px", "py", "pw", "ph"]

    def over(under: np.ndarray, top: np.ndarray, kind: np.ndarray, opacity: np.ndarray) -> np.ndarray:
        mixed = np.empty_like(top)
        for k in np.unique(kind).tolist():
            own = kind == k
            if k < 0:
                mixed[own] = blend.normal_rows(under[own], top[own])
            else:
                channels, table = tables[names[k]]
                made = table[under[own].astype(np.int32) * 256 + top[own]]
                made[:, channels:] = under[own][:, channels:]
                mixed[own] = made
        return blend.source_over_rows(under, mixed, opacity)

    def out(rows: list[np.ndarray], pixels: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(rows[3].astype(np.int64) * rows[4])]).astype(np.int32)
        data = pa.ListArray.from_arrays(ends, np.ascontiguousarray(pixels).view("<i4")[:, 0])
        return pa.record_batch([*map(pa.array, rows), data], [*tile, "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open tile and its pixels
        for batch in batches:
            for part in (batch.slice(at, AT_ONCE) for at in range(0, batch.num_rows, AT_ONCE)):
                target, px, py, pw, ph, kind, opacity, cx, cy, nx, ny = (part.column(i).to_numpy(zero_copy_only=False) for i in range(11))
                key = np.stack([target, px, py])
                new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
                of, first = np.cumsum(new) - 1, np.flatnonzero(new)
                rows = [c[first] for c in (target, px, py, pw, ph)]
                start = np.concatenate([[0], np.cumsum(rows[3].astype(np.int64) * rows[4])])
                pixels = np.zeros((start[-1], 4), np.uint8)
                if held is not None:
                    if all(c[0] == d[0] for c, d in zip(held[0][:3], rows[:3], strict=True)):
                        pixels[: start[1]] = held[1]
                    else:
                        yield out(*held)
                data = part.column(11)
                begin, size = data.offsets.to_numpy().astype(np.int64)[:-1] - data.offsets[0].as_py(), np.diff(data.offsets.to_numpy())
                values, shown = data.flatten().fill_null(0).to_numpy(), data.flatten().is_valid().to_numpy(zero_copy_only=False)
                rank = np.arange(len(of)) - first[of]
                order = np.argsort(rank, kind="stable")  # all lowest things, then all second ones
                rounds = np.concatenate([[0], np.cumsum(size[order])])[np.searchsorted(rank[order], np.arange(rank.max() + 2))]
                thing = np.repeat(order, size[order])
                i = np.arange(len(thing)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
                place = start[of[thing]] + (cy[thing] - py[thing] + i // nx[thing]) * pw[thing] + cx[thing] - px[thing] + i % nx[thing]
                at = begin[thing] + i
                for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
                    own = np.flatnonzero(shown[at[a:b]]) + a
                    if len(own):
                        p, t = place[own], thing[own]
                        top = np.ascontiguousarray(values[at[own]]).view(np.uint8).reshape(-1, 4)
                        pixels[p] = over(pixels[p], top, kind[t], opacity[t])
                cut = start[-2]
                if cut:
                    yield out([c[:-1] for c in rows], pixels[:cut])
                held = [c[-1:].copy() for c in rows], pixels[cut:].copy()
        if held is not None:
            yield out(*held)

    none = F.lit(0)
    whole = [F.coalesce(c, none).alias(c) for c in ("cx", "cy", "nx", "ny")]
    sent = rows.select(F.col("target_id").cast("long").alias("target_id"), "px", "py", "pw", "ph", kind, F.coalesce("opacity", F.lit(0.0)).alias("opacity"), *whole, F.coalesce("data", F.array().cast("array<int>")).alias("data"), "path")
    dealt = sent.repartition("target_id", "px", "py").sortWithinPartitions("target_id", "px", "py", "path").drop("path")
    return dealt.mapInArrow(run, "target_id long, px int, py int, pw int, ph int, data array<int>")


def _folded(modes: list[str]) -> Column:
    """The things of a tile's `stack` drawn one over the other, from clear: a pixel for each of the `pw` by `ph` places of the tile at `px`, `py`."""

    def over(under: Column, top: Column) -> Column:
        a, b = {c: under[c] for c in CHANNELS}, {c: top[c] for c in CHANNELS}
        made = {name: blend.mode(name)(a, b) for name in modes}
        mixed = {}
        for c in CHANNELS:
            pick = made["normal"][c]
            for name in modes:
                if name != "normal":
                    pick = F.when(top["mode"] == name, made[name][c]).otherwise(pick)
            mixed[c] = pick.cast("int").alias(c)
        # the mixed pixel stands in a lambda's variable, so that it is made once
        once = F.transform(F.array(F.struct(*mixed.values())), lambda m: _struct(blend.source_over(a, {c: m[c] for c in CHANNELS}, u8(f32(m["a"]) * f32(top["opacity"])))))
        return once[0]

    tops = f"""filter(transform(filter(stack, t -> px + i % pw >= t.cx AND px + i % pw < t.cx + t.nx AND py + i div pw >= t.cy AND py + i div pw < t.cy + t.ny),
        t -> struct(get(t.data, CAST((py + i div pw - t.cy) * t.nx + px + i % pw - t.cx AS INT)) AS v, t.mode AS mode, t.opacity AS opacity)), t -> t.v IS NOT NULL)"""
    split = ", ".join(f"shiftright(t.v, {8 * k}) & 255 AS {c}" for k, c in enumerate(CHANNELS))
    tops = F.expr(f"transform(sequence(0, pw * ph - 1), i -> transform({tops}, t -> struct({split}, t.mode AS mode, t.opacity AS opacity)))")
    return F.transform(tops, lambda stack: F.aggregate(stack, F.struct(*[F.lit(0).alias(c) for c in CHANNELS]), over))


def _struct(pixel: dict[str, Column]) -> Column:
    return F.struct(*[pixel[c].cast("int").alias(c) for c in CHANNELS])


def _spread(tiles: DataFrame) -> DataFrame:
    """The pixels of tiles (target_id, px, py, pw, data)."""
    rows = tiles.select("target_id", "px", "py", "pw", F.posexplode("data").alias("i", "v"))
    split = [F.expr(f"shiftright(v, {8 * k}) & 255").alias(c) for k, c in enumerate(CHANNELS)]
    return rows.select("target_id", F.expr("CAST(px + i % pw AS INT)").alias("x"), F.expr("CAST(py + i div pw AS INT)").alias("y"), *split)


def render(canvases: DataFrame, layers: DataFrame, pixels: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None, plain_id: int | None = None) -> DataFrame:
    """The pixels of every root canvas; image_id is its canvas_id.

    `finish` changes the flat images of all canvases below a root, but for `plain_id`, before they are turned; it may grow them.
    """
    nodes = staged(resolved(canvases))
    depth = nodes.agg(F.max("depth")).first()[0]
    if depth is None:
        return areas.blank(nodes.select(F.col("canvas_id").alias("image_id"), "width", "height"))
    items = staged(_items(nodes, layers))
    drawn = items.select("mode").union(nodes.select("blend_mode")).distinct().collect()  # names of modes
    modes = ["normal", *sorted({r[0] for r in drawn} & set(blend.MODES) - {"normal"})]
    tables = blend.tables(nodes.sparkSession, modes[1:])
    mixing = len(tables) < len(modes) - 1
    size = nodes.where("flat").select(F.col("canvas_id").alias("target_id"), F.col("width").alias("tw"), F.col("height").alias("th"))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias("opacity")
    blocks = staged(_blocks(pixels.join(items.select("image_id").distinct(), "image_id", "left_semi")))
    shape = ["target_id", "tw", "th", "path", "mode", "opacity", "x0", "y0", "w", "h", "data"]
    flats = None
    for at in range(depth, -1, -1):
        targets = nodes.where((F.col("depth") == at) & F.col("flat"))
        shown = items.where(F.col("depth") == at).join(size, "target_id").where("x < tw and y < th").join(blocks, "image_id")
        things = shown.select("target_id", "tw", "th", "path", "mode", unit(F.col("opacity")), (F.col("x") + F.col("x0")).alias("x0"), (F.col("y") + F.col("y0")).alias("y0"), "w", "h", "data")
        if flats is not None:
            things = things.unionByName(flats.join(size, "target_id").select(shape))
        things = _dealt(things)
        ground = targets.select(F.col("canvas_id").alias("target_id"), F.col("width").alias("tw"), F.col("height").alias("th"), F.explode(F.expr(f"sequence(0L, (width - 1) div {BLOCK})")).alias("tx"), "height").withColumn("ty", F.explode(F.expr(f"sequence(0L, (height - 1) div {BLOCK})"))).drop("height")
        rows = _tiles(things, ground)
        tiles = _stacked(rows, modes) if mixing else _painted(rows, tables)
        if at == 0:
            break
        about = targets.select(F.col("canvas_id").alias("target_id"), "above_id", "above_x", "above_y", "above_path", F.coalesce("blend_mode", F.lit("normal")).alias("mode"), unit(F.coalesce("opacity", F.lit(1.0))), "rotation")
        made = tiles.select("target_id", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("pw").alias("w"), F.col("ph").alias("h"), "data")
        turning = about.where("rotation is not null").select(F.col("target_id").alias("image_id"), F.col("rotation").alias("degrees"))
        turns = not turning.isEmpty()
        if finish is None and not turns:
            flat = staged(made)
        else:
            flat = staged(_spread(tiles))
            if finish is not None:
                stays = F.col("target_id") == F.lit(plain_id) if plain_id is not None else F.lit(False)
                changed = finish(flat.where(~stays).withColumnRenamed("target_id", "image_id")).withColumnRenamed("image_id", "target_id")
                flat = staged(changed.select(flat.columns).unionByName(flat.where(stays)))
            if turns:
                turned = warp.rotate(flat.withColumnRenamed("target_id", "image_id"), turning, None).withColumnRenamed("image_id", "target_id")
                flat = flat.join(about.where("rotation is null").select("target_id"), "target_id", "left_semi").unionByName(turned.select(flat.columns))
            flat = staged(_blocks(flat.withColumnRenamed("target_id", "image_id")).withColumnRenamed("image_id", "target_id"))
        flats = flat.join(about, "target_id").select(F.col("above_id").alias("target_id"), (F.col("above_x") + F.col("x0")).alias("x0"), (F.col("above_y") + F.col("y0")).alias("y0"), "w", "h", F.col("above_path").alias("path"), "mode", "opacity", "data")
    return _spread(tiles).withColumnRenamed("target_id", "image_id").select("image_id", "x", "y", *CHANNELS)
