"""Areas held as rows: outlines as tables of points, filled by scan lines.

A table of points has (area_id, seq, px, py), seq from 0 without gaps; an area is the closed polygon of its points. Any number
of areas of any number of points go through one plan. Each edge is dealt to the scan lines that it crosses, by arithmetic; the
sum of the crossings' directions along a line, in a window, says which spans lie inside. A crossing is held as the number
of the first sample column that lies right of it under the rule's own test, so spans agree with that test at every sample.

Areas without points, or with one or two of them, cover nothing. Horizontal edges cross no line. What lies at negative
places is left out, and, where the points carry an image's `width` and `height`, what lies beyond them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.functions.color import Gradient
from lumengrid.functions.numeric import div32, f32, u8, u8_round
from lumengrid.operators import blend, raster
from lumengrid.plans.views import CHANNELS, KEY, RGB
from lumengrid.sources.staging import staged

#: Sample columns beyond this are as good as infinity.
FAR = 1 << 30
#: Sample lines that a task takes of an area at once, and points of areas to a task.
BAND, POINTS = 16, 50_000
#: Ids of a place that one copy of its list of areas serves, and areas of which a list holds those around its place.
IDS, AREAS = 4096, 1 << 18
#: How much wider than exact the places are at which a distance is taken; a distance too many does no harm.
SLACK = 1e-9


def numbered(points: DataFrame, *order: str) -> DataFrame:
    """The points with seq counted anew from 0 in each area, in the given order."""
    return points.withColumn("seq", F.row_number().over(Window.partitionBy("area_id").orderBy(*order)) - 1)


def _ends(points: DataFrame) -> DataFrame:
    """(area_id, first, last) of each area, by partial aggregation."""
    at = F.struct("seq", "px", "py")
    return points.groupBy("area_id").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def edges(points: DataFrame, closed: bool = True) -> DataFrame:
    """(area_id, seq, xi, yi, xj, yj, ...): each point and the one before it; the first and the last where closed.

    Points meet by (area_id, seq), so that an area with most of all points is dealt like any other.
    """
    extra = [c for c in points.columns if c not in ("area_id", "seq", "px", "py")]
    here = points.select("area_id", "seq", F.col("px").alias("xi"), F.col("py").alias("yi"), *extra)
    before = points.select("area_id", (F.col("seq") + 1).alias("seq"), F.col("px").alias("xj"), F.col("py").alias("yj"))
    if closed:
        before = before.unionByName(_ends(points).select("area_id", "first.seq", F.col("last.px").alias("xj"), F.col("last.py").alias("yj")))
    return here.join(before, ["area_id", "seq"])


def corners(points: DataFrame, closed: bool = True) -> DataFrame:
    """(area_id, seq, vx, vy, xb, yb, xa, ya): each point with its neighbours before and after; at open ends these are null."""
    here = points.select("area_id", "seq", F.col("px").alias("vx"), F.col("py").alias("vy"))
    before = points.select("area_id", (F.col("seq") + 1).alias("seq"), F.col("px").alias("xb"), F.col("py").alias("yb"))
    after = points.select("area_id", (F.col("seq") - 1).alias("seq"), F.col("px").alias("xa"), F.col("py").alias("ya"))
    if closed:
        ends = _ends(points)
        before = before.unionByName(ends.select("area_id", "first.seq", F.col("last.px").alias("xb"), F.col("last.py").alias("yb")))
        after = after.where("seq >= 0").unionByName(ends.select("area_id", "last.seq", F.col("first.px").alias("xa"), F.col("first.py").alias("ya")))
    return here.join(before, ["area_id", "seq"], "left").join(after, ["area_id", "seq"], "left")


def _spread(rows: DataFrame, points: DataFrame, at_once: int, *keys: Column | str) -> DataFrame:
    """The rows dealt by keys to as many tasks as `at_once` points each ask for, before each is dealt to its samples.

    Their number is given, as few bytes of edges make many samples and would be put together in few tasks.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, points.count() // at_once + 1), *keys)


def _place(i: Column, samples: int) -> Column:
    """The coordinate of sample line or column i."""
    return (i + 0.5) / float(samples)


def spans(points: DataFrame, samples: int = 1, rule: str = "non-zero") -> DataFrame:
    """(area_id, line, k0, k1): on sample line `line`, sample columns k0 to k1 - 1 lie inside. `samples` lines and columns to a pixel."""
    sized = "width" in points.columns
    e = edges(points).where(F.col("yi") != F.col("yj"))
    low, high = F.least("yi", "yj"), F.greatest("yi", "yj")
    first = F.greatest(F.ceil(low * samples - 0.5) - 1, F.lit(0))
    last = F.ceil(high * samples - 0.5)
    last = F.least(last, F.col("height") * samples - 1) if sized else last
    # a band of lines of an area is dealt to one task, which makes its crossings, their sums and its spans
    e = e.withColumns({"first": first, "last": last}).where("first <= last").withColumn("band", F.explode(F.expr(f"sequence(first div {BAND}, last div {BAND})")))
    e = _spread(e, points, POINTS, "area_id", "band")
    rows = e.withColumn("line", F.explode(F.expr(f"sequence(greatest(first, band * {BAND}), least(last, band * {BAND} + {BAND - 1}))")))
    py = _place(F.col("line"), samples)
    rows = rows.where((low <= py) & (py < high))
    xi, yi, xj, yj = (F.col(c) for c in ("xi", "yi", "xj", "yj"))
    if rule == "non-zero":
        up = yi <= py
        side = lambda c: (xj - xi) * (py - yi) - (_place(c, samples) - xi) * (yj - yi)
        left = lambda c: F.when(up, side(c) > 0).otherwise(side(c) < 0)
        about, turn = (xj - xi) * (py - yi) / (yj - yi) + xi, F.when(up, 1).otherwise(-1)
    else:
        about, turn = (xj - xi) * (py - yi) / (yj - yi + 0.00001) + xi, F.lit(1)
        left = lambda c: _place(c, samples) < about
    guess = F.ceil(F.greatest(F.least(about * samples - 0.5, F.lit(float(FAR))), F.lit(float(-FAR))))
    found = rows.withColumn("k", guess)
    k = F.col("k") + F.when(left(F.col("k")), 1).otherwise(0) - F.when(left(F.col("k") - 1), 0).otherwise(1)
    own = ["width"] if sized else []
    crossings = found.select("area_id", "band", "line", k.alias("k"), turn.alias("turn"), *own).groupBy("area_id", "band", "line", "k", *own).agg(F.sum("turn").alias("turn"))
    along = Window.partitionBy("area_id", "band", "line").orderBy("k")
    inside = F.sum("turn").over(along)
    open_ = crossings.withColumns({"inside": inside if rule == "non-zero" else inside % 2, "k1": F.lead("k").over(along)}).where("inside <> 0 and k1 is not null")
    stop = F.least("k1", F.col("width") * samples) if sized else F.col("k1")
    return open_.select("area_id", "line", F.greatest("k", F.lit(0)).alias("k0"), stop.alias("k1")).where("k0 < k1")


def coverage(points: DataFrame, samples: int = 4, rule: str = "non-zero") -> DataFrame:
    """(area_id, x, y, cover): how many of a pixel's samples x samples points lie inside; pixels without any are left out."""
    at = lambda c: F.floor(c / samples).cast("int")
    rows = spans(points, samples, rule).withColumn("x", F.explode(F.sequence(at(F.col("k0")), at(F.col("k1") - 1))))
    n = F.least("k1", (F.col("x") + 1) * samples) - F.greatest("k0", F.col("x") * samples)
    each = rows.select("area_id", "x", at(F.col("line")).alias("y"), n.cast("int").alias("cover"))
    return each if samples == 1 else each.groupBy("area_id", "x", "y").agg(F.sum("cover").cast("int").alias("cover"))


def inside(points: DataFrame, rule: str = "even-odd") -> DataFrame:
    """(area_id, x, y): the pixels whose centres lie inside."""
    return coverage(points, 1, rule).select("area_id", "x", "y")


def containing(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, area_id): the areas that hold each place (id, px, py), by the even-odd rule.

    Edges are dealt by bands of rows of the plane, each one unit high, and meet the places of these rows where their crossings are
    counted. Ids at the same place share its tests. What is shuffled after them are the ids and, in arrays, the areas of each place,
    which make the pairs in as many tasks as the session shuffles by. Places of an id with several are counted together.
    """
    spark = places.sparkSession
    own = staged(places.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("px").alias("qx"), F.col("py").alias("qy")))).alias("spot")))
    spots = staged(own.groupBy("spot").agg(F.ceil(F.count("*") / IDS).alias("shares")).withColumns({"s": F.monotonically_increasing_id(), "many": F.size("spot") > 1}))
    row = F.floor(F.least("yi", "yj")), F.floor(F.greatest("yi", "yj"))
    e = edges(points).where(F.col("yi") != F.col("yj")).withColumns({"low": row[0], "high": row[1]})
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / BAND), F.floor(F.col("high") / BAND))))
    e = _spread(e, points, POINTS, "area_id", "band")
    e = e.withColumn("row", F.explode(F.sequence(F.greatest("low", F.col("band") * BAND), F.least("high", F.col("band") * BAND + BAND - 1)))).drop("seq")
    both = e.join(spots.select("s", "many", F.explode("spot").alias("at")).select("s", "many", "at.*", F.floor("at.qy").alias("row")), "row")
    xi, yi, xj, yj, qx, qy = (F.col(c) for c in ("xi", "yi", "xj", "yj", "qx", "qy"))
    hit = ((yi > qy) != (yj > qy)) & (qx < (xj - xi) * (qy - yi) / (yj - yi + 0.00001) + xi)
    counted = both.where(hit).groupBy("area_id", "band", "s", "many").agg(F.count("*").alias("n"))
    held = counted.where("n % 2 = 1 AND NOT many").select("s", "area_id")
    if not spots.where("many").isEmpty():
        held = held.unionByName(counted.where("many").groupBy("s", "area_id").agg(F.sum("n").alias("n")).where("n % 2 = 1").select("s", "area_id"))
    parts = points.where("seq = 0").count() // AREAS + 1
    lists = held.groupBy("s", F.pmod(F.xxhash64("area_id"), F.lit(parts)).alias("a")).agg(F.collect_list("area_id").alias("area_ids")).join(spots.select("s", "shares"), "s")
    lists = lists.select("s", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "area_ids")
    ids = own.join(spots, "spot").select("id", "s", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("a"))
    key = ["s", "share", "a"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # merged, ids go by one at a time: a task makes the pairs of one id and one list before it hands them on, never those of a list with all ids
    pairs = ids.repartition(tasks, *key).join(lists.repartition(tasks, *key).hint("merge"), key)
    return pairs.select("id", F.explode("area_ids").alias("area_id"))


# --- distances to outlines -----------------------------------------------------------------------------------------


def _between(low: Column, high: Column, samples: int) -> Column:
    """The sample columns from a low to a high place, none below 0."""
    first, last = F.greatest(F.ceil((low - SLACK) * samples - 0.5), F.lit(0)), F.floor((high + SLACK) * samples - 0.5)
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def _lines(low: Column, high: Column, samples: int) -> Column:
    return _between(low, high, samples)


def touched(points: DataFrame, reach: float, samples: int = 1, closed: bool = True) -> DataFrame:
    """(area_id, line, column, d): squared distances of samples to edges and corners that may be their nearest.

    A sample's nearest place on an outline lies within an edge, where its foot does, or is a corner, where it lies beyond both
    edges' ends. So each edge is dealt to the samples whose foot it holds and each corner to its wedge. The wedges of a smooth
    outline are slivers: the work grows with the outline's length and turning times `reach`, not with its number of edges.
    """
    e = edges(points, closed).where((F.col("xi") != F.col("xj")) | (F.col("yi") != F.col("yj")))
    xi, yi = F.col("xi"), F.col("yi")
    dx, dy = F.col("dx"), F.col("dy")
    e = e.withColumns({"dx": F.col("xj") - xi, "dy": F.col("yj") - yi}).withColumn("norm", dx * dx + dy * dy)
    some = int(POINTS / (reach * samples + 1) ** 2) + 100
    near_by = ("area_id", F.floor(F.col("seq") / 64))  # an area's neighbours share samples
    e = _spread(e, points, some, *near_by).withColumn("line", _lines(F.least("yi", "yj") - reach, F.greatest("yi", "yj") + reach, samples))
    py = _place(F.col("line"), samples)
    up = py - yi
    # the foot lies on the edge: 0 <= (px - xi) * dx + up * dy <= norm
    foot = lambda share: xi + (F.col("norm") * share - up * dy) / dx
    flat = (up * dy >= -SLACK) & (up * dy <= F.col("norm") + SLACK)
    low = F.when(dx != 0, F.least(foot(0.0), foot(1.0))).when(flat, -float(FAR))
    high = F.when(dx != 0, F.greatest(foot(0.0), foot(1.0))).when(flat, float(FAR))
    # and no farther than reach: |(px - xi) * dy - up * dx| <= reach * length
    wide = F.sqrt("norm") * reach
    side = lambda way: xi + (up * dx + wide * way) / dy
    close = F.abs(up * dx) <= wide + SLACK
    low = F.greatest(low, F.when(dy != 0, F.least(side(-1.0), side(1.0))).when(close, -float(FAR)))
    high = F.least(high, F.when(dy != 0, F.greatest(side(-1.0), side(1.0))).when(close, float(FAR)))
    possible = ((dx != 0) | flat) & ((dy != 0) | close)
    e = e.where(possible).withColumns({"low": low, "high": high}).withColumn("column", _between(F.col("low"), F.col("high"), samples))
    px = _place(F.col("column"), samples)
    t = F.greatest(F.least(((px - xi) * dx + (py - yi) * dy) / F.col("norm"), F.lit(1.0)), F.lit(0.0))
    square = lambda a: a * a
    feet = e.select("area_id", "line", "column", (square(px - (t * dx + xi)) + square(py - (t * dy + yi))).alias("d"))

    v = _spread(corners(points, closed), points, some, *near_by).withColumn("line", _lines(F.col("vy") - reach, F.col("vy") + reach, samples))
    up = _place(F.col("line"), samples) - F.col("vy")
    half = F.sqrt(F.greatest(reach * reach - up * up, F.lit(0.0)))
    low, high, fits = F.col("vx") - half, F.col("vx") + half, F.lit(True)
    for x, y in (("xb", "yb"), ("xa", "ya")):
        ax, ay = F.col(x) - F.col("vx"), F.col(y) - F.col("vy")
        edge = F.col("vx") + (F.lit(SLACK) - up * ay) / ax  # (px - vx) * ax + up * ay <= 0
        low, high = F.greatest(low, F.when(ax < 0, edge)), F.least(high, F.when(ax > 0, edge))  # nulls are passed over
        fits = fits & F.coalesce((ax != 0) | (up * ay <= SLACK), F.lit(True))
    v = v.where(fits).withColumns({"low": low, "high": high}).withColumn("column", _between(F.col("low"), F.col("high"), samples))
    tips = v.select("area_id", "line", "column", (square(_place(F.col("column"), samples) - F.col("vx")) + square(up)).alias("d"))
    return feet.unionByName(tips)


def near(points: DataFrame, reach: float, samples: int = 1, closed: bool = True) -> DataFrame:
    """(area_id, line, column, d): the distance to the outline of the samples within `reach` of it, least ones by partial aggregation."""
    least = touched(points, reach, samples, closed).groupBy("area_id", "line", "column").agg(F.sqrt(F.min("d")).alias("d"))
    return least.where(F.col("d") <= reach)


def weights(points: DataFrame, feather: int = 0, rule: str = "even-odd") -> DataFrame:
    """(area_id, x, y, w): 1 inside, rising over `feather` pixels from the outline; pixels outside are left out."""
    own = inside(points, rule)
    if not feather:
        return own.withColumn("w", F.lit(1.0))
    d = near(points.select("area_id", "seq", "px", "py"), float(feather)).select("area_id", F.col("column").cast("int").alias("x"), F.col("line").cast("int").alias("y"), "d")
    return own.join(d, ["area_id", "x", "y"], "left").select("area_id", "x", "y", F.coalesce(F.least(F.col("d") / float(feather), F.lit(1.0)), F.lit(1.0)).alias("w"))


def apply_in_areas(pixels: DataFrame, points: DataFrame, change: Callable[[DataFrame], DataFrame], feather: int = 0) -> DataFrame:
    """`change` applied to the images' pixels inside their areas; points carry the image_id of their area.

    An image's areas take their turn by area_id, each on what the one before left, in as many rounds as the image with the
    most areas has. Weighted results are truncated and mixed in alpha too; images without areas stay as they are.
    """
    own = points.select("image_id", "area_id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("image_id").orderBy("area_id")))
    rounds = own.agg(F.max("turn")).first()[0] or 0
    weight = weights(points.drop("image_id"), feather).join(own, "area_id")
    for turn in range(1, rounds + 1):
        new = change(pixels).select(*KEY, *[F.col(c).alias(f"t_{c}") for c in CHANNELS])
        both = pixels.join(weight.where(F.col("turn") == turn).select(*KEY, "w"), list(KEY), "left").join(new, list(KEY), "left")
        w = f32(F.col("w"))
        mix = lambda c: F.when((F.coalesce("w", F.lit(0.0)) <= 0) | F.col(f"t_{c}").isNull(), F.col(c)).otherwise(u8(f32(F.col(f"t_{c}")) * w + f32(F.col(c)) * (f32(1.0) - w)))  # noqa: B023, E731
        pixels = both.select(*KEY, *[mix(c).alias(c) for c in CHANNELS])
    return pixels


def stroke(pixels: DataFrame, points: DataFrame, size: float, color: tuple[int, int, int, int], hardness: float = 1.0) -> DataFrame:
    """A round brush drawn along the open lines of points that carry their image_id; where lines meet, the stronger one counts."""
    d = near(points.select("area_id", "seq", "px", "py"), size / 2.0, closed=False)
    images = points.select("area_id", "image_id").distinct()
    least = d.join(images, "area_id").groupBy("image_id", F.col("column").cast("int").alias("x"), F.col("line").cast("int").alias("y")).agg(F.min("d").alias("d"))
    rows = pixels.join(least, list(KEY), "left").withColumn("strength", F.coalesce(raster.dab(size, hardness, F.col("d")), F.lit(0.0)))
    old, new = {c: F.col(c) for c in CHANNELS}, {c: F.lit(v) for c, v in zip(CHANNELS, color, strict=True)}
    mixed = blend.source_over(old, new, u8(f32(F.lit(float(color[3]))) * f32(F.col("strength"))))
    return rows.select(*KEY, *[F.when(F.col("strength") > 0, mixed[c]).otherwise(old[c]).alias(c) for c in CHANNELS])


# --- fills ---------------------------------------------------------------------------------------------------------


def bounds(points: DataFrame) -> DataFrame:
    """(area_id, x0, y0, x1, y1)"""
    return points.groupBy("area_id").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def blank(images: DataFrame, color: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Constant images, one for each row (image_id, width, height); `color`, else the rows' own r, g, b, a; clear black without either."""
    given = set(CHANNELS) <= set(images.columns)
    paint = {c: F.lit(v) for c, v in zip(CHANNELS, color or (0, 0, 0, 0), strict=True)} if color or not given else {c: F.col(c) for c in CHANNELS}
    sized = images.where("width > 0 and height > 0").select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), *[paint[c].cast("int").alias(c) for c in CHANNELS])
    rows = sized.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select(*KEY, *CHANNELS)


def checkered(images: DataFrame, checker: int) -> DataFrame:
    """Light (200) and dark (100) opaque squares for each row (image_id, width, height); light at the origin."""
    even = (F.floor(F.col("x") / checker) + F.floor(F.col("y") / checker)) % 2 == 0
    return blank(images, (0, 0, 0, 255)).withColumns({c: F.when(even, 200).otherwise(100) for c in RGB})


def fill(
    points: DataFrame, paint: tuple[int, int, int, int] | DataFrame | Gradient, samples: int = 4, feather: int = 0,
    directions: DataFrame | None = None, texture: DataFrame | None = None,
) -> DataFrame:
    """A new image for each area, of its bounding box, with edges smoothed by samples; image_id is the area_id.

    `paint`: a colour; rows (area_id, r, g, b, a) of one colour each; a gradient, along its own path or each area's line in
    `directions` (area_id, ax, ay, bx, by), both in the new image's places, else between the box's upper corners; with
    `texture` (pixels), rows (area_id, image_id) name the image that each area takes its pixels from, from the corner on.
    Colours are taken at each sample, their mean is truncated. An area without width or height gives one clear pixel.
    """
    box = bounds(points).withColumns({"width": F.ceil(F.col("x1") - F.col("x0")), "height": F.ceil(F.col("y1") - F.col("y0"))})
    thin = (F.col("width") <= 0) | (F.col("height") <= 0)
    sized = box.withColumns({c: F.when(thin, 1).otherwise(F.col(c)).cast("int") for c in ("width", "height")})
    grid = blank(sized.withColumnRenamed("area_id", "image_id").select("image_id", "width", "height")).select(*KEY)
    moved = points.join(box.where(~thin).select("area_id", "x0", "y0"), "area_id").select("area_id", "seq", (F.col("px") - F.col("x0")).alias("px"), (F.col("py") - F.col("y0")).alias("py"))
    one = isinstance(paint, tuple)
    if texture is None and not feather and not isinstance(paint, Gradient):
        cover = coverage(moved, samples)
        shades = cover.select("*", *[F.lit(v).alias(c) for c, v in zip(CHANNELS, paint, strict=True)]) if one else cover.join(paint, "area_id")
    else:
        shades = _shaded(moved, box, paint, samples, feather, directions, texture)
    made = shades.withColumnRenamed("area_id", "image_id").withColumn("src", div32(f32(F.col("a")), f32(255.0)) * f32(F.col("cover") / float(samples * samples)))
    rows = grid.join(made, list(KEY), "left")
    hit = F.coalesce(F.col("src"), F.lit(0.0)) > 0
    return rows.select(*KEY, *[F.when(hit, F.col(c)).otherwise(0).cast("int").alias(c) for c in RGB], F.when(hit, u8_round(F.col("src") * f32(255.0))).otherwise(0).alias("a"))


def _shaded(moved, box, paint, samples, feather, directions, texture) -> DataFrame:
    """(area_id, x, y, cover, r, g, b, a): the means of colours taken at each sample inside."""
    rows = spans(moved, samples).withColumn("column", F.explode(F.sequence("k0", F.col("k1") - 1))).select("area_id", "line", "column")
    at = lambda c: F.floor(F.col(c) / samples).cast("int")
    if isinstance(paint, Gradient):
        px, py = _place(F.col("column"), samples), _place(F.col("line"), samples)
        if paint.direction is not None:
            time = raster.gradient_time_at(paint.direction, px, py)
        else:
            line = directions if directions is not None else box.select("area_id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y0").alias("by"))
            rows = rows.join(line, "area_id")
            dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
            norm = dx * dx + dy * dy
            time = F.when(norm > 0, F.greatest(F.least(((px - F.col("ax")) * dx + (py - F.col("ay")) * dy) / norm, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
        rows = rows.withColumn("time", time)
        color = paint.color_at(F.col("time"))
    elif texture is not None:
        source = texture.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *CHANNELS)
        rows = rows.join(paint.select("area_id", "image_id"), "area_id").withColumns({"sx": at("column"), "sy": at("line")}).join(source, ["image_id", "sx", "sy"], "left")
        color = {c: F.coalesce(c, F.lit(0)) for c in CHANNELS}
    elif isinstance(paint, DataFrame):
        rows = rows.join(paint, "area_id")
        color = {c: F.col(c) for c in CHANNELS}
    else:
        color = {c: F.lit(v) for c, v in zip(CHANNELS, paint, strict=True)}
    if feather:
        rows = rows.join(near(moved, float(feather), samples), ["area_id", "line", "column"], "left")
        color["a"] = u8(f32(color["a"]) * f32(F.coalesce(F.least(F.col("d") / float(feather), F.lit(1.0)), F.lit(1.0))))
    each = rows.select("area_id", at("column").alias("x"), at("line").alias("y"), *[color[c].alias(c) for c in CHANNELS])
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("int").alias(c)
    return each.groupBy("area_id", "x", "y").agg(F.count("*").alias("cover"), *[mean(c) for c in CHANNELS])


# --- paths ---------------------------------------------------------------------------------------------------------

#: What a segment's columns hold beyond its start x0, y0: its control points, then its end.
ENDS = {"line": 1, "quad": 2, "cubic": 3}


def flattened(segments: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Points (area_id, seq, px, py) of segments (area_id, n, kind, x0, y0, x1, y1, x2, y2, x3, y3), n in order from 0.

    A line (kind "line", to x1, y1) gives its end; a curve ("quad", "cubic") as many pieces as its control polygon is long in
    `tolerance`s, two at least. The first segment's start comes first. Points are numbered by sums over a path's segments.
    """
    d = lambda a, b: F.sqrt((F.col(f"x{b}") - F.col(f"x{a}")) ** 2 + (F.col(f"y{b}") - F.col(f"y{a}")) ** 2)
    hull = d(0, 1) + d(1, 2) + F.when(F.col("kind") == "cubic", d(2, 3)).otherwise(0.0)
    pieces = F.when(F.col("kind") == "line", 1).otherwise(F.greatest(F.lit(2), F.ceil(hull / tolerance))).cast("int")
    order = Window.partitionBy("area_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("pieces", pieces).withColumn("before", F.coalesce(F.sum("pieces").over(order), F.lit(0)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.when(F.col("n") == 0, 0).otherwise(1), F.col("pieces"))))
    t = F.col("i") / F.col("pieces")
    u = 1 - t

    def at(c: str) -> Column:
        p = [F.col(f"{c}{k}") for k in range(4)]
        return F.when(F.col("i") == 0, p[0]).when(F.col("kind") == "line", p[1]).when(F.col("kind") == "quad", u * u * p[0] + 2 * u * t * p[1] + t * t * p[2]).otherwise(u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3])

    return rows.select("area_id", (F.col("before") + F.col("i")).cast("int").alias("seq"), at("x").alias("px"), at("y").alias("py"))
