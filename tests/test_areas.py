"""Areas held as rows against loops over every sample and every edge, and against areas held as paths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions.color import Gradient
from lumengrid.operators import areas, point, raster
from lumengrid.operators.geometry import Path
from tests.test_operators import random_pixels

POINTS = "area_id long, seq int, px double, py double"


def table(spark, shapes, **extra):
    rows = [(i, k, float(x), float(y)) for i, own in shapes.items() for k, (x, y) in enumerate(own)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def odd_shapes():
    """Corners on sample places, repeated and collinear corners, crossings, thin and flat shapes, negative places."""
    r = random.Random(3)
    shapes = {i: [(r.randint(-8, 40) / 4, r.randint(-8, 40) / 4) for _ in range(r.randint(3, 9))] for i in range(40)}
    shapes |= {50: [(1, 1)], 51: [(1, 1), (5, 6)], 52: [(1, 2), (6, 2), (9, 2)], 53: [(0.5, 0.5), (0.5, 4.5), (4.5, 4.5), (4.5, 0.5)], 54: [(2, 2), (2, 2), (7, 2), (7, 2), (7, 6), (2, 6), (2, 2)]}
    return shapes | {55: [(-5, -5), (30, -5), (30, 3), (-5, 3)], 56: [(3, 1), (3, 8)] * 3, 57: [(1.125, 0.375), (6.875, 0.375), (4, 7.625)]}


def edges_of(own):
    return list(zip(own, [own[-1], *own[:-1]], strict=True))


def wound(own, x, y):
    total = 0
    for (xi, yi), (xj, yj) in edges_of(own):
        side = (xj - xi) * (y - yi) - (x - xi) * (yj - yi)
        total += 1 if yi <= y < yj and side > 0 else -1 if yj <= y < yi and side < 0 else 0
    return total != 0


def odd(own, x, y):
    return sum((yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 0.00001) + xi for (xi, yi), (xj, yj) in edges_of(own)) % 2 == 1


def away(own, x, y, closed=True):
    best = math.inf
    for (xi, yi), (xj, yj) in edges_of(own)[0 if closed else 1 :]:
        norm = (xj - xi) ** 2 + (yj - yi) ** 2
        t = min(max(((x - xi) * (xj - xi) + (y - yi) * (yj - yi)) / norm, 0), 1) if norm else 0
        best = min(best, math.hypot(x - xi - t * (xj - xi), y - yi - t * (yj - yi)))
    return best


@pytest.mark.parametrize("samples", [1, 4])
@pytest.mark.parametrize("rule, test", [("non-zero", wound), ("even-odd", odd)])
def test_coverage_is_that_of_every_sample(spark, samples, rule, test):
    shapes = odd_shapes()
    want = {}
    for i, own in shapes.items():
        for y in range(12):
            for x in range(32):
                n = sum(test(own, x + (u + 0.5) / samples, y + (v + 0.5) / samples) for u in range(samples) for v in range(samples))
                if n:
                    want[i, x, y] = n
    assert {(r.area_id, r.x, r.y): r.cover for r in areas.coverage(table(spark, shapes), samples, rule).where("y < 12").collect()} == want
    assert areas.coverage(table(spark, shapes).where("false"), samples, rule).count() == 0


def test_areas_are_clipped_to_their_image(spark):
    rows = areas.inside(table(spark, odd_shapes(), width=7, height=5))
    whole = areas.inside(table(spark, odd_shapes()))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rows) == key(whole.where("x < 7 and y < 5"))


@pytest.mark.parametrize("closed", [True, False])
def test_distances_are_those_to_every_edge(spark, closed):
    shapes = {i: own for i, own in odd_shapes().items() if len(own) > 1}
    got = {(r.area_id, r.column, r.line): r.d for r in areas.near(table(spark, shapes), 2.5, closed=closed).where("column < 16 and line < 16").collect()}
    want = {(i, x, y): d for i, own in shapes.items() for y in range(16) for x in range(16) if (d := away(own, x + 0.5, y + 0.5, closed)) <= 2.5}
    assert got.keys() ^ want.keys() <= {k for k in got.keys() | want.keys() if abs(want.get(k, got.get(k)) - 2.5) < 1e-9}
    assert max(abs(got[k] - want[k]) for k in got.keys() & want.keys()) < 1e-9
    alone = {(r.column, r.line) for r in areas.near(table(spark, {1: [(4.0, 4.0)]}), 2.0).collect()}
    assert alone == {(x, y) for x in range(9) for y in range(9) if math.hypot(x - 3.5, y - 3.5) <= 2}


def ring(n, radius=30.0, at=40.0):
    return [(at + radius * math.cos(2 * math.pi * k / n), at + radius * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_work_is_free_of_the_number_of_edges(spark):
    few, many = (areas.touched(table(spark, {0: ring(n)}), 6.0).count() for n in (100, 5000))
    assert many < 1.1 * few
    got = {(r.column, r.line): r.d for r in areas.near(table(spark, {0: ring(5000)}), 6.0).collect()}
    want = {(x, y): d for y in range(80) for x in range(80) if (d := abs(math.hypot(x + 0.5 - 40, y + 0.5 - 40) - 30)) <= 5.99}
    assert want.keys() <= got.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_thousands_of_areas_of_thousands_of_edges(spark):
    """Two thousand rings by formula; one has most of all points."""
    n = F.when(F.col("id") == 7, 300_000).otherwise(1000)
    rows = spark.range(2000).withColumn("n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    turn = F.col("seq") * 2 * math.pi / F.col("n")
    shapes = rows.select(F.col("id").alias("area_id"), "seq", (10 + 8 * F.cos(turn)).alias("px"), (10 + 8 * F.sin(turn)).alias("py"))
    counts = [r["count"] for r in areas.inside(shapes).groupBy("area_id").count().collect()]
    want = sum(math.hypot(x + 0.5 - 10, y + 0.5 - 10) < 8 for x in range(20) for y in range(20))
    assert len(counts) == 2000 and all(abs(c - want) <= 4 for c in counts)


def test_same_as_a_path(spark):
    """One area as rows and as a path: feathered changes, fills of each kind, and a stroke."""
    corners = [(3.0, 1.0), (17.5, 4.25), (12.0, 13.75), (6.5, 9.0), (2.0, 12.0)]
    px, path = random_pixels(spark, 20, 15, seed=2), Path.polygon(*corners)
    own = table(spark, {0: corners}, image_id=1)
    key = lambda df: sorted(map(tuple, df.select("image_id", "x", "y", "r", "g", "b", "a").collect()))
    for feather in (0, 3):
        assert key(areas.apply_in_areas(px, own, point.invert, feather)) == key(raster.apply_in_area(px, point.invert, [(path, feather)]))
    solid = areas.fill(own.drop("image_id"), (10, 250, 30, 200))
    assert solid.count() == 16 * 13
    assert key(solid) == key(raster.fill(spark, path, (10, 250, 30, 200)))
    line = table(spark, {0: corners, 1: [(1.0, 14.0), (19.0, 14.0)]}, image_id=1)
    two = raster.stroke(px, Path(corners[0], tuple(("line", p) for p in corners[1:])), 4.0, (1, 2, 3, 255), 0.5)
    assert key(areas.stroke(px, line.where("area_id = 0"), 4.0, (1, 2, 3, 255), 0.5)) == key(two)
    both = {k[1:3]: k for k in key(areas.stroke(px, line, 4.0, (1, 2, 3, 255), 0.5))}
    other = {k[1:3]: k for k in key(raster.stroke(px, Path((1.0, 14.0)).line_to((19.0, 14.0)), 4.0, (1, 2, 3, 255), 0.5))}
    far = [k for k in both if away(corners, k[0] + 0.5, k[1] + 0.5, False) > 2]
    assert all(both[k] == other[k] for k in far) and len(far) > 20


def test_areas_of_one_image_take_turns(spark):
    px = random_pixels(spark, 12, 12, seed=6)
    shapes = {0: [(1, 1), (9, 1), (9, 9), (1, 9)], 1: [(4, 4), (11, 4), (11, 11), (4, 11)]}
    dark = lambda p: point.sub(p, 60.0)
    got = areas.apply_in_areas(px, table(spark, shapes, image_id=1), dark)
    want = raster.apply_in_area(px, dark, [(Path.polygon(*shapes[0]), 0), (Path.polygon(*shapes[1]), 0)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, areas.apply_in_areas(px, table(spark, shapes, image_id=1).where("false"), dark).collect())) == sorted(map(tuple, px.collect()))


def test_fills_of_nothing_and_gradient_paths(spark):
    shapes = {1: [(2, 3), (9, 3)], 2: [(5, 5)], 3: [(0, 0), (8, 0), (8, 6), (0, 6)]}
    got = areas.fill(table(spark, shapes), (1, 2, 3, 255))
    assert [(r.x, r.y, r.a) for r in got.where("image_id < 3").collect()] == [(0, 0, 0)] * 2
    along = Gradient.from_to((0, 0, 0, 255), (200, 100, 50, 255)).with_direction(Path((0.0, 0.0)).line_to((8.0, 6.0)))
    made = {(r.x, r.y): r for r in areas.fill(table(spark, {3: shapes[3]}), along).collect()}
    for x, y in ((0, 0), (7, 5), (3, 2)):
        at = [min(max(((x + (u + 0.5) / 4) * 8 + (y + (v + 0.5) / 4) * 6) / 100, 0), 1) for u in range(4) for v in range(4)]
        assert (made[x, y].r, made[x, y].g, made[x, y].b, made[x, y].a) == tuple(sum(int(k * t) for t in at) // 16 for k in (200, 100, 50)) + (255,)
    assert areas.fill(table(spark, shapes).where("false"), (1, 2, 3, 255)).count() == 0


def test_places_and_numbering(spark):
    shapes = {i: own for i, own in odd_shapes().items() if len(own) > 2}
    r = random.Random(1)
    places = [(i, r.uniform(-3, 12), r.uniform(-3, 12)) for i in range(80)]
    got = {(x.id, x.area_id) for x in areas.containing(table(spark, shapes), spark.createDataFrame(places, "id int, px double, py double")).collect()}
    assert got == {(i, k) for i, x, y in places for k, own in shapes.items() if odd(own, x, y)}
    loose = table(spark, {0: [(9, 1), (3, 2), (5, 3)]}).drop("seq")
    assert [(x.seq, x.px) for x in areas.numbered(loose, "px").orderBy("seq").collect()] == [(0, 3.0), (1, 5.0), (2, 9.0)]


def test_segments_of_every_kind_become_points(spark):
    path = Path((1.0, 2.0)).line_to((4.0, 6.0)).quad_to((9.0, 6.0), (9.0, 1.0)).cubic_to((9.0, -4.0), (3.0, -4.0), (1.0, 2.0))
    rows, at = [], path.start
    for n, (kind, *to) in enumerate(path.segments):
        rows.append((5, n, kind, *[float(v) for p in [at, *to, *[(0.0, 0.0)] * (3 - len(to))] for v in p]))
        at = to[-1]
    df = spark.createDataFrame(rows, "area_id int, n int, kind string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    got = areas.flattened(df).orderBy("seq").collect()
    assert [x.seq for x in got] == list(range(len(path.flatten())))
    assert np.allclose([(x.px, x.py) for x in got], path.flatten())
