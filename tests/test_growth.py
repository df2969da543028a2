"""Queries on odd rows and on what larger tables hold: the same results in less room."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumengrid.operators import areas, blend, trees, warp
from lumengrid.plans import pixel_queries
from lumengrid.sources import images
from tests.test_trees import CANVASES, LAYERS


def size_of(spark, df, what):
    """The most rows that an operator of a run plan gave out, over those whose name begins with `what`."""
    df.collect()
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            left.append(node.plan())
            continue
        if name.startswith(what) and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        left.extend(node.children().apply(i) for i in range(node.children().size()))
    return max(found)


def test_trees_shuffle_things_by_tiles(spark):
    """one row for each thing on a tile; pixels outside a target and whole paths of each pixel are not dealt."""
    canvases = spark.createDataFrame([(c, None, 0, 20, 3, 0, 0, 1.0, "normal", None, False, None) for c in range(20)], CANVASES)
    layers = spark.createDataFrame([(c, 0, 0, 5, -2, 30, 30, 1.0, "normal", True, None) for c in range(20)] + [(c, 1, 0, 25, 0, 30, 30, 1.0, "normal", True, None) for c in range(20)], LAYERS)
    pixels = spark.range(900).selectExpr("0 AS image_id", "CAST(id % 30 AS INT) AS x", "CAST(id div 30 AS INT) AS y", "CAST(id % 256 AS INT) AS r", "3 AS g", "4 AS b", "CAST(255 - id % 2 AS INT) AS a").where("id % 7 <> 0")
    got = trees.render(canvases, layers, pixels)
    assert sum(size_of(spark, got, kind) for kind in ("BroadcastHashJoin", "SortMergeJoin")) <= 20 * 8
    want = {(c, x, y): (0, 0, 0, 0) for c in range(20) for x in range(20) for y in range(3)}
    for r in pixels.collect():
        want |= {(c, r.x + 5, r.y - 2): (r.r if r.a == 255 else None, 3, 4, r.a) for c in range(20) if r.x < 15 and 0 <= r.y - 2 < 3}
    rows = {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == v for k, v in want.items() if v[0] is not None and v[3] in (0, 255))
    assert all(rows[k][3] > 0 for k, v in want.items() if v[0] is None)


def test_places_share_their_tests(spark):
    """ids at one place are tested once; an id given twice at a place counts twice, as one in two places does."""
    points = spark.createDataFrame([(a, i, x + a, y) for a in range(3) for i, (x, y) in enumerate([(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (0.0, 5.0)])], "area_id long, seq int, px double, py double")
    rows = [(i, 3.5, 2.5) for i in range(500)] + [(600, 3.5, 2.5)] * 2 + [(601, 3.5, 2.5), (601, 0.5, 2.5), (602, None, 1.0), (603, 90.0, 2.5)]
    got = areas.containing(points, spark.createDataFrame(rows, "id long, px double, py double"))
    assert max(size_of(spark, got, kind) for kind in ("BroadcastHashJoin", "SortMergeJoin")) <= 1600
    want = {(i, a) for i in range(500) for a in range(3)} | {(601, 1), (601, 2)}
    assert sorted((r.id, r.area_id) for r in got.collect()) == sorted(want)


def test_bytes_in_the_components_precision(spark, tmp_path):
    """just below a whole number, single precision rounds up to it and double precision does not; vectors may lack components."""
    edge = np.float32(2 * np.arange(256) / 255 - 1)
    rows = [np.clip(np.nextafter(edge, np.float32(s)), -1, 1)[k : k + 64].tolist() for s in (-2, 2) for k in range(0, 256, 64)]
    rows += [None, [], [0.5] * 3, [0.25] * 70, [0.1, None] * 32]
    table = pa.table({"vec_id": pa.array([*range(len(rows)), 0]), "embedding": pa.array([*rows, [0.9] * 64], pa.list_(pa.float32())), "label": pa.array([0] * (len(rows) + 1), pa.int32())})
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.sql(pixel_queries.SQL["pixels_emb"]).fetchall()
    got = [tuple(r) for r in pixel_queries.QUERIES["pixels_emb"](spark, str(tmp_path)).collect()]
    key = lambda r: r[:3]
    assert len(got) == 16 * len(rows) and sorted(got, key=key) == sorted(want, key=key)


def test_colours_of_the_palette_meet_no_palette(spark):
    """only colours beyond the palette are compared with it."""
    pixels = spark.range(400).selectExpr("CAST(id div 100 AS INT) AS image_id", "CAST(id % 10 AS INT) AS x", "CAST(id % 100 div 10 AS INT) AS y", "CAST(id * 37 % 251 AS INT) AS r", "CAST(id * 11 % 241 AS INT) AS g", "CAST(id % 100 AS INT) AS b", "255 AS a")
    whole = images.indexed(pixels, 256)
    assert size_of(spark, whole, "SortMergeJoin") <= 400 and size_of(spark, whole, "BroadcastHashJoin") <= 400
    assert all(r.idx == r.y * 10 + r.x for r in whole.collect())
    rows = pixels.collect()
    for r in images.indexed(pixels, 16).collect():
        own = [p for p in rows if p.image_id == r.image_id]
        here = next(p for p in own if (p.x, p.y) == (r.x, r.y))
        best = min((sum((getattr(here, c) - getattr(p, c)) ** 2 for c in "rgb"), p.y * 10 + p.x) for p in own if p.y * 10 + p.x < 16)
        assert r.idx == best[1]


def test_nearest_resizing_sorts_no_pixels(spark):
    """the pixels meet the sizes of their images in a hash; sides of one pixel and gaps are kept."""
    pixels = spark.range(3 * 77).selectExpr("CAST(id div 77 AS INT) AS image_id", "CAST(id % 7 AS INT) AS x", "CAST(id % 77 div 7 AS INT) AS y", "CAST(id AS INT) AS r", "2 AS g", "3 AS b", "4 AS a").where("image_id <> 1 OR x = 0").where("image_id <> 2 OR r % 5 <> 0")
    for width, height in ((5, 23), (1, 1), (40, 3)):
        got = warp.resize_nearest(pixels, width, height)
        got.collect()
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        known = {(r.image_id, r.x, r.y): r.r for r in pixels.collect()}
        want = {}
        for i in range(3):
            w, h = (max(k[c] for k in known if k[0] == i) + 1 for c in (1, 2))
            want |= {(i, x, y): known[at] for x in range(width) for y in range(height) if (at := (i, int(x / width * (w - 1)), int(y / height * (h - 1)))) in known}
        assert {(r.image_id, r.x, r.y): r.r for r in got.collect()} == want and got.count() == len(want)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_crossings_are_not_dealt_again(spark):
    """F7, F8: edges are dealt by bands of lines; crossings, their sums and spans stay in the task that makes them."""
    points = spark.createDataFrame([(a, i, x, y) for a in range(3) for i, (x, y) in enumerate([(0.0, 0.0), (40.0, 0.5), (40.0, 50.0), (1.0, 50.0)])], "area_id long, seq int, px double, py double")
    for rule in ("even-odd", "non-zero"):
        got = areas.inside(points, rule)
        assert "hashpartitioning(area_id" in plan_of(got) and "band" in plan_of(got) and "line" not in "".join(x for x in plan_of(got).splitlines() if "Exchange hashpartitioning" in x)
        rows = [(r.area_id, r.x, r.y) for r in got.collect()]
        assert len(rows) == len(set(rows)) and {(a, 20, y) for a in range(3) for y in range(1, 50)} <= set(rows)


def test_samples_are_made_in_tasks_of_given_number(spark):
    """the edges and corners of few bytes that make many samples are not put together in few tasks."""
    points = spark.createDataFrame([(a, i, x, y) for a in range(3) for i, (x, y) in enumerate([(0.0, 0.0), (9.0, 0.5), (9.0, 8.0)])], "area_id long, seq int, px double, py double")
    assert plan_of(areas.near(points, 2.0, 4)).count("REPARTITION_BY_NUM") >= 2


def test_tiles_are_folded_many_at_once(spark, monkeypatch):
    """F1 of round 4: things are drawn in NumPy, the same as by expressions, in every mode that does not mix channels; tiles go on from batch to batch."""
    modes = [m for m in blend.MODES if hasattr(blend.mode(m), "alike")]
    assert len(modes) > 25
    canvases = spark.createDataFrame([(c, None, 0, 20, 18, 0, 0, 1.0, "normal", None, False, None) for c in range(4)] + [(9, 1, 0, 7, 9, 3, 2, 0.7, "screen", None, False, None)], CANVASES)
    rows = [(c, z, (c + z) % 3, (z * 5 + c) % 9 - 2, z % 7 - 3, 18, 18, 1 - (z % 4) / 5, m, True, None) for c in (0, 1, 9) for z, m in enumerate(["normal", *modes, "no such mode"])]
    layers = spark.createDataFrame(rows, LAYERS)
    pixels = spark.range(3 * 324).selectExpr("CAST(id div 324 AS INT) AS image_id", "CAST(id % 18 AS INT) AS x", "CAST(id div 18 % 18 AS INT) AS y", "CAST(id * 37 % 256 AS INT) AS r", "CAST(id * 91 % 256 AS INT) AS g", "CAST(id * 11 % 253 AS INT) AS b", "CAST(CASE WHEN id % 3 = 0 THEN 255 ELSE id * 53 % 256 END AS INT) AS a").where("(x + y) % 5 <> 0")
    key = ("image_id", "x", "y")
    fast = trees.render(canvases, layers, pixels)
    assert "MapInArrow" in plan_of(fast) and "collect_list" not in plan_of(fast)
    got = sorted(map(tuple, fast.select(*key, *"rgba").collect()))
    monkeypatch.setattr(trees, "AT_ONCE", 3)
    assert sorted(map(tuple, trees.render(canvases, layers, pixels).select(*key, *"rgba").collect())) == got
    monkeypatch.setattr(blend, "tables", lambda spark, names: {})
    assert sorted(map(tuple, trees.render(canvases, layers, pixels).select(*key, *"rgba").collect())) == got
    assert len(got) == len(set(r[:3] for r in got)) == 4 * 20 * 18 and not any(any(r[3:]) for r in got if r[0] in (2, 3))


def test_modes_that_mix_channels_are_drawn(spark):
    """F1 of round 4: one layer by hue in a tree has the whole tree drawn by expressions, with the same result as the mode's own."""
    canvases = spark.createDataFrame([(1, None, 0, 3, 2, 0, 0, 1.0, "normal", None, False, None)], CANVASES)
    layers = spark.createDataFrame([(1, 0, 0, 0, 0, 3, 2, 1.0, "normal", True, None), (1, 1, 1, 0, 0, 3, 2, 1.0, "hue", True, None)], LAYERS)
    pixels = spark.range(12).selectExpr("CAST(id div 6 AS INT) AS image_id", "CAST(id % 3 AS INT) AS x", "CAST(id % 6 div 3 AS INT) AS y", "CAST(id * 37 % 256 AS INT) AS r", "CAST(id * 91 % 256 AS INT) AS g", "CAST(id * 11 % 253 AS INT) AS b", "255 AS a")
    one = pixels.where("image_id = 0")
    want = blend.blend(one, pixels.where("image_id = 1").selectExpr("0 AS image_id", "x", "y", "r", "g", "b", "a"), "hue")
    got = trees.render(canvases, layers, pixels).select("x", "y", *"rgba").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("x", "y", *"rgba").collect()))


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """F2 of round 4: what is dealt are ids and lists of areas; a place's areas and ids may come in several parts, ids may be null and have several places."""
    points = spark.createDataFrame([(a, i, x + a % 7, y) for a in range(40) for i, (x, y) in enumerate([(0.0, -20.0), (9.0, -20.0), (9.0, 30.0), (0.0, 30.0)])], "area_id long, seq int, px double, py double")
    rows = [(i, 3.5, 2.5) for i in range(60)] + [(None, 3.5, 2.5), (61, -1.0, 2.5), (62, 8.5, -17.5)] + [(63, 0.5, 2.5), (63, 0.5, 28.5), (63, 2.5, -18.5)]
    frame = spark.createDataFrame(rows, "id long, px double, py double")
    hit = lambda x, a: a % 7 < x < a % 7 + 9
    want = {(i, a) for i in [*range(60), None] for a in range(40) if hit(3.5, a)} | {(62, a) for a in range(40) if hit(8.5, a)} | {(63, a) for a in range(40) if (2 * hit(0.5, a) + hit(2.5, a)) % 2}
    key = lambda r: (r[0] is None, r)
    for ids, parts in ((4096, 1 << 18), (7, 9)):
        monkeypatch.setattr(areas, "IDS", ids, raising=False)
        monkeypatch.setattr(areas, "AREAS", parts, raising=False)
        got = areas.containing(points, frame)
        plan = plan_of(got)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
        assert "collect_list(area_id" in plan and "SortMergeJoin" in plan
