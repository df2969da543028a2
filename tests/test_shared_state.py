"""Cursors that readers share, stream state of any type, and declared plugin parameters."""

import time

import pytest
from pyspark.sql import functions as F

from lumengrid import ImageFrame, plugin
from lumengrid.operators.canvas import Canvas, Layer
from lumengrid.plugins import Parameter, PluginError, PluginResult
from lumengrid.sources.cursor import ImageCursor, without
from lumengrid.streaming import subjects
from tests.test_operators import array, random_pixels


def names(taken):
    return sorted(r.path for r in taken[1].collect())


@pytest.fixture
def pile(spark):
    return spark.createDataFrame([(f"img{i:03d}.png", i) for i in range(25)], "path string, width int").repartition(7)


def test_two_readers_get_different_images(spark, pile, tmp_path):
    one = ImageCursor.open(pile, f"file://{tmp_path}/c")
    two = ImageCursor.open(pile, f"file://{tmp_path}/c")  # goes on where the folder stands
    seen = []
    for reader in (one, two, one, one, two):
        claim, rows = reader.shift(4)
        seen.append(names((claim, rows)))
        reader.commit(claim)
    assert sum(seen, []) == [f"img{i:03d}.png" for i in range(20)]
    assert names(two.pop(2)) == ["img023.png", "img024.png"] and names(one.pop(1)) == ["img022.png"]
    assert names(one.shift(9)) == ["img020.png", "img021.png"] and two.shift() is None and two.pop() is None


def test_a_failed_reader_loses_nothing(spark, pile, tmp_path):
    one, two = ImageCursor.open(pile, f"file://{tmp_path}/c", lease=0.3), ImageCursor.open(pile, f"file://{tmp_path}/c", lease=60)
    lost, _ = one.shift(3)
    held, _ = two.shift(3)
    time.sleep(0.5)  # the first reader is gone
    again, rows = two.shift(10)
    assert (again.start, again.stop, again.attempt) == (lost.start, lost.stop, 1) and names((again, rows)) == ["img000.png", "img001.png", "img002.png"]
    two.release(held)
    assert names(one.shift(1)) == ["img003.png", "img004.png", "img005.png"]
    two.commit(again)
    assert names(two.shift(2)) == ["img006.png", "img007.png"]


def test_one_claim_has_one_winner(spark, pile, tmp_path, monkeypatch):
    """A reader that looked before another made the same claim looks again."""
    one, two = ImageCursor.open(pile, f"file://{tmp_path}/c"), ImageCursor.open(pile, f"file://{tmp_path}/c")
    stale, calls = two.claims(), []

    def claims():
        calls.append(1)
        return stale if len(calls) <= 2 else ImageCursor.claims(two)

    monkeypatch.setattr(two, "claims", claims)
    assert names(one.shift(2)) == ["img000.png", "img001.png"]
    assert names(two.shift(2)) == ["img002.png", "img003.png"] and len(calls) > 2
    empty = ImageCursor.open(pile.where("false"), f"file://{tmp_path}/e")
    assert empty.shift() is None and without(pile, 3).count() == 24 and without(pile, 99).count() == 25


ROWS = "k string, ts timestamp, name string, place struct<a:int,b:array<string>>, whole decimal(10,2)"


def batches(spark, tmp_path, parts):
    """A stream of one file for each part, in order; a part is a list of (key, second, name)."""
    for i, part in enumerate(parts):
        rows = [(k, t, n, (t, [n, "x"]), t) for k, t, n in part]
        df = spark.createDataFrame(rows, "k string, t int, name string, place struct<a:int,b:array<string>>, w int")
        df.select("k", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "name", "place", F.col("w").cast("decimal(10,2)").alias("whole")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def told(spark, df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_state_of_strings_and_structs(spark, tmp_path):
    stream = batches(spark, tmp_path, [[("a", 5, "five"), ("b", 1, "one")], [("a", 3, "late but known"), ("b", 9, "nine")]])
    got = told(spark, subjects.latest_stream(stream, "k", "ts", ["name", "place", "whole"]), tmp_path, "typed")
    assert sorted((r.k, r.name, r.place.a, r.place.b, str(r.whole)) for r in got) == [("a", "five", 5, ["five", "x"], "5.00"), ("b", "nine", 9, ["nine", "x"], "9.00"), ("b", "one", 1, ["one", "x"], "1.00")]
    got = told(spark, subjects.replay_stream(stream, "k", "ts", "name", 2), tmp_path, "typed_last")
    assert sorted((r.k, r.n, r.name) for r in got if r.k == "a") == [("a", 1, "five"), ("a", 1, "five"), ("a", 2, "late but known")]


def test_late_rows_and_idle_keys(spark, tmp_path):
    """A key that is idle is forgotten; a row too late is left out; the key's next row is a new one."""
    stream = batches(spark, tmp_path, [[("a", 10, "first")], [("b", 100, "far on")], [("a", 12, "too late"), ("b", 101, "next")], [("a", 99, "anew"), ("b", 95, "older")]])
    got = told(spark, subjects.latest_stream(stream, "k", "ts", "name", idle=20.0, late="10 seconds"), tmp_path, "idle")
    assert sorted((r.k, r.name) for r in got) == [("a", "anew"), ("a", "first"), ("b", "far on"), ("b", "next")]
    with pytest.raises(ValueError):
        subjects.latest_stream(stream, "k", "ts", "name", idle=20.0)


def test_parameters_are_checked_before_any_plan(spark):
    calls = []

    @plugin("fade", "Fades.", amount=Parameter("float", 0.5, low=0.0, high=1.0), times=Parameter("integer"), mode=Parameter("string", "soft", choices=("soft", "hard")))
    def fade(frame, amount, times, mode):
        calls.append((amount, times, mode))
        return frame.opacity(amount)

    frame = ImageFrame(random_pixels(spark))
    for wrong in ({"times": 1, "amount": 2.0}, {"times": 1.5}, {"times": True}, {"times": 1, "amount": "much"}, {"times": 1, "mode": "odd"}, {"times": 1, "other": 3}, {}, {"times": 1, "amount": float("nan")}):
        with pytest.raises(PluginError) as error:
            frame.apply("fade", **wrong)
        assert error.value.kind == "invalid parameters"
    assert not calls
    assert (array(frame.apply("fade", times=2, amount=1).pixels) == array(frame.pixels)).all() and calls == [(1.0, 2, "soft")]
    with pytest.raises(PluginError, match="not found"):
        frame.apply("no such")


def test_plugins_add_canvases_images_and_layers(spark):
    px = random_pixels(spark)

    @plugin("stack")
    def stack(frame):
        own = Canvas.of(frame.pixels, 9, 7)
        return PluginResult().add_canvas(own).add_canvas(own.flipped("x")).add_layer(Layer(frame.pixels, size=(9, 7)))

    @plugin("nothing")
    def nothing(frame):
        return PluginResult()

    made = ImageFrame(px).run("stack")
    assert (len(made.canvases), len(made.layers), made.image_at(0), made.canvas_at(5)) == (2, 1, None, None) and made.layer_at(0).size == (9, 7)
    assert array(ImageFrame(px).apply("stack").pixels).shape == (7, 9, 4)
    with pytest.raises(PluginError, match="execution failed"):
        ImageFrame(px).run("nothing")
    small = ImageFrame(px).apply("collage", columns=1, rows=1, width=9, height=7)
    assert array(small.pixels).shape == (7, 9, 4)
