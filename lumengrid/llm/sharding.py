"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed into thousands of slots; the slots never change. Bytes are summed per slot, and a versioned table maps
slots to shards. Version 0 deals slots round robin; a rebalancing reads the newest version and adds the next one, which moves
as few slots as it can so that the shards' bytes come near to equal. No version is ever changed, and two writers of one version
cannot both succeed. A rebalancing that moves nothing adds none. What reaches the driver is one row per slot (a fixed number).

A record's slot is the hash of id and text, so neither one source nor a group of copies with ids of their own gathers in
a slot. Null ids and texts hash like any value; a null text has no bytes. Repeated rows share a slot; they are counted before
anything is dealt by slot, and places follow (id, checksum, size), as rows alike in these are interchangeable. An empty table gives an empty result and the version 0 map.
Columns other than id and text are not read, so no name of theirs can clash.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import shared_folder, table

SLOTS = 8192
#: Bytes that a record weighs besides its text.
OVERHEAD = 16


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalanced(current: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """The map after the edits that even out bytes.

    A shard above the mean gives up slots, the largest that fit its surplus first; slots given up, and slots of shards
    that are gone, go to the lightest shard, heaviest first. Pairs of the heaviest and lightest shard then swap slots
    while that narrows their distance.
    """
    held: list[list[int]] = [[] for _ in range(shards)]
    pool = []
    for slot, shard in enumerate(current):
        (held[shard] if shard < shards else pool).append(slot)
    w = [weight.get(slot, 0) for slot in range(len(current))]
    load = [sum(w[s] for s in own) for own in held]
    mean = sum(w) / shards
    for shard, own in enumerate(held):
        own.sort(key=lambda s: (-w[s], s))
        keep = []
        for slot in own:
            if load[shard] - w[slot] >= mean and w[slot]:
                load[shard] -= w[slot]
                pool.append(slot)
            else:
                keep.append(slot)
        if load[shard] > mean and (movable := [s for s in keep if w[s]]):  # one small slot more brings it just under the mean
            slot = movable[-1]
            keep.remove(slot)
            load[shard] -= w[slot]
            pool.append(slot)
        held[shard] = keep
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(pool, key=lambda s: (-w[s], s)):
        bytes_now, shard = heapq.heappop(heap)
        held[shard].append(slot)
        heapq.heappush(heap, (bytes_now + w[slot], shard))
    load = [sum(w[s] for s in own) for own in held]
    for _ in range(20 * shards):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best, swap = gap, None
        lows = [(0, None), *((w[s], s) for s in held[low] if w[s])]
        by_weight = sorted(lows, key=lambda x: x[0])
        weights = [x[0] for x in by_weight]
        for slot in held[high]:
            at = bisect.bisect_left(weights, w[slot] - gap / 2)
            for k in (at - 1, at):
                if 0 <= k < len(weights) and 0 < (move := w[slot] - weights[k]) and abs(gap - 2 * move) < best:
                    best, swap = abs(gap - 2 * move), (slot, by_weight[k][1], move)
        if swap is None:
            break
        slot, back, move = swap
        held[high].remove(slot)
        held[low].append(slot)
        if back is not None:
            held[low].remove(back)
            held[high].append(back)
        load[high] -= move
        load[low] += move
    out = [0] * len(current)
    for shard, own in enumerate(held):
        for slot in own:
            out[slot] = shard
    return out


MAP = "virtual_slot int, shard int, version int"
#: Equal rows that one task numbers.
CHUNK = 1 << 20


def versions_of(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the map (virtual_slot, shard, version) at `path`; none where nothing has been written yet."""
    try:
        return spark.read.schema(MAP).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MAP)


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The newest version's number and its shards by slot; None without a version."""
    known = versions_of(spark, path)
    last = known.agg(F.max("version")).first()[0]
    if last is None:
        return None
    return last, [r[0] for r in known.where(F.col("version") == last).orderBy("virtual_slot").select("shard").collect()]  # one row per slot


def add_version(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    rows = spark.createDataFrame(list(enumerate(shards)), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with shard and place, the map's versions). `map_path`: the map to edit; a new one in the shared folder by default."""
    spark, path = df.sparkSession, map_path or shared_folder(df.sparkSession)
    records = slotted(df, id_col, text_col, slots)
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # one row per slot
    weight, count = {r[0]: r[1] for r in totals}, {r[0]: r[2] for r in totals}
    newest = newest_map(spark, path)
    if newest is None:
        newest = 0, initial_map(shards, slots)
        add_version(spark, path, *newest)
    version, before = newest
    if len(before) != slots:
        raise ValueError(f"the map at {path} has {len(before)} slots, not {slots}")
    after = rebalanced(before, weight, shards)
    if after != before:
        version += 1
        add_version(spark, path, version, after)
    first, filled = {}, [0] * shards
    for slot in range(slots):  # where a slot's rows begin in its shard
        first[slot] = filled[after[slot]]
        filled[after[slot]] += count.get(slot, 0)
    starts = spark.createDataFrame(list(first.items()), "virtual_slot int, first long")
    latest = versions_of(spark, path).where(F.col("version") == version).select("virtual_slot", "shard").join(starts, "virtual_slot")
    groups = records.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = groups.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.join(F.broadcast(latest), "virtual_slot")  # one row per slot
    few = numbered.withColumns({"a": F.lit(0).cast("long"), "b": F.col("n")}).where(F.col("n") <= CHUNK)
    many = numbered.where(F.col("n") > CHUNK).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("b", F.least(F.col("a") + CHUNK, "n")).repartition("virtual_slot", "doc_id", "a")
    placed = few.unionByName(many).withColumn("i", F.explode(F.sequence("a", F.col("b") - 1)))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("before") + F.col("i")).alias("slot"), "virtual_slot"), versions_of(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents in shards 0 to 39 of nearly equal bytes."""
    placed, _ = shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
