"""Push streams as Structured Streaming: multicast, latest value, last values, a named event bus, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_value(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch: the last row of each key. One partial and one final aggregate."""
    rest = [c for c in events.columns if c != key]
    best = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(key, "v.*")


def replay_last(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Batch: the last n rows of each key, numbered from the newest (1)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def of_type(events: DataFrame, name: str, column: str = "event_type") -> DataFrame:
    """The event bus: rows with a listener's name."""
    return events.where(F.col(column) == name)


def history(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of each key numbered from 0, as an append-only log has them."""
    return events.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def windows(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` in event-time windows; with a stream, rows later than `late` are left out."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return kept.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", *keys, "n", "total")


def _packed(events: DataFrame, key: str, time: str, value: str | list[str], late: str | None) -> tuple[DataFrame, list[str]]:
    """(key, time, at, body): the time in microseconds and the values as one text, which a state can hold whatever their types."""
    values = [value] if isinstance(value, str) else list(value)
    kept = events.withWatermark(time, late) if late else events
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    body = F.to_json(F.struct(*[F.col(v) for v in values]), options)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return kept.select(key, time, at.alias("at"), body.alias("body")), values


def _unpacked(rows: DataFrame, events: DataFrame, lead: list[str], time: str, values: list[str]) -> DataFrame:
    """The columns of the events again, with the types that they had."""
    shape = ", ".join(f"`{v}` {events.schema[v].dataType.simpleString()}" for v in values)
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return rows.select(*lead, F.timestamp_micros("at").cast(events.schema[time].dataType).alias(time), F.from_json("body", shape, options).alias("v")).select(*lead, time, "v.*")


def _in_time(parts: Iterator[pd.DataFrame], state: GroupState, late: str | None) -> Iterator[pd.DataFrame]:
    """The rows that are not behind the watermark."""
    for part in parts:
        part = part if late is None else part[part["at"] // 1000 >= state.getCurrentWatermarkMs()]
        if len(part):
            yield part


def _still_known(state: GroupState, newest: int, idle: float | None) -> bool:
    return idle is None or newest // 1000 + int(idle * 1000) >= state.getCurrentWatermarkMs()


def _kept_until(state: GroupState, newest: int, idle: float | None) -> None:
    """The key's state goes when the watermark has passed its newest row by `idle` seconds."""
    if idle is not None:
        state.setTimeoutTimestamp(max(newest // 1000 + int(idle * 1000), state.getCurrentWatermarkMs() + 1))


def latest_stream(events: DataFrame, key: str, time: str, value: str | list[str], idle: float | None = None, late: str | None = None) -> DataFrame:
    """Stream: (key, time, value columns) of each key whenever a newer row comes; the state is one row for each key.

    Values may be of any types that JSON can hold, structs and arrays among them. Rows are ordered by event time; of one time the
    one that came last counts. `late` is how far behind the newest row a row may come; later ones are left out. With `idle`
    seconds, a key's state is dropped when the watermark has passed its newest row by so much, and a row that comes after that is a new one.
    """
    if idle is not None and late is None:
        raise ValueError("idle keys need a bound of how late rows come")
    rows, values = _packed(events, key, time, value, late)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, at long, body string"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = before = state.get if state.exists and _still_known(state, state.get[0], idle) else None
        for part in _in_time(parts, state, late):
            last = part.sort_values("at", kind="stable").iloc[-1]
            if best is None or int(last["at"]) >= best[0]:
                best = (int(last["at"]), last["body"])
        if best is not None:
            state.update(best)
            _kept_until(state, best[0], idle)
            if best != before:
                yield pd.DataFrame({key: [group[0]], "at": [best[0]], "body": [best[1]]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle is not None else GroupStateTimeout.NoTimeout
    found = rows.groupBy(key).applyInPandasWithState(step, schema, "at long, body string", "update", timeout)
    return _unpacked(found, events, [key], time, values)


def replay_stream(events: DataFrame, key: str, time: str, value: str | list[str], n: int, idle: float | None = None, late: str | None = None) -> DataFrame:
    """Stream: (key, n, time, value columns), the last n rows of each key, newest 1, whenever one of them changes.

    The state is a list of n rows for each key. A later row of the same time counts as newer; rows come in any order. Types,
    `idle` and `late` are as in `latest_stream`.
    """
    if idle is not None and late is None:
        raise ValueError("idle keys need a bound of how late rows come")
    rows, values = _packed(events, key, time, value, late)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, n int, at long, body string"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = list(zip(*state.get, strict=True)) if state.exists and _still_known(state, state.get[0][-1], idle) else []
        kept = list(before)
        for part in _in_time(parts, state, late):
            kept += [(int(t), v) for t, v in zip(part["at"], part["body"], strict=True)]
            kept = sorted(kept, key=lambda row: row[0])[-n:]
        if kept:
            times, bodies = (list(c) for c in zip(*kept, strict=True))
            state.update((times, bodies))
            _kept_until(state, times[-1], idle)
            if kept != before:
                yield pd.DataFrame({key: [group[0]] * len(kept), "n": list(range(len(kept), 0, -1)), "at": times, "body": bodies})

    timeout = GroupStateTimeout.EventTimeTimeout if idle is not None else GroupStateTimeout.NoTimeout
    found = rows.groupBy(key).applyInPandasWithState(step, schema, "at array<long>, body array<string>", "update", timeout)
    return _unpacked(found, events, [key, "n"], time, values)


def history_stream(events: DataFrame, key: str, time: str, value: str | list[str]) -> DataFrame:
    """Stream: (key, index, time, value columns), the rows of each key numbered from 0 in the order of their coming; the state is a count."""
    rows, values = _packed(events, key, time, value, None)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, index long, at long, body string"

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        for part in parts:
            part = part.sort_values("at", kind="stable")
            yield pd.DataFrame({key: [group[0]] * len(part), "index": range(at, at + len(part)), "at": part["at"].to_numpy(), "body": part["body"].to_numpy()})
            at += len(part)
        state.update((at,))

    found = rows.groupBy(key).applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)
    return _unpacked(found, events, [key, "index"], time, values)


def multicast(stream: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """A query that hands each micro-batch to all listeners; stop() it to unsubscribe."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for listener in listeners:
            listener(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
