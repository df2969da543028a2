"""Helpers that the training-data operators share: shared-folder tables, Arrow slices of texts, ragged arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as one slice of words; a longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name` under `sf_dir`; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Where that is unset, a local master (tests, bench) gets a temporary folder; a cluster, whose machines share none, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lumengrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/lumengrid/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; what was made from them must have been stored since."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for what is run inside: rows that carry texts or sets then take little memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers live on from task to task, and hold it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: A key with more than one in HEAVY of a table's rows is heavy; a table has fewer than HEAVY of them.
HEAVY = 128
#: A table of so many rows is no burden to one task, whatever its keys.
LIGHT = 20_000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """An inner join with `right`, which has one row for each key; `left`, a stored table, may hold any share of its rows under one key.

    Rows of heavy keys meet their fewer than HEAVY right rows by broadcast and stay where they are; only the rest are dealt by
    key. `total`: the number of rows of `left`, or a bound of it, if known.
    """
    total = left.count() if total is None else total
    if total <= LIGHT:
        return left.join(right, key)
    least = total / HEAVY
    heavy = [r[0] for r in left.groupBy(key).count().where(F.col("count") > F.lit(least)).select(key).collect()]  # fewer than HEAVY
    if not heavy:
        return left.join(right, key)
    keys = left.sparkSession.createDataFrame([(k,) for k in heavy], left.select(key).schema)
    few = right.join(F.broadcast(keys), key, "left_semi")
    return left.join(F.broadcast(few), key).unionByName(left.join(F.broadcast(keys), key, "left_anti").join(right, key))


#: Rows of a few numbers that are broadcast at most.
FEW_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with null texts as empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts hold at most `limit` bytes, or one text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def words_of(texts: pa.Array, pattern: str | None = None, regex: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each word's code, offsets of each text's words): split at `pattern`, or at ASCII white space."""
    split = pc.split_pattern_regex if regex else pc.split_pattern
    lists = split(texts, pattern) if pattern else pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` between neighbouring offsets; empty runs give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[c] : starts[c] + lengths[c]] for each code, one after the other, and their offsets."""
    size = lengths[codes].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(starts[codes] - offsets[:-1], size) + np.arange(offsets[-1])
    return values[index], offsets


class Recent:
    """A store of results by key that keeps the newest `cap` to twice as many."""

    def __init__(self, cap: int):
        self.cap, self.new, self.old = cap, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.cap:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value
