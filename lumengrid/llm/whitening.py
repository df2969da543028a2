"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz, in repeated passes over all centred rows.

An entry c becomes the whole number x = floor(scale * c) + shift. Counts and sums of x are exact, so rows are centred without
rounding before anything is multiplied: n * x - S is a whole number. A pass multiplies the covariance V by a block Q of
orthonormal columns, V Q = sum over rows of r (r Q) / n with r the centred row; Spark adds up the tasks' d x l partial sums,
and only their total reaches the driver. The finder begins with k + `oversampling` random columns and repeats V Q with a new
orthonormal basis up to `power_passes` times. Rayleigh-Ritz on Q gives components, and their residuals |V u - e u| against the
greatest eigenvalue decide: if they exceed `TOLERANCE` the basis grows to the full dimension d, where one more pass makes the
components exact to double precision. No covariance is ever formed by products of uncentred rows.

Rows whose vector is null or holds a null or non-finite entry take no part, nor do those with an entry that no long holds
(|scale * c| of 2**62 or more). All others need one length: those of the most frequent one (ties: the longest) take part, the rest
do not. Empty vectors have no components. Repeated rows and rows with a null id count once each. Components whose eigenvalue is
not above 1e-12 of the trace are no directions of the data and are left out; equal rows only, one row or an empty table give an
empty result. A deviation beyond a long is null. Only id and vector are read. The driver holds matrices of d x d doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm.common import stored, table

#: Residual of a component, relative to the greatest eigenvalue, up to which it counts as converged.
TOLERANCE = 1e-13
#: Eigenvalues, relative to the trace, that count as zero.
NOTHING = 1e-12
#: Entries of vectors that a worker holds as one matrix.
ENTRIES = 1 << 18


def quantized(df: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    c = F.col(f"`{vector_col}`")
    scaled = lambda e: e.cast("double") * F.lit(float(scale))
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(scaled(e)) & (F.abs(scaled(e)) < F.lit(2.0**62)))
    rows = df.where(c.isNotNull() & fine)
    lengths = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths[0] if lengths else 0
    return rows.where(F.size(c) == d).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(c, lambda e: F.floor(scaled(e)) + F.lit(shift)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix of whole numbers) of a few rows at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            first = batch.slice(at, 1).column(1)
            d = len(first.flatten())
            part = batch.slice(at, max(1, ENTRIES // max(d, 1)))
            at += part.num_rows
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


@dataclass
class Centre:
    """The fit list's exact count and sums."""

    n: int
    sums: list[int]
    wide: bool  # n * x - S may leave a long's range

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        s = np.array(self.sums, object if self.wide else np.int64)
        return (x.astype(object) if self.wide else x) * self.n - s

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles, rounded once."""
        return (self.whole(x) / self.n).astype(np.float64)


def centre(vectors: DataFrame) -> Centre | None:
    """None for an empty table. Sums are exact at any size: tasks add in parts that a long holds, Spark adds them as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for _, x in _matrices(batches):
            part = x.sum(axis=0) if not x.size or np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(axis=0)
            total = part.astype(object) if total is None else total + part
            low, high = (x.min(axis=0), x.max(axis=0)) if low is None else (np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
            n += len(x)
        if total is not None:
            # a sum is sent as two longs, as it may not fit in one
            whole = [divmod(int(v), 1 << 40) for v in total]
            yield pa.record_batch(
                [pa.array(np.arange(len(whole), dtype=np.int32)), pa.array([n] * len(whole), pa.int64()), pa.array([h for h, _ in whole], pa.int64()), pa.array([r for _, r in whole], pa.int64()), pa.array(low), pa.array(high)],
                ["dim", "n", "head", "tail", "low", "high"],
            )

    wide = "decimal(38,0)"
    parts = vectors.mapInArrow(run, "dim int, n long, head long, tail long, low long, high long")
    found = parts.groupBy("dim").agg(F.sum("n"), F.sum(F.col("head").cast(wide)), F.sum(F.col("tail").cast(wide)), F.min("low"), F.max("high")).orderBy("dim").collect()  # one row per dimension
    if not found:
        return None
    n = found[0][1]
    reach = max(max(abs(int(r[4])), abs(int(r[5]))) for r in found)
    return Centre(n, [int(r[2]) * (1 << 40) + int(r[3]) for r in found], 2 * n * reach >= 2**62)


def _summed(vectors: DataFrame, shape: tuple[int, int], part) -> np.ndarray:
    """The sum over all rows of `part(ids, x)`, a matrix of `shape`: added in tasks, then by Spark; the total reaches the driver."""
    width = shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            more = part(x)
            total = more if total is None else total + more
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(np.ascontiguousarray(total).ravel())], ["cell", "value"])

    out = np.zeros(shape)
    for cell, value in vectors.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        out[cell // width, cell % width] = value
    return out


def covariance_times(vectors: DataFrame, at: Centre, q: np.ndarray) -> np.ndarray:
    """V Q by one pass over all centred rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((at, q))  # d x l doubles

    def part(x: np.ndarray) -> np.ndarray:
        at, q = shared.value
        r = at.rows(x)
        return r.T @ (r @ q)

    return _summed(vectors, q.shape, part) / at.n


@dataclass
class Whitener:
    """Components (columns) by falling eigenvalue, and how they were found."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool


def fit(vectors: DataFrame, k: int = 32, oversampling: int = 16, power_passes: int = 4, seed: int = 11, tolerance: float = TOLERANCE) -> Whitener | None:
    """The first k components of the stored table (vec_id, x); None where there are no rows or no direction varies."""
    at = centre(vectors)
    if at is None or not at.sums:
        return None
    d = len(at.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(at)
    trace = float(_summed(vectors, (1, 1), lambda x: np.square(shared.value.rows(x)).sum(keepdims=True).reshape(1, 1))[0, 0]) / at.n
    if not trace > 0:
        return None
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + oversampling))))[0]
    passes, expanded = 0, q.shape[1] == d
    while True:
        y = covariance_times(vectors, at, q)
        passes += 1
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:k]
        values, turn = values[order], turn[:, order]
        components = q @ turn
        residual = np.linalg.norm(y @ turn - components * values, axis=0).max()
        if expanded or residual <= tolerance * values[0]:
            break
        if passes <= power_passes:
            q = np.linalg.qr(y)[0]
        else:  # the basis so far, filled up with what is orthogonal to it
            rest = np.random.default_rng(seed + 1).standard_normal((d, d - q.shape[1]))
            q = np.linalg.qr(np.concatenate([np.linalg.qr(y)[0], rest], axis=1))[0]
            expanded = True
    live = values > NOTHING * trace
    components = components[:, live] / np.linalg.norm(components[:, live], axis=0)
    return Whitener(at, components, values[live], trace, passes, expanded) if live.any() else None


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity: one pass for the means, one centred by them."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def scores(x: np.ndarray) -> np.ndarray:
        m = shared.value
        return m.centre.rows(x) @ (m.components / np.sqrt(m.values))

    mean = _summed(vectors, (1, k), lambda x: scores(x).sum(axis=0, keepdims=True)) / model.centre.n

    def part(x: np.ndarray) -> np.ndarray:
        w = scores(x) - mean
        return w.T @ w

    return float(np.abs(_summed(vectors, (k, k), part) / model.centre.n - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitener) -> DataFrame:
    """(vec_id, deviation, scores array<double>) of each row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, x in _matrices(batches):
            whole = m.centre.whole(x)
            narrow = not m.centre.wide and float(np.abs(whole).max()) ** 2 * x.shape[1] < 2.0**62
            squares = (whole if narrow else whole.astype(object)) ** 2
            deviation = [v if v < 2**63 else None for v in map(int, squares.sum(axis=1))]
            scores = (whole / m.centre.n).astype(np.float64) @ (m.components / np.sqrt(m.values))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1], scores.ravel())
            yield pa.record_batch([ids, pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "scores"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, deviation long, scores array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, k: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component."""
    vectors = stored(quantized(df, scale, shift, id_col, vector_col))
    model = fit(vectors, k)
    if model is None:
        return df.sparkSession.createDataFrame([], RESULT)
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("scores").alias("i", "whitened"))
    return each.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("i") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all vectors on the 32 first components of their covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))
