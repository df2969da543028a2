"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into m blocks; a block's partial products are one score list. Phase 1 gathers local lists: each task
takes the k best of every list of its rows, one list at a time, resolves these entries' exact scores and no others, and the
k-th best of all tasks' entries becomes a query's cutoff. Since it is the score of k real candidates, no answer lies below it.
Phase 2: with the cutoff broadcast, each task collects the entries with a partial product of at least cutoff / m in some
list; an entry below that in all m lists cannot reach the cutoff. Phase 3: only the collected entries' scores are resolved
exactly, and those at or above the cutoff are merged. With fewer than k candidates there is no cutoff, and all are collected.

Queries go through in blocks of bounded bytes; each block meets all rows once per phase, and its results are written, so that
plans do not grow with the number of blocks. A task sends k rows per query at most. Components become floor(scale * x) with x
as double; vectors that are null or hold null or non-finite components, and rows with a null id, take no part, nor do vectors whose
squared length is 2**62 or more after that: no product of the others leaves a long, so all sums are exact in whole numbers. Vectors are
searched among those of their own length; an empty one scores 0 with others of its kind. Ties go to the smaller id. Repeated
rows count once each; a query never meets rows of its own id, and rows that share a query's id ask once, with the shortest,
then smallest vector. An empty table or no query gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import shared_folder, stored, table

#: Bytes of the queries that one pass broadcasts.
QUERY_BYTES = 16 << 20
#: Rows that a task scores at once.
ROWS = 1024
QUERIES = 512
#: Entries whose exact scores are resolved at once, and found ones that a task holds before it drops all but the best.
ENTRIES = 1 << 16
#: Squared lengths of vectors from which on products may not fit a long.
TOO_LONG = 2.0**62
#: The cutoff of a query that has fewer than k candidates.
NO_CUT = -(2**63)


def quantized(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): whole numbers floor(scale * x) of the vectors that take part."""
    x = F.col(vector_col)
    fine = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, fine))
    parts = F.transform(x, lambda e: F.lit(float(scale)) * e.cast("double"))
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("v"))
    return rows.where(F.aggregate("v", F.lit(0.0), lambda a, e: a + F.greatest(F.abs(e), F.abs(e - 1.0)) * F.greatest(F.abs(e), F.abs(e - 1.0))) < TOO_LONG)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        yield at, np.floor(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(len(at), width)


def _exact(q: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The whole scores of the entries (query i, row j), and no others."""
    q, rows = q.astype(np.int64), rows.astype(np.int64)
    out = [np.einsum("ed,ed->e", q[i[at : at + ENTRIES]], rows[j[at : at + ENTRIES]]) for at in range(0, len(i), ENTRIES)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _lists(q: np.ndarray, rows: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """Each list's partial products [query, row] as doubles, one list at a time; off by a rounding error at most."""
    edges = np.linspace(0, q.shape[1], min(blocks, max(q.shape[1], 1)) + 1).astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield q[:, a:b] @ rows[:, a:b].T


def _gathered(q: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, blocks: int) -> np.ndarray:
    """Phase 1: marks the k best entries of each list; `own` marks a query's own rows, which take no part."""
    take = np.zeros(own.shape, bool)
    n = min(k, own.shape[1])
    for part in _lists(q, rows, blocks):
        part[own] = -np.inf
        np.put_along_axis(take, np.argpartition(-part, n - 1, axis=1)[:, :n], True, axis=1)
    return take & ~own


def _collected(q: np.ndarray, rows: np.ndarray, own: np.ndarray, cutoff: np.ndarray, blocks: int) -> np.ndarray:
    """Phase 2: marks the entries that reach the uniform threshold in some list."""
    take = np.zeros(own.shape, bool)
    m = min(blocks, max(q.shape[1], 1))
    slack = 1e-9 * (np.abs(q).sum(axis=1) * (np.abs(rows).max() if rows.size else 0) + 1)  # more than doubles may round
    least = (cutoff / m - slack)[:, None]
    for part in _lists(q, rows, blocks):
        take |= part >= least
    return take & ~own


SENT = "query_id long, vec_id long, score long"


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of each query, ties to the smaller id."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def _pass(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, blocks: int, cutoffs: dict[int, float] | None) -> DataFrame:
    """Phase 1 (no cutoffs), or phases 2 and 3, over all rows for one block of queries: ids and a matrix for each length."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, cutoffs))  # QUERY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, cut = shared.value
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                all_ids = part.column(0).to_numpy()
                for rows_at, rows in _vectors(part.column(1)):
                    if rows.shape[1] not in asked:
                        continue
                    ids, queries = asked[rows.shape[1]]
                    row_ids = all_ids[rows_at]
                    for at in range(0, len(ids), QUERIES):
                        q_ids, q = ids[at : at + QUERIES], queries[at : at + QUERIES]
                        own = q_ids[:, None] == row_ids[None, :]
                        if cut is None:
                            take = _gathered(q, rows, own, k, blocks)
                        else:
                            least = np.array([cut.get(i, NO_CUT) for i in q_ids.tolist()], np.int64)
                            take = _collected(q, rows, own, np.where(least == NO_CUT, -np.inf, least.astype(np.float64)), blocks)
                        i, j = np.nonzero(take)
                        score = _exact(q, rows, i, j)
                        if cut is not None:
                            good = score >= least[i]
                            i, j, score = i[good], j[good], score[good]
                        found.append(_best([(q_ids[i], row_ids[j], score)], k))
                        held += len(found[-1][0])
                        if held > ENTRIES:
                            found = [_best(found, k)]
                            held = len(found[0][0])
        yield pa.record_batch(list(map(pa.array, _best(found, k))), ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, SENT)


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    column = rows.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ids = rows.column("vec_id").to_numpy()
    return {m.shape[1]: (ids[at], m) for at, m in _vectors(column)}


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, blocks: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own."""
    spark = df.sparkSession
    vectors, asked = quantized(df, scale, id_col, vector_col), quantized(df.where(is_query), scale, id_col, vector_col)
    first = F.min(F.struct(F.size("v").alias("n"), "v"))
    asked = stored(asked.groupBy("vec_id").agg(first.alias("first")).select("vec_id", "first.v", (F.lit(64) + 8 * F.col("first.n")).cast("long").alias("bytes")))
    n_blocks = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // QUERY_BYTES))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    folder = shared_folder(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    empty.write.mode("append").parquet(folder)
    for block in range(n_blocks):  # of QUERY_BYTES on average, and sent in parts if it holds more
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toArrow()
        edges = np.concatenate([[0], np.cumsum(rows.column("bytes").to_numpy()) // QUERY_BYTES]) if rows.num_rows else np.zeros(1)
        for step in np.unique(edges[1:]).tolist():
            at = np.flatnonzero(edges[1:] == step)
            queries = _by_length(rows.slice(int(at[0]), len(at)))
            kth = _pass(vectors, queries, k, blocks, None).withColumn("rank", ranked).where(F.col("rank") == k).select("query_id", "score").collect()  # one row per query of the block
            final = _pass(vectors, queries, k, blocks, {r[0]: int(r[1]) for r in kth}).withColumn("rank", ranked).where(F.col("rank") <= k)
            final.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")).write.mode("append").parquet(folder)
    return spark.read.schema(empty.schema).parquet(folder)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the five best rows for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(r.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""
