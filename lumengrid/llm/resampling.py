"""Target-distribution importance resampling over hashed n-gram features, by the combination algebra of CRC-32.

A text's words are runs of ASCII letters and digits and of all other than ASCII characters, A-Z lower-cased. Its features are
all runs of 1 to `max_n` words, joined by a space, and a feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`.
Each word's CRC is computed once; the CRC of a longer run follows from CRC(a + b) = shift(CRC(a), len(b)) xor CRC(b), where
shift is the GF(2) matrix that appends so many zero bytes, so that no n-gram is ever spelled out.

The documents' and the target's features are counted by bucket (`buckets` numbers a task, added up by Spark; one row for each
bucket reaches the driver). A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), a
document's weight the floored mean of its features' gains (0 without any), and its score the weight plus Gumbel noise
floor(-1000 * ln(-ln((h + 0.5) / 2**32))) of h, the first 8 hex digits of sha256("<seed>:<id>"). The highest scores among the
documents with `least_words` words are drawn; ties go to the smaller id. Drawing so is sampling without replacement with
odds proportional to exp(weight / 1000).

Ranks come from a histogram of the scores, which are whole numbers of a narrow range, and from places within a score; rows
alike in id and score are counted first and get neighbouring ranks. A null text has no features. Rows with a null id get a
weight, but neither a score nor a rank, and do not count as documents to draw from. An empty table gives an empty result; an
empty target has T = 0. Only id and text are read of either table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import slices, stored, sums, table, texts_of

BUCKETS = 10_000
#: Bytes of text that a worker holds at once (or one text); its words take some forty bytes each.
SLICE = 1 << 20
#: Words longer than this are hashed one by one.
LONG = 64
#: Copies of one row that one task writes.
CHUNK = 1 << 16
POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32


def _byte_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(POLYNOMIAL), values >> 1).astype(np.uint32)
    return values


TABLE = _byte_table()


def _tabulated(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 GF(2) matrix, given by its columns, as one table for each byte of a vector."""
    byte = np.arange(256)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            tables[k] ^= np.where(byte >> bit & 1, columns[8 * k + bit], 0).astype(np.uint32)
    return tables


def _times(tables: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return tables[0][vectors & 255] ^ tables[1][vectors >> 8 & 255] ^ tables[2][vectors >> 16 & 255] ^ tables[3][vectors >> 24]


def _shifts(count: int = 32) -> list[np.ndarray]:
    """Tables of the matrices that append 1, 2, 4, 8 ... zero bytes; each is the square of the one before."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (unit >> 8) ^ TABLE[unit & 255]
    found = []
    for _ in range(count):
        found.append(_tabulated(columns))
        columns = _times(found[-1], columns)
    return found


SHIFTS = _shifts()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """shift(crc, length) for each pair."""
    crc = crc.astype(np.uint32)
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> bit & 1)
        crc[at] = _times(SHIFTS[bit], crc[at])
    return crc


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of the joined bytes from those of the two parts and the second's length."""
    return shifted(first, length) ^ second


def _classes() -> np.ndarray:
    """Each byte of a text as what it counts as: A-Z as a-z, other ASCII but letters and digits as a blank."""
    kind = np.arange(256, dtype=np.uint8)
    kind[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    kind[~word] = 32
    return kind


CLASS = _classes()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts and lengths of the words, offsets of each text's words), in whole arrays."""
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges -= edges[0]
    seen = CLASS[raw]
    inside = seen != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = edges[1:-1][edges[1:-1] < len(raw)]
    first[inner] = inside[inner]  # a text begins a word of its own
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return seen, starts, stops - starts, np.searchsorted(starts, edges)


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, a byte of all words at a time; of long words, block by block, which are then combined."""
    crc = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return crc
    order = np.argsort(lengths, kind="stable")
    short = order[: np.searchsorted(lengths[order], LONG, side="right")]
    now, size, at = np.full(len(short), 0xFFFFFFFF, np.uint32), lengths[short], starts[short]
    for k in range(int(size[-1]) if len(short) else 0):
        live = np.searchsorted(size, k, side="right")  # the rest have ended
        now[live:] = (now[live:] >> 8) ^ TABLE[(now[live:] & 255) ^ data[at[live:] + k]]
    crc[short] = now ^ np.uint32(0xFFFFFFFF)
    for i in order[len(short) :]:
        blocks = -(-lengths[i] // LONG)
        head = lengths[i] - (blocks - 1) * LONG  # the first block is the odd one, all others are of one length
        parts = np.concatenate([[starts[i]], starts[i] + head + LONG * np.arange(blocks - 1)])
        of = word_crcs(data, parts, np.concatenate([[head], np.full(blocks - 1, LONG)]))
        size = LONG
        while len(of) > 1:  # neighbours pair up from the end, so that every second part has `size` bytes
            odd, even = of[: len(of) % 2], of[len(of) % 2 :]
            of = np.concatenate([odd, combined(even[::2], even[1::2], np.full(len(even) // 2, size))])
            size *= 2
        crc[i] = of[0]
    return crc


def features_of(texts: pa.Array, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to max_n: (CRCs of all runs of n words, offsets of each text's runs)."""
    data, starts, lengths, offsets = words_of(texts)
    word = word_crcs(data, starts, lengths)
    blank = np.uint32(0xE96CCF45)  # the CRC of one space
    run, count = word, np.diff(offsets)
    place = np.arange(len(word)) - np.repeat(offsets[:-1], count)  # of a word in its text
    left = np.repeat(count, count) - place  # words from here to the text's end
    keep = np.arange(len(word))
    yield word, offsets
    for n in range(2, max_n + 1):
        fits = left[keep] >= n
        keep, run = keep[fits], run[fits]
        run = combined(combined(run, np.full(len(run), blank), np.ones(len(run), np.int64)), word[keep + n - 1], lengths[keep + n - 1])
        yield run, np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))])


def bucket_counts(df: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket over all rows; `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, text_col, SLICE):
            for crc, _ in features_of(texts_of(part.column(text_col)), max_n):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in df.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket, shares with one added."""
    s, t, m = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + m) / ((float(a) + 1) * (t + m)))) for a, b in zip(source, target, strict=True)], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", max_n: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in slices(batches, text_col, SLICE):
            n_words, total, count = None, 0, 0
            for crc, offsets in features_of(texts_of(part.column(text_col)), max_n):
                total = total + sums(gain[crc % np.uint32(len(gain))], offsets)
                count = count + np.diff(offsets)
                n_words = count if n_words is None else n_words
            weight = total // np.maximum(count, 1)  # floored; 0 without features
            yield pa.record_batch([part.column(id_col), pa.array(n_words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def resampled(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, max_n: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row; rank is null for rows that are not drawn.

    Draws floor(percent * N / 100) of the N rows with an id and `least_words` words.
    """
    gain = gains(bucket_counts(df, text_col, max_n, buckets), bucket_counts(target, target_text, max_n, buckets))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((key + 0.5) / 4294967296.0)))
    rows = stored(weighed(df, gain, text_col, id_col, max_n).withColumn("score", F.col("weight") + noise))
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    counts = sorted(((r[0], r[1]) for r in rows.where(able).groupBy("score").count().collect()), reverse=True)  # a row for each score: whole numbers of a narrow range
    draw = percent * sum(n for _, n in counts) // 100
    before, above = [], 0
    for score, n in counts:
        if above >= draw:
            break
        before.append((score, above))
        above += n
    first = df.sparkSession.createDataFrame(before, "score long, above long")
    # rows alike are counted, then numbered within their score
    groups = rows.where(able).join(F.broadcast(first), "score").groupBy("score", "above", "doc_id", "n_words", "n_features", "weight").agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    groups = groups.withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    few = groups.where(F.col("n") <= CHUNK).withColumn("from", F.lit(0).cast("long"))
    many = groups.where(F.col("n") > CHUNK).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    each = few.unionByName(many.repartition("doc_id", "from")).withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, "n") - 1)))
    place = F.col("before") + F.col("i") + 1
    drawn = each.withColumn("rank", F.when(place <= draw, place))
    shape = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    lowest = before[-1][0] if before else None
    rest = rows.where(~able | F.lit(lowest is None) | (F.col("score") < F.lit(lowest).cast("long"))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(shape).unionByName(rest.select(shape))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: a tenth of the documents drawn towards the benchmark's words."""
    done = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC of each distinct word, one step for each byte, by a table that the first two steps make.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS v, 0 AS step FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
codes AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: CAST(CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS INTEGER) AS BIGINT)),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM words, crc_table
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN codes USING (word) GROUP BY bucket),
gain AS (
  SELECT i AS bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM dw) + 10000)
    / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS g
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
),
mean AS (SELECT doc_id, sum(g) AS g, count(*) AS n FROM dw JOIN codes USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(g / n), 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN mean USING (doc_id)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""
