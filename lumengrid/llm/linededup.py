"""Line deduplication by range-partitioned hashes, in DataFrame operations only.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least `least` code points that
`copies` documents hold lose their lines in all of them but the largest id. Nothing but 128-bit hashes of keys goes over the
network: they are range-partitioned, sorted a second time by document (largest first) and position, and a window streams
each key's first occurrences. What comes back is one bitmap for each document that loses a line, as runs of kept lines.

A key that holds more rows than a partition's even share is heavy. Heavy keys are not dealt by key: their documents are
aggregated where they are, and the verdict of each, of which there are fewer than partitions, goes to the rows by broadcast.

A document is an id: rows that share one count as one document, and each gets its own bitmap, found by id and a hash of the
text, so repeated rows get equal ones. Rows with a null id are no document: they count for no key and keep all lines. A null
or empty text is one empty line. An empty table gives an empty result. Only id and text are read; columns of other names,
whatever they are, go through `deduplicated` unchanged.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import HEAVY, fresh, stored, table

LEAST = 20
COPIES = 3
BLANK = " \t\n\x0b\x0c\r"
#: Hash buckets that are counted to find the keys that may be heavy.
BUCKETS = 1 << 16
#: Bytes of bitmaps that are broadcast at most; more are joined by id.
BITMAP_BYTES = 32 << 20


def line_key(line: Column) -> Column:
    """Stripped and with A-Z lower-cased; ASCII lines by the faster function."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, mark, n_lines, pos): the hashed key of each line that is long enough; mark tells rows of one id apart."""
    lines = split_lines(F.col(text_col))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), lines.alias("lines"))
    each = rows.select("doc_id", "mark", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = line_key(F.col("line"))
    return each.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= least).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc_id", "mark", "n_lines", "pos")


def heavy_keys(rows: DataFrame) -> DataFrame | None:
    """(h1, h2) of the keys with more rows than a partition's even share; None without any. Buckets are counted first, then keys of full ones."""
    share = max(HEAVY, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count()
    bucket = F.pmod("h1", F.lit(BUCKETS))
    full = rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") * share > total).select("bucket")
    inside = rows.select("h1", "h2", bucket.alias("bucket")).join(F.broadcast(full), "bucket", "left_semi")  # fewer than `share` buckets
    found = stored(inside.groupBy("h1", "h2").count().where(F.col("count") * share > total).select("h1", "h2"))
    return found if found.count() else None


def lost_lines(rows: DataFrame, copies: int = COPIES) -> DataFrame:
    """The rows of `line_hashes`, a stored table, whose lines go."""
    heavy = heavy_keys(rows)
    light = rows if heavy is None else rows.join(F.broadcast(heavy), ["h1", "h2"], "left_anti")
    group = Window.partitionBy("h1", "h2")
    order = group.orderBy(F.desc("doc_id"), "pos")
    first = F.first("doc_id").over(order)
    new = F.when(F.lag("doc_id").over(order) == F.col("doc_id"), 0).otherwise(1)
    ranked = light.repartitionByRange("h1", "h2").withColumns({"keeper": first, "new": new})
    ranked = ranked.withColumn("docs", F.sum("new").over(group)).where((F.col("docs") >= copies) & (F.col("doc_id") != F.col("keeper")))
    lost = ranked.select(rows.columns)
    if heavy is None:
        return lost
    hot = rows.join(F.broadcast(heavy), ["h1", "h2"])
    verdict = hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("docs"))
    told = hot.join(F.broadcast(verdict), ["h1", "h2"])  # one row for each heavy key
    return lost.unionByName(told.where((F.col("docs") >= copies) & (F.col("doc_id") != F.col("keeper"))).select(rows.columns))


def bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """(doc_id, mark, n_lines, kept): for each document that loses lines, the runs (start, lines) of those it keeps."""
    lost = lost_lines(stored(line_hashes(df, id_col, text_col, least)), copies)
    gone = lost.groupBy("doc_id", "mark", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone"))  # lines of one text
    edges = F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines"))
    between = F.size("gone") + 1
    runs = F.zip_with(F.slice(edges, F.lit(1), between), F.slice(edges, F.lit(2), between), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("lines")))
    return gone.select("doc_id", "mark", "n_lines", F.filter(runs, lambda r: r["lines"] > 0).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, copies: int = COPIES, out: str = "kept_text", lines_out: str = "n_lines", dropped_out: str = "n_dropped") -> DataFrame:
    """`df` with the kept text, the number of lines before and of those dropped; names that `df` has already get underscores before them."""
    out, lines_out, dropped_out = fresh(df, out), fresh(df, lines_out), fresh(df, dropped_out)
    bits = stored(bitmaps(df, id_col, text_col, least, copies))
    size = bits.agg(F.sum(32 + 8 * F.size("kept"))).first()[0] or 0
    own, mark, kept, lines = fresh(df, "bits_id"), fresh(df, "bits_mark"), fresh(df, "bits_kept"), fresh(df, "bits_lines")
    named = bits.select(F.col("doc_id").alias(own), F.col("mark").alias(mark), F.col("kept").alias(kept), F.col("n_lines").alias(lines))
    joined = df.join(F.broadcast(named) if size <= BITMAP_BYTES else named, (F.col(f"`{id_col}`") == F.col(own)) & (F.xxhash64(f"`{text_col}`") == F.col(mark)), "left")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # the text is split once, as the one element of an outer array
    left = F.transform(F.array(split_lines(text)), lambda all_lines: F.concat_ws("\n", F.flatten(F.transform(F.col(kept), lambda r: F.slice(all_lines, r["start"] + 1, r["lines"])))))[0]
    count = F.coalesce(F.col(lines), F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    dropped = F.col(lines) - F.aggregate(F.col(kept), F.lit(0), lambda n, r: n + r["lines"])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns], count.cast("long").alias(lines_out), F.coalesce(dropped, F.lit(0)).cast("long").alias(dropped_out), F.when(F.col(kept).isNull(), text).otherwise(left).alias(out),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents, without the lines that three or more of them share."""
    done = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.keeper IS NOT NULL AND doc_id <> g.keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
