"""SimHash near-duplicates with stored pivot distance tables.

Every different fingerprint gets a row of a stored table: its Hamming distances to the reference fingerprints. These are
the zero word, the 64 words of one bit, and `FAR` random words. Two fingerprints within `radius` bits differ by at most
`radius` in every coordinate (triangle inequality), so a pair is discarded by its maximum coordinate difference, and only
survivors are compared bit by bit.

Candidates come from the table too, by a grid join on coordinates. A distance to a random word says little of 64 bits (for
two unrelated words it differs by 5.7 on average), but the distance to a word of one bit, less that to the zero word, is
+1 or -1 and differs only if the pair differs there: these are the references that tell most. A cell is a choice of such
coordinates with their values; rows of one cell are compared.

- `near_duplicates` is exact for fingerprints: of `blocks` blocks of references, a pair within `radius` bits has
  blocks - radius whole ones; each choice of so many is one cell. Blocks grow in number with the table, so that cells stay small.
- `similar_documents` looks for a Jaccard similarity of word shingles, of which 64 bits are only a sketch. Its cells are bands of
  `ROWS` minima of hashed shingles, as many as it takes for a pair at the similarity to share one with the chance `RECALL` (24
  at 0.8, whatever the table holds), or with `exact` the rarest part of each set by the order of hashes, of which two similar
  sets always share one (prefix filter). The sets of 32-bit shingle hashes go to the cells, and links are found and verified there:
  two similar sets share one of the shingles that are rarest in the cell, at a place that leaves room for the overlap. A cell sends
  one edge for each of its groups at most, never its pairs. Whether two texts are compared does not depend on others.

Within a cell of fingerprints, rows are swept in sorted order. Cells above `GROUP` rows are dealt to pairs of parts, so that no task holds
one whole; they are found by the cells of a share of the table, and if that misses one, its task just holds more. Cells of sets are
dealt so by their counted shingles (`PART`).

Only different texts are compared. Null and empty texts have fingerprint zero and are linked like any other; repeated rows
get the same result each. Null ids are fingerprinted by `near_duplicates` and take their component's id, but never name it
(a component with null ids only has a null id); `similar_documents` leaves them out, as nothing could name them. Texts may be
of any length: shingles are hashed in runs. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import FEW_ROWS, forget, give_back, slices, small_batches, spread_join, stored, table, texts_of
from lumengrid.llm.components import components

SEED = 42
RADIUS = 4
#: Rows of one cell that a task compares at once.
GROUP = 8192
#: Random references; their distances are the bytes of a long.
FAR = np.random.default_rng(7).integers(0, 2**64, 8, dtype=np.uint64)
#: The zero word and the words of one bit.
UNIT = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
RUN = 1 << 16
#: Minima in a band, and the chance that a pair at the similarity shares a band.
ROWS = 4
RECALL = 0.999995
#: A text's first test is the head of the cells that it shares, if they share so many bands.
SHARED = 3
#: Shingles of a cell that go to one part of it; a task holds two parts of a large cell.
PART = 1 << 19
#: The factor from one look for shingles that a single group holds to the next.
MORE = 2



def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, in runs: A-Z lower-cased, words split at 0x20 and 0x09-0x0D, joined by spaces."""
    words = text.lower().split()  # of bytes: both know ASCII only
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), RUN):
        a, b = starts[at : at + RUN].tolist(), ends[at : at + RUN].tolist()
        yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), "<u8", len(a))


def _folded(runs: Iterator[np.ndarray]) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in runs:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if it is set in over half the shingles' hashes."""
    return _folded(shingle_hashes(text, shingle, seed))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted different shingle hashes of a text."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)]))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): each row's fingerprint; its 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = [fingerprint(t.as_py().encode(), shingle) for t in texts_of(part.column("text"))]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# --- pivot tables and their cells ----------------------------------------------------------------------------------


def distances(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, a row for each fingerprint."""
    return np.stack([np.bitwise_count(fp ^ p) for p in references], axis=1).astype(np.uint8)


def pivot_table(rows: DataFrame) -> DataFrame:
    """`rows`, which have a column fp, with their coordinates: `unit` (bytes) and `far` (8 bytes as a long). Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(batch.schema.get_field_index("fp")).to_numpy().view(np.uint64)
            unit, far = distances(fp, UNIT), distances(fp, FAR)
            size = pa.array([len(UNIT)] * len(fp), pa.int32())
            offsets = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * len(UNIT))
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(unit.tobytes())])
            yield pa.record_batch([*batch.columns, data, pa.array(np.ascontiguousarray(far).view(np.int64)[:, 0])], [*batch.schema.names, "unit", "far"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(run, f"{kept}, unit binary, far long"))


def block_choices(blocks: int, radius: int) -> list[list[int]]:
    """The references of each choice of blocks that some pair within the radius leaves whole."""
    parts = np.array_split(np.arange(1, 65), blocks)
    return [np.concatenate([parts[i] for i in some]).tolist() for some in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Two blocks more than the radius, and more of them until a cell's coordinates number as many as n has bits."""
    blocks = radius + 2
    while blocks < 16 and (blocks - radius) * 64 / blocks < math.log2(max(n, 2)):
        blocks += 1
    return blocks


def cells(pivots: DataFrame, choices: list[list[int]], columns: list[str]) -> DataFrame:
    """(cell, columns): each row of the stored table once for each choice of coordinates. Equal coordinates give equal cells."""
    r = np.random.default_rng(3)
    weights = np.zeros((len(UNIT), len(choices)), np.int64)
    for c, some in enumerate(choices):
        weights[some, c] = r.integers(-(2**62), 2**62, len(some)) | 1
    start = r.integers(-(2**62), 2**62, len(choices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, len(UNIT)).astype(np.int64)
                own = (unit - unit[:, :1]) @ weights + start  # wraps at 64 bits
                for c in range(len(choices)):
                    yield pa.record_batch([pa.array(own[:, c]), *part.columns[1:]], ["cell", *columns])

    kinds = "".join(f", `{c}` {pivots.schema[c].dataType.simpleString()}" for c in columns)
    return pivots.select("unit", *columns).mapInArrow(run, f"cell long{kinds}")


def dealt(pivots: DataFrame, choices: list[list[int]], columns: list[str], group: int, n: int) -> DataFrame:
    """(columns, cell[, part]): the cells, sorted within partitions. Large ones are dealt to cells of two parts each.

    `part` is 2 for rows that are compared with each other, and 0 or 1 for rows of two parts of which only pairs across are
    compared; without a large cell there is none.
    """
    own = cells(pivots, choices, columns)
    rate = max(1, min(64, group // 128))
    large = None
    if n > group:
        some = pivots.where(F.pmod(F.xxhash64("fp", F.lit("deal")), F.lit(rate)) == 0)
        large = stored(cells(some, choices, []).groupBy("cell").count().where(F.col("count") * rate > group).select("cell", F.ceil(F.col("count") * rate / group).cast("int").alias("parts")))
    if large is not None and not large.isEmpty():  # part p of n meets each part q >= p in a cell (p, q); pairs of one part are compared in (p, p) only
        own = own.join(large, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        part = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") > F.col("q"), 1).otherwise(0).alias("part")
        own = own.select(*columns, F.xxhash64("cell", F.least("p", "q"), F.greatest("p", "q")).alias("cell"), part)
    return own.repartition("cell").sortWithinPartitions("cell")


def by_cell(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows in tables of whole cells, of about `least` rows, with each row's cell as a running number."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        g = _groups(t)
        cut = int(np.searchsorted(g, g[-1]))  # the last cell may go on in the next batch
        if cut:
            yield t.slice(0, cut), g[:cut]
            held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _groups(t)


def _groups(t: pa.Table) -> np.ndarray:
    cell = t.column("cell").to_numpy()
    return np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)


def _parts(t: pa.Table) -> np.ndarray:
    return t.column("part").to_numpy() if "part" in t.column_names else np.full(t.num_rows, 2)


def pairs_by_step(group: np.ndarray, part: np.ndarray, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell, as index arrays, one distance in the order at a time; `wanted(a, b)` picks among them first."""
    n = len(group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.array([], int)
    longest = int(np.diff(np.append(start, n)).max()) if n else 0
    at = np.arange(n)
    for step in range(1, longest):
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        some = at[(part[at] != part[at + step]) | (part[at] == 2)]
        some = some[wanted(some, some + step)]
        if len(some):
            yield some, some + step


def near(fp: np.ndarray, far: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within the radius: the maximum coordinate difference first, then the bits."""
    keep = np.abs(far[left] - far[right]).max(axis=1, initial=0) <= radius
    keep[keep] = np.bitwise_count(fp[left[keep]] ^ fp[right[keep]]) <= radius
    return keep


def _coordinates(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp = t.column("fp").to_numpy().view(np.uint64)
    return fp, np.ascontiguousarray(t.column("far").to_numpy()).view(np.uint8).reshape(-1, len(FAR)).astype(np.int8)


# --- exact components of fingerprints ------------------------------------------------------------------------------


def near_edges(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b): star edges (member, smallest member) that connect the distinct fingerprints `fp` within the radius.

    A cell sends one edge for each member at most; pairs that it has connected already are skipped.
    """
    pivots = pivot_table(distinct.select("fp"))
    n = pivots.count()
    cell_rows = dealt(pivots, block_choices(blocks_for(n, radius), radius), ["fp", "far"], group, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in by_cell(batches, 4 * group):
            fp, far = _coordinates(t)
            label = [np.arange(len(fp))]
            for a, b in pairs_by_step(g, _parts(t), lambda a, b: label[0][a] != label[0][b]):  # noqa: B023
                hit = near(fp, far, a, b, radius)
                if hit.any():
                    label[0] = _joined(label[0], a[hit], b[hit])
            moved = np.flatnonzero(label[0] != np.arange(len(fp)))
            yield pa.record_batch([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[0][moved]].view(np.int64))], ["a", "b"])

    return cell_rows.mapInArrow(run, "a long, b long").distinct()


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the smaller root of each link wins, until roots stand still."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, again := label[label]):
            label = again


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that each row reaches over links of at most `radius` differing bits."""
    rows = stored(fingerprints(df, id_col, text_col, shingle))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(near_edges(distinct.select("fp"), radius))
    named = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = stored(spread_join(named, names, "root").select("fp", "component_id"))
    return spread_join(rows, of_fp, "fp").select("doc_id", "fp", "component_id")


# --- components of similar texts -----------------------------------------------------------------------------------


def bands_for(similarity: float, recall: float | None = None) -> int:
    """How many bands of ROWS minima a pair at the similarity needs to share one with the chance `recall`."""
    recall = RECALL if recall is None else recall
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.999) ** ROWS)))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least of the hashes under each of `count` mixings, as 32-bit numbers: two sets agree in one with the chance of their similarity."""
    r = np.random.default_rng(29)
    turn, times = r.integers(0, 2**64, count, dtype=np.uint64), r.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)
    least = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[None, at : at + 2048] ^ turn[:, None]) * times[:, None]
        least = np.minimum(least, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit cell for each band of minima."""
    m = least.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(m) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ m[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(31))


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, exact: bool) -> DataFrame:
    """(doc_id, text_hash, node, n, cells): a digest of the set of shingles, its size, its cells."""
    count = bands_for(similarity) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            node, n, own_cells = [], [], []
            for t in texts_of(part.column("text")):
                own = shingle_set(t.as_py().encode(), shingle)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                n.append(len(own))
                first = own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1] if exact else _band_keys(minima(own, count))
                own_cells.append(first.view(np.int64) if len(own) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in own_cells])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *own_cells]))
            yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), lists], ["doc_id", "text_hash", "node", "n", "cells"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, n int, cells array<long>")


def mixed_cells(links: DataFrame, state: DataFrame) -> DataFrame:
    """(cell, tokens) of the cells (cell, node) that hold nodes of several groups (node, n, comp); one cell of those with the same nodes."""
    members = links.select("cell", "node").join(state, "node")
    held = [F.count("*").alias("size"), F.min("node").alias("head"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    each = members.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("tokens"), *held).where("low < high")
    return each.groupBy("size", "head", "x", "y").agg(F.min("cell").alias("cell"), F.max("tokens").alias("tokens")).select("cell", "tokens")


def set_edges(members: DataFrame, sets: DataFrame, similarity: float, limit: int | None = None) -> DataFrame:
    """(a, b): edges that connect the groups of similar sets, from (cell, tokens, node, comp) and the sets (node, hashes).

    A cell, or two parts of one, sends one edge for each of its groups at most. Cells above `limit` shingles are dealt to pairs of parts.
    """
    limit = PART if limit is None else limit
    own = members.withColumn("parts", F.greatest(F.ceil(F.col("tokens") / limit), F.lit(1)).cast("int")).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") > F.col("q"), 1).otherwise(0).alias("part")
    rows = own.select("node", "comp", F.xxhash64("cell", F.least("p", "q"), F.greatest("p", "q")).alias("cell"), part).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, g in by_cell(batches, 1):
            size = np.cumsum(pc.binary_length(whole.column("hashes")).to_numpy().astype(np.int64) // 4)
            at = 0
            while at < len(g):  # whole cells of about two parts at a time, or one cell
                last = int(np.searchsorted(size, (size[at - 1] if at else 0) + 2 * limit, side="right"))
                upto = len(g) if last >= len(g) else int(np.searchsorted(g, g[last]))
                upto = upto if upto > at else int(np.searchsorted(g, g[at], side="right"))
                t = whole.slice(at, upto - at)
                comp = t.column("comp").to_numpy()
                first, label = joined_groups(t.column("hashes").to_pylist(), g[at:upto], comp, _parts(t), similarity)
                moved = first[label[first] != first]
                yield pa.record_batch([pa.array(comp[moved]), pa.array(comp[label[moved]])], ["a", "b"])
                at = upto
        give_back()

    dealt_rows = rows.select("comp", "hashes", "cell", "part").repartition("cell").sortWithinPartitions("cell")
    return dealt_rows.mapInArrow(run, "a long, b long").distinct()


def joined_groups(sets: list[bytes], cell: np.ndarray, comp: np.ndarray, part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, label): the first row of each group `comp`, and the row that stands for each row's group after all links within cells.

    Shingles are ordered by how many of the cell's sets hold them. The first that two sets share leaves each of them room for the
    overlap that they need, so only a set's beginning is asked; shingles that one set holds alone, as most edits make, ask nothing.
    """
    size = np.array([len(s) // 4 for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    key, times = np.unique(cell[row].astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(sets), "<u4"), return_inverse=True, return_counts=True)[1:]
    key = key[np.lexsort((key, times[key], row))]
    left = np.cumsum(size)[row] - np.arange(len(row))  # shingles from this one on
    keep = (times[key] > 1) & (left >= similarity * size[row] - 1e-6)
    row, key, left = row[keep], key[keep], left[keep]
    order = np.lexsort((size[row], key))  # of two sets, the smaller comes first
    row, key, left = row[order], key[order], left[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    held = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    need = similarity / (1 + similarity)
    first, label = np.unique(comp, return_index=True, return_inverse=True)[1:]
    label = first[label]
    at = np.flatnonzero(left >= 2 * need * size[row] - 1e-6)
    step, look = 0, 1
    while True:
        step += 1
        at = at[at + step < len(row)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return first, label
        if step >= look:  # shingles that a single group holds are done
            of = label[row]
            at = at[(np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start))[held[at]]]
            look = step * MORE
        a, b = row[at], row[at + step]
        ask = (label[a] != label[b]) & ((part[a] != part[b]) | (part[a] == 2)) & (np.minimum(left[at], left[at + step]) >= need * (size[a] + size[b]) - 1e-6)
        if ask.any():
            a, b = np.unique(np.stack([np.minimum(a, b)[ask], np.maximum(a, b)[ask]]), axis=1)
            hit = np.array([alike(sets[x], sets[y], similarity) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            if hit.any():
                label = _joined(label, a[hit], b[hit])


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets of 32-bit hashes is `similarity` or more."""
    x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def shingle_sets(df: DataFrame, wanted: DataFrame, repeated: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, hashes): the sorted 32-bit shingle hashes of the texts that stand for the nodes in wanted (doc_id, text_hash, node). Stored.

    Rows that `repeated` (doc_id, text_hash) names occur more than once, and only they are dealt by node to keep one of them.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [np.unique(shingle_set(t.as_py().encode(), shingle).astype("<u4")).tobytes() for t in texts_of(part.column("text"))]
            yield pa.record_batch([part.column("node"), pa.array(hashes, pa.binary())], ["node", "hashes"])
        give_back()

    key = ["doc_id", "text_hash"]
    mark = F.broadcast if wanted.count() <= FEW_ROWS else (lambda part: part)
    rows = texts.join(mark(wanted.join(repeated, key, "left_anti")), key).select("node", "text")
    if not repeated.isEmpty():
        rows = rows.unionByName(texts.join(mark(wanted.join(repeated, key, "left_semi")), key).select("node", "text").dropDuplicates(["node"]))
    return stored(rows.mapInArrow(run, "node long, hashes binary"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a > b, whose sets are similar. The smaller node of a crowd is heavy, and joined without dealing by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                keep[i] = alike(x, y, similarity)
            yield batch.select([0, 1]).filter(pa.array(keep))
        give_back()

    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("hashes").alias(name)).join(pairs.select(c), c, "left_semi")
    both = spread_join(pairs, side("b", "y"), "b").join(side("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """(doc_id, text_hash, root, group_id): the group (its root's digest) and its smallest id, for rows that have an id.

    Groups are the components of links between texts whose sets of shingles have a Jaccard similarity of `similarity` or more.
    First each text is compared with the head of the cells that it shares most, which makes most crowds one group at a cost in
    proportion to their size. Then the sets of the cells that still hold several groups meet there, all at once, and the cells send
    what connects their groups. `exact` finds every link, at the price of more cells. `text_hash` is xxhash64 of the text.
    """
    with small_batches(df.sparkSession):
        return _similar(df, id_col, text_col, shingle, similarity, exact)


def _similar(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, exact: bool) -> DataFrame:
    rows = stored(signatures(df.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, similarity, exact))
    kept = [F.any_value(c).alias(c) for c in ("n", "cells")]  # alike for all rows of a node
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *kept))
    repeated = stored(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    every = nodes.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    crowded = every.groupBy("cell").agg(F.count("*").alias("size"), F.min("node").alias("head")).where("size > 1")
    links = stored(every.join(crowded, "cell"))
    shared = links.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("bands")).where(F.col("bands") >= (1 if exact else SHARED))
    pairs = stored(shared.groupBy("node").agg(F.max_by("head", F.struct("bands", "head")).alias("head")).select(F.col("node").alias("a"), F.col("head").alias("b")))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _with_sets(None, df, nodes, repeated, asked, id_col, text_col, shingle)
    good = stored(verified(pairs, sets, similarity))
    roots = components(good).withColumnRenamed("root", "comp")
    lone = links.select("node").distinct()
    about = nodes.join(lone, "node", "left_semi").join(roots, "node", "left")
    state = stored(about.select("node", "n", F.coalesce("comp", "node").alias("comp")))
    forget(pairs, good)
    members = stored(links.select("cell", "node").join(mixed_cells(links, state), "cell").join(state.select("node", "comp"), "node"))
    sets = _with_sets(sets, df, nodes, repeated, members.select("node").distinct(), id_col, text_col, shingle)
    edges = stored(set_edges(members, sets, similarity))
    joined = components(edges).withColumnsRenamed({"node": "comp", "root": "new_comp"})
    state, before = stored(state.join(joined, "comp", "left").select("node", F.coalesce("new_comp", "comp").alias("comp"))), state
    forget(before, members, edges)
    named = stored(nodes.select("node", "rep").join(state.select("node", F.col("comp").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min("rep.doc_id").alias("group_id"))
    of_node = stored(spread_join(named, names, "root").select("node", "root", "group_id"))
    out = stored(spread_join(rows.select("doc_id", "text_hash", "node"), of_node, "node").select("doc_id", "text_hash", "root", "group_id"))
    forget(rows, nodes, repeated, links, state, named, of_node, sets)
    return out


def _with_sets(sets: DataFrame | None, df: DataFrame, nodes: DataFrame, repeated: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, hashes) of the texts that stand for the wanted nodes, besides those that `sets` has already. Stored."""
    if sets is not None:
        wanted = wanted.join(sets.select("node"), "node", "left_anti")
    wanted = stored(nodes.join(wanted, "node", "left_semi").select("rep.*", "node"))
    if sets is not None and wanted.isEmpty():
        return sets
    new = shingle_sets(df, wanted, repeated, id_col, text_col, shingle)
    forget(wanted)
    if sets is None:
        return new
    both = stored(sets.unionByName(new))
    forget(sets, new)
    return both


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprints of 4-word shingles and the components of links at 4 or fewer bits, over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
