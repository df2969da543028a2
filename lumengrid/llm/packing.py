"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents and gaps are sorted by size into ranges: documents of one length, and sequences with one gap, are
interchangeable, so a range is (size, count) and a round works on ranges, not on rows. Each round walks the document ranges
from the longest down. A range finds its successor, the smallest gap that holds it; document r of the range takes gap r of
that gap range (conflicts resolve by rank), what is left over looks for the next gap, and gaps shrink. The round for one
length repeats until its documents are placed; what fits nowhere opens sequences. Ranges number at most `capacity` lengths
plus one gap range for each match, whatever the data's size.

Rows then take their places in one distributed pass: a document's rank among those of its length names its range, and
with it sequence and offset. A length is ranked in as many salted groups as its counted rows ask for, about `RANKED` rows each,
so a length that a third of all rows share is no hot group at any scale.

A null text is empty and still has its closing id; texts of any length are cut into whole pieces from the end, so that
only the first piece is short. Repeated rows are packed each; ids may be null or repeat. An empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import Recent, gather, give_back, slices, stored, table, texts_of, words_of

CAPACITY = 2048
#: Rows of one length that one task ranks; more, if there would be over GROUPS groups of hot lengths.
RANKED, GROUPS = 200_000, 1 << 16
CACHED_WORDS = 150_000
SPECIAL = "<|endoftext|>"


class Coder:
    """Byte-level BPE ids of whole texts; a worker keeps the ids of words."""

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.tokenizer_path, self.whole = tokenizer_path, None
        self.words = Recent(CACHED_WORDS)

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def special(self, text: str) -> bytes:
        """Texts that hold a special token's string go through the tokenizer's own file."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before each. New words are encoded as one text, which breaks before every space."""
        raw = [self.words.get(w) for w in words]
        new = [i for i, r in enumerate(raw) if r is None]
        if new:
            text = " " + " ".join([words[i] for i in new])
            ids = np.array(self.bpe.encode_ordinary(text), "<u4")
            ends = np.cumsum([len(words[i].encode()) + 1 for i in new])
            cuts = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
            at = 0
            for i, upto in zip(new, cuts.tolist(), strict=True):
                raw[i] = self.words.put(words[i], ids[at:upto].tobytes())
                at = upto
        return raw

    def encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. A word with the space before it is a unit of its own unless white space ends the word before."""
        words, codes, offsets = words_of(texts, " ")
        odd_word = np.array([not w or w[-1].isspace() for w in words], bool)
        of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        odd = np.zeros(len(texts), bool)
        odd[of_text[odd_word[codes]]] = True
        odd |= pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(~odd_word)
        raw = [b""] * len(words)
        for i, ids in zip(known.tolist(), self.encode_words([words[i] for i in known]), strict=True):
            raw[i] = ids
        size = np.array([len(r) // 4 for r in raw], np.int64)
        values, ends = gather(np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size, size, codes)
        out = []
        for i in range(len(texts)):
            a, b = offsets[i], offsets[i + 1]
            if odd[i]:
                text = texts[i].as_py()
                out.append(np.frombuffer(self.special(text) if SPECIAL in text else self.plain(text), "<u4"))
            else:
                first = np.frombuffer(self.plain(words[codes[a]]), "<u4")
                out.append(np.concatenate([first, values[ends[a + 1] : ends[b]]]))
        return out


#: Bytes of text that a worker encodes at once.
SLICE = 1 << 20


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str, tokenizer_path: str) -> Coder:
    return Coder(ranks_path, pattern, tokenizer_path)


def tokenize(df: DataFrame, ranks_path: str, pattern: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of each document's ids, `end_id` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern, tokenizer_path)
        final = np.array([end_id], "<u4")
        for part in slices(batches, limit=SLICE):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(own.encode_slice(texts_of(part.column("text")))):
                ids = np.concatenate([ids, final])
                at, upto, number = 0, len(ids) - (len(ids) - 1) // capacity * capacity, 0
                while at < len(ids):
                    data = ids[at:upto].tobytes()
                    row.append(i)
                    piece.append(number)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        kept.append(data)
                    at, upto, number = upto, upto + capacity, number + 1
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns + [pa.array(kept, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        coder.cache_clear()  # vocabulary and words are no burden to what the worker does next
        del own
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The places of all documents as ranges (length, first rank, count, first sequence, offset), from counts by length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size -> ranges (first sequence, count)
    sizes: list[int] = []  # gap sizes in order
    placed, opened = [], 0

    def add(size: int, first: int, count: int) -> None:
        if size:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):  # the successor: the smallest gap that holds this length
                size = sizes[at]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            take = min(left, count)
            if take < count:
                add(size, first + take, count - take)
            placed.append((length, rank, take, first, capacity - size))
            add(size - length, first, take)
            rank, left = rank + take, left - take
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with doc_id, piece, length, ids_crc32) with sequence_id and offset: gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    most = max(RANKED, -(-sum(counts.values()) // GROUPS))
    salts = {length: -(-n // most) for length, n in counts.items()}
    hot = {length: n for length, n in salts.items() if n > 1}
    salt = F.lit(0)
    if hot:
        own = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("length").cast("int")]
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own).cast("int"), salt)
    pieces = pieces.withColumn("salt", salt)
    at = np.zeros(capacity + 2, np.int64)  # where a length's groups begin
    at[1:] = np.cumsum([salts.get(length, 0) for length in range(capacity + 1)])
    first = np.zeros(at[-1], np.int64)  # the rank at which each group begins in its length
    if hot:
        groups = pieces.where(F.col("length").isin(list(hot))).groupBy("length", "salt").count().collect()  # 2 * GROUPS rows at most
        for r in groups:
            first[at[r["length"]] + r["salt"]] = r["count"]
        for length, n in hot.items():
            a = at[length]
            first[a : a + n] = np.cumsum(first[a : a + n]) - first[a : a + n]
    places = sorted(rounds(counts, capacity))
    shift = 1 << 44  # a key orders places by length, then rank
    keys = np.array([p[0] * shift + p[1] for p in places], np.int64)
    seq, off = np.array([p[3] - p[1] for p in places], np.int64), np.array([p[4] for p in places], np.int64)
    shared = spark.sparkContext.broadcast((keys, seq, off, at, first))  # bounded by capacity and GROUPS, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seq, off, group, first = shared.value
        for batch in batches:
            names = batch.schema.names
            if not batch.num_rows:
                continue
            length, salt, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank - 1 + first[group[length] + salt]
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            keep = [i for i, n in enumerate(names) if n not in ("salt", "rank")]
            yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(seq[at] + rank), pa.array(off[at])], [*(names[i] for i in keep), "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order).cast("long"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("salt").schema)
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def packed_documents(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents of `df` with their places, tokenized with the public byte-level vocabulary."""
    import public_tokenizers

    pieces = stored(tokenize(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"), capacity))
    return pack(pieces, capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of at most 2048 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
