"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter: each of `SLICES` tables maps a hashed trigram to a bitmask of languages; the masks of all
slices, and-ed, name all languages whose trigrams include it. A text's popcounts per language, corrected for each filter's
rate of false positives, decide. A slot is set by every trigram of a bounded sample of labelled rows, however rare. A slice has
SLOTS slots, or the power of two from twice the different trigrams of the language that has most of them in the sample: under
0.4 of its slots are set, and a rate of false positives stays under 0.1. The filters take SLICES x slots x 8 bytes for every 64
languages, of any number: 1.5 MB by default, 48 MB where a language has a million trigrams.

Trigrams are those of the lower-cased text whose middle is a letter, anything else than a letter being a boundary. Null
texts and texts without a letter are `und` with score 0. Rows without a label or text are not learned from; ties go to
the language that sorts first. Texts of any length are read whole. With nothing to learn from, every text is `und`.
Repeated rows get equal results; columns other than the named ones are not read, but `annotate` keeps them, and replaces
only those that have the names of its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumengrid.llm.common import give_back, slices, sums, table

SLOTS = 1 << 16
SLICES = 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: The bound of the sample: labelled rows of a language that the filters are fitted on, in expectation.
ROWS_PER_LANGUAGE = 3000
UNKNOWN = "und"
#: Bytes of text that are hashed at once; the arrays of trigrams take up to a hundred times as much.
SLICE = 1 << 19
NO_LETTER = re.compile(r"[\W\d_]")

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each trigram, offsets by text, whether a text has a letter)."""
    lower = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in lower], np.int64)
    code = np.frombuffer("\0".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    middle = np.flatnonzero(letter)
    a, b, c = code[middle - 1], code[middle], code[middle + 1]
    edges = np.concatenate([[0], np.cumsum(size)])
    offsets = np.searchsorted(middle, edges)
    return (a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c, offsets, np.diff(offsets) > 0


def pieces(texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """Texts with long ones cut, and the first piece of each. Cuts fall on what is no letter, so no trigram is lost."""
    out, first = [], []
    for text in texts:
        first.append(len(out))
        at = 0
        while text and len(text) - at > SLICE and (cut := NO_LETTER.search(text, at + SLICE)):
            out.append(text[at : cut.start()])
            at = cut.start()
        out.append(text[at:] if at else text)
    return out, np.array([*first, len(out)], np.int64)


def slot(grams: np.ndarray, k: int, slots: int = SLOTS) -> np.ndarray:
    h = (grams ^ (grams >> np.uint64(29))) * MULTIPLIERS[k]
    return (h ^ (h >> np.uint64(32))) * MULTIPLIERS[(k + 1) % SLICES] >> np.uint64(64 - (slots.bit_length() - 1))


class Filters:
    """The fitted slices: languages, a bitmask word array for each slice, and false-positive rates."""

    def __init__(self, languages: list[str], words: list[tuple[int, int, int, int]], slots: int = SLOTS):
        """`words`: (language, slice, word, bits), 64 slots to a word."""
        self.languages, self.slots = languages, slots
        self.masks = np.zeros((SLICES, -(-len(languages) // 64) or 1, slots), np.uint64)
        fill = np.zeros((len(languages), SLICES))
        for language, k, word, bits in words:
            at = word * 64 + np.flatnonzero(np.unpackbits(np.array([bits], "<i8").view(np.uint8), bitorder="little"))
            self.masks[k, language // 64, at] |= np.uint64(1 << language % 64)
            fill[language, k] += len(at) / slots
        self.false_rate = np.minimum(fill.prod(axis=1), 0.99)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        parts, first = pieces(texts)
        counts = np.concatenate([self._counts(parts[i : i + 1]) for i in range(len(parts))] if len(parts) > len(texts) else [self._counts(parts)])
        counts = sums(counts, first)
        n, has = np.maximum(counts[:, -1], 1), counts[:, -1] > 0
        share = np.maximum(counts[:, :-1] / n[:, None] - self.false_rate, 0) / (1 - self.false_rate)
        best = share.argmax(axis=1)
        total = share.sum(axis=1)
        score = np.where(has, share.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the trigrams that each language has, and all trigrams."""
        grams, offsets, _ = trigrams(texts)
        at = [slot(grams, k, self.slots) for k in range(SLICES)]
        out = np.zeros((len(texts), len(self.languages) + 1), np.int64)
        out[:, -1] = np.diff(offsets)
        for w in range(self.masks.shape[1]):
            mask = self.masks[0, w][at[0]]
            for k in range(1, SLICES):
                mask &= self.masks[k, w][at[k]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] = sums((mask >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32), offsets)
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Filters:
    """Filters from a sample of the labelled rows, drawn by a hash of id and text."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return Filters([], [])
    drawn = df.sparkSession.createDataFrame([(name, i, min(1.0, rows_per_language / counts[name])) for i, name in enumerate(languages)], "lang string, language int, share double")
    sample = rows.join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("language", "text")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The trigrams of each text of the sample, with its language."""
        for part in slices(batches, limit=SLICE):
            own = part.column("language").to_numpy()
            parts, first = pieces(part.column("text").to_pylist())
            own = np.repeat(own, np.diff(first))
            for language in np.unique(own).tolist():
                for text in [parts[i] for i in np.flatnonzero(own == language)]:
                    yield language, trigrams([text])[0]

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, mine in learned(batches):
            mine = np.unique(mine)
            yield pa.record_batch([pa.array(np.full(len(mine), language, np.int32)), pa.array(mine.view(np.int64))], ["language", "gram"])

    most = sample.mapInArrow(different, "language int, gram long").groupBy("language").agg(F.approx_count_distinct("gram", 0.02).alias("n")).agg(F.max("n")).first()[0] or 1
    slots = max(SLOTS, 1 << (2 * int(most * 1.05) - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for language, mine in learned(batches):
            for k in range(SLICES):
                held.setdefault((language, k), np.zeros(slots, bool))[slot(mine, k, slots).astype(np.int64)] = True
        for (language, k), got in held.items():
            bits = np.packbits(got, bitorder="little").view("<i8")
            at = np.flatnonzero(bits)
            yield pa.record_batch([pa.array(np.full(len(at), language, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(bits[at])], ["language", "slice", "word", "bits"])

    found = sample.mapInArrow(run, "language int, slice int, word int, bits long").groupBy("language", "slice", "word").agg(F.bit_or("bits").alias("bits"))
    got = found.toArrow()  # SLICES x slots / 64 rows per language at most
    return Filters(languages, list(zip(*(got.column(i).to_pylist() for i in range(4)), strict=True)), slots)


def annotate(df: DataFrame, filters: Filters, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """`df` with the language and its score; clashing columns of these names are replaced."""
    df = df.drop(lang_out, score_out)
    shared = df.sparkSession.sparkContext.broadcast(filters)  # bounded: slices x slots x languages / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE):
            names, score = shared.value.predict(part.column(text_col).to_pylist())
            yield pa.record_batch([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, lang_out, score_out])
        give_back()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())]))


def held_out(fold: int, of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the language of all documents; every fifth document, by the checksum of its id, is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit(docs.where(~held_out(0, 5)))
    return annotate(docs.select("doc_id", "text"), filters).select("doc_id", F.coalesce(held_out(0, 5), F.lit(False)).alias("held_out"), "lang_pred", "score")
