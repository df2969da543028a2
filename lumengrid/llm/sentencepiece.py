"""SentencePiece BPE encoding and decoding by a prefix table.

For each prefix of a word the last token of its encoding is unique. An Aho-Corasick automaton names the pieces that end
at a position; the one that is compatible with the last token of the prefix before it is stored. The ids are then read
off backwards. Two tokens are compatible if merging their joint surface gives exactly these two; a merge never crosses a
boundary that the merging of the two neighbours leaves standing, so neighbours decide the whole text.

Null and empty texts give no ids but the requested begin and end. Texts may be of any length: a word is read once, left
to right. Equal texts give equal ids; repeated rows stay repeated; columns other than the two named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumengrid.llm.common import Recent, gather, slices, texts_of, words_of

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words whose ids a worker keeps; twice as many at most.
CACHED_WORDS = 300_000
CACHED_PAIRS = 1_000_000


class Pairs(dict):
    """Whether two tokens (first << 16 | second) are compatible: merging their joint surface gives just these two."""

    def __init__(self, owner: "PieceModel"):
        super().__init__()
        self.owner = owner

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        a, b = self.owner.surfaces[pair >> 16], self.owner.surfaces[pair & 0xFFFF]
        fits = self[pair] = self.owner._merge(a + b) == [a, b]
        return fits


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback, and the prefix table over it."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        size = own.get_piece_size()
        self.bos, self.eos = own.bos_id(), own.eos_id()
        kinds = [(own.is_control(i), own.is_unknown(i), own.is_byte(i), own.is_unused(i)) for i in range(size)]
        if any(k[3] for k in kinds):
            raise ValueError("models with unused pieces are not supported")
        pieces = [own.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not any(kinds[i])]
        self.score = {pieces[i]: own.get_score(i) for i in plain}
        self.ids = {pieces[i]: i for i in plain}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if kinds[i][2]}
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that go on after a space are not supported")
        alphabet = {c for p in self.ids for c in p}
        self.surfaces = [*self.ids, *sorted(alphabet - self.ids.keys())]  # characters that only occur in pieces can still merge
        self.automaton = ahocorasick.Automaton()
        for t, surface in enumerate(self.surfaces):
            self.automaton.add_word(surface, t)
        self.automaton.make_automaton()
        self.lengths = [len(s) for s in self.surfaces]
        self.alone = [self._merge(s) == [s] for s in self.surfaces]
        self.fits = Pairs(self)
        self.out = [self._raw(s) for s in self.surfaces]
        self.words = Recent(CACHED_WORDS)
        shown = [b"" if k[0] else b" \xe2\x81\x87 " if k[1] else bytes([int(p[3:5], 16)]) if k[2] else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_length = np.array([len(b) for b in shown])
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.leads_space = np.array([p.startswith(SPACE) for p in pieces])

    def _raw(self, surface: str) -> bytes:
        """The ids of one token as little-endian 32-bit integers; an unknown character becomes its bytes' ids."""
        own = self.ids.get(surface)
        return np.array([own] if own is not None else [self.byte_ids[b] for b in surface.encode()], "<u4").tobytes()

    def _merge(self, surface: str) -> list[str]:
        """Plain merging: the best score first, the leftmost of equals."""
        parts, score = list(surface), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that start at safe boundaries: the prefix table forwards, the tokens backwards.

        last[i] is the unique last token of the encoding of chunk[:i], or -1 if that is a character outside the alphabet.
        Sorted chunks share the table of their common prefix.
        """
        found: dict[str, bytes] = {}
        fits, alone, lengths, out = self.fits, self.alone, self.lengths, self.out
        last, before = [-1], ""
        for chunk in sorted(chunks):
            same = 0
            for a, b in zip(chunk, before, strict=False):
                if a != b:
                    break
                same += 1
            before = chunk
            del last[same + 1 :]
            last.extend([-1] * (len(chunk) - same))
            for end, t in self.automaton.iter(chunk):
                if end < same or last[end + 1] >= 0:
                    continue
                prev = last[end + 1 - lengths[t]]
                if fits[prev << 16 | t] if prev >= 0 else alone[t]:
                    last[end + 1] = t
            ids, i = [], len(chunk)
            while i > 0:
                t = last[i]
                if t < 0:
                    ids.append(self._raw(chunk[i - 1]))
                    i -= 1
                else:
                    ids.append(out[t])
                    i -= lengths[t]
            ids.reverse()
            found[chunk] = b"".join(ids)
        return [found[c] for c in chunks]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with the space mark before each; those of words seen before come from the worker's store."""
        raw = [self.words.get(w) for w in words]
        new = [i for i, r in enumerate(raw) if r is None]
        for i, ids in zip(new, self.encode_chunks([SPACE + words[i] for i in new]), strict=True):
            raw[i] = self.words.put(words[i], ids)
        return raw

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text), without begin and end."""
        texts = pc.replace_substring(texts, SPACE, " ")
        words, codes, offsets = words_of(texts, " ")
        raw = self.encode_words(words)
        if "" in words:  # runs of spaces: such texts are cut into chunks one by one
            odd = np.zeros(len(texts), bool)
            odd[np.repeat(np.arange(len(texts)), np.diff(offsets))[codes == words.index("")]] = True
        else:
            odd = np.zeros(len(texts), bool)
        size = np.array([len(r) // 4 for r in raw], np.int64)
        values, ends = gather(np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size, size, codes)
        at = ends[offsets]
        if not odd.any():
            return values, at
        parts = []
        for i in range(len(texts)):
            if odd[i]:
                text = texts[i].as_py().replace(" ", SPACE)
                chunks = CHUNK.findall(SPACE + text) if text else []
                parts.append(np.frombuffer(b"".join(self.encode_chunks(chunks)), "<u4"))
            else:
                parts.append(values[at[i] : at[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode_slice(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id runs: bytes joined, the space that encoding put before the text taken off."""
        data, ends = gather(self.shown, self.shown_start, self.shown_length, ids)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = data[ends[a] : ends[b]].tobytes()
            visible = a + int(np.argmax(self.shown_length[ids[a:b]] > 0)) if b > a else a
            if b > a and self.leads_space[ids[visible]]:
                own = own[1:]
            out.append(own.decode("utf-8", "replace"))
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """(id_col, ids): each whole text's ids, as little-endian unsigned 32-bit integers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        first = np.array([own.bos] if begin else [], "<u4").tobytes()
        final = np.array([own.eos] if end else [], "<u4").tobytes()
        for part in slices(batches):
            ids, at = own.encode_slice(texts_of(part.column("text")))
            rows = [first + ids[a:b].tobytes() + final for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary").withColumnRenamed("doc_id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with a column `decoded`: the text of its binary ids; null ids decode to an empty text. A clashing column `decoded` is replaced."""
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in slices(batches, ids_col):
            rows = pc.fill_null(part.column(ids_col), b"").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
            texts = own.decode_slice(np.frombuffer(b"".join(rows), "<u4"), at)
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: ids of all documents with begin and end, decoded again; digests of both."""
    import public_tokenizers

    from lumengrid.llm.common import table

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
