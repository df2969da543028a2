"""Media columns: audio stored as WAV bytes, with features read back from them.

Features: polyphase resampling to 16 kHz, overlapped frames under log-mel filterbanks, and segments where a frame's energy
rises above a high mark until it falls below a low one (hysteresis). The log-mel frames are cut into windows of one shape
and kept as an Arrow fixed-shape tensor (an IPC stream in a binary column) with the time span of each window.

A payload is stored as unsigned 8-bit mono samples, without loss. Null and empty payloads become one block of padding.
Long payloads are filtered whole and framed in runs, so that memory follows one payload. Equal payloads give equal
values, repeated rows repeat. An empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import slices, table

#: Payloads are padded with spaces to a multiple of this.
BLOCK = 192
RATE = 24_000
UP, DOWN = 2, 3
HALF_TAPS = 8
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
WINDOW = 64
RUN = 2048
SLICE = 2 << 20

FEATURES = "tensors binary, windows array<struct<start:double,stop:double>>, segments array<struct<start:double,stop:double>>, feature string"


@lru_cache(maxsize=1)
def _phases() -> list[tuple[int, np.ndarray]]:
    """For each output phase: the first input sample relative to the block, and the taps of its branch of the low-pass filter."""
    span = HALF_TAPS * max(UP, DOWN)
    n = np.arange(-span, span + 1)
    low = np.sinc(n / max(UP, DOWN)) * np.hamming(2 * span + 1)
    low *= UP / low.sum()
    out = []
    for r in range(UP):
        at = r * DOWN  # place of output r on the upsampled grid; inputs sit at multiples of UP
        first, last = math.ceil((at - span) / UP), (at + span) // UP
        out.append((first, low[[at - k * UP + span for k in range(first, last + 1)]].astype(np.float32)))
    return out


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE * UP / DOWN samples a second, by polyphase branches; its length is a multiple of DOWN."""
    blocks = len(x) // DOWN
    edge = HALF_TAPS * max(UP, DOWN) + DOWN
    padded = np.pad(x, edge)
    out = np.empty(blocks * UP, np.float32)
    for r, (first, taps) in enumerate(_phases()):
        y = np.zeros(blocks, np.float32)
        for k, tap in enumerate(taps):
            at = edge + first + k
            y += tap * padded[at : at + blocks * DOWN : DOWN]
        out[r::UP] = y
    return out


@lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FFT // 2 + 1)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, log energy of each frame); the last frame is padded with silence."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.pad(y, (0, max(0, (n - 1) * HOP + FRAME - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    taper = np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, RUN):
        part = frames[at : at + RUN] * taper
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mels[at : at + RUN] = np.log(power @ _mel() + 1e-6)
        energy[at : at + RUN] = np.log((part**2).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> np.ndarray:
    """Spans [first frame, frame after the last] that begin at or above the high mark and end below the low one."""
    mid, dev = float(energy.mean()), float(energy.std())
    mark = np.where(energy >= mid + 0.5 * dev, 1, np.where(energy < mid - 0.5 * dev, -1, 0))
    told = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(told >= 0, mark[told] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def tensor_bytes(mels: np.ndarray) -> tuple[bytes, int]:
    """The frames as an Arrow IPC stream of half-precision fixed-shape tensors [WINDOW, MELS], padded with zeros."""
    n = -(-len(mels) // WINDOW)
    whole = np.zeros((n, WINDOW, MELS), np.float16)
    whole.reshape(-1, MELS)[: len(mels)] = mels
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(whole)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("log_mel", column.type)])) as out:
        out.write_batch(pa.record_batch([column], ["log_mel"]))
    return sink.getvalue(), n


def features(payload: bytes) -> dict:
    """The features of 8-bit samples."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    x = np.pad(x, (0, -len(x) % DOWN))
    mels, energy = log_mel(resample(x))
    spans = segments(energy)
    stream, n = tensor_bytes(mels)
    second = HOP * DOWN / (RATE * UP)
    end = len(payload) / RATE
    bands = mels.reshape(len(mels), 4, -1).mean(axis=(0, 2))
    text = f"frames={len(mels)};windows={n};segments={len(spans)};active={int((spans[:, 1] - spans[:, 0]).sum())};bands={','.join(f'{b:.2f}' for b in bands)}"
    return {
        "tensors": stream,
        "windows": [{"start": i * WINDOW * second, "stop": min((i + 1) * WINDOW * second, end)} for i in range(n)],
        "segments": [{"start": a * second, "stop": min(b * second, end)} for a, b in spans.tolist()],
        "feature": text,
    }


def wav(payload: bytes) -> bytes:
    sink = io.BytesIO()
    with wave.open(sink, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(payload)
    return sink.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as own:
        return own.readframes(own.getnframes())


def store_audio(df: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of a text, padded with spaces to a block, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            raw = [(t.as_py() or "").encode() for t in part.column("text")]
            media = [wav(r.ljust(max(1, -(-len(r) // BLOCK)) * BLOCK)) for r in raw]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(payload_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def audio_features(df: DataFrame) -> DataFrame:
    """`df` (doc_id, n_bytes, media) with the payload read back from the media, and its features."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", limit=SLICE):
            payload = [samples(m.as_py()) for m in part.column("media")]
            made = [features(p) for p in payload]
            spans = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
            kinds = {"tensors": pa.binary(), "windows": spans, "segments": spans, "feature": pa.string()}
            yield pa.record_batch([*part.columns, pa.array(payload, pa.binary()), *(pa.array([m[k] for m in made], t) for k, t in kinds.items())], [*part.schema.names, "payload", *kinds])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, {FEATURES}")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents as audio, read back, with digests of what is stored."""
    done = audio_features(store_audio(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "tensors",
        "windows",
        "segments",
    )
