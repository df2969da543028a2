"""Image files: PNG and GIF decoding and encoding in Arrow batches, folders and globs as tables, palettes.

Unsupported or broken files become rows with an error and no pixels; they do not fail the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg")
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IMAGE = "path string, width int, height int, rgba binary, error string"


def encode_png(rgba: bytes, width: int, height: int, level: int = 6) -> bytes:
    """RGBA bytes as an 8-bit PNG."""
    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes) of an 8-bit RGB or RGBA PNG without interlacing; else ValueError."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only 8-bit RGB and RGBA without interlacing")
    width, height, step = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * step + 1)
    out = np.zeros((height, width, step), np.uint8)
    above = np.zeros((width, step), np.int32)
    for y in range(height):
        line, kind = raw[y, 1:].reshape(width, step).astype(np.int32), raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left = corner = np.zeros(step, np.int32)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        elif kind:
            raise ValueError("unknown row filter")
        out[y] = above = line
    if step == 3:
        out = np.concatenate([out, np.full((height, width, 1), 255, np.uint8)], axis=2)
    return width, height, out.astype(np.uint8).tobytes()


def encode_gif(rgba: bytes, width: int, height: int, delay: int = 10) -> bytes:
    """A GIF of one frame that repeats, with the first 256 colours in reading order; other pixels take the nearest of them."""
    rgb = np.frombuffer(rgba, np.uint8).reshape(-1, 4)[:, :3].astype(np.int32)
    key = rgb @ np.array([65536, 256, 1])
    colors, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(first)
    kept = order[:256]
    place = np.zeros(len(colors), np.int64)
    place[kept] = np.arange(len(kept))
    table = rgb[first[kept]]
    for i in order[256:].tolist():
        place[i] = int(((table - rgb[first[i]]) ** 2).sum(axis=1).argmin())
    full = np.zeros((256, 3), np.uint8)
    full[: len(table)] = table
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + full.tobytes()
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" + b"\x21\xf9\x04\x00" + struct.pack("<H", delay) + b"\x00\x00"
    packed = _packed(place[inverse].tolist())
    blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
    return head + loop + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08" + blocks + b"\x00\x3b"


CLEAR, STOP, CODES = 256, 257, 4096


def _packed(indexes: list[int]) -> bytes:
    """Variable-length codes of byte strings, 9 to 12 bits, lowest bit first."""
    out, held, bits = bytearray(), 0, 0
    known: dict[tuple[int, int], int] = {}
    width, free = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(CLEAR)
    run = None
    for index in indexes:
        if run is None:
            run = index
        elif (longer := known.get((run, index))) is not None:
            run = longer
        else:
            put(run)
            if free < CODES:
                known[run, index] = free
                free += 1
                if free > 1 << width and width < 12:
                    width += 1
            else:
                put(CLEAR)
                known, width, free = {}, 9, 258
            run = index
    if run is not None:
        put(run)
        if free + 1 > 1 << width and width < 12:  # the reader has one string more by now
            width += 1
    put(STOP)
    if bits:
        out.append(held & 255)
    return bytes(out)


def _unpacked(data: bytes, root: int, count: int) -> bytes:
    """The byte string of `count` indexes behind variable-length codes."""
    clear = 1 << root
    strings = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, held, bits, out, size, last = root + 1, 0, 0, [], 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                strings, width, last = strings[: clear + 2], root + 1, None
                continue
            if code == clear + 1 or size >= count:
                return b"".join(out)[:count]
            if code > len(strings) or (last is None and code >= len(strings)):
                raise ValueError("broken GIF codes")
            own = strings[code] if code < len(strings) else last + last[:1]
            if last is not None and len(strings) < CODES:
                strings.append(last + own[:1])
                if len(strings) == 1 << width and width < 12:
                    width += 1
            out.append(own)
            size += len(own)
            last = own
    return b"".join(out)[:count]


def decode_gif(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes) of the first frame, opaque, coloured by the file's table; indexes beyond it are black."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    flags = data[10]
    if not flags & 0x80:
        raise ValueError("GIF without a palette")
    colors = 2 << (flags & 7)
    table = np.zeros((256, 3), np.uint8)
    table[:colors] = np.frombuffer(data[13 : 13 + 3 * colors], np.uint8).reshape(-1, 3)
    at = 13 + 3 * colors
    while data[at] == 0x21:  # extensions
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C:
        raise ValueError("no frame in GIF")
    width, height, frame = struct.unpack("<HHB", data[at + 5 : at + 10])
    at += 10 + (3 * (2 << (frame & 7)) if frame & 0x80 else 0)
    root, at, body = data[at], at + 1, b""
    while data[at]:
        body += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    index = np.zeros(width * height, np.uint8)
    got = np.frombuffer(_unpacked(body, root, width * height), np.uint8)
    index[: len(got)] = got
    if frame & 0x40:  # rows in four passes
        rows = index.reshape(height, width)
        index = np.zeros_like(rows)
        index[[y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]] = rows
        index = index.reshape(-1)
    return width, height, np.concatenate([table[index], np.full((len(index), 1), 255, np.uint8)], axis=1).tobytes()


def decode(name: str, data: bytes) -> tuple[int, int, bytes]:
    """By the file's extension; ValueError where its format has no decoder here."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "png":
        return decode_png(data)
    if kind == "gif":
        return decode_gif(data)
    raise ValueError(f"no decoder for {kind}")


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, width, height, rgba, error) of the image files under a folder or glob, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    known = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*EXTENSIONS)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    width, height, rgba = decode(name, data)
                    rows.append((name, width, height, rgba, None))
                except (ValueError, IndexError, zlib.error, struct.error) as e:
                    rows.append((name, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "width", "height", "rgba", "error"])

    return known.mapInArrow(run, IMAGE)


ENCODERS = {"png": encode_png, "gif": encode_gif}


def encoded(images: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, <kind>) of image rows (image_id, width, height, rgba)."""
    id_kind, encode = images.schema["image_id"].dataType.simpleString(), ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode(d, w, h) for w, h, d in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba")), strict=True)]
            yield pa.record_batch([batch.column("image_id"), pa.array(data, pa.binary())], ["image_id", kind])

    return images.select("image_id", "width", "height", "rgba").mapInArrow(run, f"image_id {id_kind}, {kind} binary")


def decoded(files: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, width, height, rgba) of encoded rows (image_id, <kind>)."""
    id_kind = files.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode(f"x.{kind}", d) for d in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["image_id", "width", "height", "rgba"])

    return files.select("image_id", kind).mapInArrow(run, f"image_id {id_kind}, width int, height int, rgba binary")


def write_images(images: DataFrame, folder: str, kind: str = "png") -> None:
    """One file for each image row, written by the executors into a folder that they share."""

    def run(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{base}/{row.image_id}.{kind}") as out:
                out.write(row[kind])

    encoded(images, kind).foreachPartition(run)


def first_of(images: DataFrame) -> DataFrame:
    """The image with the smallest path or id of a table of images."""
    key = "path" if "path" in images.columns else "image_id"
    return images.agg(F.min_by(F.struct(*images.columns), key).alias("v")).where("v is not null").select("v.*")


def numbered(images: DataFrame, index: int) -> DataFrame:
    """The image at a place in the order of paths or ids, from 0; none beyond the end."""
    key = "path" if "path" in images.columns else "image_id"
    return images.orderBy(key).offset(index).limit(1)


def _colors(pixels: DataFrame) -> DataFrame:
    """(image_id, idx, r, g, b): the different colours of each image, numbered in row-major order."""
    first = pixels.groupBy("image_id", "r", "g", "b").agg(F.min(F.struct("y", "x")).alias("at"))
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("at")) - 1
    return first.select("image_id", idx.alias("idx"), "r", "g", "b")


def palette(pixels: DataFrame, colors: int = 256) -> DataFrame:
    """(image_id, idx, r, g, b): the first different colours of each image in row-major order, 256 at most."""
    return _colors(pixels).where(F.col("idx") < colors)


def indexed(pixels: DataFrame, colors: int = 256) -> DataFrame:
    """(image_id, x, y, idx): the nearest palette colour by squared distance, the first of equals; distances are made once for each colour.

    A colour of the palette is its own nearest; only those beyond it meet the palette, as one array for each image.
    """
    every = _colors(pixels)
    own = every.where(F.col("idx") < colors)
    arrays = own.groupBy("image_id").agg(F.collect_list(F.struct("idx", "r", "g", "b")).alias("own"))
    d = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in "rgb"), F.lit(0))
    nearest = F.array_min(F.transform("own", lambda p: F.struct(d(p).alias("d"), p["idx"].alias("idx"))))["idx"]
    beyond = every.where(F.col("idx") >= colors).join(arrays, "image_id").select("image_id", nearest.alias("idx"), "r", "g", "b")
    return pixels.join(own.unionByName(beyond), ["image_id", "r", "g", "b"]).select("image_id", "x", "y", "idx")


