"""PNG files as rows of pixels and back. Each picture is inflated row by row and decoded by itself, in Arrow batches; files that aren't PNG or are damaged give no row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type (grey, rgb, palette, grey and alpha, rgb and alpha), and the passes of interlaced pictures (first x, first y, steps).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Pixels of a picture at most; a header may claim any size.
LARGEST = 1 << 28
_SCHEMA = "key string, width int, height int, rgb binary"


class Damaged(ValueError):
    """Not a whole PNG file."""


def chunks(data: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(kind, body) of a file's chunks, checksums confirmed, up to its end chunk."""
    if not data.startswith(SIGNATURE):
        raise Damaged("signature")
    view, at = memoryview(data), len(SIGNATURE)
    while at + 12 <= len(data):
        size = struct.unpack(">I", view[at : at + 4])[0]
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack(">I", view[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise Damaged("chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Damaged("end")


def unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from its filtered ones. ``step``: bytes a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.add.accumulate(np.pad(line, (0, -len(line) % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Damaged("filter")
    out, up, now = bytearray(step) + line.tobytes(), bytes(step) + above.tobytes(), 0
    for k in range(step, len(out)):
        a, b = out[k - step], up[k]
        if kind == 3:
            now = (a + b) >> 1
        else:
            c = up[k - step]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            now = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[k] = (out[k] + now) & 255
    return np.frombuffer(bytes(out[step:]), np.uint8)


def _samples(line: np.ndarray, depth: int, n: int) -> np.ndarray:
    """n samples of a row: 16 bits keep their high byte, fewer than 8 aren't scaled yet."""
    if depth == 8:
        return line[:n]
    if depth == 16:
        return line[: 2 * n : 2]
    bits = np.unpackbits(line).reshape(-1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:n]


def decode(data: bytes) -> np.ndarray:
    """A PNG file's pixels as height x width x 3 bytes; alpha is dropped."""
    head = palette = None
    body = zlib.decompressobj()
    packed: list[memoryview] = []
    for kind, x in chunks(data):
        if kind == b"IHDR" and len(x) == 13:
            head = struct.unpack(">IIBBBBB", x)
        elif kind == b"PLTE":
            palette = np.frombuffer(x, np.uint8)
        elif kind == b"IDAT":
            packed.append(x)
    if head is None:
        raise Damaged("header")
    width, height, depth, colour, method, filters, interlaced = head
    if not width or not height or width * height > LARGEST or depth not in DEPTHS.get(colour, ()) or method or filters or interlaced > 1 or (colour == 3 and (palette is None or len(palette) % 3)):
        raise Damaged("header")
    pixel = SAMPLES[colour]
    step = max(1, pixel * depth // 8)
    out = np.zeros((height, width, pixel), np.uint8)
    held, source = bytearray(), iter(packed)

    def take(n: int) -> bytes:
        while len(held) < n:
            if body.unconsumed_tail:
                held.extend(body.decompress(body.unconsumed_tail, 1 << 16))
                continue
            piece = next(source, None)
            if piece is None:
                held.extend(body.flush())
                if len(held) < n:
                    raise Damaged("data")
                break
            held.extend(body.decompress(piece, 1 << 16))
        got = bytes(held[:n])
        del held[:n]
        return got

    try:
        for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w <= 0 or h <= 0:
                continue
            size = -(-w * pixel * depth // 8)
            above = np.zeros(size, np.uint8)
            for y in range(h):
                line = take(size + 1)
                above = unfilter(line[0], np.frombuffer(line, np.uint8)[1:], above, step)
                out[y0 + y * dy, x0::dx] = _samples(above, depth, w * pixel).reshape(w, pixel)
    except zlib.error as e:
        raise Damaged("data") from e
    if colour == 3:
        table = palette.reshape(-1, 3)
        if int(out.max()) >= len(table):
            raise Damaged("palette")
        return table[out[..., 0]]
    if colour in (0, 4):
        grey = out[..., :1] * np.uint8(255 // ((1 << min(depth, 8)) - 1))
        return np.repeat(grey, 3, axis=2)
    return np.ascontiguousarray(out[..., :3])


def encode(p: np.ndarray) -> bytes:
    """A PNG file of rgb pixels; each row is stored as its differences from the row above."""
    rows = p.reshape(p.shape[0], -1)
    lines = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    lines[:, 0] = 2
    lines[:, 1:] = rows - np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(x, zlib.crc32(kind)))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", p.shape[1], p.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decoded(files: DataFrame) -> DataFrame:
    """(key, width, height, rgb) of (key, content); what isn't a whole PNG file has no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    p = decode(content.as_py() or b"")
                except Damaged:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([p.shape[1]], pa.int32()), pa.array([p.shape[0]], pa.int32()), pa.array([p.tobytes()], pa.binary())], names=["key", "width", "height", "rgb"])
    return files.select("key", "content").mapInArrow(run, _SCHEMA)


def encoded(pictures: DataFrame) -> DataFrame:
    """(key, content) of (key, width, height, rgb)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, w, h, rgb in zip(*b.columns, strict=True):
                p = np.frombuffer(rgb.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([encode(p)], pa.binary())], names=["key", "content"])
    return pictures.select("key", "width", "height", "rgb").where("width > 0 and height > 0").mapInArrow(run, "key string, content binary")


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """The PNG files below a folder, keyed by file name without its ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder)
    return decoded(files.select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("key"), "content"))
