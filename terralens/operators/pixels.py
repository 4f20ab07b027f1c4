"""Pictures as rows of pixels (width, height, rgb as bytes, row by row): grids, marks, means. Work is by Arrow batches, a few pictures at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 256
GLYPHS = {
    "A": "01110 10001 10001 11111 10001 10001 10001",
    "B": "11110 10001 10001 11110 10001 10001 11110",
    "C": "01111 10000 10000 10000 10000 10000 01111",
    "D": "11110 10001 10001 10001 10001 10001 11110",
}
RED, WHITE, BLACK = (255, 0, 0), (255, 255, 255), (0, 0, 0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels and how many source pixels they reach to each side.
KERNELS = {"cubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def weights(size: int, target: int, kernel: str) -> np.ndarray:
    """What each source pixel counts for each target pixel. Where a picture shrinks, the kernel widens, so that all its area counts."""
    shape, reach = KERNELS[kernel]
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    first = np.maximum((centre - reach * wide + 0.5).astype(int), 0)
    last = np.minimum((centre + reach * wide + 0.5).astype(int), size)
    at = np.arange(size)
    w = shape((at[None] - centre[:, None] + 0.5) / wide) * ((at[None] >= first[:, None]) & (at[None] < last[:, None]))
    return w / w.sum(1, keepdims=True)


def _resized(p: np.ndarray, width: int, height: int, kernel: str = "cubic") -> np.ndarray:
    """Weighted by area, across and then down; each step is rounded to bytes."""
    def along(x: np.ndarray, target: int) -> np.ndarray:
        if x.shape[1] == target:
            return x
        return np.clip(np.floor(np.einsum("ts,ysc->ytc", weights(x.shape[1], target, kernel), x.astype(np.float64), optimize=True) + 0.5), 0, 255).astype(np.uint8)
    return along(along(p, width).swapaxes(0, 1), height).swapaxes(0, 1)


def grid(pictures: list[np.ndarray], cell: int = CELL, labels: list[str] | None = None) -> np.ndarray:
    """Four pictures as two by two cells, row by row. A label (A to D) is white on a black plate in its cell's corner; any other is an empty plate."""
    out = np.zeros((2 * cell, 2 * cell, 3), np.uint8)
    for k, p in enumerate(pictures[:4]):
        y, x = divmod(k, 2)
        out[y * cell : (y + 1) * cell, x * cell : (x + 1) * cell] = _resized(p, cell, cell)
        if labels and k < len(labels) and labels[k]:
            plate = out[y * cell + 6 : y * cell + 26, x * cell + 4 : x * cell + 20]
            plate[:] = BLACK
            if labels[k] in GLYPHS:
                dots = np.kron(np.array([[int(c) for c in row] for row in GLYPHS[labels[k]].split()], bool), np.ones((2, 2), bool))
                letter = plate[3 : 3 + dots.shape[0], 3 : 3 + dots.shape[1]]
                letter[dots[: letter.shape[0], : letter.shape[1]]] = WHITE
    return out


def _disc(p: np.ndarray, cx: int, cy: int, radius: float, colour: tuple[int, int, int]) -> None:
    y, x = np.ogrid[: p.shape[0], : p.shape[1]]
    p[(x - cx) ** 2 + (y - cy) ** 2 <= radius * radius] = colour


def marked(p: np.ndarray, radius: int = 8) -> np.ndarray:
    """A red dot with a white ring at the centre."""
    p = p.copy()
    cx, cy = p.shape[1] // 2, p.shape[0] // 2
    _disc(p, cx, cy, radius + 2, WHITE)
    _disc(p, cx, cy, radius, RED)
    return p


def with_arrow(p: np.ndarray, bearing: float, length: float = 80.0, width: float = 4.0, head: float = 16.0, half: float = 8.0, radius: int = 8) -> np.ndarray:
    """A marked picture with an arrow from its centre in a direction (0 is up, 90 right): points by their distance along and across it."""
    p = marked(p, radius)
    cx, cy = p.shape[1] // 2, p.shape[0] // 2
    a = math.radians(bearing)
    ux, uy = math.sin(a), -math.cos(a)
    y, x = np.ogrid[: p.shape[0], : p.shape[1]]
    along = (x - cx) * ux + (y - cy) * uy
    across = np.abs((y - cy) * ux - (x - cx) * uy)
    shaft = (along >= 0) & (along <= length) & (across <= width / 2)
    tip = (along >= length - head) & (along <= length) & (across <= half * (length - along) / head)
    p[shaft | tip] = RED
    return p


def _mapped(df: DataFrame, make: Callable[[dict], tuple[np.ndarray, ...] | None], columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one picture after the other: a batch may hold thousands
            for r in range(b.num_rows):
                row = {n: b.column(k)[r].as_py() for k, n in enumerate(b.schema.names)}
                p = make(row)
                if p is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([row[columns[0]]], pa.string()), pa.array([p.shape[1]], pa.int32()), pa.array([p.shape[0]], pa.int32()), pa.array([p.tobytes()], pa.binary())], names=["key", "width", "height", "rgb"])
    return df.mapInArrow(run, "key string, width int, height int, rgb binary")


def _picture(row: dict, prefix: str = "") -> np.ndarray:
    return np.frombuffer(row[f"{prefix}rgb"], np.uint8).reshape(row[f"{prefix}height"], row[f"{prefix}width"], 3)


def grids(pictures: DataFrame, cell: int = CELL, labels: tuple[str, ...] | None = None) -> DataFrame:
    """One grid for each key that has all four pictures (key, place 0 to 3, width, height, rgb); others have none. Four pictures meet in a row, never more."""
    four = pictures.where(F.col("place").between(0, 3)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "width", "height", "rgb"))).alias("p")).where(F.size(F.array_distinct(F.transform("p", lambda x: x["place"]))) == 4)
    return _mapped(four.select("key", "p"), lambda r: grid([_picture(x) for x in r["p"]], cell, list(labels) if labels else None), ["key"])


def dots(pictures: DataFrame, radius: int = 8) -> DataFrame:
    return _mapped(pictures.select("key", "width", "height", "rgb"), lambda r: marked(_picture(r), radius), ["key"])


def arrows(pictures: DataFrame) -> DataFrame:
    """pictures: key, width, height, rgb and bearing; without a bearing there is no arrow."""
    return _mapped(pictures.select("key", "width", "height", "rgb", "bearing"), lambda r: None if r["bearing"] is None else with_arrow(_picture(r), r["bearing"]), ["key"])


def resized(pictures: DataFrame, most: int) -> DataFrame:
    """The longer edge scaled down to ``most``; smaller pictures stay."""
    def make(r: dict) -> np.ndarray:
        p = _picture(r)
        k = min(1.0, most / max(p.shape[:2]))
        return p if k == 1.0 else _resized(p, max(1, int(p.shape[1] * k)), max(1, int(p.shape[0] * k)), "lanczos")
    return _mapped(pictures.select("key", "width", "height", "rgb"), make, ["key"])


def channel_means(pictures: DataFrame) -> DataFrame:
    """key and the means of red, green and blue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 3).mean(axis=0) if x.as_buffer().size else np.full(3, np.nan) for x in b.column(1)]
            cols = np.array(means).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, k]) for k in range(3))], names=["key", "r", "g", "b"])
    return pictures.select("key", "rgb").mapInArrow(run, "key string, r double, g double, b double")
