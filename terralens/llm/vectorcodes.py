"""Compression of vectors to a code of one small codebook index a part, in whole numbers, with equal-average search.

A part's distance to a codebook entry is at least its squared gap of component sums over the dimension. So the entries are sorted by
their sums, and a search starts at the part's own sum and goes outwards until that bound is above the best distance found.
Codebooks are few numbers, and each round of fitting is one pass that brings only sums by entry together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.scratch import save

SCALE = 4096
#: Whole components are held between plus and minus this, so that squared distances fit 64 bits; less for parts of more than 16 components.
LIMIT = 1 << 26


@dataclass
class Codebooks:
    """entries[p] has a row for each entry of part p."""

    dim: int
    entries: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for row in part for x in row).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for; a component lies in the middle of its step."""
        return [(int(x) + 0.5) / SCALE for p, part in enumerate(self.entries) for x in part[int(code[2 * p : 2 * p + 2], 16)]]


def bounds(dim: int, parts: int) -> list[int]:
    """Part p of a vector goes from the p-th bound to the next; equal parts if their number divides the dimension."""
    return [dim * p // parts for p in range(parts + 1)]


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the vectors that are not null and have only finite components, the lengths of these, and all components (nulls as NaN)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
    return np.flatnonzero(good), size, values


def whole(values: np.ndarray, widest: int) -> np.ndarray:
    """Whole components of vectors whose widest part has so many."""
    limit = min(LIMIT, (1 << 30) // max(widest, 1))
    return np.clip(np.floor(values * SCALE), -limit, limit).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry (the lower on ties) and the squared distance, for each row of x."""
    n, w = x.shape
    best, at = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    if not w:
        return at, np.zeros(n, np.int64)
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    mine = x.sum(1)
    high = np.searchsorted(ranked, mine)
    low = high - 1
    far = np.iinfo(np.int64).max
    rows = np.arange(n)
    for step in range(len(order)):
        lo, hi, s = low[rows], high[rows], mine[rows]
        down = np.where(lo >= 0, s - ranked[np.maximum(lo, 0)], far)
        up = np.where(hi < len(order), ranked[np.minimum(hi, len(order) - 1)] - s, far)
        gap = np.minimum(down, up)
        if step:
            go = gap * gap <= best[rows] * w  # the bound may equal the best distance: a lower index may tie
            rows, lo, hi, down, up = rows[go], lo[go], hi[go], down[go], up[go]
            if not len(rows):
                break
        below = down <= up
        entry = order[np.where(below, lo, hi)]
        low[rows[below]] -= 1
        high[rows[~below]] += 1
        d = ((x[rows] - entries[entry]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], entry[better]
    return at, best


def _matrix(column: pa.Array, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors of the dimension, and their whole components."""
    rows, size, values = usable(column)
    rows = rows[size[rows] == dim]
    start = np.cumsum(size) - size
    return rows, whole(values[start[rows][:, None] + np.arange(dim)], -(-dim // parts))


def _totals(books: Codebooks):
    """Count (place -1) and component sums of the parts nearest to each entry, once a task."""
    cut = bounds(books.dim, len(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros_like(e) for e in books.entries]
        for b in batches:
            _, x = _matrix(b.column(0), books.dim, len(books.entries))
            for p, entries in enumerate(books.entries):
                part = x[:, cut[p] : cut[p + 1]]
                at, _ = nearest(part, entries)
                count[p] += np.bincount(at, minlength=len(entries))
                np.add.at(total[p], at, part)
        out = [(p, e, j, int(v)) for p in range(len(count)) for e in np.flatnonzero(count[p]) for j, v in [(-1, count[p][e]), *enumerate(total[p][e])]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "place", "v"])
    return run


def fit(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks that start as the vectors of smallest vec_id; None if there is no vector.

    The dimension is that of the smallest vec_id with a usable vector (null ids come last; among equal ids the smaller vector is first). Fewer vectors
    than ``entries`` give fewer entries. An entry that no part is nearest to stays as it is.
    """
    ok = vectors.where("embedding is not null").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    first = ok.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    head = first.limit(1).collect()
    if not head:
        return None
    dim = len(head[0].embedding)
    seeds = np.array([r.embedding for r in first.where(F.size("embedding") == dim).limit(entries).collect()], np.float64).reshape(-1, dim)
    cut = bounds(dim, parts)
    start = whole(seeds, -(-dim // parts))
    books = Codebooks(dim, [start[:, cut[p] : cut[p + 1]].copy() for p in range(parts)])
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(_totals(books), "part int, entry int, place int, v long").groupBy("part", "entry", "place").agg(F.sum("v").alias("v"))
        got = {(r.part, r.entry, r.place): r.v for r in sums.collect()}
        for (p, e, place), v in got.items():
            if place >= 0:
                books.entries[p][e, place] = v // got[p, e, -1]
    return books


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code, error of each usable vector. One of another dimension than the codebooks' has neither code nor error."""
    cut = bounds(books.dim, len(books.entries)) if books else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, _, _ = usable(b.column(2))
            rows, x = _matrix(b.column(2), books.dim, len(books.entries))
            found = [nearest(x[:, cut[p] : cut[p + 1]], e) for p, e in enumerate(books.entries)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            place = {int(r): k for k, r in enumerate(rows)}
            at = [place.get(int(r)) for r in kept]
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([None if k is None else codes[k].tobytes().hex() for k in at], pa.string()), pa.array([None if k is None else int(error[k]) for k in at], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    fields = vectors.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).schema
    rows = vectors.select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, fields) if books else vectors.sparkSession.createDataFrame([], fields)


def compress(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256.

    vectors has vec_id, embedding and label; other columns are ignored. Vectors that are null, or hold null or non-finite components, are dropped. The others
    come back once a row, repeated or null ids too; an empty table gives an empty one. A vector of another dimension than that of the smallest
    vec_id has a null code and error. Components beyond +-2^14 (less in parts of over 16
    components) count as that bound. Parts that the dimension doesn't divide into evenly differ by one.
    """
    books = fit(vectors, **options)
    coded = save(encode(vectors, books), "codes")
    by_label = coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")).withColumnRenamed("label", "_label")
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error")
            .withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string")))
