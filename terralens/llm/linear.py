"""Linear models over hashed word and character n-grams.

A document's feature is the share of each hashed n-gram among the document's n-grams of that kind, in
percent. A linear score is then a mean of bucket weights, so that scoring needs no counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import textkernel as K

U64 = np.uint64
#: Buckets of each kind.
BITS = 16
SCALE = 100.0
#: Most bytes of text that a linear model is fitted to; their features take some ten times as much on the driver.
SAMPLE_BYTES = 8 << 20


def ngram_buckets(data: np.ndarray, off: np.ndarray, kinds: tuple[str, ...], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: bucket of each n-gram, and the ranges [first, end) of each document's.

    Kinds: w1, w2 (words) and c2 to c5 (characters within a document).
    """
    if lower:
        data = K.LOWER[data]
    h = at = chars = edge = None
    for k, kind in enumerate(kinds):
        n, base = int(kind[1]), k << BITS
        if kind[0] == "w":
            if h is None:
                h, at = K.word_hashes(data, off, K.SPACED)
            g = h if n == 1 else K.mix(h[:-1] * U64(31) + h[1:]) if len(h) > 1 else h[:0]
            ends = np.maximum(at[1:] - (n - 1), at[:-1])
        else:
            if chars is None:
                point = K.code_points(data)
                chars = K.BYTE_CODE.astype(np.uint32)[point & np.uint32(255)] + (point >> np.uint32(8)) * np.uint32(0x85EBCA6B)
                edge = np.concatenate([[0], np.cumsum(K.char_starts(data))])[off]
            m = max(0, len(chars) - n + 1)
            g = np.zeros(m, np.uint32)
            for x in range(n):
                g *= np.uint32(0x01000193)
                g += chars[x : m + x]
            g *= np.uint32(0x9E3779B1)
            yield (g >> np.uint32(32 - BITS)).astype(np.int64) + base, edge[:-1], np.maximum(edge[1:] - (n - 1), edge[:-1])
            continue
        yield (g >> U64(64 - BITS)).astype(np.int64) + base, at[:-1], ends


def range_means(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Means of values[first:end] by rows; 0 for an empty range."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    end = np.minimum(end, len(values))
    n = np.maximum(end - first, 0)
    first = np.minimum(first, end)
    return np.where(n[:, None] > 0, (total[end] - total[first]) / np.maximum(n, 1)[:, None], 0.0)


def scores(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: np.ndarray, kinds: tuple[str, ...], lower: bool = False) -> np.ndarray:
    """Linear scores (documents x columns). weights: (kinds * buckets) x columns."""
    out = np.tile(bias, (len(off) - 1, 1)).astype(float)
    for bucket, first, end in ngram_buckets(data, off, kinds, lower):
        out += SCALE * range_means(weights[bucket], first, end)
    return out


def sparse_rows(kinds: tuple[str, ...], lower: bool = False):
    """Arrow function: (text, other columns) to (columns, buckets, values) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(0)):
                idx: list[list[np.ndarray]] = [[] for _ in range(j - i)]
                val: list[list[np.ndarray]] = [[] for _ in range(j - i)]
                for bucket, first, end in ngram_buckets(data, off, kinds, lower):
                    for q in range(j - i):
                        if end[q] > first[q] and (u := bucket[first[q] : end[q]]).size:
                            u, c = np.unique(u, return_counts=True)
                            idx[q].append(u.astype(np.int32))
                            val[q].append((SCALE * c / c.sum()).astype(np.float32))
                cat = lambda x, t: np.concatenate(x).astype(t).tobytes() if x else b""
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), pa.array([cat(x, np.int32) for x in idx], pa.binary()), pa.array([cat(x, np.float32) for x in val], pa.binary())],
                    names=[*b.schema.names[1:], "idx", "val"])
    return run


class Sparse:
    """Rows of (bucket, value) lists, with products in both directions, a block of entries at a time."""

    BLOCK = 1 << 20

    def __init__(self, idx: np.ndarray, val: np.ndarray, row: np.ndarray, n: int, width: int):
        self.idx, self.val, self.row, self.n, self.width = idx, val, row, n, width

    @classmethod
    def of(cls, idx: pa.Array, val: pa.Array, width: int) -> Sparse:
        data, off = K.buffers(idx)
        row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off) // 4)
        return cls(data.view(np.int32) if data.flags.aligned else data.copy().view(np.int32), K.buffers(val)[0].copy().view(np.float32), row, len(off) - 1, width)

    def take(self, rows: np.ndarray) -> Sparse:
        new = np.full(self.n, -1, np.int32)
        new[rows] = np.arange(len(rows), dtype=np.int32)
        keep = new[self.row] >= 0
        return Sparse(self.idx[keep], self.val[keep], new[self.row[keep]], len(rows), self.width)

    def _blocks(self):
        for k in range(0, len(self.idx), self.BLOCK):
            part = slice(k, k + self.BLOCK)
            yield self.idx[part], self.val[part], self.row[part]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for idx, val, row in self._blocks():
            out += np.bincount(row, weights=val * w[idx], minlength=self.n)
        return out

    def tdot(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for idx, val, row in self._blocks():
            out += np.bincount(idx, weights=val * g[row], minlength=self.width)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: Sparse, y: np.ndarray, *, loss: str, steps: int = 60, rate: float = 0.3, l2: float = 1e-4, balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias for labels 0 and 1, by full-gradient Adagrad steps. loss: logistic, or hinge (a linear support vector machine)."""
    w, b = np.zeros(x.width), 0.0
    if not x.n:
        return w, b
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if balance else np.ones(x.n)
    sign = 2.0 * y - 1
    gw, gb = np.full(x.width, 1e-8), 1e-8
    for _ in range(steps):
        z = x.dot(w) + b
        g = (sigmoid(z) - y if loss == "logistic" else np.where(sign * z < 1, -sign, 0.0)) * weight / x.n
        d, db = x.tdot(g) + l2 * w, g.sum()
        gw += d * d
        gb += db * db
        w -= rate * d / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
    return w, float(b)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (positive) and intercept (Platt scaling) that turn scores into probabilities."""
    slopes, shift = calibrate_columns(z[:, None], y, steps)
    return float(slopes[0]), shift


def calibrate_columns(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """The same from several columns of scores: a slope for each (that of the first is positive) and the intercept.

    Newton steps on smoothed targets and standardised scores; a step is halved until the loss falls.
    """
    first = np.zeros(z.shape[1])
    first[0] = 1.0
    if not len(z) or y.min() == y.max():
        return first, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = np.maximum(np.std(z, axis=0), 1e-9)
    s = np.concatenate([z / unit, np.ones((len(z), 1))], axis=1)
    ridge = 2e-3 * np.eye(s.shape[1])

    def loss(a: np.ndarray) -> float:
        m = s @ a
        return float(np.sum(np.logaddexp(0, m) - t * m)) + 1e-3 * float(a @ a)
    a = np.append(first, 0.0)
    for _ in range(steps):
        p = sigmoid(s @ a)
        v = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((s * v[:, None]).T @ s + ridge, s.T @ (p - t) + ridge @ a)
        now, k = loss(a), 1.0
        while k > 1e-6 and loss(a - k * step) > now:
            k /= 2
        a = a - k * step
        if np.abs(k * step).max() < 1e-6:
            break
    a[0] = max(a[0], 1e-3)
    return a[:-1] / unit, float(a[-1])


def sampled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, bound_bytes: int, kernel, columns: str) -> DataFrame:
    """doc_id, label, h (hash of the text) and the kernel's columns of a sample of the labelled documents, at most ``bound`` rows and ``bound_bytes`` bytes of text.

    Of several labels of one id the largest counts. Each different text of a labelled id is a row of its own; equal ones are one row. Rows come in the
    order of their ids' hashes; a text that would exceed the bytes is passed over. Ids and sizes are ranked, never texts: the chosen ids and rows
    (both bounded) are broadcast, and the kernel runs on the executors for the chosen rows alone.
    """
    chosen = (labels.where(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg(F.max(label).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = docs.select("text", "doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    sizes = (rows.groupBy("doc_id", "h").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(bound).toArrow())
    total = np.cumsum(sizes.column("size").to_numpy())
    keep = total <= bound_bytes
    if not keep.all():
        # one by one, as a passed-over text leaves room for others
        room, keep = bound_bytes, []
        for n in sizes.column("size").to_pylist():
            keep.append(n <= room)
            room -= n if n <= room else 0
    kept = sizes.filter(pa.array(keep, pa.bool_()))
    keys = docs.sparkSession.createDataFrame(list(zip(kept.column("doc_id").to_pylist(), kept.column("h").to_pylist(), strict=True)), "doc_id long, h long")
    kind = dict(chosen.dtypes)["label"]
    names = [x.split()[0] for x in columns.split(", ")]
    return (rows.join(F.broadcast(keys), ["doc_id", "h"]).select("text", "doc_id", "label", "h").mapInArrow(kernel, f"doc_id long, label {kind}, h long, {columns}")
            .groupBy("doc_id", "label", "h").agg(*(F.first(c).alias(c) for c in names)))


def _by_id(made: pa.Table) -> pa.Table:
    return made.take(np.lexsort((made.column("h").to_numpy(), made.column("doc_id").to_numpy()))).combine_chunks()


def sampled(docs: DataFrame, labels: DataFrame, label: str, bound: int, bound_bytes: int, kernel, columns: str) -> pa.Table:
    """``sampled_rows`` on the driver, in the order of ids."""
    return _by_id(sampled_rows(docs, labels, label, bound, bound_bytes, kernel, columns).toArrow())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, kinds: tuple[str, ...], lower: bool = False, bound_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, Sparse]:
    """Ids, labels and features of a sample of labelled documents; see ``sampled``."""
    rows = sampled(docs, labels, label, bound, bound_bytes, sparse_rows(kinds, lower), "idx binary, val binary")
    ids, y = rows.column("doc_id").to_numpy(), np.array(rows.column("label").to_pylist())
    return ids, y, Sparse.of(rows.column("idx"), rows.column("val"), len(kinds) << BITS)


def fitted(docs: DataFrame, labels: DataFrame, label: str, bound: int, kinds: tuple[str, ...], fit_rows, schema: str, bound_bytes: int = SAMPLE_BYTES):
    """The row that ``fit_rows`` makes of the labels and features of such a sample; None if nothing is labelled.

    The bounded sample is fitted in one task, so that its features, some ten times its text, never reach the driver. fit_rows: (labels, features) to a dict of ``schema``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(b.num_rows for b in got):
            rows = _by_id(pa.Table.from_batches(got))
            del got
            y, x = np.array(rows.column("label").to_pylist()), Sparse.of(rows.column("idx"), rows.column("val"), len(kinds) << BITS)
            del rows
            yield pa.RecordBatch.from_pylist([fit_rows(y, x)])
    return sampled_rows(docs, labels, label, bound, bound_bytes, sparse_rows(kinds), "idx binary, val binary").repartition(1).mapInArrow(run, schema).first()
