"""Quality rules: base counts, and a calibrated model of labelled quality.

The model is a logistic regression on hashed word and character n-grams, calibrated on labelled rows
that it was not fitted to, scored in Arrow batches against the fixed threshold ``KEEP_AT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import linear
from terralens.llm import textkernel as K

KINDS = ("w1", "w2", "c3", "c4")
#: Most labelled rows that a model is fitted to.
SAMPLE = 2000
#: A document is kept if it is of good quality with this probability at least.
KEEP_AT = 0.35
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = linear.scores(data, off, self.weights, np.array([self.bias]), KINDS)[:, 0]
        return linear.sigmoid(self.slope * z + self.shift)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """labels: doc_id, quality (1 good, 0 bad; null rows don't count). Without both classes everything is kept."""
    got = linear.fitted(docs, labels, "quality", bound, KINDS, _fit, "weights binary, bias double, slope double, shift double")
    if got is None or got.weights is None:
        return Model(np.zeros((len(KINDS) << linear.BITS, 1), np.float32), 0.0, 1.0, 0.0 if got is None else got.shift)
    return Model(np.frombuffer(bytes(got.weights), np.float32)[:, None], got.bias, got.slope, got.shift)


def _fit(y: np.ndarray, x: linear.Sparse) -> dict:
    y = y.astype(float)
    if y.min() == y.max():
        return {"weights": None, "bias": 0.0, "slope": 1.0, "shift": 0.0 if y.min() == 1 else -5.0}
    fold = np.arange(len(y)) % 4 == 3
    w, b = linear.fit(x.take(np.flatnonzero(~fold)), y[~fold], loss="logistic")
    slope, shift = linear.calibrate(x.take(np.flatnonzero(fold)).dot(w) + b, y[fold])
    return {"weights": w.astype(np.float32).tobytes(), "bias": float(b), "slope": float(slope), "shift": float(shift)}


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    n = len(off) - 1
    starts, ends, at = K.words(data, off, K.SPACED)
    prefix = K.prefix_hash(data)
    h = K.span_hash(prefix, starts, ends)
    out = {"n_words": np.diff(at)}
    out["word_chars"] = K.segment_sum(K.SPACED[data] & K.char_starts(data), off)
    out["n_symbols"] = K.segment_sum(SYMBOLS[data], off)
    # lines with a word, in order; a line equals an earlier one of its document
    is_line = np.ones(256, bool)
    is_line[10] = False
    ls, le, lat = K.words(data, off, is_line)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    doc = np.repeat(np.arange(n), np.diff(lat))[has_word]
    lh = K.span_hash(prefix, ls, le)[has_word] ^ K.mix((le - ls)[has_word].astype(np.uint64))
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - _distinct(doc, lh, n)
    # words in 3-word windows that the document holds twice or more
    if len(h) >= 3:
        step = np.uint64(0xD6E8FEB86659FD93)
        g = K.mix((h[:-2] * step + h[1:-1]) * step + h[2:])
        wdoc = np.repeat(np.arange(n), np.diff(at))
        ok = wdoc[:-2] == wdoc[2:]
        pos = np.flatnonzero(ok)
        key = K.mix(g[pos] + wdoc[pos].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(pos), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, pos[twice], 1)
        np.add.at(edge, pos[twice] + 3, -1)
        out["n_repeat_words"] = K.segment_sum(np.cumsum(edge[:-1]) > 0, at)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def assess(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document with its counts, calibrated quality and verdict.

    Null, empty and blank texts have no words and fail the base rules. Rows are independent; repeated ids
    stay repeated and extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                c = base_counts(data, off)
                p = model.probability(data, off)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                     pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))],
                    names=[x.split()[0] for x in SCHEMA.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; judged in the pass that reads them, without a join."""
    at = docs.columns.index("text")
    # the rows pass by position: a column's name may hold dots
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for _, _, data, off in K.text_slices(b.column(at)):
                c = base_counts(data, off)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                keep.append(~failed & (model.probability(data, off) >= keep_at))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
