"""Language identification in two levels.

First a linear classifier chooses the language family; then one-versus-one linear support vector
machines separate the languages of that family, and the language with most votes wins (then the larger
sum of margins, then the name). All are scored in one pass over hashed n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.llm import linear
from terralens.llm import textkernel as K

KINDS = ("w1", "c2", "c3", "c4")
#: Most training rows.
SAMPLE = 2000
#: Families of language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he"),
    "indic": ("hi", "ur", "bn", "mr", "ne"),
}
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids, which no model learns from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False)).alias("held_out")


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, first and second member
    weights: np.ndarray  # a column for each family (if more than one), then for each pair
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, nf = len(off) - 1, len(self.families) if len(self.families) > 1 else 0
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        z = linear.scores(data, off, self.weights, self.bias, KINDS, lower=True)
        p = linear.sigmoid(self.slope * z + self.shift)
        chosen = z[:, :nf].argmax(axis=1) if nf else np.zeros(n, int)
        sure = p[np.arange(n), chosen] / np.maximum(p[:, :nf].sum(axis=1), 1e-12) if nf else np.ones(n)
        lang, score = np.empty(n, object), np.zeros(n)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            votes, margin, belief = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    zk, pk = z[rows, nf + k], p[rows, nf + k]
                    votes[:, a] += zk > 0
                    votes[:, b] += zk <= 0
                    margin[:, a] += np.tanh(zk)
                    margin[:, b] -= np.tanh(zk)
                    belief[:, a] += pk
                    belief[:, b] += 1 - pk
            best = (votes * 4 * len(members) + margin).argmax(axis=1)
            lang[rows] = np.array(members, object)[best]
            share = belief[np.arange(len(rows)), best] / max(1, len(members) - 1) if len(members) > 1 else np.ones(len(rows))
            score[rows] = sure[rows] * share
        return list(lang), np.clip(score, 0, 1)


def train(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """docs: doc_id, text, lang. Learns from rows with a lang whose crc32 of the id (as text) is no multiple of 5."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    _, y, x = linear.labelled_sample(docs, usable.select("doc_id", "lang"), "lang", bound, KINDS, lower=True)
    langs = sorted(set(y.tolist()))
    families = sorted({family_of(v) for v in langs})
    members = [[v for v in langs if family_of(v) == f] for f in families]
    fam = np.array([families.index(family_of(v)) for v in y.tolist()]) if len(y) else np.zeros(0, int)
    fold = np.arange(len(y)) % 5 == 4
    columns, pairs = [], []

    def column(rows: np.ndarray, target: np.ndarray, loss: str) -> None:
        fit_rows, held = rows[~fold[rows]], rows[fold[rows]]
        w, b = linear.fit(x.take(fit_rows), target[~fold[rows]], loss=loss, steps=40)
        slope, shift = linear.calibrate(x.take(held).dot(w) + b, target[fold[rows]])
        columns.append((w.astype(np.float32), b, abs(slope), shift))
    if len(families) > 1:
        for f in range(len(families)):
            column(np.arange(len(y)), (fam == f).astype(float), "logistic")
    for f, own in enumerate(members):
        for a, b in combinations(range(len(own)), 2):
            rows = np.flatnonzero((y == own[a]) | (y == own[b]))
            column(rows, (y[rows] == own[a]).astype(float), "hinge")
            pairs.append((f, a, b))
    width = len(KINDS) << linear.BITS
    weights = np.stack([c[0] for c in columns], axis=1) if columns else np.zeros((width, 1), np.float32)
    rest = [np.array([c[k] for c in columns] or [0.0]) for k in (1, 2, 3)]
    return Model(families, members, pairs, weights, *rest)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    out = K.segment_sum(ascii_letter[data], off) > 0
    for q in np.flatnonzero(~out):
        text = data[off[q] : off[q + 1]].tobytes().decode("utf-8", "replace")
        out[q] = any(c.isalpha() for c in text)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score. A text that is null or has no letter is ``und`` with score 0.

    Without training rows every text is ``und``. A text of any length is scored whole, by the means over its n-grams. Rows are independent; null and
    repeated ids stay as they are, and extra columns (lang too) are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                lang, score = model.predict(data, off)
                there = has_letter(data, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([v if t else UNDETERMINED for v, t in zip(lang, there, strict=True)], pa.string()), pa.array(np.where(there, score, 0.0))],
                    names=["doc_id", "held_out", "lang_pred", "score"])
    return docs.select("doc_id", "text", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
