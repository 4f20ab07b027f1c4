"""Toxic spans by a linear-chain conditional random field.

Two states (clean, toxic) over the words of a document. Emissions are weights of the hashed word, of its first ``STEM`` bytes, and
of the words before and after it, trained with the transitions by maximum likelihood; gradients come from forward-backward marginals. Marginals
of a document give its offending offsets. Its score comes from the sum of their squares, so that many weak ones don't outweigh
a clear one (faint ones don't count at all), and from its number of words, as one faint word says less about a long text.

Documents carry one label, not token labels. The training tokens are therefore labelled first: in a toxic
document, the words or stems that are significantly tied to toxic documents (likelihood ratio, near copies counted
once) are toxic tokens; all others, and all tokens of clean documents, are clean.

The calibration of scores, and the floor below which evidence doesn't count, are chosen by ``FOLDS`` folds of the training rows: each fold is judged by
a field trained on the others, near copies staying together. Held-out rows take no part.
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
from terralens.llm.langid import held_out

U64 = np.uint64
BITS = 18
#: Most labelled rows that are learnt from, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6000, 24 << 20
#: The field is fitted to all toxic rows of the sample and to so many clean ones a toxic one, and some more, by id; the word list and the calibration use all rows.
CLEAN_A_TOXIC, CLEAN_MORE = 2, 50
FOLDS = 3
#: Least likelihood ratio of a toxic word, and least lift of its share of documents.
LEAST_RATIO, LEAST_LIFT = 24.0, 20.0
STEM, STEM_RATIO, STEM_LIFT = 6, 48.0, 5.0
#: Training sequences are cut to this many tokens.
CHUNK = 64
#: Sums of squared marginals that may be the least that counts.
FLOORS = (0.03, 0.1, 0.3, 1.0)
#: Value of each feature of a word; that of its neighbours was chosen by folds of training rows.
VALUES = np.array([1.0, 1.0, 0.3, 0.3])
#: Smaller marginals don't count, so that no length of a text adds up to evidence; chosen by folds of training rows.
FAINT = 0.3
_EDGE = U64(0x5DEECE66D1234567)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def word_and_stem(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of words and of stems, word starts and ends, first word of each document."""
    data = K.LOWER[data]
    starts, ends, at = K.words(data, off, K.ALNUM)
    prefix = K.prefix_hash(data)
    stem = K.mix(K.span_hash(prefix, starts, np.minimum(starts + STEM, ends)) + U64(1))
    return K.span_hash(prefix, starts, ends), stem, starts, ends, at


def features(h: np.ndarray, stem: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets (4 x tokens) of each word, its stem, and the words before and after it in its document."""
    before, after = np.full(len(h), _EDGE), np.full(len(h), _EDGE)
    before[1:], after[:-1] = h[:-1], h[1:]
    some = np.diff(at) > 0
    before[at[:-1][some]] = after[at[1:][some] - 1] = _EDGE
    return np.stack([bucket_of(x) for x in (h, stem, K.mix(before + U64(2)), K.mix(after + U64(3)))])


def emitted(weights: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return sum(v * weights[row] for v, row in zip(VALUES.tolist(), bucket, strict=True))


@dataclass
class Model:
    emission: np.ndarray  # toxic minus clean, of each bucket; a token adds four, times VALUES
    start: float
    move: np.ndarray  # 2 x 2 log transition weights
    slope: float = 1.0
    length: float = 0.0  # weight of log(1 + words)
    shift: float = 0.0
    floor: float = FLOORS[0]

    def tagged(self, h: np.ndarray, stem: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(toxic) of each word."""
        return marginals(emitted(self.emission, features(h, stem, at)).astype(float), at, self.start, self.move)


def squares(p: np.ndarray) -> np.ndarray:
    """Squared marginals, running sums from 0."""
    return np.concatenate([[0.0], np.cumsum(np.where(p < FAINT, 0.0, p * p))])


def evidence(total: np.ndarray, at: np.ndarray, floor: float) -> np.ndarray:
    """What a document's score is made of: log of the sum of its squared marginals, log of its number of words."""
    return np.stack([np.log(np.maximum(total, 0) + floor), np.log1p(np.diff(at))], axis=1)


def marginals(e: np.ndarray, at: np.ndarray, start: float, move: np.ndarray, pairs: bool = False):
    """P(toxic) of each token of the sequences e[at[i]:at[i+1]]; with ``pairs`` also expected transition counts.

    With two states the forward and backward vectors need only their ratios, one number a token. Sequences
    advance together, longest first.
    """
    m = np.exp(move)
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, length = at[:-1][order], n[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    x = np.exp(np.clip(e, -60, 60))
    f = np.empty(len(e))
    b = np.ones(len(e))
    r = None
    for t in range(steps):
        k = active[t]
        i = first[:k] + t
        r = x[i] * np.exp(start) if t == 0 else x[i] * (m[0, 1] + m[1, 1] * r[:k]) / (m[0, 0] + m[1, 0] * r[:k])
        f[i] = r
    # backward: ends join as the step falls below their length
    back = np.ones(len(length))
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        i = first[:k] + t
        g = x[i + 1] * back[:k]
        back[:k] = (m[1, 0] + m[1, 1] * g) / (m[0, 0] + m[0, 1] * g)
        b[i] = back[:k]
    odds = f * b
    p = odds / (1 + odds)
    if not pairs:
        return p
    last = np.zeros(len(e), bool)
    last[(at[1:] - 1)[n > 0]] = True
    i = np.flatnonzero(~last)
    nxt = x[i + 1] * b[i + 1]
    w = np.stack([np.full(len(i), m[0, 0]), m[0, 1] * nxt, f[i] * m[1, 0], f[i] * m[1, 1] * nxt], axis=1)
    return p, (w / w.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, other columns) to (other columns, word hashes, stem hashes)."""
    for b in batches:
        for i, j, data, off in K.text_slices(b.column(0)):
            h, stem, _, _, at = word_and_stem(data, off)
            each = [pa.array([x[at[q] : at[q + 1]].tobytes() for q in range(j - i)], pa.binary()) for x in (h, stem)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(1, b.num_columns)), *each], names=[*b.schema.names[1:], "words", "stems"])


def copy_keys(words: list[np.ndarray]) -> list[int]:
    """The smallest hash of three words in a row: near copies mostly share it."""
    return [int(K.mix(w[:-2] * U64(3) + w[1:-1] * U64(5) + w[2:] * U64(7)).min()) if len(w) >= 3 else int(K.mix(w).sum()) if len(w) else 0 for w in words]


def toxic_words(words: list[np.ndarray], y: np.ndarray, groups: list[int], least_ratio: float = LEAST_RATIO, least_lift: float = LEAST_LIFT) -> np.ndarray:
    """Hashes of words (or stems) that are tied to toxic documents. Documents of one group and label count once."""
    rows = list({(g, int(y[k])): k for k, g in reversed(list(enumerate(groups)))}.values())
    n1, n0 = sum(y[k] == 1 for k in rows), sum(y[k] == 0 for k in rows)
    if not n1 or not n0:
        return np.zeros(0, U64)
    uniq = [np.unique(words[k]) for k in rows]
    all_ = np.concatenate(uniq)
    lab = np.repeat(np.array([y[k] for k in rows]), [len(u) for u in uniq])
    v, inv = np.unique(all_, return_inverse=True)
    d1 = np.bincount(inv, weights=lab == 1)
    d0 = np.bincount(inv, weights=lab == 0)
    share = n1 / (n1 + n0)
    d = d1 + d0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(d1 > 0, d1 * np.log(d1 / (d * share)), 0) + np.where(d0 > 0, d0 * np.log(d0 / (d * (1 - share))), 0))
    lift = ((d1 + 0.5) / (n1 + 1)) / ((d0 + 0.5) / (n0 + 1))
    return v[(ratio >= least_ratio) & (lift >= least_lift) & (d1 > d * share)]


def fit_field(words: list[np.ndarray], stems: list[np.ndarray], y: np.ndarray, groups: list[int], steps: int) -> Model | None:
    """The field, not calibrated; None without a word that tells toxic documents."""
    bad = np.concatenate([toxic_words(words, y, groups), toxic_words(stems, y, groups, STEM_RATIO, STEM_LIFT)]) if len(words) else np.zeros(0, U64)
    if not len(bad):
        return None
    pick = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[: CLEAN_A_TOXIC * int(y.sum()) + CLEAN_MORE]])
    seq, sub = (np.concatenate([x[k] for k in pick]) for x in (words, stems))
    gold = (np.isin(seq, bad) | np.isin(sub, bad)) & np.repeat(y[pick] == 1, [len(words[k]) for k in pick])
    ends = np.cumsum([0] + [len(words[k]) for k in pick])
    bucket = features(seq, sub, ends)
    cuts = [np.append(np.arange(0, len(words[k]), CHUNK), len(words[k])) for k in pick if len(words[k])]
    base = np.cumsum([0] + [c[-1] for c in cuts])
    at = np.concatenate([*(c[:-1] + s for c, s in zip(cuts, base, strict=False)), base[-1:]])
    w = np.zeros(1 << BITS)
    bias, start, move = float(np.log((gold.sum() + 1) / (len(seq) + 2))), 0.0, np.zeros((2, 2))
    gw, gb, gs, gm = np.full(1 << BITS, 1e-6), 1e-6, 1e-6, np.full((2, 2), 1e-6)
    inner = np.ones(len(seq), bool)
    inner[at[1:-1] - 1] = inner[-1] = False
    i = np.flatnonzero(inner)
    want = np.bincount(2 * gold[i] + gold[i + 1], minlength=4).reshape(2, 2)
    for _ in range(steps):
        p, have = marginals(emitted(w, bucket) + bias, at, start, move, pairs=True)
        d = sum(v * np.bincount(row, weights=gold - p, minlength=1 << BITS) for v, row in zip(VALUES.tolist(), bucket, strict=True)) - 0.01 * w
        gw += d * d
        w += 0.5 * d / np.sqrt(gw)
        db = (gold - p).sum()
        gb += db * db
        bias += 0.2 * db / np.sqrt(gb)
        ds = (gold[at[:-1]] - p[at[:-1]]).sum()
        gs += ds * ds
        start += 0.2 * ds / np.sqrt(gs)
        dm = want - have - 0.01 * move
        gm += dm * dm
        move += 0.2 * dm / np.sqrt(gm)
    return Model((w + bias / VALUES.sum()).astype(np.float32), float(start), move)


def _totals(model: Model | None, words: list[np.ndarray], stems: list[np.ndarray]) -> np.ndarray:
    """Sum of squared marginals of each document. Documents of like length go together, as those of a group advance word by word."""
    out = np.zeros(len(words))
    order = np.argsort([len(x) for x in words], kind="stable")
    for k in range(0, len(words) if model else 0, 400):
        part = order[k : k + 400]
        w = [words[q] for q in part]
        at = np.cumsum([0] + [len(x) for x in w])
        p = model.tagged(np.concatenate(w), np.concatenate([stems[q] for q in part]), at)
        total = squares(p)
        out[part] = total[at[1:]] - total[at[:-1]]
    return out


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, steps: int = 40, bound_bytes: int = SAMPLE_BYTES) -> Model:
    """labels: doc_id, toxic (0 or 1; null rows don't count). Ids whose crc32 (as text) is a multiple of 5 are not learnt from."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = linear.sampled(docs, usable, "toxic", bound, bound_bytes, _tokens, "words binary, stems binary")
    y = np.array(got.column("label").to_pylist(), int)
    words, stems = ([np.frombuffer(x, U64) for x in got.column(c).to_pylist()] for c in ("words", "stems"))
    groups = copy_keys(words)
    model = fit_field(words, stems, y, groups, steps)
    if model is None:
        rate = float(np.clip(y.mean(), 1e-3, 0.49)) if len(y) else 0.01
        return Model(np.full(1 << BITS, -1.0, np.float32), -4.0, np.zeros((2, 2)), slope=0.0, shift=float(np.log(rate / (1 - rate))))
    # what a field says of rows that it was not fitted to
    fold = np.array([g % FOLDS for g in groups])
    total = np.zeros(len(y))
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        part = fit_field([words[k] for k in rest], [stems[k] for k in rest], y[rest], [groups[k] for k in rest], steps)
        total[own] = _totals(part, [words[k] for k in own], [stems[k] for k in own])
    at = np.cumsum([0] + [len(x) for x in words])
    fits = []
    for floor in FLOORS:
        z = evidence(total, at, floor)
        slopes, shift = linear.calibrate_columns(z, y.astype(float))
        m = z @ slopes + shift
        fits.append((float(np.sum(np.logaddexp(0, m) - y * m)), floor, slopes, shift))
    _, model.floor, (model.slope, model.length), model.shift = min(fits, key=lambda x: x[0])
    return model


def score(docs: DataFrame, model: Model, group_bytes: int = 4 * K.SLICE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans (``start:end`` of words tagged toxic; code points).

    Null and empty texts have no words and get the score of a text without toxic words.
    Rows are independent; label, lang and source columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data_all, off_all = K.buffers(b.column(1))
            for gi, gj in K.slices(off_all, group_bytes):
                hs, us, s, t, at = [], [], [], [], [np.zeros(1, np.int64)]
                off_g = off_all[gi : gj + 1]
                for i, j in K.slices(off_g):
                    data, off = data_all[off_g[i] : off_g[j]], off_g[i : j + 1] - off_g[i]
                    h, stem, starts, ends, first = word_and_stem(data, off)
                    hs.append(h)
                    us.append(stem)
                    s.append(starts + off_g[i])
                    t.append(ends + off_g[i])
                    at.append(first[1:] + at[-1][-1])
                hs, us, s, t, at = (np.concatenate(x) for x in (hs, us, s, t, at))
                p = model.tagged(hs, us, at)
                total = squares(p)
                prob = linear.sigmoid(evidence(total[at[1:]] - total[at[:-1]], at, model.floor) @ np.array([model.slope, model.length]) + model.shift)
                spans = [""] * (gj - gi)
                hit = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(at, hit, "right") - 1
                for d in np.unique(doc).tolist():
                    a = off_g[d]
                    chars = np.concatenate([[0], np.cumsum(K.char_starts(data_all[a : off_g[d + 1]]))])
                    spans[d] = ",".join(f"{chars[s[x] - a]}:{chars[t[x] - a]}" for x in hit[doc == d].tolist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(gi, gj - gi), b.column(2).slice(gi, gj - gi), pa.array(prob), pa.array((prob >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "toxic_spans"])
    return docs.select("doc_id", "text", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, toxic_spans string")
