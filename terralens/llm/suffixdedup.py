"""Removal of repeated passages by suffix arrays.

A byte goes if it lies in a ``window``-byte string that also starts earlier (smaller doc_id, or same
document and earlier start). Several texts of one doc_id are told apart, and ordered, by a hash of the text (``place``).
The work is cut so that equal windows meet in one shard:

1. Each window has an anchor: its ``GRAM``-byte string of smallest hash, the leftmost of equals. Neighbouring windows
   of one anchor form a run; equal windows have equal anchors at the same place. Of runs that are equal to the last
   byte within one slice of text, all but the earliest are done here. A task remembers runs that it has met repeatedly, so a
   passage that is everywhere sends about one row a task to its anchor's partition.
2. Runs meet by anchor hash, sorted, and are read as a stream. Anchors that have a large share of the runs of a part of the documents are dealt by the runs' content
   too, so that none fills a task (which anchors these are changes only where rows go). Equal runs: all but the earliest are repeats. An anchor with one
   kind of run has no other repeats. What is left are the earliest runs of anchors with several kinds: the
   surroundings of edits and of passage ends.
3. Those runs' bytes are collected in shards by anchor. A shard's suffix array is induced, and windows of a common
   prefix of ``window`` bytes or more are equal; all but the earliest are repeats. An anchor with more than ``HOT`` kinds of run is
   dealt by window instead, as rows of the windows' hashes without bytes, so no shard depends on how often a passage occurs.
4. Repeats come back to their documents, whose remaining bytes are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import textkernel as K
from terralens.llm.induced import common_prefixes, suffix_array
from terralens.llm.scratch import save

U64 = np.uint64
WINDOW = 100
GRAM = 24
HOT = 4000
#: A hot anchor's rows are spread over so many parts where they meet the list of hot anchors.
SALT = 64
SHARD_BYTES = 1 << 19
#: One document in so many is looked at for hot anchors; an anchor is hot if it has this many runs there, and a share of them over that of 1 / HOT_PARTS of a partition.
HOT_SAMPLE, HOT_RUNS, HOT_PARTS = 64, 8, 64
#: Repeated runs, or windows of hot anchors, that a task remembers at most; it only saves rows.
REMEMBERED = 1 << 17
_POS_BITS = 24
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram``-byte string. Equal hashes of different strings only make them meet in one shard."""
    part, width, out, done = K.BYTE_CODE[data], 1, None, 0
    while True:
        if gram & width:
            have = len(data) - (done + width) + 1
            out = part[:have] if out is None else out[:have] * U64(pow(_STEP, width, 1 << 64)) + part[done : done + have]
            done += width
        if width * 2 > gram:
            return K.mix(out)
        part = part[:-width] * U64(pow(_STEP, width, 1 << 64)) + part[width:]
        width *= 2


def runs(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first window start and number of windows of each run."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64))
    if n < window:
        return none
    prefix = K.prefix_hash(data)
    h = gram_hashes(data, gram)
    if n >> _POS_BITS:
        return _runs_of_long(h, prefix, off, window, gram)
    place = U64((1 << _POS_BITS) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=U64)
    width, size = window - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return _cut((low & place).astype(np.int64), h, prefix, off, window)


def _runs_of_long(h: np.ndarray, prefix: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """As ``runs`` where positions need more bits: the smallest masked hash, then its leftmost place."""
    key = h >> U64(_POS_BITS)
    at = np.arange(len(h))
    width, size = window - gram + 1, 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(key[b] < key[a], b, a)
    while size * 2 <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    if size < width:
        at = better(at[: len(at) - (width - size)], at[width - size :])
    return _cut(at, h, prefix, off, window)


def _cut(anchor: np.ndarray, h: np.ndarray, prefix: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """anchor: of the window at each start."""
    inside = np.zeros(len(anchor) + 1, np.int32)
    a, b = off[:-1], off[1:] - window + 1
    ok = b > a
    np.add.at(inside, a[ok], 1)
    np.add.at(inside, b[ok], -1)
    pos = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(pos):
        return tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64))
    own = anchor[pos]
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    lo, count, own = pos[first], np.diff(np.append(first, len(pos))), own[first]
    content = K.mix(K.span_hash(prefix, lo, lo + count - 1 + window) + (own - lo).astype(U64))
    return h[own], content, lo, count


_RUN = "h long, content long, doc_id long, place long, lo int, n int, done boolean"


def _earlier(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """True where (doc, place, lo) of ``a`` comes before that of ``b``."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


class _Memory:
    """Places of kinds of runs that a task has met twice in one slice: at most ``REMEMBERED``, then it starts anew."""

    def __init__(self):
        self.key = np.zeros(0, U64)
        self.rows: tuple[np.ndarray, ...] = ()

    @staticmethod
    def keys(h: np.ndarray, content: np.ndarray) -> np.ndarray:
        return K.mix(h ^ (content * U64(_STEP)))

    def repeats(self, h: np.ndarray, content: np.ndarray, at: tuple[np.ndarray, ...]) -> np.ndarray:
        """True for runs that repeat a remembered one that is earlier."""
        if not len(self.key):
            return np.zeros(len(h), bool)
        q = np.minimum(np.searchsorted(self.key, self.keys(h, content)), len(self.key) - 1)
        mh, mc, *place = (x[q] for x in self.rows)
        return (mh == h) & (mc == content) & _earlier(tuple(place), at)

    def add(self, h: np.ndarray, content: np.ndarray, at: tuple[np.ndarray, ...]) -> None:
        rows = (h, content, *at)
        if self.rows and len(self.key) + len(h) <= REMEMBERED:
            rows = tuple(np.concatenate([a, b]) for a, b in zip(self.rows, rows, strict=True))
        key = self.keys(rows[0], rows[1])
        order = np.lexsort((rows[4], rows[3], rows[2], key))
        first = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else order
        self.key, self.rows = key[first], tuple(x[first] for x in rows)


def _find_runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory()
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                h, content, lo, n = runs(data, off, window, gram)
                ids, places = (b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 2))
                at = np.searchsorted(off, lo, "right") - 1
                doc, place, lo = ids[at], places[at], lo - off[at]
                o = np.lexsort((lo, place, doc, content, h))
                same = np.zeros(len(h), bool)
                same[1:] = (h[o][1:] == h[o][:-1]) & (content[o][1:] == content[o][:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(o)))) if len(o) else o
                late = same & ((doc[o] != doc[o][head]) | (place[o] != place[o][head]) | (lo[o] != lo[o][head]))
                done = np.zeros(len(h), bool)
                done[o] = late
                done |= memory.repeats(h, content, (doc, place, lo))
                often = o[np.unique(head[late])]
                memory.add(h[often], content[often], (doc[often], place[often], lo[often]))
                # repeats next to each other become one range
                k = np.flatnonzero(done)
                start = np.ones(len(k), bool)
                start[1:] = (at[k][1:] != at[k][:-1]) | (lo[k][1:] != lo[k][:-1] + n[k][:-1])
                first = np.flatnonzero(start)
                total = np.add.reduceat(n[k], first) if len(first) else n[:0]
                keep = np.flatnonzero(~done)
                dk = k[first]
                cols = [np.concatenate([h[keep], K.mix(doc[dk].astype(U64) * U64(31) + lo[dk].astype(U64))]).view(np.int64), np.concatenate([content[keep], np.zeros(len(dk), U64)]).view(np.int64),
                        np.concatenate([doc[keep], doc[dk]]), np.concatenate([place[keep], place[dk]]), np.concatenate([lo[keep], lo[dk]]).astype(np.int32), np.concatenate([n[keep], total]).astype(np.int32),
                        np.repeat([False, True], [len(keep), len(dk)])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "content", "doc_id", "place", "lo", "n", "done"])
    return run


_SETTLED = "h long, doc_id long, place long, lo int, n int, done boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to repeats (done) and to the earliest runs of anchors with several kinds."""
    last = None  # (h, content, doc, place, lo) of the earliest run of the current kind
    waiting = None  # the only kind's earliest run so far of the current anchor
    names = ["h", "doc_id", "place", "lo", "n", "done"]
    for b in batches:
        h, content, doc, place, lo, n, done, part = (b.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        settled = np.flatnonzero(done)
        if len(settled):
            yield pa.RecordBatch.from_arrays([pa.array(x[settled]) for x in (h, doc, place, lo, n, done)], names=names)
        open_ = np.flatnonzero(~done)
        h, content, doc, place, lo, n, part = (x[open_] for x in (h, content, doc, place, lo, n, part))
        m = len(h)
        if not m:
            continue
        same_h, same = np.zeros(m, bool), np.zeros(m, bool)
        same_h[1:] = h[1:] == h[:-1]
        same[1:] = same_h[1:] & (content[1:] == content[:-1])
        if last is not None:
            same_h[0] = h[0] == last[0]
            same[0] = same_h[0] and content[0] == last[1]
        kind_at = np.maximum.accumulate(np.where(same, -1, np.arange(m)))
        head = [np.where(kind_at >= 0, x[kind_at], last[k] if last else 0) for k, x in ((2, doc), (3, place), (4, lo))]
        repeat = same & ((doc != head[0]) | (place != head[1]) | (lo != head[2]))
        first = ~same  # earliest of its kind
        group = np.cumsum(~same_h) - (0 if same_h[0] else 1)  # group 0 may go on from the last batch
        kinds = np.bincount(group, weights=first, minlength=group[-1] + 1)
        several = (kinds[group] > 1) | (part > 0)  # a hot anchor's other kinds are elsewhere
        extra = []
        if same_h[0]:
            in_first = group == 0
            if kinds[0] and waiting is not None:
                extra, waiting = [waiting], None
            several |= in_first if (kinds[0] and waiting is None) else False
        else:
            waiting = None
        if group[-1] > 0 or not same_h[0]:
            in_last = group == group[-1]
            only = np.flatnonzero(in_last & first)
            waiting = (h[only[0]], doc[only[0]], place[only[0]], lo[only[0]], n[only[0]]) if len(only) == 1 and not part[only[0]] else None
        out = np.flatnonzero(repeat | (first & several))
        cols = [x[out] for x in (h, doc, place, lo, n)]
        if extra:
            cols = [np.append(c, x).astype(c.dtype) for c, x in zip(cols, extra[0], strict=True)]
        flag = np.append(repeat[out], [False] * len(extra)).astype(bool)
        if len(flag):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, flag)], names=names)
        k = kind_at[-1]
        last = (h[-1], content[-1], doc[k], place[k], lo[k]) if k >= 0 else last


_CONTEXT = "key long, bytes binary, doc_id long, place long, lo int, n int"
_REPEAT = "doc_id long, place long, lo int, n int"


def _repeated(key: np.ndarray, at: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, late, head): rows by key and place; in that order, those that repeat the earliest of their key, and where that one is."""
    o = np.lexsort((at[2], at[1], at[0], key))
    same = np.zeros(len(o), bool)
    same[1:] = key[o][1:] == key[o][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(o)))) if len(o) else o
    late = same & ((at[0][o] != at[0][o][head]) | (at[1][o] != at[1][o][head]) | (at[2][o] != at[2][o][head]))
    return o, late, head


def _contexts(window: int):
    """(text, doc_id, place, runs) to the runs' bytes; a hot anchor's run to its windows, which have their hash as key, no bytes and n = 0. Hot windows that repeat one that a task remembers come as ranges without bytes: they are repeats."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory()
        for b in batches:
            # a row without an id has no runs
            ids, places, size = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (b.column(1), b.column(2), pc.list_value_length(b.column(3))))
            first = np.concatenate([[0], np.cumsum(size)])
            found = b.column(3).flatten()
            for i, j, data, off in K.text_slices(b.column(0)):
                part = found.slice(first[i], first[j] - first[i])
                if not len(part):
                    continue
                h, lo, n, hot = (part.field(c).to_numpy(zero_copy_only=False) for c in ("h", "lo", "n", "hot"))
                q = np.repeat(np.arange(j - i), size[i:j])
                doc, place, start = ids[i:j][q], places[i:j][q], off[q] + lo
                whole, end = data.tobytes(), start + n - 1 + window
                k = np.flatnonzero(~hot)
                yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array([whole[x:y] for x, y in zip(start[k].tolist(), end[k].tolist(), strict=True)], pa.binary()), *(pa.array(x[k]) for x in (doc, place, lo, n))], names=names)
                k = np.flatnonzero(hot)
                if not len(k):
                    continue
                # each window of the hot runs
                row = np.repeat(k, n[k])
                step = np.arange(len(row)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                key = K.span_hash(K.prefix_hash(data), start[row] + step, start[row] + step + window)
                at = doc[row], place[row], lo[row].astype(np.int64) + step
                o, late, head = _repeated(key, at)
                done = np.zeros(len(key), bool)
                done[o] = late
                done |= memory.repeats(key, key, at)
                often = o[np.unique(head[late])]
                memory.add(key[often], key[often], tuple(x[often] for x in at))
                d, p, s, m = _ranges(*(x[done] for x in at))
                left = tuple(x[~done] for x in at)
                cols = [np.concatenate(c) for c in ((key[~done].view(np.int64), K.mix(d.astype(U64) * U64(31) + s.astype(U64)).view(np.int64)), (left[0], d), (left[1], p), (left[2].astype(np.int32), s), (np.zeros(len(left[0]), np.int32), m))]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.nulls(len(cols[0]), pa.binary()), *(pa.array(c) for c in cols[1:])], names=names)
    return run


def repeats_of_shard(blobs: list[bytes], doc: np.ndarray, place: np.ndarray, lo: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, window start) of the windows that are not the earliest of their content. A byte that UTF-8 never holds ends each blob."""
    data = np.frombuffer(b"\xff".join(blobs) + b"\xff", np.uint8)
    sa = suffix_array(data)
    base = np.concatenate([[0], np.cumsum([len(x) + 1 for x in blobs])])[:-1]
    owner = np.repeat(np.arange(len(blobs)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = base[owner] + start
    # only window starts can share a window's length: all other suffixes meet an end byte before
    shared = np.zeros(len(data), bool)
    shared[at] = common_prefixes(data, sa, window, at) >= window
    group_of = np.empty(len(data), np.int64)
    group_of[sa] = np.cumsum(~shared[sa])
    group = group_of[at]
    d, p, s = doc[owner], place[owner], lo[owner] + start
    order = np.lexsort((s, p, d, group))
    g, d, p, s = group[order], d[order], p[order], s[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else g
    late = (d != d[head]) | (p != p[head]) | (s != s[head])
    return d[late], p[late], s[late]


def _ranges(d: np.ndarray, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((s, p, d))
    d, p, s = d[order], p[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(d) else first
    return d[first], p[first], s[first].astype(np.int32), (s[last] - s[first] + 1).astype(np.int32)


def _shards(window: int):
    """Sorted contexts to repeats: a shard of whole keys at a time, and single windows of hot anchors by their hashes as they come."""
    names = [x.split()[0] for x in _REPEAT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, rows, held, key = [], [], 0, None
        head = None  # (key, doc, place, lo) of the earliest window of the current hash

        def close() -> pa.RecordBatch:
            doc, place, lo, n = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _ranges(*repeats_of_shard(blobs, doc, place, lo, n, window))], names=names)
        for b in batches:
            size = b.column(5).to_numpy()
            without = pc.is_null(b.column(1)).to_numpy(zero_copy_only=False)
            known = b.filter(pa.array(without & (size > 0)))
            if known.num_rows:
                yield known.select(names)
            k = np.flatnonzero(size == 0)
            if len(k):
                w, *at = (b.column(c).to_numpy()[k].astype(np.int64) for c in (0, 2, 3, 4))
                if head is not None:
                    w, at = np.append(head[0], w), [np.append(x, y) for x, y in zip(head[1:], at, strict=True)]
                o, late, first = _repeated(w, tuple(at))
                last = o[first[-1]]
                head = (w[last], *(x[last] for x in at))
                found = _ranges(*(x[o][late] for x in at))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
            for k, x, *row in zip(*(c.to_pylist() for c in b.filter(pa.array(~without)).columns), strict=True):
                if k != key and held >= SHARD_BYTES:
                    yield close()
                    blobs, rows, held = [], [], 0
                key = k
                blobs.append(x)
                rows.append(row)
                held += len(x) + 1
        if blobs:
            yield close()
    return run


def covered(length: int, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """True for bytes in a repeated window."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, np.minimum(lo, length), 1)
    np.add.at(edge, np.minimum(lo + n - 1 + window, length), -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2)
            for i, j, data, off in K.text_slices(b.column(0)):
                size, gone, spans, kept = [], [], [], []
                for q in range(j - i):
                    raw = data[off[q] : off[q + 1]]
                    r = at[i + q].values
                    if r is None or not len(r):
                        mask = None
                        gone.append(0)
                        spans.append(0)
                    else:
                        mask = covered(len(raw), r.field("lo").to_numpy().astype(np.int64), r.field("n").to_numpy().astype(np.int64), window)
                        gone.append(int(mask.sum()))
                        spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[0]))
                    left = (raw if mask is None else raw[~mask]).tobytes()
                    size.append(len(raw))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])
    return run


def hot_anchors(docs: DataFrame, window: int, gram: int) -> list[int]:
    """Anchors that would fill a good part of a task: at most ``HOT_PARTS`` for each shuffle partition."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", "place"), F.lit(HOT_SAMPLE)) == 0)
    seen = save(few.mapInArrow(_find_runs(window, gram), _RUN).where("not done").groupBy("h").count().where(F.col("count") >= HOT_RUNS), "anchors")
    parts = HOT_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [r.h for r in seen.orderBy(F.desc("count"), "h").limit(parts).collect()]


def _dealt(found: DataFrame, hot: list[int]) -> DataFrame:
    """Runs with ``part``: 0, or a positive number by their content for hot anchors."""
    if not hot:
        return found.withColumn("part", F.lit(0))
    names = F.broadcast(found.sparkSession.createDataFrame(pa.table({"h": pa.array(hot, pa.int64())})).withColumn("_hot", F.lit(True)))
    return found.join(names, "h", "left").select("h", "content", "doc_id", "place", "lo", "n", "done", F.when(F.col("_hot"), F.pmod("content", F.lit(256)) + 1).otherwise(0).cast("int").alias("part"))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), or kept_sha256 with ``digest``.

    Null and empty texts have no bytes. Texts below ``window`` bytes stay. Different texts of one doc_id are different documents, in the order
    of a hash of the text; a row that repeats both is the same document, so it is no repeat of itself and both rows get one result. A row without
    a doc_id has no place in the order: it stays whole, and is no earlier copy of another. Remaining bytes may cut a character, hence binary.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("place"))
    found = docs.where("doc_id is not null").mapInArrow(_find_runs(window, gram), _RUN)
    dealt = _dealt(found, hot_anchors(docs.where("doc_id is not null"), window, gram))
    settled = save(dealt.repartition("h", "part").sortWithinPartitions("h", "content", "doc_id", "place", "lo").mapInArrow(_settle, _SETTLED), "runs")
    # hot anchors are few (each has over HOT rows), so they are repeated for each part of a salted join
    salt = lambda c: c.withColumn("salt", F.pmod(F.xxhash64("doc_id", "lo"), F.lit(SALT)).cast("int"))
    open_ = salt(settled.where("not done"))
    hot = open_.groupBy("h").count().where(F.col("count") > HOT).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("hot"))
    wanted = open_.join(hot, ["h", "salt"], "left").groupBy("doc_id", "place").agg(F.collect_list(F.struct("h", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    # a left join, as below: texts are shuffled once for both
    contexts = docs.join(wanted.hint("merge"), ["doc_id", "place"], "left").select("text", "doc_id", "place", "runs").mapInArrow(_contexts(window), _CONTEXT)
    late = contexts.repartition("key").sortWithinPartitions("key", "doc_id", "place", "lo").mapInArrow(_shards(window), _REPEAT)
    repeats = settled.where("done").select("doc_id", "place", "lo", "n").unionByName(late).groupBy("doc_id", "place").agg(F.collect_list(F.struct("lo", "n")).alias("at"))
    return docs.join(repeats.hint("merge"), ["doc_id", "place"], "left").select("text", "doc_id", "at").mapInArrow(_remove(window, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")
