"""Byte-level BPE encoding and decoding with segment trees.

For each distinct piece of text (a match of the splitting pattern) a segment tree over its byte
positions holds, in every node, the leftmost smallest pair rank below it. The root names the next
merge; the merge frees the right neighbour's position, and the tree is updated at the two live
positions whose pairs changed, in logarithmic steps. Pieces of one size class share array
operations: a step merges once in each of them. A long piece has a tree of its own, and a step makes all its merges of one rank.

Pieces repeat, so a worker remembers those it has encoded (at most ``REMEMBERED``, then it starts anew).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terralens.llm import textkernel as K

REMEMBERED = 200_000
_NONE = np.uint32(0xFFFFFFFF)
#: Positions handled at once.
_TREES = 1 << 20
#: Pieces of this many bytes or more are merged in rounds, each from its own tree.
LONG = 1024


def read_ranks(path: str) -> bytes:
    """The rank file's content; it has a fixed size and goes to the executors with the function."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder for one rank table and splitting pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.decimal = [str(i) for i in range(len(self.token))]
        self.split = regex.compile(pattern).findall
        self.byte_id = np.zeros(256, np.uint32)
        for t, r in self.rank.items():
            if len(t) == 1:
                self.byte_id[t[0]] = r
        left, right, merged = [], [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        self._index(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.uint32))
        self.seen: dict[str, tuple[str, bytes]] = {}

    def _index(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """Open-addressed table of pairs."""
        keys = (left << np.uint64(32)) | right
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, _NONE, np.uint32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[at[todo]] == np.iinfo(np.uint64).max
            slot, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slot], self.values[slot] = keys[won], merged[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; the largest value where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.iinfo(np.uint64).max))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (self.keys[at[open_]] != np.iinfo(np.uint64).max)]
        return out

    def _merge_class(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of up to ``width`` (a power of two) bytes.

        A node's value is its smallest rank and, below it, the position: the smallest value is the leftmost smallest pair.
        """
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        ids = np.zeros((n, width), np.uint32)
        inside = np.arange(width) < length[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        alive = inside.copy()
        after = np.where(np.arange(1, width + 1) < length[:, None], np.arange(1, width + 1), width).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        tree = np.full((n, 2 * width), np.iinfo(np.uint64).max, np.uint64)
        pos = np.arange(width - 1)
        if width > 1:
            rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            usable = inside[:, 1:] & (rank != _NONE)
            tree[:, width : 2 * width - 1] = np.where(usable, (rank.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64), tree[:, width : 2 * width - 1])
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        live = np.arange(n)
        top = np.iinfo(np.uint64).max

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while width > 1:
                node = node >> 1
                if not node[0]:
                    break
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = after[rows, at]
            there = nxt < width
            rank = self.pair_rank(ids[rows, at], ids[rows, np.where(there, nxt, 0)])
            return np.where(there & (rank != _NONE), (rank.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64), top)

        while len(live):
            root = tree[live, 1]
            go = root != top
            live, root = live[go], root[go]
            if not len(live):
                break
            at = (root & np.uint64(0xFFFFFFFF)).astype(np.int64)
            gone = after[live, at].astype(np.int64)
            ids[live, at] = (root >> np.uint64(32)).astype(np.uint32)
            alive[live, gone] = False
            nxt = after[live, gone]
            after[live, at] = nxt
            has = nxt < width
            before[live[has], nxt[has]] = at[has]
            put(live, gone, np.full(len(live), top, np.uint64))
            put(live, at, pair(live, at))
            prev = before[live, at].astype(np.int64)
            has = prev >= 0
            if has.any():
                put(live[has], prev[has], pair(live[has], prev[has]))
        flat, ends = ids[alive], np.cumsum(alive.sum(axis=1))
        return np.split(flat, ends[:-1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Token ids of one long piece, from one tree. A round does all merges of the smallest rank, from the left.

        Merging one at a time would take the same steps as long as no merge makes a pair of that rank or a smaller one; a round ends
        after the first that does.
        """
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].astype(np.uint32)
        alive = np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        tree = np.full(2 * width, _NONE, np.uint32)
        tree[width : width + n - 1] = self.pair_rank(ids[:-1], ids[1:])
        level = width
        while level > 1:
            np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
            level //= 2

        def ranks(left: np.ndarray, right: np.ndarray, there: np.ndarray) -> np.ndarray:
            out = np.full(len(left), _NONE, np.uint32)
            out[there] = self.pair_rank(left[there], right[there])
            return out

        while (low := tree[1]) != _NONE:
            node = np.ones(1, np.int64)
            while node[0] < width:
                node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                node = node[tree[node] == low]
            at = node - width
            # of a chain in which each pair begins with the end of the one before, every second pair
            chained = np.append(False, after[at[:-1]] == at[1:])
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            nxt, prev = after[gone], before[at]
            merged = np.full(len(at), low, np.uint32)
            # the pairs that a merge makes, at the time: what is left of it has been merged, what is right of it hasn't
            joined = np.append(False, prev[1:] == gone[:-1])
            left = np.where(joined, low, ids[np.maximum(prev, 0)]).astype(np.uint32)
            made = np.minimum(ranks(left, merged, prev >= 0), ranks(merged, ids[np.minimum(nxt, n - 1)], nxt < n))
            early = np.flatnonzero(made <= low)
            if len(early):
                k = early[0] + 1
                at, gone, nxt, prev, merged = at[:k], gone[:k], nxt[:k], prev[:k], merged[:k]
            ids[at] = merged
            alive[gone] = False
            after[at] = nxt
            has = nxt < n
            before[nxt[has]] = at[has]
            back = before[at]
            tree[width + gone] = _NONE
            tree[width + at] = ranks(merged, ids[np.minimum(nxt, n - 1)], has)
            some = back >= 0
            tree[width + back[some]] = self.pair_rank(ids[back[some]], merged[some])
            node = np.unique(np.concatenate([at, gone, back[some]]) + width) >> 1
            while node[0]:
                node = node[np.append(True, node[1:] != node[:-1])]
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
                node = node >> 1
        return ids[alive]

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece. A piece that is a token itself is that token, as in the tiktoken library."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for k, b in enumerate(raw):
            whole = self.rank.get(b)
            if whole is not None:
                out[k] = np.array([whole], np.uint32)
            else:
                classes.setdefault(1 << (len(b) - 1).bit_length(), []).append(k)
        for width, members in classes.items():
            if width >= LONG:
                for k in members:
                    out[k] = self._merge_long(raw[k])
                continue
            step = max(1, _TREES // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for k, got in zip(part, self._merge_class([raw[k] for k in part], width), strict=True):
                    out[k] = got
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
        """(ids joined by commas, ids) of each text; a null text is empty."""
        seen = self.seen
        split = [self.split(t) if t else [] for t in texts]
        new = list({p for pieces in split for p in pieces if p not in seen})
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = list({p for pieces in split for p in pieces})
        dec = self.decimal
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            seen[p] = (",".join([dec[i] for i in ids.tolist()]), ids.tobytes())
        for pieces in split:
            got = [seen[p] for p in pieces]
            yield ",".join([g[0] for g in got]), np.frombuffer(b"".join([g[1] for g in got]), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for a worker process, so that tasks share what it remembers."""
    key = (hash(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, *, with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """Adds to doc_id: n_tokens, and ids (array) and decoded (binary, from the ids), or their digests.

    Null and empty texts have no tokens. Rows are independent: repeated ids, ties and extra columns change nothing.
    """
    schema = "doc_id long, n_tokens long" + ", ids array<int>, decoded binary" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            _, off = K.buffers(b.column(1))
            for i, j in K.slices(off):
                n, ids, back, ids_sha, back_sha = [], [], [], [], []
                for joined, one in c.encode(b.column(1).slice(i, j - i).to_pylist()):
                    decoded = c.decode(one)
                    n.append(len(one))
                    if with_ids:
                        ids.append(one)
                        back.append(decoded)
                    if with_digests:
                        ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                        back_sha.append(hashlib.sha256(decoded).hexdigest())
                cols = [b.column(0).slice(i, j - i), pa.array(n, pa.int64())]
                if with_ids:
                    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(back, pa.binary())]
                if with_digests:
                    cols += [pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *["ids", "decoded"][: 2 * with_ids], *["ids_sha256", "decoded_sha256"][: 2 * with_digests]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
