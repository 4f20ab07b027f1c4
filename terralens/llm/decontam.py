"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers the documents of one slice of text and stores their
ids and lengths, a random name, its distinct terms, and for each term the ascending list of its positions (word places counted through the
segment). Documents are disjoint between segments, so a search runs on each segment alone.

A phrase is found from its rarest term: that term's positions, less its offset in the phrase, are the candidate
starts, which are intersected with the offset-adjusted lists of the other terms, rarest first.

A benchmark is a table of hashed word sequences, made on the executors; its windows are never written out. It is searched in blocks
of ``BLOCK_WORDS`` words, each a broadcast of bounded size, and a segment goes on only with the windows of which it has every word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import textkernel as K
from terralens.llm.scratch import save

U64 = np.uint64
WINDOW = 13
#: Words of benchmark that one pass over the index searches for: a broadcast of 12 bytes a word at most. More words mean more passes.
BLOCK_WORDS = 1 << 22
#: An item's words are cut into pieces of this many, which overlap by a window less one word.
PIECE_WORDS = 1 << 16
#: Windows, and candidate places of them, that a segment handles at once.
_WINDOWS, _PLACES = 1 << 16, 1 << 20
_SEGMENT = "name binary, doc_ids binary, absent binary, lengths binary, terms binary, counts binary, positions binary"


def term_hashes(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return K.word_hashes(K.LOWER[data], np.array([0, len(data)]), K.ALNUM)[0]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in K.text_slices(b.column(1)):
            h, at = K.word_hashes(K.LOWER[data], off, K.ALNUM)
            order = np.argsort(h, kind="stable")
            ranked = h[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
            ids = b.column(0).slice(i, j - i)
            packed = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(at).astype(np.int64),
                      ranked[first], np.diff(np.append(first, len(h))).astype(np.uint32), _pack(order)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (uuid.uuid4().bytes, *(x.tobytes() for x in packed))], names=[x.split()[0] for x in _SEGMENT.split(", ")])


def _pack(positions: np.ndarray) -> np.ndarray:
    """Steps between positions, byte by byte of their four: mostly small numbers, which compress."""
    steps = np.diff(positions.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)


def _unpack(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of doc_id and text: all words of all documents. Null texts are documents without words."""
    return save(docs.select("doc_id", "text").mapInArrow(_build, _SEGMENT), "index")


@dataclass
class Block:
    """A part of a benchmark: distinct terms, the words of its pieces as places in them, and each piece's number of words and item. Windows are derived where it is used."""

    terms: np.ndarray
    words: np.ndarray
    length: np.ndarray
    names: list[str | None]
    window: int

    @classmethod
    def of(cls, names: list[str | None], pieces: list[bytes], window: int) -> Block:
        terms, words = np.unique(np.frombuffer(b"".join(pieces), U64), return_inverse=True)
        return cls(terms, words.astype(np.uint32), np.array([len(p) // 8 for p in pieces], np.int64), names, window)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, size and piece of each window."""
        n = np.where(self.length >= self.window, self.length - self.window + 1, np.minimum(self.length, 1))
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        skip = (np.cumsum(self.length) - self.length) - (np.cumsum(n) - n)
        starts = np.arange(len(owner), dtype=np.int32) + skip.astype(np.int32)[owner]
        return starts, np.minimum(self.length, self.window).astype(np.int32)[owner], owner


@dataclass
class Segment:
    name: bytes
    doc_ids: np.ndarray
    absent: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    positions: np.ndarray

    @classmethod
    def of(cls, row: list[bytes]) -> Segment:
        return cls(bytes(row[0]), *(np.frombuffer(x, t) for x, t in zip(row[1:], (np.int64, np.uint8, np.int64, U64, np.uint32, np.uint8), strict=True)))

    def ids(self, doc: np.ndarray | slice = slice(None)) -> pa.Array:
        return pa.array(self.doc_ids[doc], pa.int64(), mask=self.absent[doc] != 0)

    def __post_init__(self):
        self.positions = _unpack(self.positions)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.lists = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        # all lists by position: a list has a position if its term is the one there
        self.term_at = np.empty(len(self.positions), np.int32)
        self.term_at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.counts)

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the segment; -1 where it is absent."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]].astype(np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list has the position."""
        return self.term_at[position] == term

    def phrases(self, local: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all occurrences within documents. place: phrases x longest, into ``local``, which has the segment's places of terms; entries from ``length`` on are ignored."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.positions) or not len(length):
            return none
        size = np.where(local >= 0, self.counts[local], 0)
        inside = np.arange(place.shape[1]) < length[:, None]
        n = np.where(inside, size[place], np.iinfo(np.int64).max)
        some = np.flatnonzero(n.min(axis=1) > 0)
        if not len(some):
            return none
        rarest = np.argsort(n[some], axis=1, kind="stable")
        pivot = local[place[some, rarest[:, 0]]]
        many = self.counts[pivot].astype(np.int64)
        # so many phrases at once that their candidate places stay bounded
        cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(many), np.arange(_PLACES, many.sum(), _PLACES), "right"), [len(many)]]))
        found = [self._intersect(some[a:b], rarest[a:b], local, place, length, pivot[a:b], many[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _intersect(self, some: np.ndarray, rarest: np.ndarray, local: np.ndarray, place: np.ndarray, length: np.ndarray, pivot: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phrase = np.repeat(np.arange(len(some)), many)
        at = np.repeat(self.lists[pivot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        start = self.positions[at].astype(np.int64) - rarest[phrase, 0]
        doc = np.searchsorted(self.starts, np.maximum(start, 0), "right") - 1
        ok = (start >= 0) & (start + length[some][phrase] <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)])
        phrase, start = phrase[ok], start[ok]
        for k in range(1, place.shape[1]):
            if not len(phrase):
                break
            offset = rarest[phrase, k]
            needed = k < length[some][phrase]
            keep = ~needed
            w = np.flatnonzero(needed)
            keep[w] = self.has(local[place[some[phrase[w]], offset[w]]], start[w] + offset[w])
            phrase, start = phrase[keep], start[keep]
        return some[phrase], start

    def windows(self, block: Block, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, words) of all occurrences of the windows of ``block``. Windows with a word that the segment lacks are left before any list is read."""
        starts, sizes, owner = windows
        local = self.place(block.terms)
        lacking = np.concatenate([np.zeros(1, np.int32), np.cumsum((local < 0)[block.words], dtype=np.int32)])
        good = np.flatnonzero(lacking[starts + sizes] == lacking[starts])
        out = [(np.zeros(0, np.int64),) * 3]
        for k in range(0, len(good), _WINDOWS):
            w = good[k : k + _WINDOWS]
            at = np.minimum(starts[w][:, None] + np.arange(sizes[w].max()), len(block.words) - 1)
            phrase, start = self.phrases(local, block.words[at], sizes[w])
            out.append((owner[w][phrase], start, sizes[w][phrase]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def proximity(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(document row, first word) of each stretch of starts from which all terms occur within ``slop`` words."""
        local = self.place(np.unique(terms))
        if not len(local) or (local < 0).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = int(self.starts[-1])
        good = np.ones(total, bool)
        for t in local[np.argsort(self.counts[local], kind="stable")]:
            p = self.postings(t)
            doc = np.searchsorted(self.starts, p, "right") - 1
            edge = np.zeros(total + 1, np.int64)
            np.add.at(edge, np.maximum(p - slop + 1, self.starts[doc]), 1)
            np.add.at(edge, p + 1, -1)
            good &= np.cumsum(edge[:-1]) > 0
        at = np.flatnonzero(good)
        doc = np.searchsorted(self.starts, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        return doc[new], at[new] - self.starts[doc[new]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for b in batches:
        for row in zip(*(b.column(k) for k in range(7)), strict=True):
            yield Segment.of([x.as_buffer() for x in row])


def find_phrase(index: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, start) of all exact occurrences of the words of ``phrase``, counted in words."""
    h = term_hashes(phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches):
            terms, place = np.unique(h, return_inverse=True)
            _, at = s.phrases(s.place(terms), place[None, :], np.array([len(h)])) if len(h) else (None, np.zeros(0, np.int64))
            doc = np.searchsorted(s.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([s.ids(doc), pa.array(at - s.starts[doc])], names=["doc_id", "start"])
    return index.mapInArrow(run, "doc_id long, start long")


def find_near(index: DataFrame, terms: str, slop: int) -> DataFrame:
    """(doc_id, start): all words of ``terms`` occur within ``slop`` words from there on; one row for a stretch of starts."""
    h = term_hashes(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches):
            doc, at = s.proximity(h, slop)
            yield pa.RecordBatch.from_arrays([s.ids(doc), pa.array(at)], names=["doc_id", "start"])
    return index.mapInArrow(run, "doc_id long, start long")


def item_pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, words (hashes) and n of the pieces of each item, which overlap so that each window lies in one. Items without words have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                h, at = K.word_hashes(K.LOWER[data], off, K.ALNUM)
                names = b.column(0).slice(i, j - i).to_pylist()
                rows = [(names[q], h[s : min(s + PIECE_WORDS, at[q + 1])]) for q in range(j - i) for s in range(at[q], max(at[q + 1] - (window - 1), at[q] + 1) if at[q + 1] > at[q] else at[q], PIECE_WORDS - (window - 1))]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x.tobytes() for _, x in rows], pa.binary()), pa.array([len(x) for _, x in rows], pa.int64())], names=["item", "words", "n"])
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words binary, n long")


#: A row for each document; segment and place are its key.
_FOUND = "segment binary, place int, doc_id long, n_words long, runs array<struct<s:long,e:long>>, items array<string>"


def _search(shared):
    """shared: a broadcast Block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = [x or "" for x in block.names]
        windows = block.windows()
        for s in _segments(batches):
            piece, start, length = s.windows(block, windows)
            edge = np.zeros(int(s.starts[-1]) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
            hit = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(s.starts, start, "right") - 1
            # places of words with a hit, as runs of each document
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            firsts = s.starts[:-1][s.lengths > 0]
            begin[firsts] = hit[firsts]
            end = hit.copy()
            end[:-1] &= ~hit[1:]
            lasts = s.starts[1:][s.lengths > 0] - 1
            end[lasts] = hit[lasts]
            b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            own = np.searchsorted(s.starts, b, "right") - 1
            n = np.bincount(own, minlength=len(s.doc_ids))
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                            pa.StructArray.from_arrays([pa.array(b - s.starts[own]), pa.array(e - s.starts[own])], names=["s", "e"]))
            found: list[list[str]] = [[] for _ in s.doc_ids]
            pairs = np.unique(np.stack([doc, piece], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            for d, k in pairs.tolist():
                found[d].append(names[k])
            key = [pa.array([s.name] * len(s.doc_ids), pa.binary()), pa.array(np.arange(len(s.doc_ids), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*key, s.ids(), pa.array(s.lengths), runs, pa.array(found, pa.list_(pa.string()))], names=["segment", "place", "doc_id", "n_words", "runs", "items"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), items.

    A word inside any occurrence of a window is hit once. Null, empty and wordless texts have no words and no hits, and such
    items no windows. A null doc_id stays null. Every row of ``docs`` has its own result, also if its id is null or repeated; items of one id
    count once for a document, and an item without an id has an empty name.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    pieces = save(item_pieces(benchmark, window), "items")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        part = pieces.where(F.col("block") == k).select("item", "words").toArrow()
        shared = spark.sparkContext.broadcast(Block.of(part.column("item").to_pylist(), part.column("words").to_pylist(), window))
        got = index.mapInArrow(_search(shared), _FOUND)
        found = got if found is None else found.unionByName(got)
    if blocks > 1:
        # a document's rows of all blocks
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    merged = F.expr("aggregate(array_sort(runs), struct(0L as n, 0L as e), (a, r) -> struct(a.n + greatest(r.e - greatest(r.s, a.e), 0L) as n, greatest(a.e, r.e) as e), a -> a.n)")
    names = F.array_sort(F.array_distinct("items"))
    return (found.withColumn("n_hit", merged).withColumn("items", names)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    The verdict depends on the text alone and is carried by a 64-bit hash of it, so ids may be null or repeated.
    """
    key = F.xxhash64("text")
    bad = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, **options).where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(bad, "key", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
