"""Near-duplicate documents by min-max hashing.

Under each of ``PERMUTATIONS`` hash functions a document keeps both its smallest and its largest
shingle hash, so one evaluation gives two signature values; each agrees between two documents with
probability equal to their Jaccard similarity. Values are banded; documents that share a band are
candidates, and candidate clusters are confirmed on full shingle sets.

Shape of the job:
1. One pass over the texts gives each document's set size, a 128-bit fingerprint of its set and its bands.
2. Documents with equal sets form a class, a vertex from here on. Copies never meet in a bucket.
3. Buckets link their members to the bucket's smallest vertex, its hub (a combined minimum, no pairs); components of
   these links are candidate clusters.
4. Sets of clustered classes are rebuilt from the text of their smallest id and stored.
5. A cluster of up to ``BLOCK`` members is compared in one task. In a larger one each member is first compared with its hubs, parts of the members
   and their hub in a task: work in proportion to the cluster, which joins nearly all of a group of near copies. What is left are pairs of
   members of different confirmed components. Members are dealt into blocks, those of a large component into blocks of its own; each pair of blocks is a task, but
   for pairs of blocks of one component. Each task returns a spanning forest of the confirmed links, not the pairs.
6. Components of confirmed links, then members by class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm import textkernel as K
from terralens.llm.components import connected_components
from terralens.llm.scratch import save

U64 = np.uint64
SHINGLE = 5
PERMUTATIONS = 32
#: 64 values in 16 bands of 4: two sets of similarity 0.85 share no band with probability 7e-6.
BAND_ROWS = 4
BLOCK = 128
#: A hub's members are compared with it in up to so many tasks.
HUB_PARTS = 1024
#: Parts of a cluster's members where they meet tables of clusters.
SALT = 64
_rng = np.random.RandomState(1318)
_A = ((_rng.randint(0, 1 << 32, PERMUTATIONS).astype(U64) << U64(32)) | _rng.randint(0, 1 << 32, PERMUTATIONS).astype(U64)) | U64(1)
_B = (_rng.randint(0, 1 << 32, PERMUTATIONS).astype(U64) << U64(32)) | _rng.randint(0, 1 << 32, PERMUTATIONS).astype(U64)
_STEP = U64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after the other, and their offsets.

    A document of fewer words than ``size`` has one shingle, its whole sequence; one without words has none.
    """
    h, at = K.word_hashes(K.LOWER[data], off, K.SPACED)
    n, count = len(h), np.diff(at)
    full = np.zeros(n, U64)
    if n >= size:
        m = n - size + 1
        for k in range(size):
            full[:m] = full[:m] * _STEP + h[k : m + k]
    full = K.mix(full)
    parts = []
    for q in range(len(count)):
        a, c = at[q], count[q]
        if c >= size:
            parts.append(np.unique(full[a : a + c - size + 1]))
        elif c:
            v = U64(c)
            with np.errstate(over="ignore"):
                for w in h[a : a + c]:
                    v = v * _STEP + w
            parts.append(K.mix(np.array([v], U64)))
        else:
            parts.append(np.zeros(0, U64))
    sets = np.concatenate(parts) if parts else np.zeros(0, U64)
    return sets, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def min_max_bands(sets: np.ndarray, off: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """Bands (documents x bands) of non-empty sets; a band holds minima or maxima of ``band_rows`` permutations."""
    low = np.empty((PERMUTATIONS, len(off) - 1), U64)
    high = np.empty_like(low)
    for k in range(PERMUTATIONS):
        v = sets * _A[k] + _B[k]
        low[k] = np.minimum.reduceat(v, off[:-1])
        high[k] = np.maximum.reduceat(v, off[:-1])
    bands = []
    for side in (low, high):
        for k in range(0, PERMUTATIONS, band_rows):
            key = np.full(side.shape[1], len(bands) + 1, U64)
            for row in side[k : k + band_rows]:
                key = K.mix(key * _STEP + row)
            bands.append(key)
    return np.stack(bands, axis=1)


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def _signatures(size: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in K.text_slices(b.column(1)):
                sets, at = shingle_sets(data, off, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                f1, f2 = _fingerprints(sets, at)
                lists = [[] for _ in range(j - i)]
                if len(some):
                    cut = np.concatenate([at[:-1][some], at[-1:]])
                    bands = min_max_bands(sets, cut, band_rows).view(np.int64)
                    width = np.zeros(j - i, np.int32)
                    width[some] = bands.shape[1]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(bands.ravel()))
                else:
                    lists = pa.array(lists, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"])
    return run


def _fingerprints(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that tell sets apart; 0 for an empty one."""
    total = lambda v: (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([np.zeros(1, U64), np.cumsum(v, dtype=U64)]))
    return total(sets), total(K.mix(sets ^ U64(0x5851F42D4C957F2D)))


def _sets_of(size: int):
    """(text, v, n_shingles, f1, f2) to (v, shingles) of the texts that have that set: other texts of a repeated id go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = [b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
            for i, j, data, off in K.text_slices(b.column(0)):
                sets, at = shingle_sets(data, off, size)
                have = (np.diff(at), *(x.view(np.int64) for x in _fingerprints(sets, at)))
                keep = np.logical_and.reduce([w[i:j] == h for w, h in zip(want, have, strict=True)])
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(sets)])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), blob], names=["v", "shingles"]).filter(pa.array(keep))
    return run


def linked_forest(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (100 * intersection >= percent * union) of a group of documents.

    sides: with both 0 and 1 present, only pairs between the sides count, as those within are another task's.
    Intersections are counted through the group's own inverted lists, for members not joined yet.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    side = np.array(sides)
    both = side.min() != side.max()
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate([first, [len(ranked)]]))
    of_token = np.empty(len(tokens), np.int64)
    of_token[order] = np.cumsum(new) - 1
    postings = owner[order]
    edge_of = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(n)
    out = []
    for i in range(n):
        rest = label != label[i]
        rest[: i + 1] = False
        if both:
            rest &= side != side[i]
        # sizes must be within the threshold's ratio
        rest &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if not rest.any():
            continue
        t = of_token[edge_of[i] : edge_of[i + 1]]
        t = t[length[t] > 1]
        runs = length[t]
        if not len(runs):
            continue
        at = np.repeat(first[t] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        inter = np.bincount(postings[at], minlength=n)
        hit = rest & (100 * inter >= percent * (size + size[i] - inter))
        for j in np.flatnonzero(hit):
            if label[j] != label[i]:
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


def _confirm(percent: int):
    """Rows sorted by group; gives the links of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (found := linked_forest(ids, sides, sets, percent)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        for b in batches:
            cluster, x, y, side, doc, blob = (b.column(k) for k in range(6))
            groups = list(zip(cluster.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True))
            data, off = K.buffers(blob)
            for r, (g, s, d) in enumerate(zip(groups, side.to_pylist(), doc.to_pylist(), strict=True)):
                if g != key:
                    yield from close()
                    key, ids, sides, sets = g, [], [], []
                ids.append(d)
                sides.append(s)
                sets.append(np.frombuffer(data[off[r] : off[r + 1]].tobytes(), U64))
        yield from close()
    return run


def _confirm_hubs(percent: int):
    """Rows (hub, part, is_member, v, shingles) sorted; gives the links of each part's members to their hub, whose row comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, np.zeros(0, U64)
        for b in batches:
            data, off = K.buffers(b.column(4))
            found = []
            for r, (h, p, member, v) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                own = np.frombuffer(data[off[r] : off[r + 1]].tobytes(), U64)
                if not member:
                    key, hub = (h, p), own
                elif key == (h, p):
                    at = np.searchsorted(hub, own)
                    inter = int(np.count_nonzero(hub[np.minimum(at, len(hub) - 1)] == own))
                    if 100 * inter >= percent * (len(hub) + len(own) - inter):
                        found.append((h, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    return run


def _hub_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of members (b) to their hubs (a). A hub's members are dealt into ``HUB_PARTS`` parts, and its set is repeated for those that have any."""
    members = stars.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)).cast("int").alias("part"), F.col("b").alias("v"), F.lit(1).alias("is_member"))
    hubs = members.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("v"), F.lit(0).alias("is_member"))
    rows = members.unionByName(hubs).join(sets.hint("merge"), "v").select("hub", "part", "is_member", "v", "shingles")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "is_member").mapInArrow(_confirm_hubs(percent), "a long, b long")


def _pair_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within clusters. placed: v, cluster, block, others (blocks to compare with, its own among them if it is to be compared within)."""
    tasks = (placed.select("v", "cluster", "block", F.explode("others").alias("other"))
             .select("v", "cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side")))
    rows = tasks.join(sets.hint("merge"), "v").select("cluster", "x", "y", "side", "v", "shingles")
    return rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "v").mapInArrow(_confirm(percent), "a long, b long")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join of rows (with v) that may be many for one key with a table of few rows, which is repeated for each part of a key."""
    few = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(few.hint("merge"), [*keys, "_part"], how).drop("_part")


def _blocks_left(big: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """Members of large clusters (v, cluster) with the blocks that they must still be compared with; clusters that are one confirmed component (v, component) have none.

    Members of small components share blocks, so only large components, one for ``block`` members at most, are numbered one by one.
    """
    rows = big.join(joined.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    sizes = rows.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0))
    blocks = F.ceil(F.col("n") / block).cast("int")
    totals = (sizes.groupBy("cluster").agg(F.count("*").alias("components"), F.ceil(small / block).cast("int").alias("mixed"), F.coalesce(F.sum(F.when(F.col("n") >= block, blocks)), F.lit(0)).cast("int").alias("own_all"))
              .where("components > 1").drop("components"))
    ahead = Window.partitionBy("cluster").orderBy("component")
    # its own blocks come after the shared ones and those of the large components before it
    pure = sizes.where(F.col("n") >= block).select("cluster", "component", blocks.alias("own"), (F.sum(blocks).over(ahead) - blocks).cast("int").alias("offset"))
    at = _salted(_salted(rows, totals, ["cluster"], "inner"), pure, ["cluster", "component"], "left")
    start = F.col("mixed") + F.col("offset")
    place = F.when(F.col("own").isNotNull(), start + F.pmod(F.xxhash64("v"), F.col("own"))).otherwise(F.pmod(F.xxhash64("v"), F.greatest("mixed", F.lit(1)))).cast("int")
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("own_all") - 1)
    inside = lambda k: F.coalesce((k >= start) & (k < start + F.col("own")), F.lit(False))
    return at.select("v", "cluster", place.alias("block"), F.filter(every, lambda k: ~inside(k)).alias("others"))


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, percent: int = 85, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    docs has doc_id and text; other columns are ignored. Null, empty and blank texts have no shingles and
    are linked with nothing. An empty table gives an empty result. A repeated doc_id stays repeated: its rows are linked by their texts, as any others are. Rows
    without an id have no component_id unless an equal set has one, and link no others.
    ``percent``: links need 100 * intersection >= percent * union; 80 or more suits the banding.
    """
    docs = docs.select("doc_id", "text")
    signed = save(docs.mapInArrow(_signatures(size, band_rows), _SIGNED), "signed")
    same = signed.where("n_shingles > 0")
    classes = same.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "bands")).alias("first"))
    classes = save(classes.select("n_shingles", "f1", "f2", "rep", F.col("first.bands").alias("bands"), F.monotonically_increasing_id().alias("v")), "classes")

    member = classes.where("rep is not null").select("v", F.explode("bands").alias("band"))
    hubs = member.groupBy("band").agg(F.min("v").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = save(member.join(hubs, "band").where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    clusters = connected_components(stars)

    sized = clusters.groupBy("component").agg(F.count("*").alias("m"))
    placed = save(clusters.join(sized, "component").select(F.col("id").alias("v"), F.col("component").alias("cluster"), (F.col("m") > block).alias("large")), "placed")
    wanted = placed.select("v").join(classes.select("v", "rep", "n_shingles", "f1", "f2"), "v").withColumnRenamed("rep", "doc_id")
    found = docs.join(wanted.hint("merge"), "doc_id").select("text", "v", "n_shingles", "f1", "f2").mapInArrow(_sets_of(size), "v long, shingles binary")
    # rows that repeat id and text bring a set twice
    sets = save(found.groupBy("v").agg(F.first("shingles").alias("shingles")), "sets")
    links = _pair_links(placed.where("not large").select("v", "cluster", F.lit(0).alias("block"), F.array(F.lit(0)).alias("others")), sets, percent)
    big = placed.where("large").select("v", "cluster")
    if not big.isEmpty():
        near_hub = save(_hub_links(stars.join(big.select(F.col("v").alias("a")), "a", "left_semi"), sets, percent), "near_hub")
        left = _blocks_left(big, connected_components(near_hub), block)
        links = links.unionByName(near_hub).unionByName(_pair_links(left, sets, percent))
    joined = connected_components(links).select(F.col("id").alias("v"), "component")
    # the smallest id of each component
    grouped = classes.select("v", "rep", "n_shingles", "f1", "f2").join(joined, "v", "left").withColumn("component", F.coalesce("component", "v"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = grouped.join(least, "component").select("n_shingles", "f1", "f2", "component_id")
    return (signed.select("doc_id", "n_shingles", "f1", "f2").join(final, ["n_shingles", "f1", "f2"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each group that ``near_duplicates`` links, with all its columns: that of the smallest doc_id, null being smaller than any.

    Rows are told apart by a stored key, so ids may be null or repeated. Rows without shingles are groups of their own.
    """
    keyed = save(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    groups = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), **options).select(F.col("doc_id").alias("key"), "component_id")
    named = groups.join(keyed.select("key", F.col("row.doc_id").alias("id")), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first")).select("first.key")
    return keyed.join(first, "key", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
