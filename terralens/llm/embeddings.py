"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, and original vectors for every decision.

A few rotations are learned on a bounded sample, thinned so that no group of copies rules it (principal axes, then turns that bring the axes' signs close to
the vectors). Their bits are cut into substrings, one a table; vectors that share a substring of one table, label and length meet. Before any pair
is made, vectors within half of the angle sought from their most frequent bucket head form a ball: all of a ball are linked, so copies cost a row
each, not a pair. A bucket's head is the vector that shares most buckets with others, the middle of a group. Balls that meet are compared by their heads;
what the triangle inequality decides for all members is counted, and only the rest is looked at vector by vector. Vectors that are balls of
their own are compared in blocks of a bucket, which give counts and a spanning forest of the links, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.components import connected_components
from terralens.llm.scratch import save

#: Vectors that the rotations are learned on; fewer where vectors are long, so that the sample stays below SAMPLE_NUMBERS.
SAMPLE, SAMPLE_NUMBERS = 4096, 1 << 20
ROUNDS = 30
#: What centring must leave of nine in ten unit vectors.
LEFT = 0.9
#: Random directions whose signs tell groups of the sample apart.
THIN = 12
#: Two vectors of cosine 0.98 share a bit with probability 0.94 and so none of 16 substrings of 20 bits with probability 0.006; of cosine 0.99, 0.0002.
TABLES, WIDTH = 16, 20
#: Balls of a bucket that are compared at once with as many others.
BLOCK = 128
#: Longer vectors are folded to this length by signed sums for their codes.
FOLD = 512
#: Angles are compared with this margin; what lies within it is decided on the vectors themselves.
MARGIN = 1e-6


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors in double precision) for each length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    return [(rows, values[start[rows][:, None] + np.arange(d)]) for d in np.unique(size) for rows in [np.flatnonzero(size == d)]]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fold(x: np.ndarray, dim: int) -> np.ndarray:
    """Vectors cut or filled with zeros to a length, and folded if that is long."""
    x = np.pad(x[:, :dim], ((0, 0), (0, max(0, dim - x.shape[1]))))
    if dim <= FOLD:
        return x
    x = np.pad(x * np.random.default_rng(1).choice([-1.0, 1.0], dim), ((0, 0), (0, -dim % FOLD)))
    return x.reshape(len(x), -1, FOLD).sum(1)


@dataclass
class Tables:
    """Substring t of a vector's code is that of columns t * width to (t + 1) * width."""

    dim: int
    mean: np.ndarray
    axes: np.ndarray
    width: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        bits = (fold(unit(x), self.dim) - self.mean) @ self.axes > 0
        n = bits.shape[1] // self.width
        value = bits.reshape(len(x), n, self.width) @ (1 << np.arange(self.width, dtype=np.int64))
        return value + (np.arange(n, dtype=np.int64) << self.width)


def rotation(v: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """The turn of centred, principal-axis vectors that iterative quantisation finds from a random start."""
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
        r = u @ w
    return r


def learn(sample: np.ndarray, dim: int, *, tables: int = TABLES, width: int = WIDTH, rounds: int = ROUNDS) -> Tables:
    """sample: unit vectors, folded. As many rotations as the tables' bits need, each from another start; the bits are mixed over the tables.

    Of vectors with the same signs in a few random directions only the first counts, so that the axes don't follow a large group of copies. As much of the mean is taken off
    as leaves vectors near to their length, so that near ones keep a small angle.
    """
    signs = sample @ np.random.default_rng(2).normal(size=(sample.shape[1], THIN)) > 0
    sample = sample[np.unique(signs @ (1 << np.arange(THIN)), return_index=True)[1]]
    mean = sample.mean(0)
    far = lambda share: np.quantile(np.sqrt(((sample - share * mean) ** 2).sum(1)), 0.1) >= LEFT
    mean = mean * next((share for share in (1.0, 0.75, 0.5, 0.25) if far(share)), 0.0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    need = tables * width
    made = np.concatenate([axes @ rotation(centred @ axes, k, rounds) for k in range(-(-need // axes.shape[1]))], 1)
    made = made[:, np.random.default_rng(0).permutation(made.shape[1])[:need]]
    return Tables(dim, mean, made, width)


def fit(vectors: DataFrame) -> Tables | None:
    """vectors: rid and embedding, all usable. Learns on the vectors of smallest hash; None if there are none."""
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if dim is None:
        return None
    most = min(SAMPLE, max(FOLD, SAMPLE_NUMBERS // dim))
    picked = vectors.orderBy(F.xxhash64("embedding", "rid"), "rid").limit(most).select("embedding").collect()
    return learn(np.concatenate([fold(unit(np.array([r.embedding], np.float64)), dim) for r in picked]), dim)


def _codes(found: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            subs = np.zeros((len(b), found.axes.shape[1] // found.width), np.int64)
            for rows, x in matrix(b.column(2)):
                subs[rows] = found.substrings(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * subs.shape[1], pa.int32()), pa.array(subs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["rid", "place", "subs"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys that others have too, and how many of them were seen together (in a batch). A task's first and last key may go on in another: their rows all come out."""
    held, before, opening = None, None, True
    for b in batches:
        if not len(b):
            continue
        # the last row of the batch before goes along, as it isn't known yet whether its key goes on
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        k = b.column(0).to_numpy()
        new = np.concatenate([[before is None or k[0] != before], k[1:] != k[:-1]])
        busy = ~new | np.concatenate([~new[1:], [True]])
        busy[0] |= opening
        opening = opening and len(k) == 1
        run = np.cumsum(new) - new[0]
        counted = b.append_column("n", pa.array(np.bincount(run)[run]))
        out = counted.slice(0, len(b) - 1).filter(pa.array(busy[:-1]))
        before = k[-2] if len(k) > 1 else before
        held, last = b.slice(len(b) - 1), counted.slice(len(b) - 1)
        if len(out):
            yield out
    if held is not None:
        yield last


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, each with the first row that its key has in this task."""
    key, head = None, None
    for b in batches:
        if len(b):
            k, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            first = rid[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            if not new[0]:
                first[np.cumsum(new) == 0] = head
            key, head = k[-1], first[-1]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(first)], names=["rid", "head"])


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric matrix of links connects, less than one a row."""
    left, edges = np.ones(len(near), bool), []
    for k in range(len(near)):
        if left[k]:
            left[k] = False
            todo = [k]
            while todo:
                i = todo.pop()
                found = np.flatnonzero(near[i] & left)
                left[found] = False
                edges += [(i, int(j)) for j in found]
                todo += found.tolist()
    return edges


_COMPARED = "kind string, a long, b long, n long"


def _compare(tables: Tables, least: float):
    """Blocks of buckets. Rows of kind pair: balls, not both single, that may have links; count: a single vector's links to single ones, each in the first table that both share; edge: links that connect these."""
    theta = math.acos(least)

    def unit_rows(rows: list[tuple]) -> Iterator[tuple]:
        x = unit(np.array([r[7] for r in rows], np.float64))
        ball, side, single, r = (np.array([row[k] for row in rows]) for k in (4, 3, 5, 6))
        cosine = np.clip(x @ x.T, -1, 1)
        apart = side[:, None] != side[None] if rows[0][1] != rows[0][2] else ~np.eye(len(rows), dtype=bool)
        both = single[:, None] & single[None]
        maybe = apart & ~both & (np.arccos(cosine) <= theta + r[:, None] + r[None] + MARGIN)
        for i, j in zip(*np.nonzero(np.triu(maybe | maybe.T)), strict=True):
            yield "pair", int(min(ball[i], ball[j])), int(max(ball[i], ball[j])), 0
        near = apart & both & (cosine >= least)
        if near.any():
            subs = tables.substrings(x)
            t = rows[0][8]
            before = np.zeros_like(near)
            for u in range(t):
                before |= subs[:, u][:, None] == subs[:, u][None]
            n = (near & ~before).sum(1)
            yield from (("count", int(ball[i]), 0, int(n[i])) for i in np.flatnonzero(n))
            yield from (("edge", int(ball[i]), int(ball[j]), 0) for i, j in _forest(near))

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    out += unit_rows(rows)
                    rows = []
                    if len(out) > 10_000:
                        yield pack(out)
                        out = []
                rows.append(row)
        if rows:
            out += unit_rows(rows)
        if out:
            yield pack(out)
    return run


def with_cosine(df: DataFrame, left: str, right: str) -> DataFrame:
    """The other columns and cosine, -1 for vectors of different lengths."""
    rest = [c for c in df.columns if c not in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(len(b), -1.0)
            a, c = b.column(len(rest)), b.column(len(rest) + 1)
            same = np.flatnonzero(a.value_lengths().to_numpy(zero_copy_only=False) == c.value_lengths().to_numpy(zero_copy_only=False))
            take = pa.array(same, pa.int64())
            for (rows, x), (_, y) in zip(matrix(a.take(take)), matrix(c.take(take)), strict=True):
                out[same[rows]] = (unit(x) * unit(y)).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(out)], names=[*rest, "cosine"])

    fields = df.select(*rest, F.lit(None).cast("double").alias("cosine")).schema
    return df.select(*rest, left, right).mapInArrow(run, fields)


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def _links(tables: Tables, stars: DataFrame, busy: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(members: rid, vec_id, ball, n_links) and (links that connect balls: a, b)."""
    c = F.col
    theta = math.acos(least)
    heads = _named(busy, head="rid", other="label", v="embedding")
    near = with_cosine(busy.where("head <> rid").select("rid", "label", "embedding", "head").join(heads, "head").where("label = other").select("rid", "head", "embedding", "v"), "embedding", "v")
    angle = F.acos(F.least(c("cosine"), F.lit(1.0)))
    placed = near.withColumn("r", angle).where(c("r") < theta / 2 - MARGIN).select("rid", c("head").alias("ball"), "r")
    members = save(busy.select("rid", "vec_id").join(placed, "rid", "left").select("rid", "vec_id", F.coalesce("ball", "rid").alias("ball"), F.coalesce("r", F.lit(0.0)).alias("r")), "members")
    balls = save(members.groupBy("ball").agg(F.count("*").alias("n"), F.max("r").alias("r"), ((F.count("*") == 1) & F.bool_or(c("rid") == c("ball"))).alias("single")), "balls")

    met = save(stars.join(members.select("rid", "ball"), "rid").select("key", "t", "ball").distinct(), "met")
    blocks = met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(c("m") / BLOCK).cast("int").alias("blocks"))
    at = met.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("ball"), c("blocks").cast("long")).cast("int"))
    units = at.select("key", "t", "ball", "block", F.explode(F.sequence(F.lit(0), c("blocks") - 1)).alias("other"))
    units = units.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (c("block") > c("other")).cast("int").alias("side"), "ball", "t")
    held = units.join(balls, "ball").join(_named(busy, ball="rid", v="embedding"), "ball").select("key", "x", "y", "side", "ball", "single", "r", "v", "t")
    compared = save(held.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_compare(tables, least), _COMPARED), "compared")
    pairs = compared.where("kind = 'pair'").select("a", "b").distinct()
    # a ball's head needn't be a member of it, but it is a stored vector
    whole = balls.drop("single").join(_named(busy, ball="rid", label="label", v="embedding"), "ball")
    side = lambda x: _named(whole, **{x: "ball", f"n{x}": "n", f"r{x}": "r", f"l{x}": "label", f"v{x}": "v"})
    held = with_cosine(pairs.join(side("a"), "a").join(side("b"), "b").where("la = lb").drop("la", "lb"), "va", "vb")
    reach = c("ra") + c("rb")
    verdict = (F.when(angle + reach <= theta - MARGIN, "all").when(angle - reach > theta + MARGIN, "none").otherwise("some"))
    judged = save(held.withColumn("verdict", verdict).where("verdict <> 'none'").select("a", "b", "na", "nb", "ra", "rb", "verdict"), "ball_pairs")
    full, some = judged.where("verdict = 'all'"), judged.where("verdict = 'some'")

    # members against the other ball's head
    turned = _named(some, ball="a", other="b", n="nb", r="rb").unionByName(_named(some, ball="b", other="a", n="na", r="ra"))
    mine = members.select("rid", "ball").join(_named(busy, rid="rid", v="embedding"), "rid")
    seen = with_cosine(turned.join(mine, "ball").join(_named(busy, other="rid", w="embedding"), "other"), "v", "w")
    how = F.when(angle + c("r") <= theta - MARGIN, "all").when(angle - c("r") > theta + MARGIN, "none").otherwise("some")
    seen = save(seen.withColumn("how", how).where("how <> 'none'").select("ball", "other", "rid", "n", "how"), "ball_members")
    sure, open_ = seen.where("how = 'all'"), seen.where("how = 'some'")
    sure_of = sure.groupBy("ball", "other").agg(F.count("*").alias("n"))
    by_sure = open_.select("rid", "ball", "other").join(_named(sure_of, other="ball", ball="other", n="n"), ["ball", "other"]).select("rid", "ball", "other", "n")
    # what is left, vector by vector
    vec = _named(busy, rid="rid", v="embedding")
    x = _named(open_.where("ball < other"), a="ball", b="other", x="rid").join(_named(vec, x="rid", vx="v"), "x")
    y = _named(open_.where("ball > other"), a="other", b="ball", y="rid").join(_named(vec, y="rid", vy="v"), "y")
    exact = save(with_cosine(x.join(y, ["a", "b"]), "vx", "vy").where(c("cosine") >= least).select("a", "b", "x", "y"), "exact")

    links = compared.where("kind = 'edge'").select("a", "b").unionByName(full.select("a", "b")).unionByName(sure.select(c("ball").alias("a"), c("other").alias("b"))).unionByName(exact.select("a", "b"))
    alone = _named(compared.where("kind = 'count'"), ball="a", n="n")
    by_ball = _named(full, ball="a", n="nb").unionByName(_named(full, ball="b", n="na")).unionByName(alone).groupBy("ball").agg(F.sum("n").alias("more"))
    by_rid = (sure.select("rid", "n").unionByName(by_sure.select("rid", "n")).unionByName(exact.select(c("x").alias("rid"), F.lit(1).cast("long").alias("n")))
              .unionByName(exact.select(c("y").alias("rid"), F.lit(1).cast("long").alias("n"))).groupBy("rid").agg(F.sum("n").alias("extra")))
    counts = members.join(balls.join(by_ball, "ball", "left").select("ball", (c("n") - 1 + F.coalesce("more", F.lit(0))).alias("n")), "ball").join(by_rid, "rid", "left")
    return counts.select("rid", "vec_id", "ball", (c("n") + F.coalesce("extra", F.lit(0))).alias("n_links")), links


def near_duplicates(vectors: DataFrame, *, least: float = 0.98) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links, its own included), kept (vec_id = component_id).

    vectors has vec_id, embedding and label; other columns are ignored. Rows of equal, not null label are linked if the cosine of their vectors, in double
    precision, is ``least`` or more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. One row comes
    back for each, repeated or null ids too: a row without an id is linked as any other, has the id of its component, null if that has none, and isn't kept.
    An empty table gives an empty result. Links are complete but for pairs that share no substring (``TABLES``).
    """
    c = F.col
    number = lambda x: x.cast("double")
    bad = lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf"))
    ok = c("label").isNotNull() & c("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: number(x) != 0)
    stored = save(vectors.select("vec_id", "label", "embedding", F.coalesce(ok, F.lit(False)).alias("ok"), F.monotonically_increasing_id().alias("rid")), "vectors")
    good = stored.where("ok").select("rid", "vec_id", "label", "embedding")
    tables = fit(good)
    if tables is None:
        return stored.select("vec_id", F.lit(0).cast("long").alias("n_links"), c("vec_id").alias("component_id"), c("vec_id").isNotNull().alias("kept"))
    coded = good.select("rid", F.xxhash64("label", F.size("embedding")).alias("place"), "embedding").mapInArrow(_codes(tables), "rid long, place long, subs array<long>")
    keyed = coded.select("rid", "place", F.explode("subs").alias("sub")).select(F.xxhash64("place", "sub").alias("key"), "rid", F.shiftright("sub", tables.width).cast("int").alias("t"))
    stars = save(keyed.repartitionByRange("key", "rid").sortWithinPartitions("key").mapInArrow(_shared, "key long, rid long, t int, n long"), "stars")
    # how many others a vector meets over all tables; the one that meets most is its buckets' head. A bucket that is cut by the ranges has a head in each
    met = stars.groupBy("rid").agg(F.sum("n").alias("met"))
    ranked = stars.select("key", "rid").join(met, "rid").repartitionByRange("key", "rid").sortWithinPartitions("key", F.desc("met"), "rid")
    head = ranked.select("key", "rid").mapInArrow(_heads, "rid long, head long").groupBy("rid").agg(F.mode("head", True).alias("head"))
    busy = save(good.join(head, "rid"), "busy")
    members, links = _links(tables, stars, busy, least)
    members = save(members, "counted")
    joined = connected_components(links)
    balls = members.groupBy("ball").agg(F.min("vec_id").alias("low")).join(_named(joined, ball="id", component="component"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    lowest = balls.groupBy("component").agg(F.min("low").alias("component_id"))
    named = members.select("rid", "ball", "n_links").join(balls.join(lowest, "component").select("ball", "component_id"), "ball").select("rid", "n_links", "component_id")
    return (stored.select("rid", "vec_id").join(named, "rid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(c("vec_id") == c("component_id"), F.lit(False))))
