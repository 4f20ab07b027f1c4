"""Aggregates of the points in a box around each sample, without a row for each pair.

Right points are dealt into large cells (a quadtree where they are dense) and samples go to each cell that their box touches. A task holds the points of one
cell, sorted, and answers its samples in batches; the answers of a sample's cells are brought together by the caller. What is shuffled is the points once, the samples
once for each cell and the answers, so it grows with the tables and not with the pairs. Where answers are larger than points (``surroundings``), samples go to one cell and points to
each cell that they can be seen from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.operators import spatial

#: A cell is this many reaches wide and high.
SPAN = 16
#: A cell with more points than this is split.
DENSE = 1_000_000
#: The same where a cell gives the whole answer and so gets the points around it too; a sample counts as so many points.
WHOLE, SAMPLE = 2_000_000, 8
#: Points of a cell that are indexed at once where its answers are added up.
PART = 1_000_000
#: Classes with fewer points than this in a cell are counted point by point.
FEW = 64
NO_ORD = (1 << 63) - 1
EARTH_M = 6371000.0


class Ranks:
    """Points sorted by longitude, with the bits of their latitude ranks by levels (a wavelet matrix): counts in boxes take a step a level."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        order = np.argsort(lon, kind="stable")
        self.lon, lat = lon[order], lat[order]
        self.lat = np.sort(lat)
        rank = np.empty(len(lat), np.int64)
        rank[np.argsort(lat, kind="stable")] = np.arange(len(lat))
        self.levels = []
        for k in reversed(range(max(1, len(lat).bit_length()))):
            bit = (rank >> k) & 1
            self.levels.append((k, np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32)))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def below(self, i: np.ndarray, j: np.ndarray, top: np.ndarray) -> np.ndarray:
        """How many of the points i to j (by longitude) have a latitude rank below ``top``."""
        n = np.zeros(len(i), np.int64)
        for k, zeros in self.levels:
            a, b, one = zeros[i], zeros[j], ((top >> k) & 1).astype(bool)
            n += np.where(one, b - a, 0)
            i, j = np.where(one, i - a + zeros[-1], a), np.where(one, j - b + zeros[-1], b)
        return n

    def count(self, lat, lon, dy, dx) -> np.ndarray:
        i, j = span(self.lon, lon, dx)
        low, high = span(self.lat, lat, dy)
        return self.below(i, j, high) - self.below(i, j, low)


def span(values: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the sorted values for which abs(value - at) < reach, as doubles subtract."""
    if not len(values):
        return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    u, first = np.unique(values, return_index=True)
    first = np.append(first, len(values))

    def edge(k, inside):
        # quotients and sums are rounded: step over values that the subtraction judges otherwise
        while True:
            back = (k > 0) & inside(u[np.maximum(k - 1, 0)])
            ahead = ~back & (k < len(u)) & ~inside(u[np.minimum(k, len(u) - 1)])
            if not (back.any() or ahead.any()):
                return k
            k = k - back + ahead
    low = edge(np.searchsorted(u, at - reach, "right"), lambda v: v - at > -reach)
    high = edge(np.searchsorted(u, at + reach, "left"), lambda v: v - at >= reach)
    return first[low], first[np.maximum(low, high)]


def _each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places a[row] to b[row]."""
    n = b - a
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - a, n)


class Classes:
    """Counts of each class of points and its smallest ``ord`` in boxes; a class whose ``ord`` is ``NO_ORD`` isn't searched for it."""

    SCHEMA = "sample_id string, key string, n long, o long"

    def __init__(self, points: pa.Table):
        code = points.column("key").combine_chunks().dictionary_encode()
        self.names = code.dictionary
        self.of(len(self.names), code.indices.to_numpy(), *(points.column(c).to_numpy() for c in ("lat", "lon", "ord")))

    def of(self, names: int, code: np.ndarray, lat: np.ndarray, lon: np.ndarray, order: np.ndarray) -> None:
        """Points of classes that are given by numbers below ``names``."""
        self.size = max(1, names)
        at = np.lexsort((order, code))
        lat, lon, order, code = lat[at], lon[at], order[at], code[at]
        edge = np.searchsorted(code, np.arange(names + 1))
        few = np.diff(edge) < FEW
        self.many = [(k, lat[a:b], lon[a:b], order[a:b], Ranks(lat[a:b], lon[a:b])) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if not few[k]]
        rest = np.flatnonzero(few[code])
        rest = rest[np.argsort(lat[rest], kind="stable")]
        self.few = lat[rest], lon[rest], order[rest], code[rest]

    def found(self, lat, lon, dy, dx) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sample, class, n, o) of the classes in each box."""
        out = []
        y, x, order, code = self.few
        row, at = _each(*span(y, lat, dy))
        near = np.abs(x[at] - lon[row]) < dx[row]
        key, place, n = np.unique(row[near] * self.size + code[at[near]], return_inverse=True, return_counts=True)
        low = np.full(len(key), NO_ORD)
        np.minimum.at(low, place, order[at[near]])
        out.append((key // self.size, key % self.size, n, low))
        for k, y, x, order, ranks in self.many:
            n = ranks.count(lat, lon, dy, dx)
            row = np.flatnonzero(n)
            low = np.full(len(row), NO_ORD)
            if order[0] != NO_ORD:
                # the points come in the order of ord, so the first one within is sought in blocks; a box that holds a fair share is soon done
                left, a, step = np.arange(len(row)), 0, 8
                while len(left):
                    for c in range(0, len(left), max(1, (1 << 22) // step)):
                        part = left[c : c + max(1, (1 << 22) // step)]
                        r = row[part]
                        hit = (np.abs(y[None, a : a + step] - lat[r, None]) < dy[r, None]) & (np.abs(x[None, a : a + step] - lon[r, None]) < dx[r, None])
                        low[part] = np.where(hit.any(1), order[a + hit.argmax(1)], np.iinfo(np.int64).min)
                    left, a, step = left[low[left] == np.iinfo(np.int64).min], a + step, min(2 * step, 1 << 12)
            out.append((row, np.full(len(row), k), n[row], low))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def answer(self, some: pa.RecordBatch) -> pa.RecordBatch:
        row, code, n, low = self.found(*(some.column(c).to_numpy() for c in ("lat", "lon", "dy", "dx")))
        return pa.RecordBatch.from_arrays([some.column("sample_id").take(pa.array(row)), self.names.take(pa.array(code)), pa.array(n, pa.int64()), pa.array(low, pa.int64())], names=["sample_id", "key", "n", "o"])


class Nearest:
    """The nearest point in each box, by planar squared degrees or on the sphere; of equals the first by (a, b).

    Points lie in rows, sorted by longitude. A square about the sample is doubled until its nearest point is nearer than anything outside it can be, so what is looked at doesn't grow with the density.
    """

    SCHEMA = "sample_id string, lat double, lon double, rlat double, rlon double, d double, a long, b long"
    #: Points that are looked at in one go.
    BLOCK = 1 << 21
    sphere = False

    def __init__(self, points: pa.Table):
        lat, lon, a, b = (points.column(c).to_numpy() for c in ("lat", "lon", "a", "b"))
        self.south, self.west = lat.min(), lon.min()
        high, wide = np.ptp(lat) + 1e-9, np.ptp(lon) + 1e-9
        self.area = high * wide / len(lat)
        self.rows = max(1, int(np.sqrt(len(lat) / 4)))
        self.height, self.wide = high / self.rows, wide * 4 + 1
        row = ((lat - self.south) // self.height).astype(np.int64)
        at = np.lexsort((lon, row))
        self.lat, self.lon, self.a, self.b = lat[at], lon[at], a[at], b[at]
        self.key = row[at] * self.wide + (self.lon - self.west)
        self.rank = np.empty(len(at), np.int64)
        self.rank[np.lexsort((self.b, self.a))] = np.arange(len(at))

    def _look(self, lat, lon, dy, dx, h, hx):
        """(d, rank's place) of the nearest in the square of half sides h and hx; place -1 without one."""
        eps = 1e-9
        low = np.clip((lat - h - eps - self.south) // self.height, 0, self.rows - 1).astype(np.int64)
        high = np.clip((lat + h + eps - self.south) // self.height, 0, self.rows - 1).astype(np.int64)
        s, r = _each(low, high + 1)
        west = np.clip(lon[s] - hx[s] - eps - self.west, -1e-6, self.wide / 2)
        east = np.clip(lon[s] + hx[s] + eps - self.west, -1e-6, self.wide / 2)
        i, j = np.searchsorted(self.key, r * self.wide + west), np.searchsorted(self.key, r * self.wide + east, "right")
        j = np.maximum(i, j)
        best, place = np.full(len(lat), np.inf), np.full(len(lat), -1)
        # rows of a square are split between blocks, so a dense one needs no more memory
        total = np.concatenate([[0], np.cumsum(j - i)])
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + self.BLOCK, self.BLOCK)))
        for c, e in zip(cuts[:-1], cuts[1:], strict=True):
            k, p = _each(i[c:e], j[c:e])
            k = s[c:e][k]
            y, x = self.lat[p] - lat[k], self.lon[p] - lon[k]
            ok = (np.abs(y) < dy[k]) & (np.abs(x) < dx[k])
            k, p, y, x = k[ok], p[ok], y[ok], x[ok]
            d = y * y + x * x
            if self.sphere:
                u = np.sin(np.radians(y) / 2) ** 2 + np.cos(np.radians(lat[k])) * np.cos(np.radians(self.lat[p])) * np.sin(np.radians(x) / 2) ** 2
                d = EARTH_M * 2 * np.arctan2(np.sqrt(u), np.sqrt(1 - u))
            o = np.lexsort((self.rank[p], d, k))
            k, p, d = k[o], p[o], d[o]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            k, p, d = k[new], p[new], d[new]
            better = (d < best[k]) | ((d == best[k]) & (self.rank[p] < self.rank[place[k]]))
            best[k[better]], place[k[better]] = d[better], p[better]
        return best, place

    def found(self, lat, lon, dy, dx) -> tuple[np.ndarray, np.ndarray]:
        """(d, place) of the nearest point in each box; place -1 without one."""
        best, place = np.full(len(lat), np.inf), np.full(len(lat), -1)
        left = np.arange(len(lat))
        share = np.clip(np.sqrt(2 * self.area / np.maximum(dy * dx, 1e-300)), 1 / 1024, 1.0)
        while len(left):
            h, hx = share[left] * dy[left], share[left] * dx[left]
            best[left], place[left] = self._look(lat[left], lon[left], dy[left], dx[left], h, hx)
            if self.sphere:
                sure = EARTH_M * np.minimum(np.radians(h), np.arcsin(np.clip(np.cos(np.radians(lat[left])) * np.sin(np.radians(np.minimum(hx, 90.0))), 0, 1)))
            else:
                sure = np.minimum(h, hx) ** 2
            left = left[(share[left] < 1) & ~(best[left] < sure * (1 - 1e-6))]
            share[left] = np.minimum(1.0, share[left] * 2)
        return best, place

    def answer(self, some: pa.RecordBatch) -> pa.RecordBatch:
        lat, lon, dy, dx = (some.column(c).to_numpy() for c in ("lat", "lon", "dy", "dx"))
        best, place = self.found(lat, lon, dy, dx)
        row = np.flatnonzero(place >= 0)
        p = place[row]
        return pa.RecordBatch.from_arrays([some.column("sample_id").take(pa.array(row)), *(pa.array(v) for v in (lat[row], lon[row], self.lat[p], self.lon[p], best[row], self.a[p], self.b[p]))],
                                          names=["sample_id", "lat", "lon", "rlat", "rlon", "d", "a", "b"])


class NearestOnSphere(Nearest):
    sphere = True


class Thinned:
    """How many points are kept around a sample, if those within a box and a distance on the sphere are taken by ``ord`` and each is kept that has no kept one within ``gap`` in both axes.

    Points of one place count once, as the first of them excludes the others or is excluded with them. A sample's points are read in order, in growing blocks, and a kept one marks those near it; what is near a
    point is held for the next samples, up to a limit. At most four kept points are near any one, so the work for a sample grows with its points, and nothing is written for a pair.
    """

    #: Places that are found in one go, and held in all.
    BLOCK, HELD = 1 << 20, 1 << 24
    EPS = 1e-9

    def __init__(self, points: pa.Table, box: float, metres: float, gap: float):
        lat, lon, order = (points.column(c).to_numpy() for c in ("lat", "lon", "ord"))
        at = np.lexsort((lon, lat, order))
        lat, lon = lat[at], lon[at]
        at = np.lexsort((np.arange(len(lat)), lon, lat))
        first = np.ones(len(at), bool)
        first[1:] = (lat[at[1:]] != lat[at[:-1]]) | (lon[at[1:]] != lon[at[:-1]])
        at = np.sort(at[first])
        self.lat, self.lon = lat[at], lon[at]
        self.box, self.gap = box, gap
        self.metres, self.limit = metres, np.sin(metres / EARTH_M / 2) ** 2
        self.margin = np.radians(box) ** 2 + 1e-9
        self.south, self.west = self.lat.min(), self.lon.min()
        self.height = max(gap, np.ptp(self.lat) / (1 << 20))
        self.rows = int(np.ptp(self.lat) // self.height) + 1
        self.wide = np.ptp(self.lon) * 1.5 + 1
        row = np.clip((self.lat - self.south) // self.height, 0, self.rows - 1).astype(np.int64)
        self.at = np.lexsort((self.lon, row)).astype(np.int32)
        self.key = row[self.at] * self.wide + (self.lon[self.at] - self.west)
        self.y, self.x = self.lat[self.at], self.lon[self.at]
        self.cos = np.cos(np.radians(self.y))
        self.mark = bytearray(len(self.lat))
        self.marks = np.frombuffer(self.mark, np.uint8)
        self.held, self.size = {}, 0

    def _ranges(self, lat, lon, dy: float, dx: float):
        """(point, first, end) of the places, row by row, that hold all within dy and dx."""
        low = np.clip((lat - dy - self.EPS - self.south) // self.height, 0, self.rows).astype(np.int64)
        high = np.clip((lat + dy + self.EPS - self.south) // self.height, -1, self.rows - 1).astype(np.int64)
        s, r = _each(low, np.maximum(low, high + 1))
        west = np.clip(lon[s] - dx - self.EPS - self.west, -1e-6, self.wide - 0.5)
        east = np.clip(lon[s] + dx + self.EPS - self.west, -1e-6, self.wide - 0.5)
        i = np.searchsorted(self.key, r * self.wide + west)
        return s, i, np.maximum(i, np.searchsorted(self.key, r * self.wide + east, "right"))

    def _hold(self, some: list[int]) -> None:
        k = np.array(some)
        s, i, j = self._ranges(self.lat[k], self.lon[k], self.gap, self.gap)
        total = np.cumsum(np.bincount(s, j - i, len(k)))
        n = max(1, int(np.searchsorted(total, self.BLOCK, "right")))
        i, j, s = i[s < n], j[s < n], s[s < n]
        row, at = _each(i, j)
        k = k[:n]
        row = s[row]
        near = (np.abs(self.y[at] - self.lat[k[row]]) < self.gap) & (np.abs(self.x[at] - self.lon[k[row]]) < self.gap)
        row, at = row[near], self.at[at[near]]
        if self.size + len(at) > self.HELD:
            self.held, self.size = {}, 0
        self.size += len(at)
        edge = np.searchsorted(row, np.arange(n + 1)).tolist()
        for m, a, b in zip(k.tolist(), edge[:-1], edge[1:], strict=True):
            self.held[m] = at[a:b]

    def within(self, lat: float, lon: float) -> np.ndarray:
        """The points strictly within the box and no farther than the distance, in their order."""
        _, i, j = self._ranges(np.array([lat]), np.array([lon]), self.box, self.box)
        at = _each(i, j)[1]
        y, x = self.y[at] - lat, self.x[at] - lon
        u, v = np.radians(y) / 2, np.radians(x) / 2
        c = np.cos(np.radians(lat)) * self.cos[at]
        # half angles for their sines; what lies at the edge is judged by the sines
        d = u * u + c * v * v
        ok = (np.abs(y) < self.box) & (np.abs(x) < self.box) & (d <= self.limit * (1 + self.margin) + 1e-300)
        edge = np.flatnonzero(ok & (d >= self.limit * (1 - self.margin)))
        h = np.sin(u[edge]) ** 2 + c[edge] * np.sin(v[edge]) ** 2
        ok[edge] = EARTH_M * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) <= self.metres
        return np.sort(self.at[at[ok]])

    def kept(self, lat: float, lon: float) -> list[int]:
        points, out, a, step, mark, marks = self.within(lat, lon), [], 0, 128, self.mark, self.marks
        while a < len(points):
            part = points[a : a + step]
            part = part[marks[part] == 0].tolist()
            for n, k in enumerate(part):
                if mark[k]:
                    continue
                near = self.held.get(k)
                if near is None:
                    self._hold([k, *(m for m in part[n + 1 : n + 64] if not mark[m] and m not in self.held)])
                    near = self.held[k]
                out.append(k)
                marks[near] = 1
            a, step = a + step, min(2 * step, 1 << 13)
        marks.fill(0)
        return out

    def answer(self, some: pa.RecordBatch) -> pa.RecordBatch:
        lat, lon = (some.column(c).to_numpy() for c in ("lat", "lon"))
        n = [len(self.kept(y, x)) for y, x in zip(lat.tolist(), lon.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([some.column("lat"), some.column("lon"), pa.array(n, pa.int64())], names=["lat", "lon", "n"])


CATEGORIES = ["building", "amenity", "landuse", "park", "road", "signal", "water"]
#: Categories whose values count, and of these, the ones whose values have an order.
VALUED, ORDERED = ["building", "amenity", "landuse", "road"], ["building", "landuse", "road"]
#: Between the parts of what an element is.
_SEP = "\x1f"


def _first(row: np.ndarray, most: int) -> np.ndarray:
    """True for the first ``most`` of each row number; these come sorted."""
    start = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    return np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0)) < most if len(row) else start


class Around:
    """All that lies around the samples of a cell. Points come in parts, each of which is indexed, asked and forgotten, so memory grows with the samples and a part."""

    SCHEMA = ("sample_id string, lat double, lon double, water_lat double, water_lon double, buildings long, median_levels double, building_types array<struct<key: string, value: bigint>>, amenities long, "
              "amenity_types array<string>, landuse string, parks long, surface string, roads long, roundabouts long, bridges long, signals long")
    #: Samples that are asked for at once.
    ASKED = 8192

    def __init__(self, ids: pa.Array, lat: np.ndarray, lon: np.ndarray, dx: np.ndarray, dy: float):
        self.ids, self.lat, self.lon, self.dx, self.dy = ids, lat, lon, dx, np.full(len(lat), dy)
        self.keys: dict[tuple[str, str], int] = {}
        none = np.zeros(0, np.int64)
        self.sums = none, none, none, none  # sample, key, n, smallest ord
        self.near = np.full(len(lat), np.inf)
        self.water = np.full((2, len(lat)), np.nan)

    def _key(self, kind: str, value: str) -> int:
        return self.keys.setdefault((kind, value), len(self.keys))

    def add(self, points: pa.Table) -> None:
        what = points.column("what").combine_chunks().dictionary_encode()
        lat, lon, order = (points.column(c).to_numpy() for c in ("lat", "lon", "ord"))
        code, texts = what.indices.to_numpy(), what.dictionary.to_pylist()
        # an element counts for its category, its value, its levels and its marks; the first seen matters for values only
        ways = np.full((5, len(texts)), -1)
        water = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            category, marks, levels, value = text.split(_SEP, 3)
            water[k] = category == "water"
            ways[0, k] = self._key("category", category)
            if value:
                ways[1, k] = self._key(category, value)
            if levels:
                ways[2, k] = self._key("levels", levels)
            for m, mark in enumerate(("roundabout", "bridge")):
                if marks[m] == "1":
                    ways[3 + m, k] = self._key("mark", mark)
        parts = [(ways[w, code], lat, lon, order if w == 1 else np.full(len(lat), NO_ORD)) for w in range(5)]
        parts = [tuple(x[p[0] >= 0] for x in p) for p in parts]
        index = Classes.__new__(Classes)
        index.of(len(self.keys), *(np.concatenate(c) for c in zip(*parts, strict=True)))
        del parts
        near = None
        if water.any():
            places = np.unique(np.stack([lat[water[code]], lon[water[code]]]), axis=1)
            zero = np.zeros(places.shape[1], np.int64)
            near = NearestOnSphere(pa.table({"lat": places[0], "lon": places[1], "a": zero, "b": zero}))
        found = [self.sums]
        for k in range(0, len(self.lat), self.ASKED):
            some = slice(k, k + self.ASKED)
            box = self.lat[some], self.lon[some], self.dy[some], self.dx[some]
            row, key, n, o = index.found(*box)
            found.append((row + k, key, n, o))
            if near is not None:
                d, place = near.found(*box)
                at = np.flatnonzero((place >= 0) & (d < self.near[some]))
                self.near[at + k], self.water[0, at + k], self.water[1, at + k] = d[at], near.lat[place[at]], near.lon[place[at]]
        row, key, n, o = (np.concatenate(c) for c in zip(*found, strict=True))
        at = np.lexsort((key, row))
        row, key, n, o = row[at], key[at], n[at], o[at]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
        self.sums = row[new], key[new], *((np.add.reduceat(n, new), np.minimum.reduceat(o, new)) if len(new) else (n, o))

    def answer(self, top: int) -> pa.RecordBatch:
        row, key, n, o = self.sums
        size = len(self.lat)
        names = list(self.keys)
        kind_of = np.array([k for k, _ in names], object)
        # places of names in their order
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=lambda k: names[k][1])] = np.arange(len(names))
        values = pa.array([v for _, v in names], pa.string())

        def total(kind: str, value: str) -> pa.Array:
            out = np.zeros(size, np.int64)
            k = self.keys.get((kind, value))
            at = np.flatnonzero(key == k) if k is not None else []
            out[row[at]] = n[at]
            return pa.array(out)

        def best(kind: str, most: int, by_name: bool = False) -> np.ndarray:
            """The entries of a kind's first values of each sample: by number and first seen, or by name."""
            at = np.flatnonzero(np.isin(key, np.flatnonzero(kind_of == kind)))
            at = at[np.lexsort((place[key[at]], *(() if by_name else (o[at], -n[at])), row[at]))]
            return at[_first(row[at], most)]

        def lists(at: np.ndarray, items: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(size + 1)), pa.int32()), items)

        def one(at: np.ndarray) -> pa.Array:
            out = np.full(size, -1)
            out[row[at]] = key[at]
            return values.take(pa.array(out, mask=out < 0))
        # the upper median of levels: how often each occurs, in their order
        number = np.array([float(v) if k == "levels" else 0.0 for k, v in names])
        at = np.flatnonzero(np.isin(key, np.flatnonzero(kind_of == "levels")))
        at = at[np.lexsort((number[key[at]], row[at]))]
        seen = np.cumsum(n[at])
        edge = np.searchsorted(row[at], np.arange(size + 1))
        before = np.concatenate([[0], seen])[edge]
        there = np.flatnonzero(np.diff(edge))
        median = np.zeros(size)
        median[there] = number[key[at]][np.searchsorted(seen, before[there] + np.diff(before)[there] // 2, "right")]
        types, amenity = best("building", top), best("amenity", 10, True)
        wet = np.isnan(self.water[0])
        columns = [self.ids, self.lat, self.lon, pa.array(self.water[0], mask=wet), pa.array(self.water[1], mask=wet), total("category", "building"), pa.array(median, mask=np.diff(edge) == 0),
                   lists(types, pa.StructArray.from_arrays([values.take(pa.array(key[types])), pa.array(n[types])], ["key", "value"])), total("category", "amenity"), lists(amenity, values.take(pa.array(key[amenity]))),
                   one(best("landuse", 1)), total("category", "park"), one(best("road", 1)), total("category", "road"), total("mark", "roundabout"), total("mark", "bridge"), total("category", "signal")]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in self.SCHEMA.split(", ") if not x.startswith("value:")])


def _wholes(dy: float, top: int, part: int):
    """Rows (cell, is_point, lat, lon, dx, ord, what) sorted by cell, its samples first, to what is around each sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, samples, points, held, around = None, [], [], 0, None

        def index() -> None:
            nonlocal around, samples, points, held
            if around is None and samples:
                t = pa.Table.from_batches(samples)
                around, samples = Around(t.column("what").combine_chunks(), *(t.column(c).to_numpy() for c in ("lat", "lon", "dx")), dy), []
            if around is not None and points:
                around.add(pa.Table.from_batches(points))
            points, held = [], 0
        for b in batches:
            ids, point = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (point[1:] != point[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if j == i:
                    continue
                if ids[i] != cell:
                    index()
                    if around is not None:
                        yield around.answer(top)
                    cell, around = ids[i], None
                if not point[i]:
                    samples.append(b.slice(i, j - i))
                elif samples or around is not None:  # points that no sample is near are passed over
                    points.append(b.slice(i, j - i))
                    held += j - i
                    if held >= part:
                        index()
        index()
        if around is not None:
            yield around.answer(top)
    return run


def surroundings(samples: DataFrame, elements: DataFrame, reach_lat: float, reach_lon: Callable[[Column], Column], top: int, dense: int = WHOLE, part: int = PART) -> DataFrame:
    """What lies strictly within each sample's box (see ``Around.SCHEMA``), for samples (sample_id, lat, lon) and elements as of ``spatial.contexts``.

    Each sample goes to one cell, and elements to each cell from which they can be seen, so a cell's answer is the whole one: no partial answers are shuffled. A sample without a place has nothing around it.
    """
    c = F.col
    ok = "abs(lat) < 1e9 and abs(lon) < 1e9"  # neither null nor NaN
    place = [c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon")]
    left, right = samples.select("sample_id", *place).where(ok), elements.withColumns({"lat": place[0], "lon": place[1]}).where(ok).where(c("category").isin(CATEGORIES))
    is_ = lambda *k: c("category").isin(*k)
    mark = lambda name: F.when(is_("road") & c(name), "1").otherwise("0")
    # a function of lambdas keeps this apart from the caller's code, see ``spatial.dealt``
    what = F.array_join(F.transform(F.array("category", F.concat(mark("roundabout"), mark("bridge")), F.when(is_("building"), c("levels").cast("string")), F.when(is_(*VALUED), c("value"))), lambda x: F.coalesce(x, F.lit(""))), _SEP)
    order = F.when(is_(*ORDERED) & (c("value") != ""), c("ord").cast("long"))
    own = right.select("lat", "lon", F.coalesce(order, F.lit(NO_ORD)).alias("ord"), what.alias("what"))
    counted = right.select("lat", "lon", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(left.select("lat", "lon", F.lit(SAMPLE).alias("n"), F.lit(SAMPLE).alias("m")))
    # a sample's box may be as wide as that of the farthest latitude in reach
    far = F.abs("lat") + reach_lat
    seen = lambda lat: F.when(far < 89.9, reach_lon(far)).otherwise(1080.0)
    p, q, cell = spatial.dealt(own, left.withColumn("dx", reach_lon(c("lat"))), reach_lat * SPAN, lambda lat: reach_lon(lat) * SPAN, dense, reach_lat, seen, counted)
    where = F.xxhash64(*cell).alias("cell")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = q.select(where, F.lit(False).alias("is_point"), c("rlat").alias("lat"), c("rlon").alias("lon"), "dx", none("long", "ord"), c("sample_id").cast("string").alias("what")).unionByName(
        p.select(where, F.lit(True).alias("is_point"), "lat", "lon", none("double", "dx"), "ord", "what"))
    # a number that is given isn't made smaller: few bytes here are much work
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "cell").sortWithinPartitions("cell", "is_point").mapInArrow(_wholes(reach_lat, top, part), Around.SCHEMA)
    nowhere = samples.select(c("sample_id").cast("string").alias("sample_id"), *place).where(f"not coalesce({ok}, false)")
    zero = [f for f in found.schema.fields if f.name not in ("sample_id", "lat", "lon")]
    blank = lambda f: F.lit(0).cast("long") if f.dataType.simpleString() == "bigint" else F.array().cast(f.dataType) if f.dataType.simpleString().startswith("array") else F.lit(None).cast(f.dataType)
    return found.unionByName(nowhere.select("sample_id", "lat", "lon", *(blank(f).alias(f.name) for f in zero)))


def _answers(index_of, size: int):
    """Rows (cell, is_sample, lat, lon, dy, dx, sample_id, columns of points) sorted by cell, its points first; gives the answers of each cell's index to its samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, points, index = None, [], None
        for b in batches:
            ids, sample = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (sample[1:] != sample[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if j == i:
                    continue
                part = b.slice(i, j - i)
                if ids[i] != cell:
                    cell, points, index = ids[i], [], None
                if not sample[i]:
                    points.append(part)
                    continue
                if index is None:
                    if not points:
                        continue
                    index, points = index_of(pa.Table.from_batches(points)), []
                for k in range(0, j - i, size):
                    yield index.answer(part.slice(k, size))
    return run


def answers(samples: DataFrame, points: DataFrame, index_of, reach_lat: float, reach_lon: Callable[[Column], Column], dense: int = DENSE) -> DataFrame:
    """What ``index_of`` says of the points strictly within each sample's box, for each cell that the box touches. samples: sample_id (a string), lat, lon. points: lat, lon and the columns of the index."""
    left = samples.select("sample_id", "lat", "lon").withColumn("dx", reach_lon(F.col("lat")))
    counted = points.select("lat", "lon", F.lit(1).alias("n"), F.lit(1).alias("m"))
    l, r, cell = spatial.dealt(left, points, reach_lat * SPAN, lambda lat: reach_lon(lat) * SPAN, dense, reach_lat, reach_lon, counted)
    where = F.xxhash64(*cell).alias("cell")
    own = [f for f in points.schema.fields if f.name not in ("lat", "lon")]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    at = lambda y, x: (F.col(y).cast("double").alias("lat"), F.col(x).cast("double").alias("lon"))
    rows = r.select(where, F.lit(False).alias("is_sample"), *at("rlat", "rlon"), none("double", "dy"), none("double", "dx"), none("string", "sample_id"), *(f.name for f in own)).unionByName(
        l.select(where, F.lit(True).alias("is_sample"), *at("lat", "lon"), F.lit(reach_lat).alias("dy"), "dx", "sample_id", *(none(f.dataType, f.name) for f in own)))
    # a number that is given isn't made smaller: few bytes here are much work
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell", "is_sample").mapInArrow(_answers(index_of, 4096), index_of.SCHEMA)


def box_counts(samples: DataFrame, points: DataFrame, reach_lat: float, reach_lon: Callable[[Column], Column], dense: int = DENSE) -> DataFrame:
    """(sample_id, key, n, o): how many points of each key lie strictly within the box of each sample, and their smallest ``ord``, null if they have none.

    The same rows as a range join grouped by sample_id and key. points: key (a string; null ones don't count), ord (null for all of a key or for none), lat, lon.
    """
    points = points.where("key is not null").select("key", F.coalesce(F.col("ord").cast("long"), F.lit(NO_ORD)).alias("ord"), "lat", "lon")
    got = answers(samples, points, Classes, reach_lat, reach_lon, dense)
    return got.groupBy("sample_id", "key").agg(F.sum("n").alias("n"), F.nullif(F.min("o"), F.lit(NO_ORD)).alias("o"))


def nearest(samples: DataFrame, points: DataFrame, reach_lat: float, reach_lon: Callable[[Column], Column], sphere: bool = False, dense: int = DENSE) -> DataFrame:
    """The nearest point within each sample's box, for each cell that it touches: sample_id, lat, lon, rlat, rlon, d, a, b. Points of one place are one, that of the least (a, b). points: a, b (longs), lat, lon."""
    points = points.groupBy("lat", "lon").agg(F.min(F.struct("a", "b")).alias("m")).select("lat", "lon", F.col("m.a").cast("long").alias("a"), F.col("m.b").cast("long").alias("b"))
    return answers(samples, points, NearestOnSphere if sphere else Nearest, reach_lat, reach_lon, dense)


def thinned_counts(samples: DataFrame, points: DataFrame, box: float, metres: float, gap: float) -> DataFrame:
    """(sample_id, n): how many points (ord, lat, lon) are kept around each sample, see ``Thinned``; 0 without any. No pair is formed.

    Thinning needs all points of a sample in one place: samples are dealt into cells four boxes wide, and each point goes to the cells that it can be reached from (2.25 on average). Samples of one place are one.
    """
    c = F.col
    side = 4 * box
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / side), F.floor(b / side)))
    own = lambda df: df.where(~F.isnan("lat") & ~F.isnan("lon"))
    places = own(samples.select(c("lat").cast("double"), c("lon").cast("double")).where("lat is not null and lon is not null")).distinct()
    near = box * (1 + 1e-9) + 1e-12
    p = own(points.select(c("ord").cast("long"), c("lat").cast("double"), c("lon").cast("double")).where("ord is not null and lat is not null and lon is not null"))
    p = p.withColumn("y", cells(c("lat") - near, c("lat") + near)).withColumn("x", cells(c("lon") - near, c("lon") + near))
    where = lambda y, x: F.xxhash64(y, x).alias("cell")
    rows = p.select(where("y", "x"), F.lit(False).alias("is_sample"), "lat", "lon", "ord").unionByName(
        places.select(where(F.floor(c("lat") / side), F.floor(c("lon") / side)), F.lit(True).alias("is_sample"), "lat", "lon", F.lit(None).cast("long").alias("ord")))
    # a number that is given isn't made smaller: few bytes here are much work
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.repartition(parts, "cell").sortWithinPartitions("cell", "is_sample").mapInArrow(_answers(lambda t: Thinned(t, box, metres, gap), 4096), "lat double, lon double, n long")
    return samples.select("sample_id", c("lat").cast("double"), c("lon").cast("double")).join(got, ["lat", "lon"], "left").select("sample_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
