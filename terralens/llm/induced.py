"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; an S suffix after an L
one is leftmost-smaller (LMS). LMS substrings are sorted by induction and named, the names are sorted,
and the sorted LMS suffixes induce all others. The induction runs a bucket at a time on arrays: what a bucket's
entries induce is put at the ends of its buckets in one step, and what falls into the same bucket makes the next
step. Strings of names have nearly as many symbols as entries, so there buckets are no help: they are sorted by doubling
(of few symbols: by induction again).
"""

from __future__ import annotations

import numpy as np

#: Strings of more symbols than this are sorted by doubling.
BYTES = 512


def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the unique smallest one."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        change = np.where(s[:-1] != s[1:], np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(change[::-1])[::-1]
        out[:-1] = s[np.minimum(at + 1, n - 1)] > s[at]
    return out


def _lms(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from ``lms``, LMS positions in order within each bucket."""
    n, top = len(s), np.cumsum(count)
    low = top - count
    sa = np.full(n, -1, np.int64)
    lms = lms[np.argsort(s[lms], kind="stable")]
    edge = np.searchsorted(s[lms], np.arange(len(count) + 1))
    used = np.flatnonzero(count)

    def spread(j: np.ndarray, at: np.ndarray, step: int) -> None:
        c = s[j]
        if len(j) > 1:
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        rank = np.arange(len(c)) - np.repeat(first, size)
        if step > 0:
            sa[at[c] + rank] = j
            at[c[first]] += size
        else:
            sa[at[c] - 1 - rank] = j
            at[c[first]] -= size

    head = low.copy()
    for b in used:
        done = low[b]
        while done < head[b]:
            f, done = sa[done : head[b]] - 1, head[b]
            f = f[f >= 0]
            f = f[~is_s[f]]
            if len(f):
                spread(f, head, 1)
        if edge[b] < edge[b + 1]:
            f = lms[edge[b] : edge[b + 1]] - 1
            if len(f := f[f >= 0]):
                spread(f[~is_s[f]], head, 1)
    tail = top.copy()
    sa[0], tail[s[n - 1]] = n - 1, low[s[n - 1]]
    for b in used[::-1]:
        done = top[b]
        while done > tail[b]:
            f, done = sa[tail[b] : done][::-1] - 1, tail[b]
            f = f[f >= 0]
            f = f[is_s[f]]
            if len(f):
                spread(f, tail, -1)
        f = sa[low[b] : head[b]][::-1] - 1
        f = f[f >= 0]
        f = f[is_s[f]]
        if len(f):
            spread(f, tail, -1)
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: suffixes in order of their first symbols, then of twice as many, until all are told apart. Only those that aren't yet are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    first = np.concatenate([[True], s[sa[1:]] != s[sa[:-1]]])
    rank = np.empty(n, np.int64)
    at = np.arange(n)
    head = np.maximum.accumulate(np.where(first, at, 0))
    rank[sa] = head
    # places of those that share their rank; the unique last symbol lies beyond all that such suffixes share
    at = at[~(first & np.append(first[1:], True))]
    step = 1
    while len(at):
        own = sa[at]
        group = rank[own]
        key = group * n + rank[own + step]
        o = np.argsort(key)
        own, key, group = own[o], key[o], group[o]
        sa[at] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank[own] = head
        at = at[~(first & np.append(first[1:], True))]
        step *= 2
    return sa


def _differ(s: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where the substrings at ``one`` and ``two`` differ; size: of each of ``one`` and of the last of ``two``. Substrings of equal size are compared symbol by symbol."""
    out = size[1:] != size[:-1]
    todo = np.flatnonzero(~out)
    n = size[todo]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    unequal = s[np.repeat(one[todo], n) + step] != s[np.repeat(two[todo], n) + step]
    if len(todo):
        out[todo] = np.logical_or.reduceat(unequal, np.cumsum(n) - n)
    return out


def _sort(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of a string of small integers that ends with its unique smallest symbol."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    if symbols > BYTES:
        return _doubled(s)
    is_s = classify(s)
    count = np.bincount(s, minlength=symbols)
    lms = _lms(is_s)
    if len(lms) > 1:
        sa = _induce(s, is_s, lms, count)
        mark = np.zeros(n, bool)
        mark[lms] = True
        ordered = sa[mark[sa]]
        # an LMS substring ends with the next LMS symbol; equal ones, which are neighbours in order, get equal names
        end = np.full(n, n - 1)
        end[lms[:-1]] = lms[1:]
        new = np.concatenate([[False], _differ(s, ordered[:-1], ordered[1:], end[ordered] - ordered + 1)])
        name = np.cumsum(new)
        if name[-1] + 1 == len(lms):
            lms = ordered
        else:
            at = np.zeros(n, np.int64)
            at[ordered] = name
            lms = lms[_sort(at[lms], int(name[-1]) + 1)]
    return _induce(s, is_s, lms, count)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of a byte string's suffixes in order."""
    if not len(data):
        return np.zeros(0, np.int64)
    present = np.zeros(256, bool)
    present[data] = True
    # 16 bits: numpy sorts these by digits
    rank = np.cumsum(present).astype(np.uint16)
    return _sort(np.append(rank[data], np.uint16(0)), int(rank[-1]) + 1)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int, at: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each position (of ``at``, or all), the length (up to ``cap``) that its suffix shares with the one before it in order.

    Eight bytes are compared at once, for the positions that are equal so far.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate([data, np.zeros(cap + 16, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        wide[:-k] |= wide[k:] << np.uint64(8 * k)
    at = np.arange(n) if at is None else at
    out = np.zeros(len(at), np.int64)
    row = np.flatnonzero(before[at] >= 0)
    live = at[row]
    other = before[live]
    for k in range(0, cap, 8):
        x = wide[live + k] ^ wide[other + k]
        stop = x != 0
        low = x[stop]
        low &= ~low + np.uint64(1)
        out[row[stop]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        row, live, other = row[~stop], live[~stop], other[~stop]
        if not len(live):
            break
    out[row] = cap
    return np.minimum(np.minimum(out, n - np.maximum(at, before[at])), cap)
