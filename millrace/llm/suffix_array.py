"""Suffix arrays by induced sorting, and their permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as smaller or larger than their right
neighbour, sorts the leftmost-smaller (LMS) substrings by one induction, names
them, sorts the reduced string of names by itself, recursively, and induces the
whole array from it.  An induction walks the buckets of first symbols, and
everything a stretch of a bucket induces is placed at once.  Where the alphabet
is large (a reduced string's) many buckets are taken together, so interpreter
steps grow like the square root of its size.
"""

from __future__ import annotations

import numpy as np


#: Buckets of a large alphabet that are tried together at first.
WIDTH = 64


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is the least and unique."""
    n = len(t)
    out = np.empty(n, bool)
    out[-1] = True
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    # an equal symbol takes the type of the next unequal one
    at = np.where(step != 0, np.arange(n - 1), n)
    out[:-1] = step[np.minimum.accumulate(at[::-1])[::-1].clip(max=n - 2)] > 0
    return out


def _place(sa: np.ndarray, t: np.ndarray, took: np.ndarray, ends: np.ndarray, forward: bool) -> None:
    """Puts suffixes ``took``, in order, at the heads or tails of their buckets."""
    if not len(took):
        return
    c = t[took]
    order = np.argsort(c, kind="stable")
    took, c = took[order], c[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    counts = np.diff(np.append(starts, len(c)))
    rank = np.arange(len(c)) - np.repeat(starts, counts)
    if forward:
        sa[ends[c] + rank] = took
        ends[c[starts]] += counts
    else:
        sa[ends[c] - 1 - rank] = took
        ends[c[starts]] -= counts


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes given in order within each bucket.

    A step takes a run of buckets together, as far as none of them induces into
    another one of the run; runs grow while that succeeds.
    """
    n, symbols = len(t), np.flatnonzero(np.diff(bounds))
    sa = np.full(n, -1, np.int64)
    by = t[lms]
    order = np.argsort(by, kind="stable")
    lms, cuts = lms[order], np.searchsorted(by[order], np.arange(len(bounds)))
    heads = bounds[:-1].copy()

    def before(chunk: np.ndarray, small: bool) -> np.ndarray:
        p = chunk[chunk > 0] - 1
        return p[is_s[p] == small]

    at, width, alone = 0, WIDTH if len(symbols) > 4 * WIDTH else 1, False
    while at < len(symbols):
        run = symbols[at : at + (1 if alone else width)]
        # What the buckets hold so far, larger suffixes before the LMS ones.
        if len(run) == 1:
            c = run[0]
            i = bounds[c]
            while i < heads[c]:
                i, chunk = heads[c], sa[i : heads[c]]
                _place(sa, t, before(chunk, False), heads, True)
            _place(sa, t, before(lms[cuts[c] : cuts[c + 1]], False), heads, True)
            at, alone = at + 1, False
            continue
        larger, held = heads[run] - bounds[run], cuts[run + 1] - cuts[run]
        both = np.stack([larger, held], 1).ravel()
        ends = np.cumsum(both)
        chunk = np.empty(ends[-1], np.int64)
        own = np.repeat(np.arange(len(run)), larger + held)
        first = np.zeros(len(chunk), bool)
        first[_ragged((ends - both)[::2], larger)] = True
        chunk[first] = sa[_ragged(bounds[run], larger)]
        chunk[~first] = lms[_ragged(cuts[run], held)]
        p = chunk - 1
        use = (chunk > 0) & ~is_s[p]
        to = t[p]
        # The run ends before the first bucket that one of it induces into.
        inside = use & (to <= run[-1])
        stop = int(np.searchsorted(run, to[inside].min())) if inside.any() else len(run)
        if stop == 0:
            alone = True
            continue
        _place(sa, t, p[use & (own < stop)], heads, True)
        at, width = at + stop, width * 2 if stop == len(run) else max(2, (width + stop) // 2)
    tails = bounds[1:].copy()

    sa[0] = n - 1  # the sentinel
    tails[t[n - 1]] = bounds[t[n - 1]]
    at, width, alone = 0, WIDTH if len(symbols) > 4 * WIDTH else 1, False
    down = symbols[::-1]
    while at < len(down):
        run = down[at : at + (1 if alone else width)]
        if len(run) == 1:
            c = run[0]
            if c == t[n - 1]:
                _place(sa, t, before(sa[bounds[c] : bounds[c + 1]], True), tails, False)
            else:
                i = bounds[c + 1]
                while i > tails[c]:
                    i, chunk = tails[c], sa[tails[c] : i][::-1]
                    _place(sa, t, before(chunk, True), tails, False)
                _place(sa, t, before(sa[bounds[c] : heads[c]][::-1], True), tails, False)
            at, alone = at + 1, False
            continue
        # Downwards: the smaller suffixes placed so far, then the larger ones, each from the right.
        small, large = bounds[run + 1] - tails[run], heads[run] - bounds[run]
        total = small + large
        own = np.repeat(np.arange(len(run)), total)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(total) - total, total)
        tail = rank < small[own]
        chunk = sa[np.where(tail, bounds[run + 1][own] - 1 - rank, heads[run][own] - 1 - (rank - small[own]))]
        p = chunk - 1
        use = (chunk > 0) & is_s[p]
        to = t[p]
        inside = use & (to >= run[-1])
        stop = int((run > to[inside].max()).sum()) if inside.any() else len(run)
        if t[n - 1] in run[:stop]:  # the sentinel's bucket, the last, is taken alone
            stop -= 1
        if stop == 0:
            alone = True
            continue
        _place(sa, t, p[use & (own < stop)], tails, False)
        at, width = at + stop, width * 2 if stop == len(run) else max(2, (width + stop) // 2)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` (small non-negative integers, the last one least and unique) in order."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = smaller(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=int(t.max()) + 1))])
    sa = _induce(t, is_s, lms, bounds)
    if len(lms) < 2:
        return sa
    index = np.full(n, -1, np.int64)
    index[lms] = np.arange(len(lms))
    order = index[sa]
    order = order[order >= 0]  # LMS substrings, sorted
    ends = np.concatenate([lms[1:], [n - 1]])
    size = ends - lms + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    at = np.flatnonzero(same)
    differ = t[_ragged(lms[a[at]], size[a[at]])] != t[_ragged(lms[b[at]], size[b[at]])]
    starts = np.cumsum(size[a[at]]) - size[a[at]]
    if len(at):
        same[at] = ~np.logical_or.reduceat(differ, starts)
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    # Names are dense, and the last one, the sentinel's, is the least: the reduced string is of the same kind.
    order = suffix_array(names) if names.max() + 1 < len(lms) else np.argsort(names, kind="stable")
    return _induce(t, is_s, lms[order], bounds)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, forced: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, by text position.

    A value whose left neighbours agree is its left neighbour's less one, so only
    the others are compared, and those at the positions ``forced``.  Compared
    values stop at ``cap``; they are exact up to cap less the distance to the
    last forced position.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    own = np.ones(n, bool)
    own[1:] = (phi[1:] <= 0) | (t[:-1] != t[np.maximum(phi[1:] - 1, 0)])
    own[forced] = True
    at = np.flatnonzero(own & (phi >= 0))
    padded = np.concatenate([t, np.full(cap + 8, -1, np.int32)]) if t.dtype.kind == "i" else np.concatenate([t.astype(np.int32), np.full(cap + 8, -1, np.int32)])
    lcp = np.zeros(n, np.int64)
    left, right, alive = at.copy(), phi[at], at
    step = np.arange(8)
    done = 0
    while len(alive) and done < cap:
        equal = padded[left[:, None] + step] == padded[right[:, None] + step]
        more = equal.all(1)
        lcp[alive] += np.where(more, 8, equal.argmin(1))
        left, right, alive = left[more] + 8, right[more] + 8, alive[more]
        done += 8
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(lcp[last] - (np.arange(n) - last), 0)
