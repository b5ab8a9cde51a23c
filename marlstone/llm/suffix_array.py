"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as S (smaller than the next) or L; the leftmost S of
each run (LMS) are sorted by inducing their substrings, naming these and
recursing on the names; the rest are induced from them in two sweeps over the
buckets.  A sweep handles a bucket as one vector operation (again for a run of
equal symbols), so the alphabet must be small: a larger one is spelt as two
digits a symbol, which keeps the order of the suffixes at even places.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024
DIRECT = 256


def _direct(t: np.ndarray) -> np.ndarray:
    """Prefix doubling, for short strings."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.full(n, -1, dtype=np.int64)
        ahead[: max(n - step, 0)] = rank[step:]
        sa = np.lexsort((ahead, rank))
        new = (rank[sa[1:]] != rank[sa[:-1]]) | (ahead[sa[1:]] != ahead[sa[:-1]])
        rank[sa] = np.concatenate([[0], np.cumsum(new)])
        if new.all():
            return sa
        step *= 2


def _ranks_in_group(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal keys."""
    n = len(sorted_keys)
    first = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
    return np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))


def _induce(t: np.ndarray, s_type: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from LMS suffixes that are in order within each bucket."""
    n = len(t)
    sizes = np.bincount(t, minlength=sigma)
    end = np.cumsum(sizes)
    start = end - sizes
    sa = np.full(n, -1, dtype=np.int32)
    c = t[lms]
    order = np.argsort(c, kind="stable")
    lms, c = lms[order], c[order]
    count = np.bincount(c, minlength=sigma)
    if len(lms):
        sa[(end - count)[c] + _ranks_in_group(c)] = lms
    head = start.copy()
    head_end = n - 1  # the last suffix is L and follows the empty one
    sa[head[t[head_end]]] = head_end
    head[t[head_end]] += 1

    def place_l(block: np.ndarray) -> None:
        j = block[block > 0] - 1
        j = j[~s_type[j]]
        if not len(j):
            return
        k = t[j]
        if len(j) > 1:
            o = np.argsort(k, kind="stable")
            j, k = j[o], k[o]
            r = _ranks_in_group(k)
            sa[head[k] + r] = j
            last = np.flatnonzero(np.concatenate([k[1:] != k[:-1], [True]]))
            head[k[last]] += r[last] + 1
        else:
            sa[head[k[0]]] = j[0]
            head[k[0]] += 1

    for b in np.flatnonzero(sizes).tolist():
        p = start[b]
        while p < head[b]:
            q = head[b]
            place_l(sa[p:q])
            p = q
        if count[b]:
            place_l(sa[end[b] - count[b] : end[b]])

    # The S part is induced afresh, from the right.
    tail = end.copy()

    def place_s(block: np.ndarray) -> None:
        j = block[::-1]
        j = j[j > 0] - 1
        j = j[s_type[j]]
        if not len(j):
            return
        k = t[j]
        if len(j) > 1:
            o = np.argsort(k, kind="stable")
            j, k = j[o], k[o]
            r = _ranks_in_group(k)
            sa[tail[k] - 1 - r] = j
            last = np.flatnonzero(np.concatenate([k[1:] != k[:-1], [True]]))
            tail[k[last]] -= r[last] + 1
        else:
            tail[k[0]] -= 1
            sa[tail[k[0]]] = j[0]

    for b in np.flatnonzero(sizes)[::-1].tolist():
        p = end[b]
        while p > tail[b]:
            q = tail[b]
            place_s(sa[q:p])
            p = q
        if head[b] > start[b]:
            place_s(sa[start[b] : head[b]])
    return sa


def _names(t: np.ndarray, s_type: np.ndarray, sigma: int, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """The names of the LMS substrings in the order of the text, and how many there are."""
    n = len(t)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sa = _induce(t, s_type, sigma, lms)
    by = sa[is_lms[sa]]  # LMS places by their substrings
    stop = np.full(n, n, dtype=np.int64)  # last place of each LMS substring
    stop[lms[:-1]] = lms[1:]
    a, b = by[:-1].astype(np.int64), by[1:].astype(np.int64)
    length = stop[a] - a
    same = (length == stop[b] - b) & (stop[a] < n) & (stop[b] < n)
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        ok = (t[x] == t[y]) & (s_type[x] == s_type[y])
        same[live[~ok]] = False
        live = live[ok & (length[live] > k)]
        k += 1
    name = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
    named = np.empty(n, dtype=np.int32)
    named[by] = name
    return named[lms], int(name[-1]) + 1


def _sorted_lms(t: np.ndarray, s_type: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    # What naming needed is given back before the recursion.
    reduced, names = _names(t, s_type, sigma, lms)
    if names == len(lms):
        order = np.empty(len(lms), dtype=np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, names)
    return lms[order]


def _s_type(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next."""
    n = len(t)
    d = np.empty(n, dtype=np.int8)
    d[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    d[-1] = -1
    at = np.where(d != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return d[np.minimum.accumulate(at[::-1])[::-1]] > 0


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Places of all suffixes of t (symbols from 0 to sigma - 1) in ascending order; the end sorts first."""
    n = len(t)
    if n <= DIRECT:
        return _direct(t).astype(np.int32) if n > 1 else np.arange(n, dtype=np.int32)
    if sigma > SMALL_ALPHABET:
        base = int(np.ceil(np.sqrt(sigma)))
        while base * base < sigma:
            base += 1
        digits = np.empty(2 * n, dtype=np.int32)
        digits[0::2], digits[1::2] = np.divmod(t, base)
        sa = suffix_array(digits, base)
        return sa[(sa & 1) == 0] >> 1
    t = t.astype(np.uint16 if sigma <= 1 << 16 else np.int32)
    s_type = _s_type(t)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        lms = _sorted_lms(t, s_type, sigma, lms)
    return _induce(t, s_type, sigma, lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the common prefix with the suffix before it in sa, and that suffix's place (-1: none).

    Only irreducible places (whose left neighbours differ) are compared symbol
    by symbol; each other one has its left neighbour's value less one.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    lcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    k = 0
    while len(live):
        a, b = live + k, phi[live] + k
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        live = live[t[a] == t[b]]
        k += 1
        lcp[live] = k
    last = np.maximum.accumulate(np.where(reducible, 0, i))
    return np.where(reducible, lcp[last] - (i - last), lcp), phi
