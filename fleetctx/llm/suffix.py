"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as S (smaller than the next) or L; leftmost S suffixes (LMS) are sorted by their
substrings, named, and sorted recursively as a reduced text; the whole array is then induced from them, L
suffixes from the left and S suffixes from the right. A bucket's suffixes are induced as one array, so the
work is linear in numpy steps, with one round for each bucket and each link of a run of equal characters.
Where a reduced text has too many names for that to pay, ranks are doubled instead: 1.8 MB of prose have 27,040 names, and
take 1.9 s so, 50 s with recursion alone.
"""

from __future__ import annotations

import numpy as np

#: Reduced texts of more names than this are sorted by doubling ranks.
NAMES = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The end of the text is smaller than any character."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        up = t[:-1] < t[1:]
        known = np.append(t[:-1] != t[1:], True)  # the last suffix is L
        at = np.where(known, np.arange(n), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        s = np.append(up, False)[nearest]
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array (or, from LMS suffixes in any order, their substrings' order) from LMS suffixes in order."""
    n, sigma = len(t), len(size)
    tail0 = np.cumsum(size)
    head0 = tail0 - size
    sa = np.full(n, -1, np.int64)
    of = t[lms]
    order = np.argsort(of, kind="stable")
    held = np.bincount(of, minlength=sigma)
    placed = lms[order]
    starts = np.cumsum(held) - held
    sa[np.repeat(tail0 - held, held) + np.arange(len(lms)) - np.repeat(starts, held)] = placed

    head = head0.copy()
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1

    def put_left(batch: np.ndarray, c: int) -> np.ndarray:
        before = batch[batch > 0] - 1
        before = before[~s[before]]
        if not len(before):
            return before
        chars = t[before]
        same = before[chars == c]
        if len(same):
            sa[head[c] : head[c] + len(same)] = same
            head[c] += len(same)
        if len(same) < len(before):
            rest = chars != c
            before, chars = before[rest], chars[rest]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cut = np.flatnonzero(np.diff(chars, prepend=-1))
            count = np.diff(np.append(cut, len(chars)))
            first = head[chars[cut]]
            sa[np.repeat(first - cut, count) + np.arange(len(chars))] = before
            head[chars[cut]] += count
        return same

    for c in np.flatnonzero(size):
        batch = sa[head0[c] : head[c]].copy()
        while len(batch):
            batch = put_left(batch, c)
        if held[c]:
            put_left(sa[tail0[c] - held[c] : tail0[c]].copy(), c)

    tail = tail0.copy()

    def put_right(batch: np.ndarray, c: int) -> np.ndarray:
        """batch: suffixes from the right; so is what it returns."""
        before = batch[batch > 0] - 1
        before = before[s[before]]
        if not len(before):
            return before
        chars = t[before]
        same = before[chars == c]
        if len(same):
            sa[tail[c] - len(same) : tail[c]] = same[::-1]
            tail[c] -= len(same)
        if len(same) < len(before):
            rest = chars != c
            before, chars = before[rest], chars[rest]
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cut = np.flatnonzero(np.diff(chars, prepend=-1))
            count = np.diff(np.append(cut, len(chars)))
            last = tail[chars[cut]] - 1
            sa[np.repeat(last + cut, count) - np.arange(len(chars))] = before
            tail[chars[cut]] -= count
        return same

    left_end = head  # L suffixes of bucket c lie in head0[c]:left_end[c]
    for c in np.flatnonzero(size)[::-1]:
        batch = sa[tail[c] : tail0[c]][::-1].copy()
        while len(batch):
            batch = put_right(batch, c)
        put_right(sa[head0[c] : left_end[c]][::-1].copy(), c)
    return sa


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in the order of the text; equal substrings share one."""
    n = len(t)
    length = np.empty(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    length[-1] = n - lms[-1] + 1  # runs into the end, as no other does
    where = np.full(n, 0, np.int64)
    where[lms] = np.arange(len(lms))
    index = where[ordered]
    a, b = ordered[:-1], ordered[1:]
    size = length[index]
    same = (size[:-1] == size[1:]) & (index[:-1] != len(lms) - 1) & (index[1:] != len(lms) - 1)
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[live] > k]
    names = np.empty(len(lms), np.int64)
    names[index] = np.append(0, np.cumsum(~same))
    return names, int((~same).sum()) + 1


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array by doubling the length by which ranks compare."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        step = np.diff(key[sa], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(step) - 1
        if rank[sa[-1]] == n - 1:
            return sa
        k *= 2
        if k >= n:
            return sa


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Suffixes of t (characters 0 to sigma - 1) in order; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    if sigma > NAMES:
        return _doubled(t)
    t = np.ascontiguousarray(t, np.int16 if sigma <= 32767 else np.int32)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    size = np.bincount(t, minlength=sigma)
    if not len(lms):
        return _induce(t, s, lms, size)
    first = _induce(t, s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names, kinds = _names(t, s, lms, ordered)
    if kinds < len(lms):
        ordered = lms[suffix_array(names, kinds)]
    return _induce(t, s, ordered, size)


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one little-endian number, zeros past the end."""
    n = len(t)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = t
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for r in range(8):
        out[r::8] = padded[r : r + len(out)].view(np.uint64)
    return out[:n]


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place i: how far the suffix at i agrees with its predecessor in sa (0 for the first).

    Only irreducible places, where the characters before the two differ, are compared; from there the value falls by one a place.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    start = (phi <= 0) | (at == 0)
    start[1:] |= t[at[1:] - 1] != t[np.maximum(phi[1:], 1) - 1]
    i = np.flatnonzero(start)
    j = phi[i]
    found = np.zeros(len(i), np.int64)
    most = n - np.maximum(i, j)
    w = words_at(t)
    live = np.flatnonzero(j >= 0)
    while len(live):
        x = w[np.minimum(i[live] + found[live], n - 1)] ^ w[np.minimum(j[live] + found[live], n - 1)]
        done = (x != 0) | (found[live] + 8 >= most[live])
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        found[live] = np.minimum(found[live] + equal, most[live])
        live = live[~done]
    last = np.maximum.accumulate(np.where(start, at, 0))
    value = np.zeros(n, np.int64)
    value[i] = found
    return np.maximum(value[last] - (at - last), 0)
