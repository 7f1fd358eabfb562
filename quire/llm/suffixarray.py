"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than their right neighbours; the
substrings between leftmost smaller ones are sorted by inducing, named, and the
string of names is sorted by the same procedure, at every level.  Names beyond
``WALKED`` are written as two digits each, which keeps the order of suffixes
and the alphabet small.

The walk over buckets is vectorised: what a stretch of a bucket induces is
appended to the other buckets in one go, so a pass costs a few array
operations per character of the alphabet and per repeat of equal characters.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is walked bucket by bucket; more names are split in two digits.
WALKED = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour (S-type)."""
    n = len(s)
    differ = np.nonzero(s[1:] != s[:-1])[0]
    up = s[differ] < s[differ + 1]
    out = np.ones(n, bool)
    nxt = np.searchsorted(differ, np.arange(n - 1))
    inside = nxt < len(differ)
    out[: n - 1][inside] = up[nxt[inside]]
    return out


def _push(sa, at, s, j, size, step):
    """Append suffixes ``j`` to their buckets in order; ``at`` moves on."""
    c = s[j]
    order = np.argsort(c, kind="stable")
    c = c[order]
    counts = np.bincount(c, minlength=size)
    first = np.cumsum(counts) - counts
    within = np.arange(len(c)) - first[c]
    sa[at[c] + step * within] = j[order]
    at += step * counts


def _induce(s: np.ndarray, size: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order induced from ``lms`` suffixes given in order."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    present = np.nonzero(counts)[0].tolist()
    by_char = np.argsort(s[lms], kind="stable")
    grouped = lms[by_char]
    cuts = np.searchsorted(s[lms][by_char], np.arange(size + 1)).tolist()
    # Large suffixes, left to right.
    at = starts.copy()
    for c in present:
        done = int(starts[c])
        while (filled := int(at[c])) > done:
            j = sa[done:filled] - 1
            done = filled
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                _push(sa, at, s, j, size, 1)
        if cuts[c + 1] > cuts[c]:
            j = grouped[cuts[c] : cuts[c + 1]] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                _push(sa, at, s, j, size, 1)
    heads = at  # one past the large suffixes of each bucket
    # Small suffixes, right to left.
    at = ends - 1
    for c in reversed(present):
        done = int(ends[c]) - 1
        while (filled := int(at[c])) < done:
            j = sa[filled + 1 : done + 1][::-1] - 1
            done = filled
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                _push(sa, at, s, j, size, -1)
        if heads[c] > starts[c]:
            j = sa[int(starts[c]) : int(heads[c])][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                _push(sa, at, s, j, size, -1)
    sa[0] = n - 1  # the sentinel, smallest of all
    return sa


def _sort_names(names: np.ndarray, kinds: int, walked: int) -> np.ndarray:
    """Order of the suffixes of a string of names, whose last is 0 and unique."""
    if kinds <= walked:
        return suffix_array(names, kinds, walked)
    base = int(np.ceil(np.sqrt(kinds)))
    digits = np.zeros(2 * len(names) - 1, np.int64)  # the last name is the last digit
    digits[0:-1:2], digits[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    order = suffix_array(digits, base + 2, max(walked, base + 2))
    return order[order % 2 == 0] // 2


def suffix_array(s: np.ndarray, size: int, walked: int = WALKED) -> np.ndarray:
    """Order of all suffixes of ``s``: integers in ``[0, size)`` whose last is
    a 0 that occurs nowhere before."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = _types(s)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    sa = _induce(s, size, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    m = len(ordered)
    if m > 1:
        # Names: equal only for equal LMS substrings.
        length = np.zeros(n, np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = ordered[:-1], ordered[1:]
        live = np.nonzero(length[a] == length[b])[0]
        same = np.zeros(m - 1, bool)
        k = 0
        while len(live):
            ended = length[a[live]] <= k
            same[live[ended]] = True
            live = live[~ended]
            live = live[s[a[live] + k] == s[b[live] + k]]
            k += 1
        names = np.concatenate(([0], np.cumsum(~same)))
        kinds = int(names[-1]) + 1
        if kinds < m:
            number = np.zeros(n, np.int64)
            number[ordered] = names
            ordered = lms[_sort_names(number[lms], kinds, walked)]
        sa = _induce(s, size, small, ordered)
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each of ``starts``, in text order, how many
    bytes of ``data`` its suffix shares with the suffix before it in ``sa``,
    counted up to ``most``.  Compared a machine word at a time."""
    before = np.full(len(sa), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    before = before[starts]
    out = np.zeros(len(starts), np.int64)
    padded = np.concatenate((data, np.zeros(most + 8, np.uint8)))
    words = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), 0, (1,))
    room = len(data) - np.maximum(starts, before)
    live = np.nonzero((before >= 0) & (room > 0))[0]
    for at in range(0, most, 8):
        differ = words[starts[live] + at] ^ words[before[live] + at]
        apart = differ != 0
        # The lowest bit that differs lies in the first byte that differs.
        low = differ[apart]
        bit = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
        out[live[apart]] = at + bit // 8
        live = live[~apart]
        if not len(live):
            break
    out[live] = most
    return np.minimum(np.minimum(out, np.maximum(room, 0)), most)
