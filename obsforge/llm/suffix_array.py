"""Suffix arrays by induced sorting, and permuted common prefixes, of one bounded text."""

from __future__ import annotations

import numpy as np

#: Up to so many symbols, whole buckets are induced at a time; beyond, suffixes one by one.
FEW_SYMBOLS = 600


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The last symbol is the only smallest one."""
    n = len(s)
    turn = np.flatnonzero(s[:-1] != s[1:])  # the next place where two neighbours differ decides
    up = s[turn] < s[turn + 1]
    smaller = np.repeat(up, np.diff(np.concatenate([[-1], turn])))
    return np.concatenate([smaller, np.ones(n - len(smaller), bool)])


def induce(s: np.ndarray, smaller: np.ndarray, symbols: int, seeds: np.ndarray) -> np.ndarray:
    """Suffix array induced from seeds: leftmost-smaller suffixes in the order they take in their buckets."""
    counts = np.bincount(s, minlength=symbols)
    ends = np.cumsum(counts)
    sa = np.full(len(s), -1, np.int64)
    rank = np.arange(len(seeds)) - np.searchsorted(s[seeds], s[seeds], "left") if len(seeds) else seeds
    seeded = np.bincount(s[seeds], minlength=symbols)
    sa[ends[s[seeds]] - seeded[s[seeds]] + rank] = seeds
    return (_by_bucket if symbols <= FEW_SYMBOLS else _one_by_one)(s, smaller, ends - counts, ends, seeded, sa)


def _push(s: np.ndarray, sa: np.ndarray, found: np.ndarray, edge: np.ndarray, sign: int) -> None:
    """Append suffixes to their buckets in the given order, from the front (sign 1) or from the back (-1)."""
    order = np.argsort(s[found], kind="stable")
    found = found[order]
    symbol = s[found]
    counts = np.bincount(symbol, minlength=len(edge))
    within = np.arange(len(found)) - (np.cumsum(counts) - counts)[symbol]
    sa[edge[symbol] + sign * within] = found
    edge += sign * counts


def _by_bucket(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeded: np.ndarray, sa: np.ndarray) -> np.ndarray:
    head, small = starts.copy(), s.astype(np.uint16)
    for c in np.flatnonzero(ends > starts):
        done = starts[c]
        while done < head[c]:
            block, done = sa[done : head[c]] - 1, head[c]
            _push(small, sa, block[(block >= 0) & ~smaller[block]], head, 1)
        block = sa[ends[c] - seeded[c] : ends[c]] - 1
        _push(small, sa, block[block >= 0], head, 1)
    tail = ends - 1
    for c in np.flatnonzero(ends > starts)[::-1]:
        if c == 0:
            continue
        done = ends[c] - 1
        while done > tail[c]:
            block, done = sa[tail[c] + 1 : done + 1][::-1] - 1, tail[c]
            _push(small, sa, block[(block >= 0) & smaller[block]], tail, -1)
        block = sa[starts[c] : head[c]][::-1] - 1
        _push(small, sa, block[(block >= 0) & smaller[block]], tail, -1)
    sa[0] = len(s) - 1
    return sa


def _one_by_one(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeded: np.ndarray, sa: np.ndarray) -> np.ndarray:
    text, small, out, head, tail = s.tolist(), smaller.tolist(), sa.tolist(), starts.tolist(), (ends - 1).tolist()
    larger = [False] * len(text)
    for i in range(len(text)):
        j = out[i] - 1
        if j >= 0 and not small[j]:
            c = text[j]
            out[head[c]] = j
            larger[head[c]] = True
            head[c] += 1
    for i in range(1, len(text)):
        if not larger[i]:
            out[i] = -1
    for i in range(len(text) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and small[j]:
            c = text[j]
            out[tail[c]] = j
            tail[c] -= 1
    out[0] = len(text) - 1
    return np.array(out, np.int64)


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of integers below symbols that end with their only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sorted_ = induce(s, smaller, symbols, lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sorted_[is_lms[sorted_]]
    # Names of the substrings from one leftmost-smaller place to the next, equal ones sharing a name.
    until = np.concatenate([lms[1:], [n - 1]])
    length = np.zeros(n, np.int64)
    length[lms] = until - lms + 1
    same = length[order[1:]] == length[order[:-1]]
    same[0:1] = False  # the end alone
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        a, b = order[at + 1] + k, order[at] + k
        differs = (s[a] != s[b]) | (smaller[a] != smaller[b])
        same[at[differs]] = False
        k += 1
        at = at[~differs & (length[order[at]] > k)]
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.zeros(n, np.int64)
    names[order] = name
    reduced, most = names[lms], int(name[-1]) + 1
    if most == len(lms):
        seeds = order
    else:
        seeds = lms[suffix_array(reduced, most)]
    return induce(s, smaller, symbols, seeds)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the symbols its suffix shares with the suffix before it in order; the first in order shares none.

    Where the symbols to the left differ the prefix is counted; elsewhere it is one less than its left neighbour's.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    counted = np.ones(n, bool)
    i = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    counted[i] = (s[i - 1] != s[before[i] - 1]) | (before[i - 1] != before[i] - 1)
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(counted & (before >= 0))
    k = 0
    padded = np.concatenate([s, np.zeros(8, s.dtype)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)  # eight symbols at a time where they fit in bytes
    wide = 8 if len(s) and int(s.max()) < 256 else 1
    for b in range(wide):
        words |= padded[b : b + n] << np.uint64(8 * b)
    while len(at):  # the last symbol is unique, so no comparison runs past the end
        a, b = at + k, before[at] + k
        equal = words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)]
        equal &= (a < n) & (b < n)
        stop = at[~equal]
        for step in range(wide):
            x, y = stop + k + step, before[stop] + k + step
            inside = (x < n) & (y < n)
            ok = inside & (s[np.minimum(x, n - 1)] == s[np.minimum(y, n - 1)])
            common[stop[~ok]] = k + step
            stop = stop[ok]
        common[stop] = k + wide
        at = at[equal]
        k += wide
    last = np.maximum.accumulate(np.where(counted, np.arange(n), 0))
    return np.maximum(common[last] - (np.arange(n) - last), 0)
