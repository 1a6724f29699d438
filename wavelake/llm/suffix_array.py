"""Suffix arrays by induced sorting, and repeated strings from them."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (S-type).  The last
    symbol is the unique smallest one and S-type by definition."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    # an equal neighbour has the type of the next position that differs
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    smaller = np.ones(n, dtype=bool)
    inside = nxt < n
    smaller[:-1][inside] = step[nxt[inside]] > 0
    return smaller


class _Buckets:
    """Positions per symbol, in the order in which they were dealt."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def deal(self, symbols: np.ndarray, places: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, places = symbols[order], places[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for c, part in zip(symbols[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
            self.parts[c].append(part)

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _induce(s: np.ndarray, small: np.ndarray, symbols: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the LMS positions in the given order: larger types
    bucket by bucket upwards, smaller types downwards.  A bucket is induced in
    waves, one per repetition of its symbol, each as one array operation."""
    lms_by = _Buckets(symbols)
    lms_by.deal(s[lms], lms)
    larger, found = _Buckets(symbols), []
    for c in range(symbols):
        own, wave = [], larger.take(c)
        while len(wave):
            own.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            to = s[before]
            larger.deal(to[to != c], before[to != c])
            wave = before[to == c]
        found.append(np.concatenate(own) if own else wave)
        first = lms_by.take(c)
        before = first[first > 0] - 1
        larger.deal(s[before], before)  # what stands before an LMS position is L-type
    smaller, out = _Buckets(symbols), [None] * symbols
    for c in range(symbols - 1, -1, -1):
        own, wave = [], smaller.take(c)
        while len(wave):
            own.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            to = s[before]
            smaller.deal(to[to != c], before[to != c])
            wave = before[to == c]
        left = found[c][::-1]
        before = left[left > 0] - 1
        before = before[small[before]]
        smaller.deal(s[before], before)
        tail = np.concatenate(own)[::-1] if own else wave
        out[c] = np.concatenate((found[c], tail))
    out[0] = np.array([len(s) - 1])  # the end symbol, which nothing induces
    return np.concatenate(out)


def _induce_each(s: list[int], small: list[bool], symbols: int, lms: list[int]) -> list[int]:
    """:func:`_induce` one position at a time, for alphabets with too many
    buckets to visit one by one."""
    n = len(s)
    sizes = np.bincount(np.asarray(s), minlength=symbols)
    ends = np.cumsum(sizes)
    sa = [-1] * n
    tail = (ends - 1).tolist()
    for p in reversed(lms):
        sa[tail[s[p]]] = p
        tail[s[p]] -= 1
    head = (ends - sizes).tolist()
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = s[p]
            sa[head[c]] = p
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = s[p]
            sa[tail[c]] = p
            tail[c] -= 1
    sa[0] = n - 1
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring (in text order) among the distinct ones, by
    comparing neighbours in ``ordered``."""
    length = np.diff(np.append(lms, len(s) - 1)) + 1
    of = np.empty(len(s), dtype=np.int64)
    of[lms] = length
    a, b = ordered[:-1], ordered[1:]
    same = of[a] == of[b]
    at = np.flatnonzero(same)
    t = 0
    while len(at):
        live = of[a[at]] > t
        at = at[live]
        equal = s[a[at] + t] == s[b[at] + t]
        same[at[~equal]] = False
        at = at[equal]
        t += 1
    rank = np.concatenate(([0], np.cumsum(~same)))
    name = np.empty(len(s), dtype=np.int64)
    name[ordered] = rank
    return name[lms], int(rank[-1]) + 1


_FEW_SYMBOLS = 512


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``s`` (integers below ``symbols``) whose last symbol is
    0 and occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    few = symbols <= _FEW_SYMBOLS

    def induced(order: np.ndarray) -> np.ndarray:
        if few:
            return _induce(s, small, symbols, order)
        return np.array(_induce_each(s.tolist(), small.tolist(), symbols, order.tolist()))

    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    first = induced(lms)
    names, distinct = _names(s, lms, first[is_lms[first]])
    if distinct < len(lms):
        order = lms[suffix_array(names, distinct)]
    else:
        order = np.empty(len(lms), dtype=np.int64)
        order[names] = lms
    return induced(order)


_SEPARATOR = 0xFF  # never a byte of UTF-8 text


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a separator after each, and where each starts."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8), starts


def repeated_groups(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group): all positions with ``left`` >= ``length`` bytes
    before the next separator, in suffix order, positions with the same next
    ``length`` bytes in one group."""
    s = np.append(data.astype(np.int16) + 1, np.int16(0))
    order = suffix_array(s, 257)[1:]
    order = order[left[order] >= length]
    if not len(order):
        return order, order
    # permuted common prefixes: each position against its predecessor in
    # suffix order, visited in text order, as far as ``length``
    before = np.full(len(data), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    words = np.lib.stride_tricks.sliding_window_view(
        np.concatenate((data, np.zeros(8, np.uint8))), 8)
    for t in [*range(0, length - 7, 8), max(0, length - 8)]:
        a = words[at + t].copy().view(np.uint64).ravel()
        b = words[before[at] + t].copy().view(np.uint64).ravel()
        at = at[a == b]
    same = np.zeros(len(data), dtype=bool)
    same[at] = True
    return order, np.cumsum(~same[order])
