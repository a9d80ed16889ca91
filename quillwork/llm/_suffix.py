"""Suffix arrays by induced sorting, bucket by bucket, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from ._text import prefix_hash, span_hash

#: Alphabets up to this size are induced bucket by bucket; larger ones, which only occur for the
#: names of a reduced string, by doubling of ranks.
BUCKETS = 2048


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where larger (L)."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = np.append(text[:-1] < text[1:], True)
    return smaller[following]


class _Induced:
    """Fills a suffix array from ordered leftmost-smaller suffixes."""

    def __init__(self, text: np.ndarray, small: np.ndarray):
        self.text, self.small = text, small
        self.size = int(text.max()) + 1
        count = np.bincount(text, minlength=self.size)
        self.n_large = np.bincount(text[~small], minlength=self.size)
        self.tail = np.cumsum(count)
        self.head = self.tail - count
        self.present = np.flatnonzero(count)

    def _deal(self, block: np.ndarray, small: bool, at: np.ndarray, step: int) -> None:
        """Put the predecessors of the suffixes in ``block`` at the ends of their buckets, in order."""
        p = block[block > 0] - 1
        p = p[self.small[p] == small]
        if not len(p):
            return
        c = self.text[p]
        order = np.argsort(c.astype(np.uint16), kind="stable")  # a radix sort
        p, c = p[order], c[order]
        runs = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(runs, len(c)))
        rank = np.arange(len(c)) - np.repeat(runs, size)
        self.sa[at[c] + step * rank] = p
        at[c[runs]] += step * size

    def fill(self, leftmost: np.ndarray) -> np.ndarray:
        """The suffix array whose leftmost-smaller suffixes stand in the order given."""
        n = len(self.text)
        self.sa = np.full(n, -1, np.int64)
        first = self.text[leftmost]
        by = leftmost[np.argsort(first.astype(np.uint16), kind="stable")]
        ends = np.cumsum(np.bincount(first, minlength=self.size))
        at = self.head.copy()
        for c in self.present:  # larger suffixes, left to right
            done = self.head[c]
            while done < at[c]:
                block, done = self.sa[done : at[c]], at[c]
                self._deal(block, False, at, 1)
            if c == 0 or ends[c] > ends[c - 1]:
                self._deal(by[ends[c - 1] if c else 0 : ends[c]], False, at, 1)
        at = self.tail - 1
        self.sa[0] = n - 1
        at[self.text[n - 1]] -= 1
        for c in self.present[::-1]:  # smaller suffixes, right to left
            done = self.tail[c] - 1
            while done > at[c]:
                block, done = self.sa[at[c] + 1 : done + 1][::-1], at[c]
                self._deal(block, True, at, -1)
            self._deal(self.sa[self.head[c] : self.head[c] + self.n_large[c]][::-1], True, at, -1)
        return self.sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        fresh = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


def _alike(text: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each substring but the first equals the one before it; hashes choose those that are compared value by value."""
    out = (h[1:] == h[:-1]) & (size[1:] == size[:-1])
    on = np.flatnonzero(out)
    n = size[on]
    first = np.cumsum(n) - n
    for a in range(0, len(on), 1 << 16):  # a bounded number of values at a time
        part = slice(a, a + (1 << 16))
        shift = np.arange(int(n[part].sum())) - np.repeat(first[part] - first[a], n[part])
        differs = text[np.repeat(start[on[part]], n[part]) + shift] != text[np.repeat(start[on[part] + 1], n[part]) + shift]
        out[on[part]] = ~np.logical_or.reduceat(differs, first[part] - first[a])
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose last value must be its one least value, 0.

    Suffixes are classified; leftmost-smaller substrings are sorted by induction and
    named; the string of names is sorted recursively where names repeat; the whole
    array is then induced from the sorted leftmost-smaller suffixes, in linear passes.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    if int(text.max()) >= BUCKETS:
        return _by_doubling(text)
    small = suffix_types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induced = _Induced(text, small)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    sa = induced.fill(leftmost)
    ordered = sa[is_leftmost[sa]]
    number = np.zeros(n, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    ends = np.minimum(np.append(leftmost[1:], n - 1) + 1, n)
    prefix = prefix_hash(text)
    which = number[ordered]
    h, size = span_hash(prefix, leftmost, ends)[which], (ends - leftmost)[which]
    name = np.empty(len(leftmost), np.int64)
    name[which] = np.append(0, np.cumsum(~_alike(text, leftmost[which], size, h)))
    if name.max() + 1 < len(name):
        leftmost = leftmost[suffix_array(name)]
    else:
        leftmost = leftmost[np.argsort(name, kind="stable")]
    return induced.fill(leftmost)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the length of the prefix its suffix shares with the suffix before it in ``sa``.

    In text order the length falls by at most one a step, and does exactly that where
    the bytes before both suffixes agree; only the other places are compared.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    place = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (data[place[1:] - 1] == data[before[1:] - 1])
    own = np.flatnonzero(~same & (before >= 0))
    length = np.zeros(n, np.int64)
    a, b, on = own.copy(), before[own], own
    while len(on):
        left = n - np.maximum(a, b)
        x = words[a] ^ words[b]
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        step = np.minimum(equal, left)
        length[on] += step
        go = (step == 8) & (left > 8)
        a, b, on = a[go] + 8, b[go] + 8, on[go]
    last = np.maximum.accumulate(np.where(same, -1, place))
    return np.where(same, length[np.maximum(last, 0)] - (place - last), length)
