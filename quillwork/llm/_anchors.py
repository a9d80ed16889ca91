"""Content-defined anchors of all 100-byte strings of a text."""

from __future__ import annotations

import numpy as np

from ._text import prefix_hash, span_hash

SPAN = 100
#: Bytes of an anchor. Equal strings of SPAN bytes have equal anchors at equal places.
GRAM = 40
#: Low bits that hold a place; the hash's high bits stand above them, and of equal ones the leftmost is taken.
_PLACE = np.uint64(32)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first, last, at, hash): the runs of ``span``-byte strings that share an anchor.

    The anchor of a string is its leftmost least-hashed run of ``gram`` bytes, so it
    depends on the string alone. ``first`` and ``last`` are the starts of the strings
    of the run and ``at`` the place of their anchor, all counted in ``data``.
    """
    n, width = len(data), span - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n < span:
        return empty
    at = np.arange(n - gram + 1)
    h = span_hash(prefix_hash(data), at, at + gram)
    low = ((h >> _PLACE) << _PLACE) | at.astype(np.uint64)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: -(width - have)], low[width - have :])
    owner = (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
    valid = at[: len(owner)] + span <= offsets[1:][row]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty
    own, row = owner[starts], row[starts]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    return row[first], starts[first], starts[last], own[first], h[own[first]]
