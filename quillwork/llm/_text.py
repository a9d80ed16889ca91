"""Whole Arrow text columns as numpy bytes: words, hashes and slices without Python strings."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Return freed memory to the system; a Python worker otherwise keeps its peak for all later tasks."""
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL(None).malloc_trim(0)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text or binary column and its offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first, last = int(offs[0]), int(offs[-1])
    return np.frombuffer(data, np.uint8)[first:last], offs - first


def slices(batch: pa.RecordBatch, column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose text is about ``most`` bytes; one longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def powers(name: str, n: int) -> np.ndarray:
    """Powers of the hash base (``up``) or of its inverse (``down``) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), BASE if name == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**position up to each position; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers("up", len(data))[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    h = prefix[ends] - prefix[starts]
    h *= powers("down", len(prefix))[starts]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy over all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_spans(column: pa.Array, symbols: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends and the row of each word.

    With ``symbols``, runs of other characters than white space are words too.

    A word is a run of letters, digits and marks of any script: ASCII other than
    letters and digits, Latin-1 signs, general and CJK punctuation part words.
    """
    data, offsets = column_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    keep = _PLAIN[data]
    n = len(data)
    if n > 2 and (data >= 0xC2).any():
        for lead, second, length in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
            at = np.flatnonzero(data[: n - length + 1] == lead)
            if second is not None:
                at = at[(data[at + 1] >= second[0]) & (data[at + 1] <= second[1])]
            for k in range(length):
                keep[at + k] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    kind = keep.view(np.uint8)
    if symbols:
        kind = np.where(~keep & ~_BLANK[data], 2, kind).astype(np.uint8)
    turns = np.ones(n + 1, bool)
    turns[1:n] = kind[1:] != kind[:-1]
    turns |= edge
    starts = np.flatnonzero((kind > 0) & turns[:n])
    ends = np.flatnonzero((kind > 0) & turns[1:]) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return data, starts, ends, rows


def row_runs(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's run in an ordered array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
