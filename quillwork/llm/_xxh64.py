"""XXH64 of many spans of one byte buffer at once."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """The unsigned XXH64 of data[start : start + length] for every span.

    All spans advance together: one step takes the next stripe, lane or byte of the
    spans that still have one.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(padded)
    u64 = np.ndarray((n - 7,), "<u8", padded.data, 0, (1,))
    u32 = np.ndarray((n - 3,), "<u4", padded.data, 0, (1,))
    starts = starts.astype(np.int64)
    lengths = lengths.astype(np.int64)
    h = np.full(len(starts), (seed + int(P5)) & ((1 << 64) - 1), np.uint64)
    at = starts.copy()
    big = np.flatnonzero(lengths >= 32)
    if len(big):
        lanes = [(seed + x) & ((1 << 64) - 1) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        acc = [np.full(len(big), v, np.uint64) for v in lanes]
        stripes, p = lengths[big] // 32, starts[big]
        left = np.arange(len(big))
        for k in range(int(stripes.max())):
            left = left[stripes[left] > k]
            q = p[left] + 32 * k
            for i in range(4):
                acc[i][left] = _round(acc[i][left], u64[q + 8 * i])
        v = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            v = (v ^ _round(np.zeros_like(a), a)) * P1 + P4
        h[big] = v
        at[big] = p + 32 * stripes
    h += lengths.astype(np.uint64)
    rest = starts + lengths - at
    for k in range(3):  # fewer than 32 bytes are left of each
        on = np.flatnonzero(rest >= 8)
        if not len(on):
            break
        h[on] = _rot(h[on] ^ _round(np.zeros(len(on), np.uint64), u64[at[on]]), 27) * P1 + P4
        at[on] += 8
        rest[on] -= 8
    on = np.flatnonzero(rest >= 4)
    h[on] = _rot(h[on] ^ (u32[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    rest[on] -= 4
    for k in range(3):
        on = np.flatnonzero(rest > 0)
        if not len(on):
            break
        h[on] = _rot(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        rest[on] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h
