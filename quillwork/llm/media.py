"""Media columns: bytes as motion-JPEG in AVI, read back through the RIFF index, and shots.

A payload byte is one 8 x 8 block of an intra frame of 24 x 24 blocks. The block is
flat, so its only coefficient is the DC term; with a DC quantiser of 8 that term is
the byte itself less 128, and the baseline JPEG holds it without loss. Such frames are
decoded all in step; frames of other writers (any baseline JPEG that brings its own
Huffman tables) are decoded one by one, with all coefficients.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._text import column_bytes, slices

GRID = 24
FRAME = GRID * GRID
PAD = 255
FRAME_MS = 40

# JPEG's usual luminance DC code (counts of codes by length, then categories).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The AC code holds the end of block alone, as one bit.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header() -> bytes:
    """All that stands before the entropy-coded data of a frame."""
    side = 8 * GRID
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"AVI1\0" + bytes(9)),
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


HEADER = jpeg_header()


def canonical(counts: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of a Huffman table as JPEG writes one."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC = canonical(DC_COUNTS, DC_SYMBOLS)
_CODE = np.array([_DC[c][0] for c in range(9)], np.uint64)
_LENGTH = np.array([_DC[c][1] for c in range(9)], np.int64)
_CATEGORY = np.array([int(v).bit_length() for v in range(256)], np.int64)


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, byte-stuffed scans of (frames, 576) samples, and their offsets."""
    frames = len(samples)
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    cat = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff).astype(np.uint64)
    length = np.empty((frames, FRAME + 1), np.int64)
    length[:, :-1] = _LENGTH[cat] + cat + 1
    used = length[:, :-1].sum(1)
    length[:, -1] = -used % 8
    code = np.empty((frames, FRAME + 1), np.uint64)
    code[:, :-1] = ((_CODE[cat] << cat.astype(np.uint64)) | extra) << np.uint64(1)
    code[:, -1] = (np.uint64(1) << length[:, -1].astype(np.uint64)) - np.uint64(1)
    length, code = length.ravel(), code.ravel()
    ends = np.cumsum(length)
    at = ends - length
    word = at >> 5
    placed = code << (64 - (at & 31) - length).astype(np.uint64)
    runs = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words = np.zeros(int(ends[-1] >> 5) + 3, np.uint64)
    words[word[runs]] += np.add.reduceat(placed >> np.uint64(32), runs)
    words[word[runs] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), runs)
    raw = words.astype(">u4").view(np.uint8)[: int(ends[-1] >> 3)]
    offsets = np.concatenate([[0], ends[FRAME :: FRAME + 1] >> 3])
    marks = np.flatnonzero(raw == 0xFF)
    return np.insert(raw, marks + 1, 0), offsets + np.searchsorted(marks, offsets)


def write_avi(scans: list[bytes]) -> bytes:
    """An AVI file of the frames, with its index."""
    side = 8 * GRID
    body, index, at = [], [], 4
    for scan in scans:
        n = len(HEADER) + len(scan) + 2
        body.append(b"00dc" + struct.pack("<I", n) + HEADER + scan + b"\xff\xd9" + b"\0" * (n % 2))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, n))
        at += 8 + n + n % 2
    biggest = max(map(len, body))
    avih = struct.pack("<14I", FRAME_MS * 1000, biggest * 1000 // FRAME_MS, 0, 0x10, len(scans), 0, 1, biggest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(scans), biggest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", 3 * side * side, 0, 0, 0, 0)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    stream = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + stream)
    movi = chunk(b"LIST", b"movi" + b"".join(body))
    return chunk(b"RIFF", b"AVI " + head + movi + chunk(b"idx1", b"".join(index)))


def _riff(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Milliseconds a frame and the (start, length) of every video frame of an AVI file, by its index or else its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, ms = None, None, FRAME_MS
    found: list[tuple[int, int]] = []
    todo = [(12, len(data))]
    while todo:
        at, stop = todo.pop()
        while at + 8 <= stop:
            name, n = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                if kind in (b"hdrl", b"movi", b"rec "):
                    todo.append((at + 8 + n + n % 2, stop))
                    stop = min(stop, at + 8 + n)
                    at += 12
                    continue
            elif name == b"avih":
                ms = max(struct.unpack_from("<I", data, at + 8)[0] // 1000, 1)
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", n // 16 * 4, at + 8).reshape(-1, 4)
            elif movi is not None and name[2:] in (b"dc", b"db"):
                found.append((at + 8, n))
            at += 8 + n + n % 2
    if movi is None:
        raise ValueError("no frames")
    if index is not None:
        video = index[np.isin(index[:, 0] >> 16, [int.from_bytes(x, "little") for x in (b"dc", b"db")])]
        if len(video):
            base = movi if data[movi + int(video[0, 2]) :][:4] == video[0, 0].tobytes() else 0  # some writers count from the file's start
            found = [(base + int(o) + 8, int(n)) for o, n in video[:, 2:]]
    if any(a + n > len(data) for a, n in found):
        raise ValueError("a frame passes the end of the file")
    return ms, found


def read_avi(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of every video frame of an AVI file."""
    return _riff(data)[1]


def scan_tables(frame: bytes) -> tuple[int, int, bytes, bytes]:
    """Where the scan starts, the DC quantiser and both Huffman tables of a frame."""
    at, quantiser, dc, ac = 2, 0, b"", b""
    while True:
        mark, kind, n = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + n]
        if mark != 0xFF:
            raise ValueError("no marker where one is due")
        if kind == 0xDB:
            quantiser = body[1]
        elif kind == 0xC4:
            dc, ac = (body, ac) if body[0] >> 4 == 0 else (dc, body)
        elif kind == 0xC0:
            if body[:1] != b"\x08" or struct.unpack(">HHB", body[1:6]) != (8 * GRID, 8 * GRID, 1):
                raise ValueError("not one 8-bit component of the expected size")
        at += 2 + n
        if kind == 0xDA:
            return at, quantiser, dc, ac


def _block_codes(quantiser: int, dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that a block may start with: its DC difference and its length (0: no such block)."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    end, end_len = canonical(ac[1:17], ac[17:])[0]
    for cat, (code, n) in canonical(dc[1:17], dc[17:]).items():
        total = n + cat + end_len
        if cat > 8 or total > 16:
            continue
        for extra in range(1 << cat):
            v = extra if cat == 0 or extra >> (cat - 1) else extra - (1 << cat) + 1
            first = ((((code << cat) | extra) << end_len) | end) << (16 - total)
            value[first : first + (1 << (16 - total))] = v * quantiser // 8
            length[first : first + (1 << (16 - total))] = total
    return value, length


_block_cache: dict[tuple[int, bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def decode_frames(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 576) samples of all files and the number of frames of each.

    All frames are decoded in step: block k of every frame, then block k + 1.
    Frames must have flat blocks, which is what ``encode_frames`` writes; any other block raises ValueError.
    """
    scans, counts, tables, head = [], [], None, None
    for data in files:
        spans = read_avi(data)
        counts.append(len(spans))
        for start, n in spans:
            if head is None or not data.startswith(head, start):
                at, *found = scan_tables(data[start : start + n])
                if tables not in (None, found):
                    raise ValueError("frames differ in their tables")
                tables, head = found, data[start : start + at]
            scans.append(data[start + len(head) : start + n - 2])
    sizes = np.array([len(s) for s in scans])
    raw = np.frombuffer(b"".join(scans), np.uint8)
    offsets = np.cumsum(sizes) - sizes
    stuffed = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
    keep = np.ones(len(raw), bool)
    keep[stuffed] = False
    offsets = offsets - np.searchsorted(stuffed, offsets)
    flat = np.concatenate([raw[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (flat[:-3] << np.uint32(24)) | (flat[1:-2] << np.uint32(16)) | (flat[2:-1] << np.uint32(8)) | flat[3:]
    key = (tables[0], tables[1], tables[2])
    if key not in _block_cache:
        _block_cache[key] = _block_codes(*key)
    value, length = _block_cache[key]
    bit = offsets.astype(np.int64) * 8
    level = np.full(len(scans), 128, np.int64)
    out = np.empty((FRAME, len(scans)), np.uint8)
    for k in range(FRAME):
        code = (window[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        step = length[code]
        if not step.all():
            raise ValueError("a block that is not flat")
        level += value[code]
        out[k] = level
        bit += step
    return np.ascontiguousarray(out.T), np.array(counts)


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block, by rows, of each coefficient in the order in which JPEG writes them."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(order)


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _scan_blocks(raw: bytes, order: list[tuple[int, int]], mcus: int, tables: dict[int, tuple[dict, dict]], out: list[list[list[int]]]) -> None:
    """Read ``mcus`` groups of blocks from one run of entropy-coded bytes; ``order`` has (component, blocks)."""
    raw = raw.replace(b"\xff\x00", b"\xff")
    bits, size, at = int.from_bytes(raw[:64] + bytes(8), "big"), (len(raw[:64]) + 8) * 8, 0
    loaded = len(raw[:64])
    pos = 0  # bits used

    def peek(n: int) -> int:
        nonlocal bits, size, at, loaded
        while pos - at + n > size - 64 and loaded < len(raw):  # go on to the next bytes
            keep = pos >> 3
            part = raw[keep : keep + 64]
            bits, size, at, loaded = int.from_bytes(part + bytes(8), "big"), (len(part) + 8) * 8, keep * 8, keep + len(part)
        if pos + n > len(raw) * 8 + 16:
            raise ValueError("the scan ends before its last block")
        return (bits >> (size - (pos - at) - n)) & ((1 << n) - 1)

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        nonlocal pos
        code = peek(16)
        for n in range(1, 17):
            found = codes.get((n, code >> (16 - n)))
            if found is not None:
                pos += n
                return found
        raise ValueError("no such code")

    def signed(n: int) -> int:
        nonlocal pos
        if not n:
            return 0
        v = peek(n)
        pos += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    level = dict.fromkeys((c for c, _ in order), 0)
    for _ in range(mcus):
        for c, blocks in order:
            dc, ac = tables[c]
            for _ in range(blocks):
                block = [0] * 64
                level[c] += signed(symbol(dc))
                block[0] = level[c]
                k = 1
                while k < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        if k > 63:
                            raise ValueError("a coefficient beyond the block")
                        block[k] = signed(s & 15)
                    k += 1
                out[c].append(block)
    if pos > len(raw) * 8:
        raise ValueError("the scan ends before its last block")


def decode_jpeg(frame: bytes) -> np.ndarray:
    """The first component (grey or luminance) of a baseline JPEG as an array of its rows.

    Any size, up to four components with any sampling, restarts; a frame without its
    own tables, a progressive one, and one whose scan is cut or corrupt raise ValueError.
    """
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, dcs, acs, parts, restart = 2, {}, {}, {}, [], 0
    height = width = 0
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame):
            raise ValueError("no scan")
        mark, kind, n = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + n]
        if mark != 0xFF:
            raise ValueError("no marker where one is due")
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                count = sum(body[1:17])
                codes = {(length, code): s for s, (code, length) in canonical(body[1:17], body[17 : 17 + count]).items()}
                (acs if body[0] >> 4 else dcs)[body[0] & 15] = codes
                body = body[17 + count :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, many = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("not 8 bits a sample, or no size")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            break
    used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if not parts or set(used) != {p[0] for p in parts}:
        raise ValueError("not one scan of all components")
    try:
        tables = {i: (dcs[used[p[0]] >> 4], acs[used[p[0]] & 15]) for i, p in enumerate(parts)}
        first = quant[parts[0][3]]
    except KeyError:
        raise ValueError("a table is missing") from None
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        most_h = most_v = 1
        order = [(0, 1)]
    else:
        order = [(i, p[1] * p[2]) for i, p in enumerate(parts)]
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    end = frame.rfind(b"\xff\xd9")
    data = frame[at : end if end >= at else len(frame)]
    runs, start = [], 0
    for i in range(len(data) - 1) if restart else ():
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            runs.append(data[start:i])
            start = i + 2
    runs.append(data[start:])
    out: list[list[list[int]]] = [[] for _ in parts]
    left = across * down
    for run in runs:
        n = min(restart or left, left)
        _scan_blocks(run, order, n, tables, out)
        left -= n
    if left:
        raise ValueError("the scan ends before its last block")
    coef = np.zeros((len(out[0]), 64))
    coef[:, _ZIGZAG] = np.array(out[0]) * first
    blocks = _COSINES.T @ coef.reshape(-1, 8, 8) @ _COSINES
    h, v = (1, 1) if len(parts) == 1 else parts[0][1:3]
    plane = blocks.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
    own_w, own_h = -(-width * h // most_h), -(-height * v // most_v)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:own_h, :own_w]


#: Bins of a histogram.
BINS = 64


def histograms(samples: np.ndarray, ignore: int | None = None) -> np.ndarray:
    """The histogram of each row of samples; samples of the value ``ignore`` (a filler) are left out."""
    n = len(samples)
    key = np.arange(n)[:, None] * BINS + (samples >> 2)
    hist = np.bincount(key.ravel(), minlength=BINS * n).reshape(n, BINS)
    if ignore is not None:
        hist[:, ignore >> 2] -= (samples == ignore).sum(1)
    return hist


def shot_starts(hist: np.ndarray, counts: np.ndarray, reach: int = 5, least: float = 4.0, spread: float = 2.0) -> np.ndarray:
    """Which frames start a shot, from the histograms of all frames and the number of frames of each file.

    The difference of neighbours is the chi-square of their histograms as two samples
    of one source, told in deviations of what chance gives, so frames of any size (and
    frames filled in part) compare alike. A shot starts where the difference is over
    ``least`` and over the mean and ``spread`` deviations of the differences within
    ``reach`` frames around.
    """
    n = len(hist)
    if not n:
        return np.zeros(0, bool)
    file = np.repeat(np.arange(len(counts)), counts)
    first = (np.cumsum(counts) - counts)[file]
    last = np.cumsum(counts)[file] - 1
    size = hist.sum(1).astype(float)
    share = hist / np.maximum(size, 1)[:, None]
    both = share[1:] + share[:-1]
    weight = 2 * size[1:] * size[:-1] / np.maximum(size[1:] + size[:-1], 1)
    bins = (both > 0).sum(1)
    diff = np.zeros(n)
    diff[1:] = ((share[1:] - share[:-1]) ** 2 / np.where(both > 0, both, 1)).sum(1) * weight
    diff[1:] = np.where(weight > 0, (diff[1:] - bins) / np.sqrt(2 * np.maximum(bins, 1)), 0)
    opens = np.arange(n) == first
    diff[opens] = 0
    diff = np.rint(diff * 4096).astype(np.int64)  # whole, so that the running sums do not depend on what stands before
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (diff, diff * diff // 4096))
    lo, hi = np.maximum(first + 1, np.arange(n) - reach), np.minimum(last, np.arange(n) + reach) + 1
    lo = np.minimum(lo, hi)
    around = np.maximum(hi - lo - 1, 1)  # without the frame itself
    mean = (sums[hi] - sums[lo] - diff) / around
    variance = np.maximum((squares[hi] - squares[lo] - diff * diff // 4096) / around * 4096 - mean * mean, 0)
    return opens | ((diff > least * 4096) & (diff > mean + spread * np.sqrt(variance)))


def clips_of(hist: np.ndarray, level: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first frame, frame after, mean level) of every shot; ``level`` has the sum and the number of samples of each frame."""
    starts = np.flatnonzero(shot_starts(hist, counts))
    if not len(starts):
        return starts, starts, np.zeros(0)
    total = np.add.reduceat(level, starts)
    return starts, np.append(starts[1:], len(hist)), total[:, 0] / np.maximum(total[:, 1], 1)


def _levels(samples: np.ndarray, ignore: int | None = None) -> np.ndarray:
    """The sum and the number of the samples of each row."""
    total, many = samples.sum(1, dtype=np.int64), np.full(len(samples), samples.shape[1])
    if ignore is not None:
        filler = (samples == ignore).sum(1)
        total, many = total - filler * ignore, many - filler
    return np.stack([total, many], axis=1)


def _padded(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Each row's bytes, its number of frames, and all samples."""
    data, offsets = column_bytes(part.column("text"))
    sizes = np.diff(offsets)
    frames = np.maximum(-(-sizes // FRAME), 1)
    samples = np.full(int(frames.sum()) * FRAME, PAD, np.uint8)
    at = (np.cumsum(frames) - frames) * FRAME
    samples[np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)] = data
    return sizes, frames, samples.reshape(-1, FRAME)


def _media(part: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    sizes, frames, samples = _padded(part)
    scans, offsets = encode_frames(samples)
    raw = scans.tobytes()
    ends = np.cumsum(frames)
    files = [write_avi([raw[offsets[f] : offsets[f + 1]] for f in range(e - n, e)]) for n, e in zip(frames, ends)]
    return sizes, files


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as an AVI file; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, files = _media(part)
                yield pa.record_batch([part.column("id"), pa.array(sizes), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def clip_rows(media: DataFrame, ignore: int | None = None) -> DataFrame:
    """Timed rows of the shots of (id, media): id, clip, start_ms, end_ms, frames, mean_level.

    Times follow the frame time that the file's header tells. Samples of the value
    ``ignore`` are left out of histograms and levels. A null file has no clips, one
    without frames neither; a file that is no AVI, or a frame that is cut, corrupt or
    not baseline, raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                ids, files = part.column("id").to_pylist(), part.column("media").to_pylist()
                hists, levels, counts, times = [np.zeros((0, BINS), np.int64)], [np.zeros((0, 2), np.int64)], [], []
                for data in files:
                    ms, frames = _riff(data)
                    own = all(data.startswith(HEADER, a) for a, _ in frames)
                    rows = [decode_frames([data])[0]] if own and frames else [decode_jpeg(data[a : a + n]).reshape(1, -1) for a, n in frames]
                    hists += [histograms(r, ignore) for r in rows]
                    levels += [_levels(r, ignore) for r in rows]
                    counts.append(len(frames))
                    times.append(ms)
                counts = np.array(counts)
                starts, ends, level = clips_of(np.concatenate(hists), np.concatenate(levels), counts)
                file = np.repeat(np.arange(len(counts)), counts)[starts]
                first, ms = (np.cumsum(counts) - counts)[file], np.array(times)[file]
                clip = np.arange(len(starts)) - np.searchsorted(file, file)
                cols = [pa.array([ids[i] for i in file], part.column("id").type), pa.array(clip), pa.array((starts - first) * ms), pa.array((ends - first) * ms), pa.array(ends - starts), pa.array(level)]
                yield pa.record_batch(cols, ["id", "clip", "start_ms", "end_ms", "frames", "mean_level"])

    rows = media.select("id", "media").where("media is not null")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, clip long, start_ms long, end_ms long, frames long, mean_level double")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back from the stored bytes, and digest both.

    The file is made, read and dropped in one task: it is never shuffled. ``feature``
    tells the timed clips of the frames read back, each with its mean level; padding
    counts for nothing in them. Defined
    cases: a null or empty text is one frame of padding; equal texts have equal files
    and features; repeated rows each give a row; an empty table gives none.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sizes, files = _media(part)
                samples, counts = decode_frames(files)
                starts, ends, level = clips_of(histograms(samples, PAD), _levels(samples, PAD), counts)
                clips = [f"{m:.2f}" for m in level]
                rows, at, c = [], 0, 0
                for n, f, data in zip(sizes.tolist(), counts.tolist(), files):
                    back = samples[at : at + f].tobytes()
                    told = []
                    while c < len(starts) and starts[c] < at + f:
                        told.append(f"{(starts[c] - at) * FRAME_MS}-{(ends[c] - at) * FRAME_MS}@{clips[c]}")
                        c += 1
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{f} frames, clips in ms {' '.join(told)}"))
                    at += f
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.record_batch([part.column("id"), *cols], names)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as AVI files, read back."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
