import hashlib
import zlib

import numpy as np
import pytest

from quillwork.llm import media
from quillwork.llm.media import BINS, PAD, canonical, clip_rows, decode_frames, decode_jpeg, encode_frames, histograms, op6_avi_mjpeg, read_avi, shot_starts, to_media, write_avi


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 256, (50, 576)).astype(np.uint8)
    s[0], s[1], s[2, ::2], s[2, 1::2] = 0, 255, 0, 255
    scans, at = encode_frames(s)
    raw = scans.tobytes()
    files = [write_avi([raw[at[i] : at[i + 1]] for i in r]) for r in (range(1), range(1, 20), range(20, 50))]
    back, counts = decode_frames(files)
    assert (back == s).all() and counts.tolist() == [1, 19, 30]
    assert files[0][:4] == b"RIFF" and int.from_bytes(files[0][4:8], "little") == len(files[0]) - 8
    start, n = read_avi(files[1])[3]
    assert files[1][start : start + 2] == b"\xff\xd8" and files[1][start + n - 2 : start + n] == b"\xff\xd9"


def test_blocks_that_are_not_flat_raise():
    with pytest.raises(ValueError, match="not flat"):
        decode_frames([write_avi([b"\xfe" * 500])])


def jpeg(planes, sampling, width, height, restart=0, quantiser=3):
    """A plain baseline encoder for tests: forward transform, fixed-length codes, any sampling."""
    zig = media._ZIGZAG
    seg = lambda k, b: bytes([0xFF, k]) + (len(b) + 2).to_bytes(2, "big") + b
    symbols = [r << 4 | n for r in range(16) for n in range(11)]
    code = canonical(bytes([0] * 7 + [len(symbols)] + [0] * 8), bytes(symbols))
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    n = len(planes)
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([quantiser] * 64)) + seg(0xC4, b"\x00" + table + b"\x10" + table)
    head += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    head += seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    H, V = (1, 1) if n == 1 else (max(h for h, _ in sampling), max(v for _, v in sampling))
    across, down = -(-width // (8 * H)), -(-height // (8 * V))
    bits, out, level = "", b"", [0] * n

    def value(v):
        k = int(abs(v)).bit_length()
        return k, format(v if v >= 0 else v + (1 << k) - 1, f"0{k}b") if k else ""

    def closed(b):
        b += "1" * (-len(b) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            out, bits, level = out + closed(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8]), "", [0] * n
        for c, plane in enumerate(planes):
            h, v = (1, 1) if n == 1 else sampling[c]
            for b in range(h * v):
                y, x = (m // across * v + b // h) * 8, (m % across * h + b % h) * 8
                block = np.pad(plane, ((0, 64), (0, 64)), mode="edge")[y : y + 8, x : x + 8].astype(float) - 128
                coef = np.rint((media._COSINES @ block @ media._COSINES.T).ravel()[zig] / quantiser).astype(int)
                k, extra = value(coef[0] - level[c])
                level[c] = coef[0]
                bits += format(code[k][0], "08b") + extra
                run = 0
                for q in coef[1:]:
                    if q == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(code[0xF0][0], "08b")
                        run -= 16
                    k, extra = value(q)
                    bits += format(code[run << 4 | k][0], "08b") + extra
                    run = 0
                if run:
                    bits += format(code[0][0], "08b")
    return head + out + closed(bits) + b"\xff\xd9"


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(2, 2)], 3), ([(1, 1)] * 3, 0), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 0)])
def test_pictures_with_all_coefficients(sampling, restart):
    rng = np.random.default_rng(4)
    w, h = 45, 37
    y, x = np.mgrid[:h, :w]
    luma = np.clip(128 + 80 * np.sin(x / 5) + 40 * np.cos(y / 3) + rng.normal(0, 6, (h, w)), 0, 255)
    planes = [luma] + [np.full((h, w), 90.0)] * (len(sampling) - 1)
    frame = jpeg(planes, sampling, w, h, restart)
    back = decode_jpeg(frame)
    assert back.shape == (h, w) and np.abs(back - luma).max() < 12 and np.abs(back - luma).mean() < 2
    for bad in (frame[: len(frame) // 2], b"GIF", frame[:2] + frame[3:]):
        with pytest.raises(ValueError):
            decode_jpeg(bad)


def test_the_own_frames_are_baseline_jpegs():
    s = np.random.default_rng(2).integers(0, 256, (2, 576)).astype(np.uint8)
    scans, at = encode_frames(s)
    for i in range(2):
        got = decode_jpeg(media.HEADER + scans.tobytes()[at[i] : at[i + 1]] + b"\xff\xd9")
        assert (got[4::8, 4::8].ravel() == s[i]).all() and got.shape == (192, 192)


def test_clips_of_pictures_of_other_writers(spark):
    """Frames of 40 x 24 whose pictures change after the third and the seventh."""
    y, x = np.mgrid[:24, :40]
    looks = [60 + 2.0 * x, 215 - 2.0 * y, 10 + 1.0 * x]
    rng = np.random.default_rng(0)
    frames = [jpeg([np.clip(looks[k] + rng.normal(0, 1, looks[k].shape), 0, 255)], [(1, 1)], 40, 24) for k in (0, 0, 0, 1, 1, 1, 1, 2, 2)]
    plain = write_avi([f[2:-2] for f in frames])
    data = plain.replace(media.HEADER, b"\xff\xd8" + b"\xff\xfe" + (len(media.HEADER) - 4).to_bytes(2, "big") + bytes(len(media.HEADER) - 6))
    rows = clip_rows(spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, media binary")).orderBy("clip").collect()
    assert [(r.start_ms, r.end_ms, r.frames) for r in rows] == [(0, 120, 3), (120, 280, 4), (280, 360, 2)]
    no_index = data[: data.index(b"idx1")] + b"JUNK" + data[data.index(b"idx1") + 4 :]
    assert read_avi(no_index) == read_avi(data)


def test_shots_follow_the_histogram():
    s = np.zeros((12, 576), np.uint8)
    s[4:8], s[8:] = 100, 200
    assert np.flatnonzero(shot_starts(histograms(s), np.array([12]))).tolist() == [0, 4, 8]
    assert np.flatnonzero(shot_starts(histograms(s[:4]), np.array([2, 2]))).tolist() == [0, 2]
    assert shot_starts(np.zeros((0, BINS), int), np.zeros(0, int)).tolist() == []


def plain_shots(raw, reach=5, least=4.0, spread=2.0):
    """The rule frame by frame, without padding and without running sums."""
    frames = [np.bincount(np.frombuffer(raw[i : i + 576], np.uint8) >> 2, minlength=64).astype(float) for i in range(0, len(raw), 576)] or [np.zeros(64)]
    diff = [0.0]
    for a, b in zip(frames, frames[1:]):
        p, q, n, m = a / a.sum(), b / b.sum(), a.sum(), b.sum()
        on = p + q > 0
        diff.append((((p - q)[on] ** 2 / (p + q)[on]).sum() * 2 * n * m / (n + m) - on.sum()) / (2 * on.sum()) ** 0.5)
    out = [0]
    for i in range(1, len(diff)):
        near = [diff[j] for j in range(max(1, i - reach), min(len(diff), i + reach + 1)) if j != i] or [0.0]
        if diff[i] > least and diff[i] > np.mean(near) + spread * np.std(near):
            out.append(i)
    return out


def test_shots_depend_on_content(spark):
    prose = ("the quiet harbor wind carried lantern light over grey stones " * 60).encode()
    table = b"".join(b"%d;%d;%d\n" % (i, i * 7919 % 10007, i * i) for i in range(600))
    raws = [prose[:4000] + table[:3000] + prose[:3500], prose * 3, table, b"", prose[:700], table[:900] + prose[:2000] + b"\n" * 1500]
    rows = spark.createDataFrame([(i, r.decode()) for i, r in enumerate(raws)], "doc_id long, text string")
    got = {}
    for r in clip_rows(to_media(rows), PAD).orderBy("id", "clip").collect():
        got.setdefault(r.id, []).append(r.start_ms // 40)
    assert [got[i] for i in range(len(raws))] == [plain_shots(r) for r in raws]
    assert len(got[0]) > 1 and len(got[1]) == 1
    told = {r.id: r.feature for r in media.media_digests(rows).collect()}
    for i in got:
        assert [int(x.split("-")[0]) // 40 for x in told[i].split(" ms ")[1].split()] == got[i]


def test_query(spark, docs, empty, repeated, texts, sf_dir):
    got = {r.doc_id: r for r in op6_avi_mjpeg(spark, sf_dir(documents=docs)).collect()}
    files = {r.id: bytes(r.media) for r in to_media(docs).collect()}
    for i, t in texts:
        raw, r = padded(t), got[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert got[7].feature == got[8].feature and got[7].media_sha256 == got[8].media_sha256
    assert to_media(empty).count() == 0 and media.media_digests(repeated).count() == 2 * len(texts)


def test_clips_cover_each_file(spark, docs):
    rows = clip_rows(to_media(docs)).toPandas()
    for _, g in rows.groupby("id"):
        g = g.sort_values("clip")
        assert g.start_ms.iloc[0] == 0 and (g.start_ms.iloc[1:].to_numpy() == g.end_ms.iloc[:-1].to_numpy()).all()
    assert rows.id.nunique() == docs.where("doc_id is not null").count()
