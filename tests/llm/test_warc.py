import base64
import hashlib
import time

import duckdb
import numpy as np
import pytest

from quillwork.llm import warc
from quillwork.llm.warc import MAGIC, OP4_SQL, archive_blocks, candidates, chain_ends, op4_boundary_chain, reachable, read_archives, read_pages, write_archives

LONG = (MAGIC + b"Content-Length: ").decode() + "9" * 5000 + "\r\n\r\nx"


def pages(spark):
    body = "<html>" + "x" * 1500
    trap = "<p>" + (MAGIC + b"WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode() * 40
    nested = "\r\n\r\n" + (MAGIC + b"Content-Length: 0\r\n\r\n\r\n\r\n").decode() * 60
    rows = [(1, "http://a", body), (2, "http://b", body), (3, "http://c", "small"), (4, "http://d", "small"), (5, None, None), (6, "", ""), (7, "http://x y\n\"é", trap), (8, "http://t", trap), (9, "u", "é" * 700), (10, "z", "tail\r\n\r\n")]
    rows += [(11, "http://digits", "\r\n\r\n" + LONG), (12, "http://magic", MAGIC.decode() * 300), (13, "http://nested", nested), (14, "http://open", "\r\n\r\nWARC/1.1\r\nContent-Length: 5"), (15, "http://long", "<p>line\r\n\r\n" * 20_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


def test_magic_in_payload_is_no_record():
    inner = MAGIC + b"Content-Length: 1\r\n\r\nx\r\n\r\n"
    record = MAGIC + b"WARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    data = record + record
    starts, _, nexts, cut = candidates(data)
    assert len(starts) == 4 and cut == -1
    assert starts[reachable(starts, nexts)].tolist() == [0, len(record)]
    assert starts[chain_ends(starts, nexts)].tolist()[0] == len(record)
    assert candidates(data[: len(record) + 5])[3] == -1 and candidates(data[: len(record) + 20])[3] == len(record)


def test_pointer_jumping_reaches_long_chains():
    starts = np.arange(0, 10_000, 10)
    nexts = starts + 10
    nexts[500] = -1
    assert reachable(starts, nexts).sum() == 501
    assert chain_ends(starts, nexts)[0] == 500 and chain_ends(starts, nexts)[501] == 999


@pytest.mark.parametrize("piece", [MAGIC, MAGIC + b"\r\n", b"\r\n\r\n" + MAGIC, b"\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n"])
def test_hostile_pages_are_scanned_in_linear_time(piece):
    took = []
    for n in (1 << 20, 1 << 22):
        began = time.perf_counter()
        at, _, to, _ = candidates(piece * (n // len(piece)))
        reachable(at, to)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_a_broken_chain_is_told_with_the_records_before_it(spark):
    good = MAGIC + b"WARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = spark.createDataFrame([("f", 0, bytearray(good + MAGIC + b"Content-Length: 99\r\n\r\nshort")), ("g", 0, bytearray(b"no archive")), ("h", 0, bytearray(good)), ("i", 0, None)], "file string, start long, bytes binary")
    got = {(r.file, r.offset): r for r in read_archives(rows).collect()}
    assert set(got) == {("f", 0), ("f", len(good)), ("g", 0), ("h", 0)}
    assert bytes(got["f", 0].payload) == b"hi" and "breaks" in got["f", len(good)].error and "no record" in got["g", 0].error and got["h", 0].error is None
    with pytest.raises(Exception, match="breaks here"):
        read_pages(rows.where("file = 'f'")).collect()


def test_records_of_other_writers(spark):
    def record(version, headers, block):
        return b"WARC/%s\r\n%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (version, headers, len(block), block)

    sha = hashlib.sha1(b"<p>").digest()
    data = record(b"1.0", b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>", b"software: x")
    data += record(b"1.0", b"WARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(sha), b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>")
    data += record(b"1.1", b"WARC-Type: request", b"GET /\r\n\r\n") + record(b"1.1", b"content-type: text/html\r\nWARC-Payload-Digest: sha1:" + b"0" * 40, b"other")
    files = spark.createDataFrame([("f.warc", bytearray(data)), ("empty", bytearray())], "path string, content binary")
    for size in (200, 250, 1 << 20):
        got = sorted(read_archives(archive_blocks(files, size), block_bytes=size).collect(), key=lambda r: r.offset)
        assert [r.record_type for r in got] == ["warcinfo", "response", "request", None]
        assert [bytes(r.payload) for r in got] == [b"software: x", b"<p>", b"GET /\r\n\r\n", b"other"]
        assert [r.digest_holds for r in got] == [None, True, None, False] and got[0].record_id == "urn:uuid:1" and got[1].url is None


def test_query_matches_sql(spark, sf_dir):
    path = sf_dir(pages=pages(spark))
    out = op4_boundary_chain(spark, path)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = {tuple(r) for r in out.select(cols).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as from '{path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(f"select {', '.join(cols)} from ({OP4_SQL})").fetchall())
    by = {r[0]: r for r in got}
    assert by[1][3:] == ("revisit", 2) and by[2][3:] == ("response", None) and by[3][3] == "response" and by[7][3:] == ("revisit", 8)
    assert by[5][1:3] == (0, hashlib.sha1(b"").hexdigest())


def test_blocks_of_any_size_give_the_same_records(spark):
    df = pages(spark)
    want = {(r.page_id, bytes(r.html.encode()) if r.html else b"") for r in df.collect() if r.page_id not in (1, 7)}
    for size in (400, 997, 4096):
        rows = read_archives(write_archives(df.coalesce(1), block_bytes=size), block_bytes=size).where("record_type = 'response'").collect()
        assert {(int(r.record_id[9:]), bytes(r.payload)) for r in rows} == want
        assert all(r.error is None and r.digest_holds for r in rows)


def test_edges(spark):
    df = pages(spark)
    n = df.count()
    assert read_archives(write_archives(df.limit(0))).count() == 0
    assert read_archives(write_archives(df.unionByName(df))).count() == 2 * n
    odd = df.limit(2).selectExpr("cast(null as long) page_id", "url", "html")
    assert {r.record_type for r in read_archives(write_archives(odd)).collect()} == {"response"}
    many = write_archives(df, archive_bytes=100)
    assert many.count() == n and read_archives(many).count() == n
    far = df.limit(1).selectExpr("page_id", f"repeat('u', {warc.HEADER_BYTES}) url", "html")
    assert read_archives(write_archives(far)).first().url.startswith("urn:sha1:")
