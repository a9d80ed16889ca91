"""WARC archives in blocks: written with revisit records, read back by boundary-chain verification.

An archive is a table of blocks (file, start, bytes) of one size, so that a file is
scanned by as many tasks as it has blocks and is never held whole.

1. Each block tells where a record might start and which place must follow it. Its own
   chains are jumped through there and then: a candidate tells the last record of its
   chain in the block and the place after that.
2. A header cut by the end of a block is read from the block's last bytes and the next
   block's first ones.
3. Pointer jumping over these links, as a table, keeps what the chain from each file's
   start reaches. Magic in a payload is on no such chain.
4. Blocks give their reached records; a record over several blocks is put together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import stored

MAGIC = b"WARC/1.1\r\n"
#: A record with fewer payload bytes is never a revisit.
REVISIT_BYTES = 1000
#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes of a block of an archive; all blocks of a file but the last have as many.
BLOCK_BYTES = 4 << 20
#: A longer header is no header. It must fit into a block.
HEADER_BYTES = 1 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)
#: Bytes at the end of a block in which a version line may be cut, and the blank line before it.
_CUT = 13


def _record(page: str, url: str, digest: str, payload: bytes, refers: str | None) -> bytes:
    """One WARC record. A revisit has no block; its headers name the record it repeats."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if len(clean.encode()) > HEADER_BYTES // 2:
        clean = f"urn:sha1:{hashlib.sha1(url.encode()).hexdigest()}"
    head = [
        MAGIC.decode() + ("WARC-Type: revisit" if refers is not None else "WARC-Type: response"),
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + _BLANK + payload + _BLANK


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as blocks of archives (file, start, bytes).

    Of the pages whose payloads are equal and at least 1000 bytes long, the one with
    the largest page_id is a response and the others revisit it. Digests are grouped
    on narrow rows with partial aggregation; html is shuffled once, by page. A task
    holds one block and one page.

    Defined cases: a null html is an empty payload, a null url an empty one, a url too
    long for a header is named by its digest; pages with a null page_id are written
    under an empty name and never are responses that others refer to unless none of
    the group has an id; repeated rows of the largest page_id all are responses; an
    empty table gives no archive; other columns are not looked at.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    shared = narrow.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    revisits = narrow.join(shared, "digest").where("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = rows.withColumn("digest", F.sha1("payload")).join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, start, held = 0, 0, bytearray()

        def block(n: int) -> pa.RecordBatch:
            nonlocal start
            out = pa.record_batch([pa.array([f"{part:06d}-{file:06d}"]), pa.array([start]), pa.array([bytes(held[:n])], pa.binary())], ["file", "start", "bytes"])
            del held[:n]
            start += n
            return out

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held += _record("" if page is None else str(page), url, digest, payload, None if refers is None else str(refers))
                while len(held) > block_bytes:
                    yield block(block_bytes)
                if start + len(held) >= archive_bytes:
                    yield block(len(held))
                    file, start = file + 1, 0
        if held:
            yield block(len(held))

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, start long, bytes binary")


def archive_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of uncompressed archive files as Spark's ``binaryFile`` source reads them (path, content)."""
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("content") / F.lit(block_bytes)) - 1, F.lit(0)).cast("int")))
    rows = files.where(F.octet_length("content") > 0).select(F.col("path").alias("file"), "content", cut.alias("i"))
    return rows.select("file", (F.col("i").cast("long") * block_bytes).alias("start"), F.substring("content", F.col("i") * block_bytes + 1, F.lit(block_bytes)).alias("bytes"))


def candidates(data: bytes, opens: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where a record might start, where its block starts, and its successor; and where a header is cut by the end.

    ``opens``: the data starts a file. A record follows a blank line or starts the
    data, so headers of two candidates never overlap and the scan is linear. Magic
    inside a payload gives a candidate too; one without a length gives none.
    """
    starts, bodies, nexts, cut = [], [], [], -1
    for m in _VERSION.finditer(data):
        at = m.start()
        if (at >= 4 and data[at - 4 : at] != _BLANK) or (opens and 0 < at < 4):
            continue
        end = data.find(_BLANK, m.end() - 2)
        if end < 0:
            cut = at if len(data) - at <= HEADER_BYTES else -1
            break
        found = _LENGTH.search(data, at, end + 2) if end - at <= HEADER_BYTES else None
        if found:
            starts.append(at)
            bodies.append(end + 4)
            nexts.append(end + 4 + int(found[1]) + 4)
    return np.array(starts, np.int64), np.array(bodies, np.int64), np.array(nexts, np.int64), cut


def _successors(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """The candidate that follows each one, or the number of candidates where none stands at its end."""
    n = len(starts)
    place = np.searchsorted(starts, nexts)
    good = place < n
    good[good] = starts[place[good]] == nexts[good]
    return np.where(good, place, n)


def chain_ends(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """The last candidate of the chain from each one, by pointer jumping: log2(n) rounds."""
    n = len(starts)
    jump = np.minimum(_successors(starts, nexts), n)
    jump = np.where(jump == n, np.arange(n), jump)
    while True:
        far = jump[jump]
        if np.array_equal(far, jump):
            return jump
        jump = far


def reachable(starts: np.ndarray, nexts: np.ndarray, first: int = 0) -> np.ndarray:
    """Which candidates the chain from the place ``first`` reaches, by pointer jumping.

    Round k adds what is 2**k successors after a reached record, so a chain of n
    records takes log2(n) rounds.
    """
    n = len(starts)
    jump = np.append(_successors(starts, nexts), n)
    reached = np.append(starts == first, False)
    while (jump != n).any():
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def _links(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, at, last, to) of all candidates: the last record of the chain from ``at`` in its block, and what follows; and (file, size)."""
    schema = "kind byte, file string, at long, last long, to long, tail binary, head binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, data in zip(*(batch.column(c) for c in ("file", "start", "bytes"))):
                file, start, data = file.as_py(), start.as_py(), data.as_py()
                at, _, to, cut = candidates(data, start == 0)
                end = chain_ends(at, to)
                n = len(at)
                tail = data[max(0, (cut if cut >= 0 else len(data) - _CUT + 4) - 4) :]
                blank = data.find(_BLANK)
                head = data[: min(blank + 4 if blank >= 0 else len(data), HEADER_BYTES)] if start else b""
                yield pa.record_batch(
                    [
                        pa.array([0] * n + [1], pa.int8()),
                        pa.array([file] * (n + 1)),
                        pa.array(np.append(at + start, start)),
                        pa.array(np.append(at[end] + start, 0)),
                        pa.array(np.append(to[end] + start, start + len(data))),
                        pa.array([None] * n + [tail], pa.binary()),
                        pa.array([None] * n + [head], pa.binary()),
                    ],
                    names,
                )

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, edge, tail, head in zip(*(batch.column(c).to_pylist() for c in ("file", "edge", "tail", "head"))):
                data, base = tail + head, edge - len(tail)
                for m in _VERSION.finditer(data):
                    at = m.start()
                    end = data.find(_BLANK, m.end() - 2)
                    if at >= len(tail) or end < 0:
                        break
                    if end + 4 <= len(tail) or (at >= 4 and data[at - 4 : at] != _BLANK):
                        continue
                    found = _LENGTH.search(data, at, end + 2) if end - at <= HEADER_BYTES else None
                    if found:
                        rows.append((file, base + at, base + at, base + end + 4 + int(found[1]) + 4))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "at", "last", "to"])

    told = stored(blocks.select("file", "start", "bytes").where("octet_length(bytes) > 0").mapInArrow(scan, schema))
    ends = told.where("kind = 1")
    seams = ends.select("file", F.col("to").alias("edge"), "tail").join(ends.where("at > 0").select("file", F.col("at").alias("edge"), "head"), ["file", "edge"])
    links = told.where("kind = 0").select("file", "at", "last", "to").unionByName(seams.mapInArrow(seam, "file string, at long, last long, to long"))
    return links, ends.groupBy("file").agg(F.max("to").alias("size"))


def _chain(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """The links that the chain from each file's start reaches, and ``whole``: whether what follows is a record or the end.

    Only links that another one leads to can be reached: one or two a block. Round k
    of the pointer jumping adds what is 2**k links further.
    """
    wanted = links.select("file", F.col("to").alias("at")).distinct().unionByName(sizes.select("file", F.lit(0).cast("long").alias("at")))
    entries = stored(links.join(wanted, ["file", "at"], "left_semi"))
    reached = entries.where("at = 0").select("file", "at")
    jump = entries.select("file", "at", "to")
    while True:
        far = stored(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("__far")), ["file", "to"]).select("file", "at", F.col("__far").alias("to")))
        reached = stored(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))))
        if far.isEmpty():
            break
        jump = far
    follows = reached.select("file", F.col("at").alias("to")).join(entries.select("file", F.col("at").alias("to")), ["file", "to"], "left_semi").withColumn("follows", F.lit(True))
    on = entries.join(reached, ["file", "at"], "left_semi").join(sizes, "file").join(follows, ["file", "to"], "left")
    return on.select("file", "at", "last", "to", "size", (F.coalesce("follows", F.lit(False)) | (F.col("to") == F.col("size"))).alias("whole"))


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _digest_holds(told: str | None, sha1: bytes) -> bool | None:
    """Whether a digest header names this SHA-1, in hex or base 32; None where it names none."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() == sha1.hex() or value.upper() == base64.b32encode(sha1).decode()


_FIELDS = "file string, offset long, record_type string, record_id string, url string, digest string, refers_to_id string, n_bytes long, payload_sha1 string, digest_holds boolean, payload binary, error string"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in _FIELDS.split(", ")]


def _told(file: str, offset: int, record: bytes, body: int, payload: bool) -> tuple:
    """One row of ``_FIELDS`` from the bytes of a record, whose block starts at ``body``."""
    h = _headers(record[: body - 4])
    block = record[body:-4]
    if h.get("content-type", "").lower().startswith("application/http") and _BLANK in block:
        block = block[block.index(_BLANK) + 4 :]
    sha1 = hashlib.sha1(block).digest()
    named = h.get("warc-payload-digest") or h.get("warc-block-digest")
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    holds = None if h.get("warc-type") == "revisit" else _digest_holds(named, sha1)
    error = None if record[-4:] == _BLANK else "no blank line after the record"
    return (file, offset, h.get("warc-type"), bare(h.get("warc-record-id")), bare(h.get("warc-target-uri")), named, bare(h.get("warc-refers-to")), len(block), sha1.hex(), holds, block if payload else None, error)


def read_archives(blocks: DataFrame, payload: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of archives (file, start, bytes): one row of ``_FIELDS`` each.

    ``digest_holds`` tells whether the payload has the SHA-1 that its header names
    (null: it names none, or the record is a revisit). Without ``payload`` only its
    size and digest are told. Where a file's chain breaks, its records up to there are
    told, and one row with ``error`` tells the file and the place: nothing is lost in
    silence. Records of any type are read, with null for headers they lack.

    Defined cases: null and empty blocks hold nothing; a record over several blocks is
    put together and must fit into a cell (2 GB); an empty table gives no rows; other
    columns are not looked at. Blocks are ``block_bytes`` long but for a file's last.
    """
    links, sizes = _links(blocks)
    chain = stored(_chain(links, sizes))
    place = lambda c: F.floor(F.col(c) / F.lit(block_bytes)).cast("long")
    stop = F.min(F.when(~F.col("whole"), F.col("last")))
    first = chain.groupBy("file", place("at").alias("i")).agg(F.min("at").alias("entry"), stop.alias("stop"))
    over = chain.where("whole").select("file", "last", "to").where(place("last") < F.floor((F.col("to") - 1) / block_bytes))
    over = over.distinct().withColumn("i", F.explode(F.sequence(place("last"), F.floor((F.col("to") - 1) / block_bytes).cast("long"))))
    spans = over.groupBy("file", "i").agg(F.collect_list(F.struct("last", "to")).alias("spans"))  # two a block at most
    work = first.join(spans, ["file", "i"], "full")
    schema = _FIELDS + ", part long, fragment binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, data, entry, stop, spans in zip(*(batch.column(c) for c in ("file", "start", "bytes", "entry", "stop", "spans"))):
                file, start, data, entry, stop = (x.as_py() for x in (file, start, data, entry, stop))
                rows = []
                if entry is not None:
                    at, body, to, _ = candidates(data, start == 0)
                    for a, b, c in zip(*(x[reachable(at, to, entry - start)].tolist() for x in (at, body, to))):
                        if c <= len(data) and start + a != stop:
                            rows.append((*_told(file, start + a, data[a:c], b - a, payload), None, None))
                for s in spans.as_py() or ():
                    piece = data[max(s["last"] - start, 0) : min(s["to"] - start, len(data))]
                    rows.append((file, s["last"], *[None] * (len(_NAMES) - 2), start, piece))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*_TYPES, pa.int64(), pa.binary()])], [*_NAMES, "part", "fragment"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, parts in zip(*(batch.column(c) for c in ("file", "offset", "parts"))):
                record = b"".join(x["fragment"] for x in parts.as_py())
                row = _told(file.as_py(), offset.as_py(), record, record.index(_BLANK) + 4, payload)
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, _TYPES)], _NAMES)

    rows = blocks.select("file", "start", "bytes", place("start").alias("i")).join(work, ["file", "i"]).drop("i")
    read = stored(rows.mapInArrow(run, schema))
    parts = read.where("part is not null").groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("part", "fragment"))).alias("parts"))
    broken = chain.where("not whole").select("file", F.col("last").alias("offset"), F.lit("the chain of records breaks here").alias("error"))
    started = chain.where("at = 0").select("file")
    broken = broken.unionByName(sizes.join(started, "file", "left_anti").select("file", F.lit(0).cast("long").alias("offset"), F.lit("no record starts the file").alias("error")))
    lost = broken.select(*[F.col(n) if n in ("file", "offset", "error") else F.lit(None).cast(x.split()[1]).alias(n) for n, x in zip(_NAMES, _FIELDS.split(", "))])
    return read.where("part is null").select(_NAMES).unionByName(parts.mapInArrow(join, _FIELDS)).unionByName(lost)


def read_pages(blocks: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pages as the archives tell them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests are computed from the payloads read; a revisit takes those of
    the response it names. A broken archive, or a payload that is not the one its
    header names, raises an error.
    """
    page = lambda c: F.expr(f"try_cast(substring({c}, length('urn:page:') + 1) AS bigint)")
    read = read_archives(blocks, False, block_bytes)
    wrong = F.coalesce("error", F.when(F.col("digest_holds") == F.lit(False), F.lit("a payload differs from its digest")))
    sound = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(" ", "file", F.col("offset").cast("string"), wrong)).cast("string")).otherwise(F.col("record_type"))
    read = stored(read.select(page("record_id").alias("page_id"), sound.alias("record_type"), page("refers_to_id").alias("refers_to"), F.col("n_bytes").alias("n"), F.col("payload_sha1").alias("digest")))
    named = read.where("record_type = 'response' and n >= %d" % REVISIT_BYTES).select(F.col("page_id").alias("refers_to"), F.col("n").alias("full_n"), F.col("digest").alias("full_digest")).distinct()
    first = read.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    again = read.where("record_type = 'revisit'").join(named, "refers_to", "left")
    return first.unionByName(again.select("page_id", F.col("full_n").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to"))


def op4_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back."""
    return read_pages(stored(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


OP4_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN p.page_id < g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= {REVISIT_BYTES}
"""
