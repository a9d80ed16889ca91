"""Removal of repeated 100-byte strings by suffix arrays over shards of candidate strings.

1. Every text's 100-byte strings are grouped by their anchor, a run of bytes that the
   string alone decides; equal strings have equal anchors at equal places.
2. Anchors are counted by hash. Texts are read again for the repeated ones, and each
   such anchor sends its bytes (the union of its strings) to the shard of its hash.
3. Each shard sorts the suffixes of what it was sent by induction, computes the
   permuted common prefixes, and finds the strings of at least 100 bytes in common;
   all but the earliest of each are told as intervals.
4. Each text is cut at its intervals.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import SPAN, anchors
from ._store import free_names, stored
from ._suffix import permuted_prefixes, suffix_array
from ._text import column_bytes, give_back, mixed, prefix_hash, slices, span_hash

#: An anchor with more than a HOT_SHARE-th of all anchors, or with more than HOT_MOST, is split into its
#: single strings. By counting there are at most HOT_SHARE such anchors, or one in HOT_MOST of all (8 bytes
#: for every 17 MB of text), so the list can be sent to every task.
HOT_SHARE = 50_000
HOT_LEAST = 1_000
HOT_MOST = 1_000_000
#: Anchors or contexts that a task gathers before it folds equal ones together.
GATHER = 1 << 19
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 20


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more.

    The first collection frees the frames, the second what their plans held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _columns(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [table.column(n).to_numpy() for n in names]


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(key, h, id, th, at, n): one row for each anchor, and one for each hash that repeats in a task.

    A hash that repeats in a task is known to repeat, so its anchors need not meet:
    they go to keys of their own texts, and one row (n > 1) tells their number. A hash
    in a third of all texts thus sends one row a task to its shard.
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, id_, th, at = (np.concatenate(x) for x in zip(*held))
        uniq, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        known = count[inverse] > 1
        key = np.where(known, mixed(id_.view(np.uint64) ^ th.view(np.uint64)), h)
        many = count > 1
        none = np.full(int(many.sum()), -1)
        key, h = np.concatenate([key, uniq[many]]), np.concatenate([h, uniq[many]])
        n = np.concatenate([np.where(known, 0, 1), count[many]])
        cols = [key.view(np.int64), h.view(np.int64), *(np.concatenate([x, none]) for x in (id_, th, at)), n]
        for s in range(0, len(h), 200_000):
            yield pa.record_batch([pa.array(c[s : s + 200_000]) for c in cols], ["key", "h", "id", "th", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                row, _, _, at, h = anchors(data, offsets)
                held.append((h, part.column("id").to_numpy()[row], part.column("th").to_numpy()[row], at - offsets[row]))
                size += len(h)
                if size >= GATHER:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return rows.mapInArrow(run, "key long, h long, id long, th long, at long, n long")


def _repeated(found: DataFrame) -> DataFrame:
    """(id, th, at) of the anchors whose hash repeats; rows without id tell (h, n), and once a task all (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, id_, th, at, n = _columns(got, "h", "id", "th", "at", "n")
        known = n == 0
        met = ~known
        uniq, inverse = np.unique(h[met], return_inverse=True)
        total = np.bincount(inverse, n[met], minlength=len(uniq)).astype(np.int64)
        keep = np.zeros(len(h), bool)
        keep[met] = (n[met] == 1) & (total[inverse] > 1)
        keep |= known
        hot = np.flatnonzero(total > HOT_LEAST)
        told = [id_[keep], th[keep], at[keep], np.zeros(int(keep.sum()), np.int64), np.full(int(keep.sum()), 0)]
        more = [np.full(len(hot) + 1, -1), np.full(len(hot) + 1, -1), np.full(len(hot) + 1, -1), np.append(uniq[hot], 0), np.append(total[hot], total.sum())]
        kind = np.concatenate([np.zeros(len(told[0]), np.int8), np.ones(len(hot), np.int8), [2]]).astype(np.int8)
        cols = [np.concatenate(x) for x in zip(told, more)]
        for s in range(0, len(kind), 200_000):
            yield pa.record_batch([pa.array(c[s : s + 200_000]) for c in (kind, *cols)], ["kind", "id", "th", "at", "h", "n"])
        del got, told, more, cols, kind, uniq, inverse, total, keep, h, id_, th, at, n, known, met
        give_back()

    return found.repartition("key").mapInArrow(run, "kind byte, id long, th long, at long, h long, n long")


def _contexts(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, id, th, first, last, bytes): what each repeated anchor sends to its shard.

    ``bytes`` holds all strings that start from ``first`` to ``last``. Equal bytes in a
    task are sent once, for the earliest (hashes bring them together, the bytes decide); the later ones are repeats for certain and
    are told with null bytes, those that touch as one, under a key of their own text. Strings of a hot anchor
    are sent one by one, by their own hash.
    """
    sent = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, code, id_, th, first, last = (np.concatenate([x[i] for x in held]) for i in range(6))
        bodies = [b for x in held for b in x[6]]
        order = np.lexsort((first, th, id_, code, key))
        again = np.zeros(len(order), bool)
        same = np.flatnonzero((key[order][1:] == key[order][:-1]) & (code[order][1:] == code[order][:-1]))
        again[1 + same] = [bodies[a] == bodies[b] for a, b in zip(order[same].tolist(), order[same + 1].tolist())]
        later = np.zeros(len(order), bool)
        later[order] = again
        names = ["key", "id", "th", "first", "last", "bytes"]
        sure = np.flatnonzero(later)
        sure = sure[np.lexsort((first[sure], th[sure], id_[sure]))]
        i, t, a, z = id_[sure], th[sure], first[sure], last[sure]
        runs = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (a[1:] > z[:-1] + SPAN))) if len(sure) else sure
        ends = np.append(runs[1:], len(sure))[: len(runs)] - 1
        told = mixed(i[runs].view(np.uint64) ^ t[runs].view(np.uint64))
        cols = [pa.array(c) for c in (told.view(np.int64), i[runs], t[runs], a[runs], z[ends])]
        yield pa.record_batch([*cols, pa.nulls(len(runs), pa.binary())], names)
        sent = np.flatnonzero(~later)
        for s in range(0, len(sent), 50_000):
            on = sent[s : s + 50_000]
            cols = [pa.array(c[on]) for c in (key.view(np.int64), id_, th, first, last)]
            yield pa.record_batch([*cols, pa.array([bodies[k] for k in on.tolist()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, size = sent.value, [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = column_bytes(part.column("text"))
                row, first, last, at, h = anchors(data, offsets)
                lists = part.column("ats")
                wanted = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
                on = np.isin(at, wanted)
                row, first, last, h = row[on], first[on], last[on], h[on]
                if len(hot) and len(h):
                    slot = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    split = hot[slot] == h
                    count = np.where(split, last - first + 1, 1)
                    shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    split = np.repeat(split, count)
                    row, h, first, last = (np.repeat(x, count) for x in (row, h, first, last))
                    first = first + shift
                    last = np.where(split, first, last)
                else:
                    split = np.zeros(len(h), bool)
                if not len(h):
                    continue
                code = span_hash(prefix_hash(data), first, last + SPAN)
                key = np.where(split, code, h)
                raw, base = data.tobytes(), offsets[row]
                bodies = [raw[a:b] for a, b in zip(first.tolist(), (last + SPAN).tolist())]
                held.append((key, code, part.column("id").to_numpy()[row], part.column("th").to_numpy()[row], first - base, last - base, bodies))
                size += len(key)
                if size >= GATHER // 2:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return texts.mapInArrow(run, "key long, id long, th long, first long, last long, bytes binary")


def shard_repeats(bodies: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, stop): the spans of each body made of strings that stand earlier in the list.

    Bodies are given in the order of their places; ``first`` is where each starts in
    its text. One suffix array over all of them finds the strings in common.
    """
    size = np.array([len(b) for b in bodies])
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # 255 is in no text
    text = np.append(data.astype(np.int64) + 1, 0)
    sa = suffix_array(text)
    data = np.append(data, np.uint8(0))
    common = permuted_prefixes(data, sa)[sa]
    body = np.repeat(np.arange(len(bodies)), size + 1)
    owned = np.append(np.arange(len(data) - 1) - begin[body] + SPAN <= size[body], False)
    runs = np.flatnonzero(common < SPAN)
    earliest = np.minimum.reduceat(np.where(owned[sa], sa, len(sa)), runs)
    group = np.cumsum(common < SPAN) - 1
    repeat = np.sort(sa[owned[sa] & (sa > earliest[group])])
    if not len(repeat):
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.flatnonzero(np.append(True, (np.diff(repeat) > 1) | (body[repeat[1:]] != body[repeat[:-1]])))
    low, high = repeat[cut], repeat[np.append(cut[1:], len(repeat)) - 1]
    which = body[low]
    return which, first[which] + low - begin[which], first[which] + high - begin[which] + SPAN


def _intervals(sent: DataFrame) -> DataFrame:
    """(id, th, start, stop): the bytes to remove, from the contexts of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "start", "stop"]
        held = []
        for batch in batches:
            told = batch.filter(pc.is_null(batch.column("bytes")))
            if told.num_rows:
                yield pa.record_batch([told.column("id"), told.column("th"), told.column("first"), pc.add(told.column("last"), SPAN)], names)
            held.append(batch.filter(pc.is_valid(batch.column("bytes"))))
        held = [b for b in held if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, id_, th, first, last = (table.column(c).to_numpy() for c in ("key", "id", "th", "first", "last"))
        body = table.column("bytes").to_pylist()
        del held, table
        order = np.lexsort((first, th, id_, key))
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        ends = np.append(starts[1:], len(order))
        out: list[tuple] = []
        again: list[int] = []
        chosen: list[int] = []
        size = 0

        def sort_shard() -> None:
            nonlocal size
            at = np.array(chosen)
            at = at[np.lexsort((first[at], th[at], id_[at]))]
            which, start, stop = shard_repeats([body[i] for i in at], first[at])
            out.append((id_[at[which]], th[at[which]], start, stop))
            chosen.clear()
            size = 0

        for s, e in zip(starts.tolist(), ends.tolist()):
            seen: set[bytes] = set()
            for i in order[s:e].tolist():
                if body[i] in seen:  # the same strings from another task, at a later place
                    again.append(i)
                else:
                    seen.add(body[i])
                    chosen.append(i)
                    size += len(body[i]) + 1
            if size >= SHARD_BYTES:
                sort_shard()
        if chosen:
            sort_shard()
        at = np.array(again, np.int64)
        out.append((id_[at], th[at], first[at], last[at] + SPAN))
        cols = [np.concatenate(x) for x in zip(*out)]
        for s in range(0, len(cols[0]), 200_000):
            yield pa.record_batch([pa.array(c[s : s + 200_000].astype(np.int64)) for c in cols], names)
        del body, out, again, cols, order, key, id_, th, first, last
        give_back()

    return sent.repartition("key").mapInArrow(run, "id long, th long, start long, stop long")


def _body(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column, Column]:
    """Spans (id, th, spans) of the texts that repeat something; id and th as columns of ``docs``.

    ``th`` tells texts under one id apart; it is 0 where ids are unique.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    twice = not docs.select(id_.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    th = F.xxhash64(_body(docs, text_col)) if twice else F.lit(0).cast("long")
    unique = docs.select(id_.alias("id"), th.alias("th"), _body(docs, text_col).alias("text"))
    if twice:
        unique = unique.dropDuplicates(["id", "th"])
    told = stored(_repeated(_anchor_rows(unique)))
    _release(spark)
    total = told.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    hot = told.where((F.col("kind") == 1) & (F.col("n") > max(HOT_LEAST, min(total // HOT_SHARE, HOT_MOST)))).select("h").toArrow()
    ats = told.where("kind = 0").groupBy("id", "th").agg(F.collect_list("at").alias("ats"))
    sent = _contexts(unique.join(ats, ["id", "th"]), hot.column("h").to_numpy().view(np.uint64))
    found = stored(_intervals(sent))
    del sent, ats
    _release(spark)
    spans = found.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return spans, id_, th


def _merged(spans: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Maximal runs of each row's spans; spans that touch are one run."""
    out = []
    for row in spans.to_pylist():
        runs: list[tuple[int, int]] = []
        for a, b in sorted((x["start"], x["stop"]) for x in row or ()):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        out.append(runs)
    return out


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return raw
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every text without its repeated strings.

    A byte goes if a 100-byte string over it also starts earlier: in a text of smaller
    id, or earlier in the same text. Strings are judged on the input.

    Defined cases: a null text is empty; a null id is smaller than any other; rows
    that repeat a whole (id, text) are one text and are cut alike, and of different
    texts under one id that with the smaller hash is earlier; an empty table gives
    no rows; other columns are not looked at.
    """
    spans, id_, th = removed_spans(docs, id_col, text_col)
    texts = docs.select(id_.alias("id"), th.alias("th"), _body(docs, text_col).alias("text"))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                raw, runs = data.tobytes(), _merged(part.column("spans"))
                kept = [_cut(raw[offsets[i] : offsets[i + 1]], r) for i, r in enumerate(runs)]
                cols = [pa.array(np.diff(offsets)), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(kept, pa.binary())]
                yield pa.record_batch([part.column("id"), *cols], names)

    return texts.join(spans, ["id", "th"], "left").select("id", "text", "spans").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without their repeated 100-byte strings."""
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated strings, ``n_chars`` counted anew.

    Characters that were cut in part go too. A document of which nothing is left goes;
    null and empty texts have nothing to cut and stay; very long texts are cut whole; a
    null id is smaller than any other; of different texts under one id that with the
    smaller hash is earlier, and repeated rows are one text, cut alike; an empty table
    gives none; other columns are passed on.
    """
    spans, id_, th = removed_spans(docs)
    kinds, (own_id, own_th, own_spans) = docs.schema, free_names(docs, "id", "th", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, runs = part.column("text"), _merged(part.column(own_spans))
                cut = [t if not r else _cut(t.encode(), r).decode(errors="ignore") for t, r in zip(text.to_pylist(), runs)]
                cols = [pa.array(cut, pa.string()) if n == "text" else part.column(n) for n in kinds.names]
                out = pa.record_batch(cols, kinds.names)
                yield out.filter(pa.array([not r or t != "" for t, r in zip(cut, runs)], pa.bool_()))

    joined = docs.withColumns({own_id: id_, own_th: th}).join(spans.toDF(own_id, own_th, own_spans), [own_id, own_th], "left")
    cut = joined.select(*kinds.names, own_spans).mapInArrow(run, kinds)
    return cut.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType)) if "n_chars" in kinds.names else cut
