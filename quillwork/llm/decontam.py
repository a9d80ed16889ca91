"""Benchmark decontamination: SimHash of item-sized windows, a multi-index, exact verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mixed, powers, prefix_hash, row_runs, slices, span_hash, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which a window is compared. Texts whose shingles agree to 0.8 differ in about
#: 10 of 64 bits, with a deviation of 3. Of 5,551 edited benchmark items measured with a similarity from
#: 0.8 to under 1, three were not within 17 bits; of the 1,052 from 0.80 to 0.82, all were.
RADIUS = 17
#: Blocks of a fingerprint, of 16 bits each.
BLOCKS = 4
#: Benchmark items in one pass over the documents, and bytes of their texts.
BLOCK_ITEMS = 2000
BLOCK_BYTES = 32 << 20
#: Windows that are looked up at once.
AT_ONCE = 20_000


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one row, and the word at which each starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * powers("up", k + 1)[i + 1]
    at = np.flatnonzero(rows[:n] == rows[k - 1 : k - 1 + n])
    return mixed(total[at] + np.uint64(k)), at


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of every bit; row i counts the first i hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def majority(ones: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    """64-bit fingerprints: the bits set in over half the hashes."""
    return np.packbits(2 * ones > np.reshape(count, (-1, 1)), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@dataclass
class Item:
    """One benchmark item: its words, its distinct shingles and how often each occurs."""

    item_id: int
    n_words: int
    shingle: int
    hashes: np.ndarray
    counts: np.ndarray
    fingerprint: np.uint64


def make_items(ids: Sequence[int], texts: Sequence[str | None]) -> list[Item]:
    """Items that have a word; an item of fewer than five words is one shingle."""
    data, starts, ends, rows = word_spans(pa.array(["" if t is None else t for t in texts], pa.large_string()))
    words, runs = span_hash(prefix_hash(data), starts, ends), row_runs(rows, len(texts))
    out = []
    for i, item_id in enumerate(ids):
        own = words[runs[i] : runs[i + 1]]
        if len(own):
            k = min(SHINGLE, len(own))
            h, _ = shingle_hashes(own, np.zeros(len(own), np.int64), k)
            uniq, counts = np.unique(h, return_counts=True)
            out.append(Item(item_id, len(own), k, uniq, counts, majority(bit_sums(h)[-1:], len(h))[0]))
    return out


def _within(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most ``radius`` of them set."""
    values = np.arange(1 << bits, dtype=np.int64)
    return values[np.bitwise_count(values) <= radius]


class Index:
    """Items by shingle (at which windows to look) and by the blocks of their fingerprint (with which items to compare)."""

    def __init__(self, items: list[Item], radius: int = RADIUS):
        self.items, self.radius = items, radius
        self.fingerprints = np.array([x.fingerprint for x in items], np.uint64)
        self.lengths = sorted({x.shingle for x in items})
        self.sizes = sorted({x.n_words for x in items})
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in self.lengths:
            h = np.concatenate([x.hashes for x in items if x.shingle == k])
            size = np.concatenate([np.full(len(x.hashes), x.n_words) for x in items if x.shingle == k])
            uniq, inverse = np.unique(h, return_inverse=True)
            pairs = np.unique(np.stack([inverse, size]), axis=1)
            light = np.zeros(1 << 20, bool)
            light[(uniq >> np.uint64(44)).astype(np.int64)] = True
            self.postings[k] = (uniq, np.searchsorted(pairs[0], np.arange(len(uniq) + 1)), pairs[1], light)
        # Fingerprints within the radius differ by at most radius // 4 bits in one of the 4 blocks; where the
        # radius leaves a rest, one bit less will do in the blocks after the first rest + 1.
        reach, rest = divmod(radius, BLOCKS)
        number = np.searchsorted(self.sizes, [x.n_words for x in items])
        self.blocks = []
        for b in range(BLOCKS):
            flips = _within(16, reach if b <= rest else reach - 1)
            value = ((self.fingerprints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = ((number << 16)[:, None] | (value[:, None] ^ flips[None, :])).ravel()
            order = np.argsort(keys)
            self.blocks.append((keys[order].astype(np.int32), np.repeat(np.arange(len(items), dtype=np.int32), len(flips))[order]))

    def near(self, size: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size within the radius, all of them.

        Each block of a window's fingerprint is looked up among the block's values near
        an item's; only the items found so are compared in all bits.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        number = int(np.searchsorted(self.sizes, size)) << 16
        for start in range(0, len(fps), AT_ONCE):
            own, found = fps[start : start + AT_ONCE], []
            for b, (keys, items) in enumerate(self.blocks):
                key = (number | ((own >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)).astype(np.int32)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                many = high - low
                at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                found.append(np.repeat(np.arange(len(own)), many) * len(self.items) + items[at])
            pair = np.unique(np.concatenate(found))
            window, item = pair // len(self.items), pair % len(self.items)
            close = np.bitwise_count(own[window] ^ self.fingerprints[item]) <= self.radius
            out.append((start + window[close], item[close]))
        return np.concatenate([w for w, _ in out]), np.concatenate([i for _, i in out])


def weighted_similarity(hashes: np.ndarray, item: Item) -> float:
    """Sum of the smaller over the sum of the larger shingle counts of a window and an item."""
    at = np.minimum(np.searchsorted(item.hashes, hashes), len(item.hashes) - 1)
    mine = np.bincount(at[item.hashes[at] == hashes], minlength=len(item.hashes))
    both = int(np.minimum(mine, item.counts).sum())
    return both / (len(hashes) + int(item.counts.sum()) - both)


def leaks_in(column: pa.Array, index: Index, similarity: float = SIMILARITY, gate: bool = True) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, differing bits, similarity) of each row's best window for each item.

    With ``gate`` only windows that hold a shingle of some item of their size get a
    fingerprint; the others have similarity 0 with every item, so nothing changes.
    """
    data, starts, ends, rows = word_spans(column)
    words = span_hash(prefix_hash(data), starts, ends)
    runs = row_runs(rows, len(column))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k in index.lengths:
        uniq, offsets, sizes, light = index.postings[k]
        h, at = shingle_hashes(words, rows, k)
        first_shingle = np.searchsorted(at, runs)  # of each row, in h
        if gate:
            on = np.flatnonzero(light[(h >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(uniq, h[on]), len(uniq) - 1)
            hit = uniq[slot] == h[on]
            on, slot = on[hit], slot[hit]
            count = offsets[slot + 1] - offsets[slot]
            where = np.repeat(at[on], count)
            size = sizes[np.repeat(offsets[slot], count) + np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)]
        for n in np.unique(sizes):
            if gate:
                mine = where[size == n]  # ordered, as ``at`` is
                held = np.unique(rows[mine])
            else:
                held = np.flatnonzero(np.diff(runs) >= k)
            for r in held.tolist():
                lo, hi = int(runs[r]), int(runs[r + 1])
                span = min(int(n), hi - lo)  # a shorter text is one window
                s = np.arange(lo, hi - span + 1)
                if gate:
                    p = mine[np.searchsorted(mine, lo) : np.searchsorted(mine, hi)]
                    after = np.searchsorted(p, s)  # the first shared shingle at or after each start
                    s = s[(after < len(p)) & (p[np.minimum(after, len(p) - 1)] <= s + span - k)]
                own = h[first_shingle[r] : first_shingle[r + 1]]
                m = span - k + 1
                breaks = np.flatnonzero(np.append(True, np.diff(s) > m))  # windows far apart share no sums
                for c in range(len(breaks)):
                    part = s[breaks[c] : breaks[c + 1] if c + 1 < len(breaks) else len(s)] - lo
                    for f in range(0, len(part), AT_ONCE):
                        these = part[f : f + AT_ONCE]
                        sums = bit_sums(own[these[0] : these[-1] + m])
                        fps = majority(sums[these - these[0] + m] - sums[these - these[0]], m)
                        for w, i in zip(*index.near(int(n), fps)):
                            item = index.items[i]
                            first = int(these[w])
                            value = weighted_similarity(own[first : first + m], item)
                            key = (r, int(i))
                            if value >= similarity and value > best.get(key, (0.0,))[0]:
                                best[key] = (value, first, int(np.bitwise_count(fps[w] ^ item.fingerprint)))
    return [(r, index.items[i].item_id, first, bits, value) for (r, i), (value, first, bits) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block: int = BLOCK_ITEMS, most: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The benchmark in blocks of a bounded number of items and bytes; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
        if len(ids) == block or size >= most:
            yield make_items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield make_items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Passages of ``benchmark`` (item_id, text) in ``docs``: a row for each text and item.

    Windows of as many words as an item has get a SimHash; the multi-index finds all
    items within the radius, and the exact weighted similarity of five-word shingles
    decides. Windows that share no shingle with an item of their size cannot be similar
    and get none. Every block of items is one pass over the texts, without a shuffle.
    Returns id, item_id, first_word, bits, similarity.

    Defined cases: null and wordless texts and items match nothing; a text shorter than
    an item is one window; an item of fewer than five words is one shingle; repeated
    rows each give their rows; of equally similar windows the first is told; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, item_id long, first_word long, bits int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        if not items:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, radius)
            for batch in batches:
                for part in slices(batch, "text"):
                    found = leaks_in(part.column("text"), index, similarity)
                    if found:
                        row, item, first, bits, value = zip(*found)
                        yield pa.record_batch([part.column("id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(bits, pa.int32()), pa.array(value, pa.float64())], ["id", "item_id", "first_word", "bits", "similarity"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` that hold an item of ``benchmark``, with the item and the place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, with their columns.

    Null, empty and wordless texts hold none and stay; very long texts are searched
    whole; of rows with one id, and of rows without an id, each is judged by its own
    text; repeated rows stay or go together; an empty table gives none; other columns
    are passed on.
    """
    body = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    named = docs.select(F.struct(docs["doc_id"].alias("id"), body.alias("h")).alias("name"), docs["text"])
    found = leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "name").select("id.id", "id.h").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["id"]) & (body == found["h"]), "left_anti")
