"""SimHash near-duplicates: tiled exact comparison of fingerprints, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components, local_forest
from ._store import free_names, stored
from ._text import column_bytes, slices
from ._xxh64 import xxh64_spans

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a tile; a block value with more is compared tile by tile in as many tasks as pairs of tiles.
TILE = 4096

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def simhash_texts(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of every text; ``data`` is their UTF-8 and ``offsets`` their places.

    Words are joined by one space in a second buffer, so that a shingle is one span
    of it. Bits are counted in byte lanes of 64-bit sums over at most 255 shingles.
    """
    n = len(offsets) - 1
    data = _FOLD[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    ends = np.flatnonzero(~space & (np.append(space[1:], True) | edge[1:]))
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(rows, minlength=n)
    # the second buffer: each word and one space
    length = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(int(place[-1]), 32, np.uint8)
    kept = np.flatnonzero(~space)
    joined[np.arange(len(kept)) + np.repeat(np.arange(len(length)), length)] = data[kept]
    first = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words >= shingle, words - shingle + 1, (words > 0).astype(np.int64))
    span = np.minimum(words, shingle)
    row = np.repeat(np.arange(n), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    word = first[:-1][row] + np.arange(len(row)) - begin[row]
    last = word + span[row] - 1
    h = xxh64_spans(joined, place[word], place[last] + length[last] - place[word], seed)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    # blocks of at most 255 shingles of one text
    blocks = -(-count[some] // 255)
    block_row = np.repeat(np.arange(len(some)), blocks)
    block_no = np.arange(len(block_row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_at = begin[some][block_row] + 255 * block_no
    row_at = np.cumsum(blocks) - blocks
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & lanes, block_at)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), row_at, axis=0)
        set_ = 2 * ones > count[some][:, None]
        for byte in range(8):
            out[some] |= set_[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = simhash_texts(*column_bytes(part.column("text")))
                yield pa.record_batch([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _tile_links(fps: np.ndarray, cut: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group of fingerprints sorted by population count, tile by tile.

    A pair of tiles is skipped where their population counts differ by more than
    the radius. ``cut`` over 0: only links from the first ``cut`` to the others.
    """
    size = 1024
    bits = np.bitwise_count(fps).astype(np.int64)
    left, right = (np.arange(len(fps)),) * 2 if not cut else (np.argsort(bits[:cut], kind="stable"), cut + np.argsort(bits[cut:], kind="stable"))
    found_a, found_b = [], []
    for i in range(0, len(left), size):
        a = left[i : i + size]
        for j in range(0 if cut else i, len(right), size):
            b = right[j : j + size]
            if bits[b[0]] - bits[a[-1]] > radius or bits[a[0]] - bits[b[-1]] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= radius)
            found_a.append(a[x])
            found_b.append(b[y])
            if sum(map(len, found_a)) > 1 << 20:  # keep a forest of what was found, not all links
                la, lb = np.concatenate(found_a), np.concatenate(found_b)
                label = local_forest(la, lb, len(fps))
                found_a, found_b = [np.arange(len(fps))], [label]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def tile_forest(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between fingerprints with equal keys.

    ``side`` is 0 for a whole group, else 1 and 2 for the two tiles of a pair.
    """
    order = np.lexsort((np.bitwise_count(fp), side, key))
    key, side, fp = key[order], side[order], fp[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    small = np.repeat((sizes <= 64) & (side[starts] == 0), sizes)
    points = np.flatnonzero(small)
    bits = np.bitwise_count(fp).astype(np.int64)
    step = 1
    while len(points):
        points = points[points + step < len(key)]
        points = points[key[points] == key[points + step]]
        points = points[bits[points + step] - bits[points] <= radius]
        hit = points[np.bitwise_count(fp[points] ^ fp[points + step]) <= radius]
        a.append(hit)
        b.append(hit + step)
        step += 1
    for s, m in zip(starts, sizes):
        if m > 64 or side[s]:
            cut = int(np.searchsorted(side[s : s + m], 2)) if side[s] else 0
            if side[s] and cut in (0, m):
                continue
            x, y = _tile_links(fp[s : s + m], cut, radius)
            a.append(s + x)
            b.append(s + y)
    if not a:
        return fp[:0], fp[:0]
    label = local_forest(np.concatenate(a), np.concatenate(b), len(fp))
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def link_forest(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` bits.

    Fingerprints within 3 bits agree in one of ``radius + 1`` blocks of their bits, so
    only those are compared, in tiles sorted by population count; each comparison is
    exact. A block value with more than ``tile`` fingerprints is cut into tiles, and
    each pair of its tiles is a key of its own. Each task emits a spanning forest of
    the links it found: a group of copies never gives all its pairs.
    """
    k = radius + 1
    width = 64 // k
    value = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << (width if i < k - 1 else 64 - width * (k - 1))) - 1 if i < k - 1 else -1) for i in range(k)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(value)])).alias("block")).select("fp", F.xxhash64("block.i", "block.v").alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    keyed = keyed.join(hot, "key", "left")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = keyed.select("fp", "key", tiles.alias("tiles"), mine.alias("mine"))
    whole = dealt.where("tiles is null").select("fp", "key", F.lit(0).alias("side"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    split = dealt.where("tiles is not null").select("fp", "key", "mine", other.alias("other"))
    split = split.select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return
        all_ = pa.concat_tables(got)
        key, side, fp = (all_.column(c).to_numpy() for c in ("key", "side", "fp"))
        a, b = tile_forest(key, side, fp.view(np.uint64), radius)
        for s in range(0, len(a), 100_000):
            yield pa.record_batch([pa.array(a[s : s + 100_000].view(np.int64)), pa.array(b[s : s + 100_000].view(np.int64))], ["a", "b"])

    return whole.unionByName(split).repartition("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable by links.

    Defined cases: a null, empty or blank text has fingerprint 0 and is linked like
    any other; repeated rows each give a row; a null id never is a component's id
    unless all its members have none; an empty table gives no rows; other columns are
    not looked at.
    """
    fps = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    roots = components(link_forest(nodes.select("fp"), radius))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = linked.where("linked").groupBy("root").agg(F.min("rep").alias("least"))
    shared = linked.where("linked or n > 1").join(least, "root", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    out = fps.join(shared, "fp", "left")
    return out.select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def op7_tiled_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their fingerprint and near-duplicate component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each near-duplicate group stays, with its columns.

    That is the row with the smallest id; rows without an id come last, and rows with
    one id (or none) stand by the hash of all their columns, so each is judged by its
    own text. Null, empty and blank texts are near-duplicates of each other; very long
    texts count whole; of repeated rows one stays; an empty table gives none; other
    columns are passed on.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        kept = near_duplicates(docs).where("id = component_id").select(F.col("id").alias("doc_id"))
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    every = F.xxhash64(*[docs[c] for c in docs.columns])
    name = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), every.alias("h"))
    own = free_names(docs, "name")[0]
    kept = near_duplicates(docs.select(name.alias("name"), docs["text"]), "name").where("id = component_id").select(F.col("id").alias(own)).distinct()
    return docs.withColumn(own, name).join(kept, own, "left_semi").dropDuplicates([own]).select(docs.columns)
