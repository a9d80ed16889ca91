"""Sharding by a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._quantile import cut_points, small_table
from ._store import stored

#: A key is 16 bits of a metadata coordinate, 20 bits of the text's hash, 24 bits of the id's hash:
#: rows with equal metadata are dealt by text, equal texts stay neighbours, and any group can still be cut.
_COORD, _TEXT, _ID = 16, 20, 24
#: A cut falls between texts, not among copies of one, where that costs its sides no more than this share
#: of a leaf; only a group that weighs over twice as much can be cut.
WHOLE_SHARE = 0.02
_ROWS_PER_RUN = 50_000


def _coordinate(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    """A metadata value on 0 .. 2**16 - 1; text by hash, numbers by place in their range, null lowest."""
    top = (1 << _COORD) - 1
    if low is None:
        place = F.pmod(F.xxhash64(df[name]), F.lit(1 << _COORD))
    elif high == low:
        place = F.lit(0)
    else:
        place = F.floor((df[name].cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(top)))
    return F.coalesce(F.least(F.greatest(place.cast("long"), F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def kd_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    target_bytes: int | None = None,
    n_shards: int | None = None,
    overhead: int = 8,
) -> DataFrame:
    """Deal every row to a leaf of a k-d tree over ``dims``; leaves weigh alike in bytes.

    The tree is split again and again at the weighted median of the widest
    dimension until leaves reach ``target_bytes`` (or until there are
    ``n_shards``); a node of k leaves gives floor(k/2) of them to its lower side.
    Medians come from histograms summed on the executors; rows are never sorted
    or moved to find them. Copies of a text share the least metadata among them, so
    they are neighbours in every order. A cut falls between two texts unless that
    would put it off its median by over WHOLE_SHARE of a leaf, so a group of copies
    lies in one shard unless it weighs more than twice that and a median falls in it.

    Defined cases: a null text weighs ``overhead`` bytes and has the checksum of
    the empty text; a null or absent dimension value sorts lowest; very long texts
    weigh what they are; repeated rows are separate rows; an empty table gives no
    rows; columns other than those named are not looked at. Returns id, size,
    text_crc32, shard, slot (gapless from 0 in each shard).
    """
    spark = df.sparkSession
    body = F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary")
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    names = [f"d{i}" for i in range(len(dims))]
    size = F.octet_length(body).cast("long") + F.lit(overhead)
    base = stored(df.select(df[id_col].alias("id"), size.alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("h"), *[(df[d].cast("double") if d in numeric else df[d].cast("string")).alias(n) for d, n in zip(dims, names)]))
    copies = base.groupBy("h").agg(*[F.min(n).alias(f"g_{n}") for n in names], *[F.max(n).alias(f"t_{n}") for n in names], *[F.count(n).alias(f"n_{n}") for n in names], F.count("*").alias("n"))
    differ = " or ".join(f"g_{n} < t_{n} or (n_{n} > 0 and n_{n} < n)" for n in names)
    copies = copies.where(differ).select("h", F.lit(True).alias("mixed"), *[f"g_{n}" for n in names])  # copies whose metadata differ
    base = base.join(copies, "h", "left").select("id", "size", "crc", "h", *[F.when(F.col("mixed"), F.col(f"g_{n}")).otherwise(F.col(n)).alias(n) for n in names])
    ranged = [n for d, n in zip(dims, names) if d in numeric]
    ends = base.agg(F.count("*").alias("n"), F.sum("size").alias("w"), *[f(n).alias(f"{s}{n}") for n in ranged for f, s in ((F.min, "lo_"), (F.max, "hi_"))]).first()
    total, n_rows = float(ends.w or 0), ends.n
    leaves = n_shards or max(1, round(total / target_bytes))
    tie = F.shiftleft(F.shiftrightunsigned("h", 64 - _TEXT), _ID) + F.shiftrightunsigned(F.xxhash64("id", "h"), 64 - _ID)
    keys = []
    for n in names:
        low, high = (ends[f"lo_{n}"] or 0.0, ends[f"hi_{n}"] or 0.0) if n in ranged else (None, None)
        keys.append(F.shiftleft(_coordinate(base, n, low, high), _TEXT + _ID) + tie)
    rows = stored(base.select("id", "size", "crc", F.lit(1).cast("long").alias("v"), F.array(*keys).alias("k")))
    nodes = {1: (0, leaves, total)}  # node: first leaf, leaves, weight; the children of v are 2v and 2v + 1
    least = total / leaves * WHOLE_SHARE
    while n_rows and (wide := {v for v, (_, k, _) in nodes.items() if k > 1}):
        ends_of = [f(F.col("k")[i]).alias(f"{s}{i}") for i in range(len(dims)) for f, s in ((F.min, "lo"), (F.max, "hi"))]
        wanted, by = {}, {}
        for r in rows.groupBy("v").agg(*ends_of).collect():  # a row for each node
            if r.v in wide:
                _, k, w = nodes[r.v]
                width = [(r[f"hi{i}"] >> (_TEXT + _ID)) - (r[f"lo{i}"] >> (_TEXT + _ID)) for i in range(len(dims))]
                by[r.v] = dim = width.index(max(width))
                wanted[r.v] = (r[f"lo{dim}"], r[f"hi{dim}"], w * (k // 2) / k)
        if not wanted:
            break
        along = rows.join(small_table(spark, list(by.items()), "v", "dim"), "v")
        key = F.col("k")[F.col("dim").cast("int")]
        between = cut_points(along, F.col("v"), F.shiftrightunsigned(key, _ID), F.col("size"), {v: (lo >> _ID, hi >> _ID, w) for v, (lo, hi, w) in wanted.items()})
        found = {v: (cut << _ID, below) for v, (cut, below) in between.items()}
        off = {v: wanted[v] for v, (_, below) in found.items() if abs(below - wanted[v][2]) > least}
        if off:
            found |= cut_points(along, F.col("v"), key, F.col("size"), off, dict.fromkeys(off, least / 100))
        for v, (_, below) in found.items():
            first, k, w = nodes.pop(v)
            nodes[2 * v], nodes[2 * v + 1] = (first, k // 2, below), (first + k // 2, k - k // 2, w - below)
        cuts = small_table(spark, [(v, by[v], cut) for v, (cut, _) in found.items()], "v", "dim", "cut")
        below = F.col("k")[F.col("dim").cast("int")] >= F.col("cut")
        rows = stored(rows.join(cuts, "v", "left").select("id", "size", "crc", F.when(F.col("cut").isNull(), F.col("v")).otherwise(F.col("v") * 2 + below.cast("long")).alias("v"), "k"))
        nodes = {v: x for v, x in nodes.items() if v not in wide or v in wanted}

    leaf = small_table(spark, [(v, first) for v, (first, _, _) in nodes.items()], "v", "first")
    rows = rows.join(leaf, "v", "left")
    runs = max(1, -(-n_rows // _ROWS_PER_RUN))
    dealt = rows.select("id", F.col("size"), F.col("crc").alias("text_crc32"), F.coalesce("first", F.lit(0)).cast("int").alias("shard"), F.pmod(F.xxhash64("id", "k"), F.lit(runs)).cast("int").alias("run"))
    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("in_run"))
    before = counts.select("shard", "run", (F.sum("in_run").over(Window.partitionBy("shard").orderBy("run")) - F.col("in_run")).alias("before"))
    in_run = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "text_crc32", "size"))
    placed = dealt.withColumn("at", in_run).join(before, ["shard", "run"])
    return placed.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = kd_shards(docs, n_shards=24)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
