"""Quality selection by importance resampling: hashed n-gram models and a Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._quantile import cut_points
from ._store import stored
from ._text import mixed, prefix_hash, slices, span_hash, word_spans

#: Buckets of hashed words and word pairs; the models' size, whatever the input.
BUCKET_BITS = 16
#: Labelled good rows that the target model is counted on, at most. The raw model counts every row.
TARGET_ROWS = 20_000
SMOOTH = 1.0
SEED = 17
_FIXED = 20  # fractional bits of the selection key


def ngram_buckets(column: pa.Array, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word or run of signs, and every pair of neighbours, of each text."""
    data, starts, ends, rows = word_spans(column, symbols=True)
    words = span_hash(prefix_hash(data), starts, ends)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = mixed(words[pair] * np.uint64(3) + words[pair + 1])
    return np.concatenate([rows, rows[pair]]), (np.concatenate([words, pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def ngram_counts(rows: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, raw, target) over all (text, target) rows; each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = ngram_buckets(part.column("text"), bits)
                good = part.column("target").to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=1 << bits)
                target += np.bincount(bucket[good[row]], minlength=1 << bits)
        on = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(on), pa.array(raw[on]), pa.array(target[on])], ["bucket", "raw", "target"])

    counts = rows.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def importance(rows: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(id, log_ratio): the log of the target model's to the raw model's likelihood of each text."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in ngram_counts(rows, bits).collect():  # 2**bits rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    sent = rows.sparkSession.sparkContext.broadcast(share(target) - share(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = ngram_buckets(part.column("text"), bits)
                score = np.bincount(row, sent.value[bucket], minlength=part.num_rows).astype(float)
                yield pa.record_batch([part.column("id"), pa.array(score)], ["id", "log_ratio"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, log_ratio double")


def gumbel_top(scored: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """The ``share`` of all rows (id, log_ratio) with the greatest log_ratio + Gumbel noise.

    Noise depends on the id and the seed alone. The threshold is found by repeated
    histograms, so no task sorts or holds the selection; rows that are alike in key
    and id stand or fall together.
    """
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(u)))
    high = F.round(-F.col("gumbel_key") * F.lit(float(1 << _FIXED))).cast("long")
    limit = 1 << 46
    high = F.greatest(F.lit(-limit), F.least(F.lit(limit - 1), high))
    place = F.shiftleft(high, 16) + F.shiftrightunsigned(F.xxhash64("id"), 48)
    keyed = stored(keyed.withColumn("__place", place))
    ends = keyed.agg(F.count("*").alias("n"), F.min("__place").alias("lo"), F.max("__place").alias("hi")).first()
    keep = round(share * ends.n)
    if not ends.n or keep >= ends.n:
        return keyed.drop("__place")
    cut, _ = cut_points(keyed, F.lit(0), F.col("__place"), F.lit(1), {0: (ends.lo, ends.hi, float(keep))})[0]
    return keyed.where(F.col("__place") < F.lit(cut)).drop("__place")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Select texts like the labelled good ones: (id, log_ratio, gumbel_key) of the kept rows.

    ``labels`` has doc_id and quality (1: good). The raw model counts the n-grams of
    every row; the target model those of at most TARGET_ROWS good rows, taken by a
    hash of their id. ``share`` of all rows is kept; where None, the share of good rows
    among the labelled ones.

    Defined cases: a null or wordless text scores 0; labels that repeat an id count by
    the greatest quality; repeated rows are scored alike and kept or dropped together;
    different texts under one id, and all without an id, share their noise; without labels every row is kept; an empty table
    gives no rows; other columns are not looked at.
    """
    flags = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = flags.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    if share is None:
        share = (seen.good or 0) / seen.n if seen.n else 1.0
    good = flags.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    flagged = rows.join(F.broadcast(good), "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    return gumbel_top(importance(flagged), share)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` kept: as large a share as is good among the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels).withColumnRenamed("id", "doc_id")
