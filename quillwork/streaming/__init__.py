"""Streams of documents: search as they arrive, and sessions that end when idle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import pattern_of

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New Parquet files of documents below a folder, at most ``files`` of them in a batch."""
    reader = spark.readStream.schema(DOCUMENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def matches(docs: DataFrame, patterns: Sequence[str], whole_word: bool = False) -> DataFrame:
    """Paragraphs that match, with their count; no state is kept."""
    p = pattern_of(patterns, whole_word)
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))
    return paras.where(F.regexp_like("text", F.lit(p))).select("doc_id", "para_idx", F.regexp_count("text", F.lit(p)).alias("match_count"), F.regexp_extract("text", p, 0).alias("match_text"))


def sessions(events: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of (user_id, ts) that end after ``idle``; events up to ``late`` are still counted."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("expires"), "n")
