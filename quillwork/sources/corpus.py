"""The driver's tables as the relations of a document corpus; every order is an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, para_idx, text): a row for each line of each document; no shuffle."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, comment_id, parent_id, author, text): conversations as threads; turn 0 is the root."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("comment_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), F.col("role").alias("author"), "text")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, link_idx, target): the hyperlinks of each page in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("link_idx", "target"))


def tagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, run_idx, bold, text): the text between tags of each page, bold inside ``<b>``."""
    parts = F.split("html", r"(?=<)")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(parts).alias("run_idx", "part"))
    return rows.select("page_id", "run_idx", F.startswith("part", F.lit("<b>")).alias("bold"), F.regexp_replace("part", "^<[^>]*>", "").alias("text")).where("text <> ''")
