"""Plan files, manifests, test results and markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plan_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, plan_index, plan_id, base_revision, steps) of JSON plan files for one document, indexed by a hash of their path.

    All files are rows; ``planning.plan_errors`` tells those that are refused.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("plan_id"), F.col("value").alias("steps"))
    return files.select(F.lit(0).cast("long").alias("doc_id"), F.crc32(F.col("plan_id").cast("binary")).alias("plan_index"), "plan_id", F.lit(None).cast("int").alias("base_revision"), "steps")


def discovered(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """Files below a folder with size, hash and a category by the prefix of their name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.startswith(name, F.lit("simple")), "simple").when(F.startswith(name, F.lit("complex")), "complex").otherwise("other")
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), kind.alias("category"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of a manifest (name) that no file has; all are told together."""
    return manifest.join(files.select("name"), "name", "left_anti")


def test_results(spark: SparkSession, path: str) -> DataFrame:
    """(story, status, stop) of a folder of JSON results; what cannot be parsed has the status unknown."""
    rows = spark.read.schema("story string, status string, stop long, broken string").option("columnNameOfCorruptRecord", "broken").option("multiLine", "true").json(path)
    return rows.select("story", F.coalesce("status", F.lit("unknown")).alias("status"), "stop")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, heading, cells) of the rows of markdown tables; a heading holds for the rows below it."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("line", r"^#+\s+(.*)$", 1), F.lit(""))
    rows = lines.withColumn("heading", F.last(head, True).over(w))
    bar = F.regexp_like("line", F.lit(r"^\s*\|.*\|\s*$")) & ~F.regexp_like("line", F.lit(r"^[\s|:-]+$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return rows.where(bar).select("file", "line_no", "heading", cells.alias("cells"))


def markdown_report(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows as one markdown table."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit(head + "\n"), body).alias("report"))
