"""From raw documents to token ids: filter, deduplicate, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm._store import stored
from quillwork.llm.decontam import drop_leaks
from quillwork.llm.pieces import encoded
from quillwork.llm.simhash import keep_one_of_each_group
from quillwork.llm.suffix_dedup import cut_repeats
from quillwork.llm.toxicity import drop_toxic

#: (name, function) in order. A function takes (spark, docs, sf_dir), where docs has the columns of
#: ``documents`` and is what the stage before it kept. All but the last return those columns.
STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encoded),
]

#: The fitted models and the search for pieces have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
