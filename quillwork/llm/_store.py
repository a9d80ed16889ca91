"""Shared-folder tables that cut lineage, and a few frame helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where it is set.

    Only on one machine, as in tests, an unset value is replaced by a local folder; a
    cluster without a shared folder raises. The folder goes when the program ends.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "quillwork")
    folder = f"{root.rstrip('/')}/{context.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        atexit.register(_drop, files, path)
    return folder


def _drop(files, path) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone
        files.delete(path, True)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table survives lost executors, so nothing above it is computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_prefix(df: DataFrame, end: str = "") -> str:
    """More underscores than any column of ``df`` begins with, and ``end``: no name that starts so clashes with a column."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)) + end


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that keeps them apart from the columns of ``df``."""
    return [free_prefix(df) + n for n in names]


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns cannot clash with what an operator adds."""
    return df.select(*[df[n] for n in names])
