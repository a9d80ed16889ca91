"""Cutting the lineage of frames that loops build."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share.

    Only on one machine, as in tests, a local folder stands in for an unset one; a
    cluster without a shared folder raises. A folder that is made here goes when the
    program ends; one that the session has already stays.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir")
        if not root:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = os.path.join(tempfile.gettempdir(), f"quillwork-{context.applicationId}")
        context.setCheckpointDir(root)
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        atexit.register(_drop, path.getFileSystem(context._jsc.hadoopConfiguration()), path)
    return context.getCheckpointDir()


def _drop(files, path) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone
        files.delete(path, True)


def tasks(spark: SparkSession) -> int:
    """How many tasks what is much work, or much memory, for its bytes is dealt to: by number, so that they are not joined by size."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder that the session names; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
