"""Intermediate tables in a folder that all executors share.

A flow with several two-pass operators stages its table between them: each later pass
reads columns of a finished Parquet table instead of computing its whole past again,
and a lost executor costs only the current step. The folder is, in this order, the one
a caller names, the session's ``spark.checkpoint.dir``, a folder in its warehouse.
``clear_staged`` deletes what a session has staged, once the results are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    named = folder or spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging").rstrip("/")


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path below the shared folder; ``clear_staged`` deletes it."""
    path = f"{shared_dir(spark, folder)}/footstats/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete all this session's staged folders; how many were there."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm, found = spark._jvm, 0
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
