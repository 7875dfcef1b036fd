"""Small helpers of this subpackage: the shared folder, written intermediate tables, held-out marks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder in its warehouse only where that is not set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


#: While it is on, the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut`` of ``df``, and the folder it was written to. The shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: a lost executor repeats one step only.

    The written folder stays until the caller clears ``<shared folder>/llm-<application id>``.
    """
    return written(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``written`` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(rows: DataFrame, run, schema: str, id_col: str = "doc_id") -> DataFrame:
    """``rows.mapInPandas(run, "<id_col> ..., " + schema)`` with the id in its own type.

    On the way through pandas the id is text: integers beside a null would turn into floating point there.
    """
    kind = rows.schema[id_col].dataType
    made = rows.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, f"{id_col} string, {schema}")
    return made.withColumn(id_col, F.col(id_col).cast(kind))


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the mark that splits rows into learned and held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
