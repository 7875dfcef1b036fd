"""Sinks. Writers keep the partitions they are given; one file only where asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one file inside the folder of a video, and of one file of a table.
FILE_ROWS, TABLE_ROWS = 1_000_000, 2_000_000


def write_table(df: DataFrame, path: str, partitions: int | None = None, rows: int = TABLE_ROWS) -> None:
    """Parquet, overwriting; ``partitions`` sets the number of files by an even exchange.

    The rows are counted for that: a table of more than ``partitions`` times ``rows`` rows gets more files, of about ``rows``
    each, so that no task grows with the table. Choose fewer for very wide rows.
    """
    if partitions is not None:
        df = df.repartition(max(partitions, -(-df.count() // rows)))
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines, overwriting. ``files=1`` is for small results such as perf records."""
    out = df if files is None else df.coalesce(files)
    out.write.mode("overwrite").json(path)


def _in_order(df: DataFrame, by: Sequence[str], order: str, rows: int):
    """A writer of bounded files, one folder per ``by``: a hot key is dealt to several tasks, and files follow each other in ``order``."""
    dealt = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    return dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by)


def write_phases(df: DataFrame, path: str, by: Sequence[str] = ("video",), order: str = "timestamp", rows: int = FILE_ROWS) -> None:
    """Phase log as CSV with a header, one folder per video; files of at most ``rows`` rows, in the order of their names."""
    _in_order(df, by, order, rows).option("header", True).csv(path)


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """One column as plain text, one value per line."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_chunks(
    df: DataFrame, path: str, size: int = 480, frame: str = "frame_index", by: Sequence[str] = (), rows: int = FILE_ROWS
) -> None:
    """Parquet in chunks of ``size`` frames, one folder per chunk (below ``by``, e.g. the video), files of at most ``rows`` rows.

    Small folders suit the readers of one recording; for archives choose a larger ``size``. Without ``by`` the frames of equal number of
    all videos share a folder; ranges of frames keep its tasks apart all the same.
    """
    chunked = df.withColumn("chunk", F.floor(F.col(frame) / size).cast("int"))
    dealt = chunked.repartitionByRange(*by, "chunk", frame).sortWithinPartitions(*by, "chunk", frame)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by, "chunk").parquet(path)


def project_manifest(files: DataFrame, col: str = "path") -> DataFrame:
    """``.mp4`` files as annotation tasks: ``{"video": …, "annotations": []}`` (``video, annotations``).

    An empty list of files is an empty table; callers that must report it can ask ``isEmpty``.
    """
    videos = files.where(F.col(col).endswith(".mp4"))
    return videos.select(F.col(col).alias("video"), F.array().cast("array<string>").alias("annotations"))


def write_subtitles(cues: DataFrame, path: str, by: Sequence[str] = ("video",), rows: int = FILE_ROWS) -> None:
    """Subtitle text in cue order, one folder per video; files of at most ``rows`` cues, in the order of their names."""
    ordered = cues.repartitionByRange(*by, "cue").sortWithinPartitions(*by, "cue")
    texts = ordered.select(*by, F.col("text").alias("value"))
    texts.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by).text(path)
