"""Scans: images, JSON exports, CSV logs, text labels. Schemas are given, never inferred twice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from footstats.functions.paths import file_stem
from footstats.sources.schemas import PERF, SECOND_LABELS


_SCHEME = r"^[a-z0-9]+:(//[^/]*)?"


def _bare(path: Column) -> Column:
    """Path without scheme and host (``file:/a``, ``file:///a``, ``s3a://b/a`` -> ``/a``)."""
    return F.regexp_replace(path, _SCHEME, "")


def _file_path() -> Column:
    # The metadata path is percent-encoded, a plus sign is not.
    return _bare(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))


def relative_to(path: Column, root: str) -> Column:
    bare, start = _bare(path), re.sub(_SCHEME, "", root).rstrip("/") + "/"
    below = F.substring(bare, F.lit(len(start) + 1), F.length(bare))
    return F.when(bare.startswith(start), below).otherwise(bare)


def read_binary(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """All files below ``root`` whose name fits ``glob``; ``path`` becomes relative to it.

    ``content`` is not read unless a later step selects it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return files.withColumn("path", relative_to(F.col("path"), root))


def read_json_array(spark: SparkSession, path: str | list[str], schema: str, multi_line: bool = True) -> DataFrame:
    """Files that each hold one JSON array of records.

    Such a file is read by one task; write large ones as JSON lines (``write_json``) and
    read those with ``multi_line=False``, which splits.
    """
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_second_labels(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Per-second labels with ``time`` as long, whether it was written as 3 or 3.0."""
    schema = SECOND_LABELS.replace("time long", "time double")
    rows = read_json_array(spark, path, schema, multi_line)
    return rows.withColumn("time", F.col("time").cast("long"))


def combine_json(spark: SparkSession, folder: str, schema: str, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """All JSON files of a folder (arrays of records, or with ``multi_line=False`` a record a line) as one table, with the file each record came from."""
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("pathGlobFilter", glob)
    return reader.json(folder).select("*", _file_path().alias("source"))


def consolidate_csv(spark: SparkSession, folder: str, schema: str, suffix: str = "_phases") -> DataFrame:
    """All CSV files of a folder as one table by column *name*; ``video`` is the file name without ``suffix``.

    The first line of each file that is not blank is its header, told by its place in the file, whatever it names. Files may order
    their columns differently, lack some or all of them (null) or have more (left out). A file whose first line names no wanted
    column but reads like a row (as many fields as columns, a number where a number is wanted) has no header: that is an
    error, not a loss of rows. A leading byte-order mark is ignored; a value spans one line. Folders written by
    ``write_phases`` already carry ``video`` and keep it.
    """
    wanted = StructType.fromDDL(schema)
    lines = spark.read.text(folder, recursiveFileLookup=False)
    inside = [c for c in lines.columns if c != "value"]  # partition folders
    names = [f.name for f in wanted if f.name not in inside]
    # A task reads its stretches of files from front to back, so ids grow along a stretch; stretches have their place in the file.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(*inside, F.regexp_replace("value", "^\ufeff", "").alias("value"), _file_path().alias("_file"), place.alias("_at"))
    lines = lines.where(F.trim("value") != "")
    fields = F.transform(F.split("value", ","), lambda x: F.trim(F.translate(x, '"', "")))
    first = F.min(F.struct("_at", "value"))
    headers = lines.groupBy("_file").agg(first.alias("_first")).select("_file", F.col("_first._at").alias("_top"), F.col("_first.value").alias("value"))
    headers = headers.select("_file", "_top", fields.alias("_header"))
    rows = lines.join(headers, "_file").where(F.col("_at") != F.col("_top"))
    numeric = [i for i, n in enumerate(names) if isinstance(wanted[n].dataType, NumericType)]
    if numeric:
        number = F.try_element_at("_header", F.lit(numeric[0] + 1)).try_cast("double").isNotNull()
        nameless = F.size(F.array_intersect("_header", F.array(*[F.lit(n) for n in names]))) == 0
        bare = headers.where((F.size("_header") == len(names)) & nameless & number).select("_file").limit(3).collect()
        if bare:
            raise ValueError(f"files without a header: {', '.join(r['_file'] for r in bare)}")
    kinds = {f.name: f.dataType.simpleString() for f in wanted}
    parsed = None
    for (header,) in headers.select("_header").distinct().collect():  # a few orders of columns, not files
        part = F.from_csv("value", ", ".join(f"c{i} {kinds.get(n, 'string')}" for i, n in enumerate(header)))
        own = rows.where(F.col("_header") == F.array(*[F.lit(n) for n in header])).withColumn("_row", part).select(
            "_file", *inside, *[(F.col(f"_row.c{header.index(n)}") if n in header else F.lit(None).cast(kinds[n])).alias(n) for n in names]
        )
        parsed = own if parsed is None else parsed.unionByName(own)
    if parsed is None:
        return spark.createDataFrame([], schema)
    if "video" in inside or "video" in names:
        return parsed.select(*[F.col(f.name).cast(f.dataType) for f in wanted])
    name = F.element_at(F.split("_file", "/"), -1)
    return parsed.select(*names, F.regexp_replace(file_stem(name), f"{suffix}$", "").alias("video"))


def read_perf(spark: SparkSession, glob: str, depth: int = 4) -> DataFrame:
    """Perf records below ``…/<feature>/<label>/perf/*.json`` with file name and feature."""
    rows = spark.read.schema(PERF).json(glob).select("*", _file_path().alias("filename"))
    return rows.withColumn("feature", F.element_at(F.split("filename", "/"), -depth))


# Fixed column names of the detector's training log and what the tables call them.
TRAINING_COLUMNS = {
    "val/box_loss": "val_box_loss",
    "val/cls_loss": "val_classification_loss",
    "metrics/precision(B)": "Precision",
    "metrics/recall(B)": "Recall",
}


def read_training_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training log with padded headers and values -> epoch and the four named columns."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(
        F.col("epoch").cast("int").alias("epoch"),
        *[F.col(f"`{old}`").cast("double").alias(new) for old, new in TRAINING_COLUMNS.items()],
    )


def read_yolo_labels(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Box label files, one line ``class x y w h`` per box -> ``file, line, cls, x, y, w, h``."""
    lines = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
        .select(relative_to(_file_path(), folder).alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
        .where(F.col("line") != "")
    )
    part = F.split("line", r"\s+")
    return lines.select(
        "file", "line", F.get(part, F.lit(0)).alias("cls"),
        *[F.get(part, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xywh", 1)],
    )


def manifest(spark: SparkSession, root: str, base_url: str, glob: str = "*") -> DataFrame:
    """One ``value`` per file below ``root``: its path under ``base_url``."""
    files = read_binary(spark, root, glob).select("path")
    return files.select(F.concat(F.lit(base_url.rstrip("/") + "/"), "path").alias("value"))
