"""Equal files and matching names.

Copies of one file may make up a large part of a table. Rows are never paired with each
other: the known side is reduced to distinct keys (or counts), and the searched side is
spread where a key is hot, so that one content does not end in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.functions.paths import file_stem, path_tail

#: Rows of one key that a task may hold; more are spread over several.
HOT_ROWS = 1_000_000


def content_hash(content: Column, algo: str = "sha1") -> Column:
    """Hex digest, empty for null: a join key that cannot be null is not computed twice for a null filter."""
    return F.coalesce({"sha1": F.sha1, "md5": F.md5}[algo](content), F.lit(""))


def salted_join(
    rows: DataFrame, known: DataFrame, key: str, spread: Sequence[str], how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """Join ``rows`` to a ``known`` side with about one row per key; hot keys are spread.

    Keys with more than ``hot_rows`` rows are counted first. Only their known rows are copied, once for each
    started ``hot_rows``, and their rows take one of these copies by the hash of ``spread``, columns that
    differ between rows of equal key. All other keys are joined as they are.
    """
    hot_rows = hot_rows or HOT_ROWS
    # At most one key for each ``hot_rows`` rows: small enough to broadcast.
    hot = F.broadcast(
        rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    )
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), parts).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    copies = known.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def key_match(
    rows: DataFrame, known: DataFrame, key: str, spread: Sequence[str], how: str = "left_semi"
) -> DataFrame:
    """``rows`` whose ``key`` is (``left_semi``) or is not (``left_anti``) among ``known``."""
    return salted_join(rows, known.select(key).distinct(), key, spread, how)


def hash_semi(
    rows: DataFrame, known: DataFrame, content: str, spread: Sequence[str], algo: str = "sha1", how: str = "left_semi"
) -> DataFrame:
    """Rows whose content occurs in ``known``, with their ``digest``.

    Content itself is exchanged only if a later step selects it.
    """
    digest = content_hash(F.col(content), algo)
    found = known.where(F.col(content).isNotNull()).select(digest.alias("digest"))
    matched = key_match(rows.withColumn("digest", digest), found, "digest", spread, how)
    return matched.withColumn("digest", F.nullif("digest", F.lit("")))


def dup_files(a: DataFrame, b: DataFrame, content: str, spread: Sequence[str], how: str = "shared") -> DataFrame:
    """Files of ``b`` that also lie in ``a`` (``shared``) or do not (``missing``), by md5."""
    return hash_semi(b, a, content, spread, "md5", {"shared": "left_semi", "missing": "left_anti"}[how])


def value_semi(rows: DataFrame, values: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Rows whose ``key`` is in the list ``values``."""
    return key_match(rows, values, key, spread)


def join_path_tail(
    tasks: DataFrame, files: DataFrame, spread: Sequence[str], n: int = 3, image: str = "image", path: str = "path"
) -> DataFrame:
    """Tasks whose last ``n`` path parts equal those of a file, with how many files match.

    An id counts once per matching file; that number is the column ``matches``, so that
    equal names on both sides are not multiplied.
    """
    counts = files.groupBy(path_tail(F.col(path), n).alias("_tail")).agg(F.count(F.lit(1)).alias("matches"))
    return salted_join(tasks.withColumn("_tail", path_tail(F.col(image), n)), counts, "_tail", spread).drop("_tail")


def join_stem(
    images: DataFrame, labels: DataFrame, spread: Sequence[str], image: str = "image", label: str = "label_file"
) -> DataFrame:
    """Images with the label file of the same stem; of label files with equal stems, the first by name."""
    left = images.withColumn("_stem", file_stem(F.col(image)))
    others = [c for c in labels.columns if c != label]
    first = F.min_by(F.struct(label, *others), F.struct(label, F.xxhash64(*labels.columns))).alias("_first")
    right = labels.groupBy(file_stem(F.col(label)).alias("_stem")).agg(first).select("_stem", *[F.col(f"_first.{c}").alias(c) for c in labels.columns])
    return salted_join(left, right, "_stem", spread).drop("_stem")
