"""Deterministic splits: the side of a row depends on its key alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.operators.sequences import with_position

SPLITS = ("train", "val", "test")


def split_crc32(df: DataFrame, key: str = "file", ratio: float = 0.8, out: str = "split") -> DataFrame:
    """``crc32(key) % 100`` below ``ratio``: train, else test; a file never sits on both sides."""
    return df.withColumn(out, F.when(F.crc32(F.col(key)) % 100 < ratio * 100, "train").otherwise("test"))


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def split_hash(
    df: DataFrame,
    key: str,
    ratios: Sequence[float],
    seed: int = 42,
    names: Sequence[str] | None = None,
    out: str = "split",
) -> DataFrame:
    """Seeded split in about the given ratios, without a shuffle."""
    names = names or (SPLITS if len(ratios) == 3 else ("train", "test"))
    share = F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("long") % 10000
    side, upto = F, 0.0
    for name, ratio in zip(names[:-1], ratios):
        upto += ratio
        side = side.when(share < round(upto * 10000), name)
    return df.withColumn(out, side.otherwise(names[-1]))


def split_exact(
    df: DataFrame, key: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42, out: str = "split"
) -> DataFrame:
    """Seeded split of unique keys with exact sizes: ``int(ratio * n)`` rows each, the rest last.

    Rows are ranked by a seeded digest; its leading digits bucket the ranking evenly.
    """
    names = SPLITS if len(ratios) == 3 else ("train", "test")
    digest = df.withColumn("_digest", _digest(key, seed)).withColumn("_all", F.lit(0))
    ranked = with_position(digest, ["_all"], ["_digest", key], F.substring("_digest", 1, 4), "_rank")
    n = df.agg(F.count(F.lit(1))).scalar()
    side, upto = F, F.lit(0)
    for name, ratio in zip(names[:-1], ratios):
        upto = upto + F.floor(F.lit(ratio) * n)
        side = side.when(F.col("_rank") < upto, name)
    return ranked.withColumn(out, side.otherwise(names[-1])).drop("_digest", "_all", "_rank")
