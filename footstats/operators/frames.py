"""Frame listings and class probabilities per frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from footstats.functions import paths as p
from footstats.operators.sequences import CHUNK_ROWS, with_halo


def parse_frame_path(df: DataFrame, path: str = "path") -> DataFrame:
    """``…/mat_MM/BBBB/FFFF.jpg`` -> ``mat, batch_id, frame_id, timestamp`` (seconds)."""
    c = F.col(path)
    return (
        df.withColumn("mat", p.frame_mat(c))
        .withColumn("batch_id", p.frame_batch(c))
        .withColumn("frame_id", p.frame_number(c))
        .withColumn("timestamp", p.frame_timestamp(c))
    )


def frame_key(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``(file, time)``, the key that joins frames to per-second labels."""
    return df.withColumn("file", p.clip_file(F.col(path))).withColumn("time", p.clip_second(F.col(path)))


def order_timeline(df: DataFrame, key: Sequence[str] = ("mat",), time: str = "timestamp") -> DataFrame:
    return df.orderBy(*key, time)


def argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predict_label(df: DataFrame, prob: str = "prob", labels: str = "labels") -> DataFrame:
    index = argmax(F.col(prob))
    return df.withColumn("predicted_index", index).withColumn("predicted_label", F.get(labels, index))


def expand_probs(df: DataFrame, names: Sequence[str], prob: str = "prob", labels: str = "labels") -> DataFrame:
    """One column per label name; null where a row does not know the name."""
    at = lambda n: F.get(prob, F.nullif(F.array_position(labels, n), F.lit(0)).cast("int") - 1)
    return df.select("*", *[at(n).alias(n) for n in names])


def context_window(
    df: DataFrame,
    k: int,
    aggs: Callable[[WindowSpec], dict[str, Column]],
    key: Sequence[str] = ("mat",),
    time: str = "timestamp",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Aggregates over the rows of the same mat within ``k`` seconds on both sides."""
    return with_halo(df, key, time, k, k, lambda w: aggs(w.rangeBetween(-k, k)), size)


def pad_edges(df: DataFrame, k: int, key: Sequence[str] = ("mat",), time: str = "timestamp") -> DataFrame:
    """Repeat the first row for the ``k`` seconds before it and the last for the ``k`` after it."""
    key = list(key)
    rest = F.struct(*[c for c in df.columns if c not in (*key, time)])
    edges = df.groupBy(*key).agg(
        F.min(time).alias("_lo"), F.max(time).alias("_hi"),
        F.min_by(rest, time).alias("_first"), F.max_by(rest, time).alias("_last"),
    )

    def pads(lo, hi, row):
        times = edges.select(*key, row, F.explode(F.sequence(lo, hi)).alias(time))
        return times.select(*[F.col(c) if c in (*key, time) else F.col(f"{row}.{c}") for c in df.columns])

    lo, hi = F.col("_lo"), F.col("_hi")
    if k < 1:
        return df
    return df.union(pads(lo - k, lo - 1, "_first")).union(pads(hi + 1, hi + k, "_last"))
