"""Ordered-sequence operators that survive a video holding most of the rows.

A plain ``Window.partitionBy(video)`` puts a whole video into one task. Here every
video is cut into chunks of ``size`` consecutive positions and the windows run per
``(video, chunk)``:

* a bounded frame (lag, rolling mean) gets its neighbours by copying only the rows
  next to a chunk border (``with_halo``): one shuffle, no join;
* an unbounded frame (fill, run length, running total) is finished by a carry from
  one summary row per chunk (``nearest_marks``, ``running_total``).

``pos`` must be dense (0, 1, 2, ... inside a key); ``with_position`` makes it. Rows with a
null key or position are kept, but stand outside every sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from footstats.sources.staging import stage

CHUNK_ROWS = 1 << 18

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE_HERE = (Window.unboundedPreceding, -1)


def chunk_of(pos: Column | str, size: int = CHUNK_ROWS) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def with_position(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "pos",
) -> DataFrame:
    """Dense 0-based position of each row in its key.

    ``bucket`` must not decrease along ``order`` and bounds the rows of one window
    task (a minute of timestamps, a range of ids). The input is read and sorted once: rows
    are staged with their number inside ``(key, bucket)``, and the counts that
    shift these numbers come from two columns of the staged table.
    """
    key = list(key)
    local = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order))
    rows = stage(df.withColumn("_bucket", bucket).withColumn("_local", local), "positions")
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(*_BEFORE_HERE)
    starts = rows.groupBy(*key, "_bucket").agg(F.max("_local").alias("_rows")).select(
        *key, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    return (
        rows.join(starts, [*key, "_bucket"], "left")
        .withColumn(out, F.col("_start") + F.col("_local") - 1)
        .drop("_bucket", "_local", "_start")
    )


def with_global_position(df: DataFrame, order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Dense 0-based rank over the whole table, for an order that has no natural bucket.

    Rows are range partitioned and sorted once and staged in that order with their partition number and their
    place in it; one count for each partition (so a table of bounded size) shifts the places.
    """
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_local", in_part), "ranges")
    before = Window.orderBy("_part").rowsBetween(*_BEFORE_HERE)
    starts = rows.groupBy("_part").agg(F.max("_local").alias("_last")).select(
        "_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_start")
    )
    return rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def with_halo(
    df: DataFrame,
    key: Sequence[str],
    pos: str,
    before: int,
    after: int,
    cols: Callable[[WindowSpec], dict[str, Column]],
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``before`` / ``after`` rows away.

    Rows near a chunk border are copied into the neighbouring chunk, the windows run
    per chunk, and the copies are dropped. ``pos`` may have gaps when the windows are
    range frames over ``pos`` itself.
    """
    wanted_by = F.sequence(
        chunk_of(F.col(pos) - after, size), chunk_of(F.col(pos) + before, size)
    )
    w = Window.partitionBy(*key, "_chunk").orderBy(pos)
    spread = df.withColumn("_chunk", F.explode_outer(wanted_by))
    for name, col in cols(w).items():
        spread = spread.withColumn(name, col)
    return spread.where(F.col("_chunk").eqNullSafe(chunk_of(pos, size))).drop("_chunk")


def nearest_marks(
    df: DataFrame,
    key: Sequence[str],
    pos: str,
    hit: Column,
    payload: Sequence[str] = (),
    before: str = "prev",
    after: str = "next",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the closest marked row at or before, and at or after, each row.

    ``before`` and ``after`` are structs ``(pos, *payload)``, null where there is no
    such row. Also adds ``first_pos`` and ``last_pos`` of the key.
    """
    key = list(key)
    at = F.when(hit, F.col(pos))
    rows = df.withColumn("_chunk", chunk_of(pos, size)).withColumn(
        "_mark", F.when(hit, F.struct(pos, *payload))
    )

    def edge(pick, extreme):
        return F.when(
            extreme(at).isNotNull(),
            F.struct(extreme(at).alias(pos), *[pick(F.col(c), at).alias(c) for c in payload]),
        )

    edges = rows.groupBy(*key, "_chunk").agg(
        edge(F.max_by, F.max).alias("_last"),
        edge(F.min_by, F.min).alias("_first"),
        F.min(pos).alias("_lo"),
        F.max(pos).alias("_hi"),
    )
    by_key = Window.partitionBy(*key)
    forward = by_key.orderBy("_chunk").rowsBetween(*_BEFORE_HERE)
    backward = by_key.orderBy(F.desc("_chunk")).rowsBetween(*_BEFORE_HERE)
    carry = edges.select(
        *key,
        "_chunk",
        F.last("_last", ignorenulls=True).over(forward).alias("_left"),
        F.last("_first", ignorenulls=True).over(backward).alias("_right"),
        F.min("_lo").over(by_key).alias("first_pos"),
        F.max("_hi").over(by_key).alias("last_pos"),
    )
    in_chunk = Window.partitionBy(*key, "_chunk")
    up = in_chunk.orderBy(pos).rowsBetween(*_UP_TO_HERE)
    down = in_chunk.orderBy(F.desc(pos)).rowsBetween(*_UP_TO_HERE)
    return (
        rows.join(carry, [*key, "_chunk"], "left")
        .withColumn(before, F.coalesce(F.last("_mark", ignorenulls=True).over(up), "_left"))
        .withColumn(after, F.coalesce(F.last("_mark", ignorenulls=True).over(down), "_right"))
        .drop("_chunk", "_mark", "_left", "_right")
    )


def spread_over_chunks(
    df: DataFrame,
    key: Sequence[str],
    pos: str,
    aggs: dict[str, tuple[Callable[[Column | str], Column], Column]],
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add per-key aggregates to every row without a join on the (skewed) key.

    ``aggs`` maps an output name to ``(aggregate, input)``; the aggregate must be its
    own merge function (``F.max``, ``F.min``, ``F.sum``). Partial values per chunk are
    merged over the chunks of a key, then joined back on ``(key, chunk)``.
    """
    key = list(key)
    rows = df.withColumn("_chunk", chunk_of(pos, size))
    by_key = Window.partitionBy(*key)
    parts = rows.groupBy(*key, "_chunk").agg(*[f(c).alias(n) for n, (f, c) in aggs.items()])
    merged = parts.select(*key, "_chunk", *[f(n).over(by_key).alias(n) for n, (f, _) in aggs.items()])
    return rows.join(merged, [*key, "_chunk"], "left").drop("_chunk")
