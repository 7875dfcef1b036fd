"""Box centres -> motion intensity -> major actions, per video.

``frame`` is dense per video; all windows run per chunk (see ``sequences``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.operators.quantiles import exact_quantile
from footstats.operators.sequences import (
    CHUNK_ROWS,
    chunk_of,
    nearest_marks,
    spread_over_chunks,
    with_halo,
    with_position,
)
from footstats.vocab import MOTION_WINDOW, PEAK_QUANTILE, PEAK_STEP

VIDEO = ("video",)


def fill_gaps_locf(
    df: DataFrame,
    cols: Sequence[str] = ("cx", "cy"),
    key: Sequence[str] = VIDEO,
    frame: str = "frame",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Last known value, before the first one the first, and 0 for a video without any.

    The columns are known or missing together, as the parts of a centre are.
    """
    marked = nearest_marks(df, key, frame, F.col(cols[0]).isNotNull(), cols, "_before", "_after", size)
    filled = {c: F.coalesce(F.col(f"_before.{c}"), F.col(f"_after.{c}"), F.lit(0.0)).alias(c) for c in cols}
    return marked.select(*[filled.get(c, F.col(c)) for c in df.columns])


def diff(
    df: DataFrame, col: str, out: str, key: Sequence[str] = VIDEO, frame: str = "frame",
    first: float | None = None, size: int = CHUNK_ROWS,
) -> DataFrame:
    """Difference to the previous row; null (or ``first``) on the first row of a key."""

    def cols(w):
        step = F.col(col) - F.lag(col).over(w)
        return {out: step if first is None else F.coalesce(step, F.lit(first))}

    return with_halo(df, key, frame, 1, 0, cols, size)


def intensity(
    df: DataFrame, key: Sequence[str] = VIDEO, frame: str = "frame", size: int = CHUNK_ROWS
) -> DataFrame:
    """Length of the move of ``(cx, cy)`` since the previous frame; 0 on the first one."""

    def cols(w):
        step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
        return {"dx": step("cx"), "dy": step("cy")}

    moved = with_halo(df, key, frame, 1, 0, cols, size)
    return moved.withColumn(
        "intensity_score", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    )


def boost_normalized(
    df: DataFrame, col: str = "intensity_score", factor: float = 1000,
    key: Sequence[str] = VIDEO, frame: str = "frame", size: int = CHUNK_ROWS,
) -> DataFrame:
    """Scale a video whose largest value lies between 0 and 1 (coordinates in image units)."""
    peaked = spread_over_chunks(df, key, frame, {"_max": (F.max, F.col(col))}, size)
    scale = F.when((F.col("_max") > 0) & (F.col("_max") < 1), F.lit(float(factor))).otherwise(1.0)
    return peaked.withColumn(col, F.col(col) * scale).drop("_max")


def rolling_mean(
    df: DataFrame, col: str, out: str, window: int = MOTION_WINDOW,
    key: Sequence[str] = VIDEO, frame: str = "frame", size: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean of the last ``window`` rows, of fewer at the start."""
    span = lambda w: w.rowsBetween(1 - window, 0)
    return with_halo(df, key, frame, window - 1, 0, lambda w: {out: F.avg(col).over(span(w))}, size)


def major_actions(
    df: DataFrame, col: str = "smoothed_intensity", q: float = PEAK_QUANTILE, step: int = PEAK_STEP,
    key: Sequence[str] = VIDEO, frame: str = "frame", size: int = CHUNK_ROWS,
) -> DataFrame:
    """Every ``step``-th of the rows above the ``q`` quantile of their video (if it is positive).

    Three scans of ``df``: counts, values around the limit, peaks. A limit goes to each chunk of its video, so a long video stays split.
    """
    limits = exact_quantile(df, col, q, key, "threshold", extent=frame).where(F.col("threshold") > 0)
    chunks = F.sequence(chunk_of(f"{frame}_first", size), chunk_of(f"{frame}_last", size))
    limits = limits.withColumn("_chunk", F.explode(chunks)).drop(f"{frame}_first", f"{frame}_last")
    peaks = df.withColumn("_chunk", chunk_of(frame, size)).join(limits, [*key, "_chunk"]).where(F.col(col) > F.col("threshold")).drop("_chunk")
    numbered = with_position(peaks, key, [frame], chunk_of(frame, size), "_n")
    return numbered.where(F.col("_n") % step == 0).drop("_n")
