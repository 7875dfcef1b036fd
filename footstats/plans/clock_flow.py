"""Clock readings -> timeline -> matches -> rest ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.operators.clock import (
    fill_clock,
    parse_clock,
    pause_lengths,
    smooth_clock,
    suppress_short_runs,
)
from footstats.operators.matches import frame_runs, segment_runs
from footstats.operators.sequences import CHUNK_ROWS
from footstats.sources.staging import stage
from footstats.vocab import CLOCK_FPS, MATCH_PAUSE_SECONDS


def smoothed_clock(readings: DataFrame, fps: int = CLOCK_FPS, key: Sequence[str] = ("video",)) -> DataFrame:
    """``(key, frame, raw_text, ...)`` with dense frames -> parsed, filled and smoothed clock.

    The readings are scanned twice (fill carries, then fill); parsing is row-local.
    """
    return smooth_clock(fill_clock(parse_clock(readings), fps, key), fps, key)


def clock_timeline(readings: DataFrame, fps: int = CLOCK_FPS, key: Sequence[str] = ("video",)) -> DataFrame:
    """The full timeline with one pause column per length (3, 5, 10 and 15 s)."""
    smoothed = stage(smoothed_clock(readings, fps, key), "clock-smooth")
    return suppress_short_runs(smoothed, pause_lengths(fps), key)


def running_flags(timeline: DataFrame, column: str, key: Sequence[str] = ("video",)) -> DataFrame:
    return timeline.select(*key, "frame", (F.col(column) != 0).cast("int").alias("running"))


def clock_matches(
    readings: DataFrame,
    fps: int = CLOCK_FPS,
    pause_seconds: int = MATCH_PAUSE_SECONDS,
    hold_seconds: int = 5,
    key: Sequence[str] = ("video",),
    cumulative_pause: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(runs, segments) of all videos: runs of running (1) and paused (0) frames are staged and feed ``run_ratios``, too."""
    smoothed = stage(smoothed_clock(readings, fps, key), "clock-smooth")
    held = hold_seconds * fps
    flags = running_flags(suppress_short_runs(smoothed, [held], key), f"direction_over{held}frames", key)
    runs = stage(frame_runs(flags, key, size=4 * CHUNK_ROWS), "match-runs")
    return runs, segment_runs(runs, pause_seconds * fps, key, cumulative_pause)
