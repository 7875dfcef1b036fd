"""Phase log -> filled centres -> motion intensity -> major actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from footstats.operators.motion import boost_normalized, fill_gaps_locf, intensity, major_actions, rolling_mean
from footstats.sources.staging import stage


def motion_timeline(log: DataFrame, key: Sequence[str] = ("video",)) -> DataFrame:
    """``(video, frame, cx, cy, …)`` -> filled centre, steps, raw and smoothed intensity.

    Staged twice: before the two-pass fill and before the two-pass scaling.
    """
    centres = stage(log, "motion-centres")
    moves = stage(intensity(fill_gaps_locf(centres, key=key), key), "motion-moves")
    return rolling_mean(boost_normalized(moves, key=key), "intensity_score", "smoothed_intensity", key=key)


def motion_actions(log: DataFrame, key: Sequence[str] = ("video",), **options) -> DataFrame:
    """Major actions of a phase log; the timeline is staged, as limits and peaks read it three times."""
    return major_actions(stage(motion_timeline(log, key), "motion-timeline"), key=key, **options)
