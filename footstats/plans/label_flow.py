"""Annotation export -> clamped and complemented intervals -> per-second labels."""

from pyspark.sql import DataFrame

from footstats.operators.intervals import (
    clamp_intervals,
    complement_intervals,
    discretize,
    intervals_nested,
    load_intervals,
)


def raw_intervals(export: DataFrame, strict: bool = False) -> DataFrame:
    return intervals_nested(complement_intervals(clamp_intervals(load_intervals(export), strict)))


def second_labels(export: DataFrame, step: float = 1) -> DataFrame:
    """One narrow pass: no shuffle between the export and its labels."""
    return discretize(raw_intervals(export), step)
