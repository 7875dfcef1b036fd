"""Bounding boxes: ``struct<x1, y1, x2, y2>`` or an array of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from footstats.vocab import (
    PHASE_GROUND,
    PHASE_NONE,
    PHASE_STANDING,
    PHASE_UNKNOWN,
    STANDING_HEIGHT,
)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def phase(n: Column, mean_height: Column, threshold: float = STANDING_HEIGHT) -> Column:
    """Fewer than two boxes: no match; else standing above the height threshold, groundwork below."""
    return (
        F.when(n < 2, PHASE_NONE)
        .when(mean_height.isNull(), PHASE_UNKNOWN)
        .when(mean_height > threshold, PHASE_STANDING)
        .otherwise(PHASE_GROUND)
    )


def mean_height(boxes: Column) -> Column:
    """Null for an empty list and when any box lacks a height."""
    total = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + (b["y2"] - b["y1"]).cast("double"))
    return F.try_divide(total, F.size(boxes))


def primary_center(boxes: Column) -> Column:
    """Largest box as ``struct<area, place, cx, cy>``, the first one on ties; null without boxes."""
    ranked = F.transform(
        boxes,
        lambda b, i: F.struct(
            area(b["x1"], b["y1"], b["x2"], b["y2"]).alias("area"),
            (-i).alias("place"),
            ((b["x1"] + b["x2"]) / 2).alias("cx"),
            ((b["y1"] + b["y2"]) / 2).alias("cy"),
        ),
    )
    return F.array_max(ranked)


def parse_boxes(text: Column) -> Column:
    """``[[x1, y1, x2, y2], …]`` as text (a CSV cell); a bare count or broken text gives null."""
    lists = F.from_json(text, "array<array<double>>")
    at = lambda b, i: F.get(b, F.lit(i))
    return F.transform(
        lists,
        lambda b: F.struct(
            at(b, 0).alias("x1"), at(b, 1).alias("y1"), at(b, 2).alias("x2"), at(b, 3).alias("y2")
        ),
    )
