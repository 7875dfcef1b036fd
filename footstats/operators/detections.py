"""Detected boxes per frame.

Long form: one row per box, ``(video, frame, cls, x1, y1, x2, y2, confidence)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.functions import boxes as bx
from footstats.operators.reports import top_k_per_group
from footstats.vocab import CLOCK_FPS, ENTITIES, ENTITY_COLOURS, REFEREE_CLASS, STANDING_HEIGHT

FRAME = ("video", "frame")
_CORNERS = ("x1", "y1", "x2", "y2")

COORDINATES = ("x1", "y1", "x2", "y2")


def _area() -> Column:
    return bx.area(*(F.col(c) for c in _CORNERS))


def box_features(df: DataFrame, names: Sequence[str] = ENTITIES) -> DataFrame:
    """Whole-pixel corners (cut, not rounded), width / height and the class name."""
    whole = df.withColumns({c: F.col(c).cast("int") for c in _CORNERS})
    ratio = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("cls"))
    return whole.withColumn("aspect_ratio", ratio).withColumn("name", name)


def box_to_percent(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Corners -> ``x, y, width, height`` in percent of the image."""
    return df.select(
        *[c for c in df.columns if c not in _CORNERS],
        (F.col("x1") / width * 100).alias("x"),
        (F.col("y1") / height * 100).alias("y"),
        ((F.col("x2") - F.col("x1")) / width * 100).alias("width"),
        ((F.col("y2") - F.col("y1")) / height * 100).alias("height"),
    )


def task_results(
    percent: DataFrame, width: Column, height: Column, from_name: str, to_name: str, box_id: str = "place"
) -> DataFrame:
    """Boxes in percent as the nested result rows an annotation tool imports."""
    return percent.select(
        *[c for c in percent.columns if c not in ("x", "y", "width", "height", "name", "confidence")],
        F.struct(
            F.col(box_id).cast("string").alias("id"),
            F.lit(from_name).alias("from_name"),
            F.lit(to_name).alias("to_name"),
            F.lit("rectanglelabels").alias("type"),
            F.col("confidence").alias("score"),
            width.alias("original_width"),
            height.alias("original_height"),
            F.lit(0).alias("image_rotation"),
            F.struct(
                F.lit(0).alias("rotation"), "x", "y", "width", "height", F.array("name").alias("rectanglelabels")
            ).alias("value"),
        ).alias("result"),
    )


def select_class(df: DataFrame, cls: int = REFEREE_CLASS, confidence: float | None = None) -> DataFrame:
    """Boxes of one class, at least ``confidence`` sure when given."""
    kept = df.where(F.col("cls") == cls)
    return kept if confidence is None else kept.where(F.col("confidence") >= confidence)


def sample_frames(df: DataFrame, every: int = 30, fps: float = CLOCK_FPS, frame: str = "frame") -> DataFrame:
    return df.where(F.col(frame) % every == 0).withColumn("timestamp", F.col(frame) / F.lit(fps))


def top_boxes(df: DataFrame, ties: Sequence[str | Column], k: int = 3, by: Sequence[str] = FRAME) -> DataFrame:
    """The ``k`` largest boxes per image, with their ``rank``."""
    return top_k_per_group(df.withColumn("area", _area()), k, by, [F.desc("area"), *ties], "rank")


def task_score(df: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("confidence").alias("score"), F.count(F.lit(1)).alias("boxes"))


def boxes_per_frame(frames: DataFrame, boxes: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Each frame with its boxes, frames without boxes once with nulls."""
    return frames.join(boxes, list(by), "left")


def frame_phases(
    frames: DataFrame, boxes: DataFrame, by: Sequence[str] = FRAME, threshold: float = STANDING_HEIGHT, keep: str | None = None
) -> DataFrame:
    """Number of boxes, phase and centre of the largest box per frame.

    ``keep`` names a column that also carries the boxes themselves, as text ``[[x1, y1, x2, y2], …]`` in the order of
    ``place`` (``[]`` without boxes): the cell of a phase log that ``primary_centers`` reads. A frame's boxes are few,
    as a detector bounds them.

    Boxes are reduced before they meet the frames; on equal areas the box with the
    smaller ``place`` wins (its order in the detector output).
    """
    by = list(by)
    height = F.col("y2") - F.col("y1")
    # Coordinates last: equal areas and places still have one winner.
    best = F.struct(_area(), -F.col("place"), *[F.col(c) for c in COORDINATES])
    per_frame = boxes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_detections"),
        F.when(F.count(height) == F.count(F.lit(1)), F.avg(height)).alias("_height"),
        F.max_by((F.col("x1") + F.col("x2")) / 2, best).alias("cx"),
        F.max_by((F.col("y1") + F.col("y2")) / 2, best).alias("cy"),
        *([F.array_sort(F.collect_list(F.struct("place", *COORDINATES))).alias("_boxes")] if keep else []),
    )
    lists = F.transform("_boxes", lambda b: F.array(*[b[c].cast("double") for c in COORDINATES])) if keep else None
    kept = [F.coalesce(F.to_json(lists), F.lit("[]")).alias(keep)] if keep else []
    n = F.coalesce("n_detections", F.lit(0).cast("long"))
    return frames.join(per_frame, by, "left").select(
        *frames.columns, n.alias("n_detections"), bx.phase(n, F.col("_height"), threshold).alias("phase"), "cx", "cy", *kept
    )


def classify_phase(df: DataFrame, boxes: str = "boxes", threshold: float = STANDING_HEIGHT) -> DataFrame:
    """The same for frames that carry their boxes as an array: ``n_detections, phase, cx, cy``."""
    n = F.coalesce(F.size(boxes), F.lit(0))
    # Separate steps, so that the folds over the boxes run once per row.
    folded = df.withColumn("_height", bx.mean_height(F.col(boxes))).withColumn(
        "_center", bx.primary_center(F.col(boxes))
    )
    return folded.select(
        *df.columns,
        n.cast("long").alias("n_detections"),
        bx.phase(n, F.col("_height"), threshold).alias("phase"),
        F.col("_center.cx").alias("cx"),
        F.col("_center.cy").alias("cy"),
    )


def primary_centers(df: DataFrame, cell: str) -> DataFrame:
    """Box lists as text (a CSV cell) -> ``cx, cy`` of the largest box."""
    parsed = df.withColumn("_boxes", bx.parse_boxes(F.col(cell)))
    found = parsed.withColumn("_center", bx.primary_center(F.col("_boxes")))
    return found.select(*df.columns, F.col("_center.cx").alias("cx"), F.col("_center.cy").alias("cy"))


def coalesce_keys(df: DataFrame) -> DataFrame:
    """Videos of a project manifest: the first filled path key, and a name for it.

    Entries without any path are dropped; the name defaults to the file name.
    """
    filled = lambda *names: F.coalesce(
        *[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string")
    )
    path = filled("video", "video_path", "path")
    name = F.coalesce(filled("video_name", "name"), F.element_at(F.split(path, "/"), -1))
    return df.select(path.alias("video_path"), name.alias("video_name")).where(F.col("video_path").isNotNull())


def nearest_centroid_vote(
    pixels: DataFrame,
    by: Sequence[str] = ("box_id",),
    centroids: Mapping[str, tuple[int, int, int]] = ENTITY_COLOURS,
) -> DataFrame:
    """The colour most pixels of a box are nearest to; the earlier centroid wins ties."""

    def distance(c):
        return sum(((F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v)) for x, v in zip("rgb", c)), F.lit(0))

    options = [F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids.values())]
    nearest = F.array_min(F.array(*options))["i"]
    names = F.array(*[F.lit(n) for n in centroids])
    counts = pixels.groupBy(*by, nearest.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct(F.col("_n").alias("n"), (-F.col("_i")).alias("i"))).alias("_b")
    return counts.groupBy(*by).agg(best).select(
        *by, F.get(names, -F.col("_b.i")).alias("label"), F.col("_b.n").alias("votes")
    )


def bad_class_files(lines: DataFrame, cls: str = "3") -> DataFrame:
    """Label files with an unexpected class, one row per offending line ``(file, line)``."""
    return lines.where(F.col("cls") == cls).select("file", "line")
