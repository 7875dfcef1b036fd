"""Work plans: which stretch of which recording goes into which output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.operators.sequences import with_global_position

#: Clips that travel as one row, and clips that one task lists.
STRETCH_CLIPS, TASK_CLIPS = 4096, 1_000_000


def batch_plan(
    videos: DataFrame,
    offset: int = 0,
    duration: int = 60,
    rate: int = 1,
    batch: int = 600,
    prefix: str = "mat",
    unit: str = "batch",
) -> DataFrame:
    """Frame batches of every video: ``path, seq_id, offset, duration, prefix``.

    Videos are numbered from 1 in path order; a tail shorter than ``batch`` is left out.
    ``offset`` and ``duration`` step by ``batch`` itself; with ``unit="seconds"`` they step
    by the seconds a batch lasts, which differs when ``rate`` is not 1.
    """
    frames = duration * rate
    if batch > frames:
        raise ValueError(f"batch of {batch} exceeds the {frames} frames of a recording")
    step = F.lit(batch) if unit == "batch" else F.lit(batch) / F.lit(rate)
    numbered = with_global_position(videos.select("path"), ["path"], "_i")
    steps = F.sequence(F.lit(0), F.lit(frames // batch - 1))
    return numbered.select("path", "_i", F.explode(steps).alias("seq_id")).select(
        "path",
        "seq_id",
        (F.lit(offset) + F.col("seq_id") * step).alias("offset"),
        step.alias("duration"),
        F.format_string("%s_%02d/%04d", F.lit(prefix), F.col("_i") + 1, "seq_id").alias("prefix"),
    )


def clip_plan(
    videos: DataFrame, duration: int = 600, offset: int = 0, stretch: int = STRETCH_CLIPS, rows: int = TASK_CLIPS
) -> DataFrame:
    """Clips of ``(path, total_seconds)``: ``path, clip, start, duration, name``.

    At least one clip per video; clips that would begin past the end are left out.
    A short table can stand for very many clips, so they are counted first: beyond ``rows`` of them, stretches of at most
    ``stretch`` clips are dealt to tasks of about ``rows`` each, and a long recording to several.
    """
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total_seconds") / duration))
    first = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(stretch).cast("long"))
    stretches = videos.select("path", "total_seconds", F.explode(first).alias("_first"))
    tasks = -(-(videos.agg(F.sum(n)).first()[0] or 0) // rows)
    if tasks > 1:
        stretches = stretches.repartition(tasks)
    clips = F.sequence(F.col("_first"), F.least(F.col("_first") + stretch, n) - 1)
    digits = F.col("clip").cast("string")
    return (
        stretches.select("path", "total_seconds", F.explode(clips).alias("clip"))
        .withColumn("start", F.lit(offset) + F.col("clip") * duration)
        .where(F.col("start") < F.col("total_seconds"))
        .select(
            "path", "clip", "start", F.lit(duration).alias("duration"),
            # As %04d, without a call of the formatter for each clip.
            F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), "0"), F.lit(".mp4")).alias("name"),
        )
    )
