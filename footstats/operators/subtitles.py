"""Clock timeline as subtitle cues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.functions.clock import srt_time
from footstats.vocab import CLOCK_FPS


def subtitle_rows(
    timeline: DataFrame,
    fps: float = CLOCK_FPS,
    raw: str = "direction",
    held: str = "direction_over150frames",
    key: Sequence[str] = ("video",),
) -> DataFrame:
    """One cue per second: ``(key, cue, text)``.

    The first frame of each second is shown, so a fractional ``fps`` works too; the cue
    number follows from the frame because frames are dense.
    """
    frame = F.col("frame")
    second = F.floor(frame / F.lit(fps))
    opens = (frame == 0) | (second != F.floor((frame - 1) / F.lit(fps)))
    shown = lambda c: F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan"))
    state = lambda c: F.when(F.col(c) == 0, "Paused").otherwise("Running")

    def line(caption: str, value: Column) -> Column:
        return F.concat(F.lit(caption), value)

    # Fixed captions of the cue text.
    lines = [
        line("Frame ", frame.cast("string")),
        line("Filename : ", F.col("filename")),
        line("Available : ", F.initcap(F.col("available").cast("string"))),
        line("Raw Text : ", F.col("raw_text")),
        line("Not processed timer : ", shown("time_seconds")),
        line("Processed timer : ", shown("time_seconds_smooth")),
        line("Not processed : ", state(raw)),
        line("Processed : ", state(held)),
    ]
    cue = (second + 1).cast("long")
    span = F.concat(srt_time(second), F.lit(" --> "), srt_time(second + 1))
    text = F.concat(F.concat_ws("\n", cue.cast("string"), span, *lines), F.lit("\n"))
    return timeline.where(opens).select(*key, cue.alias("cue"), text.alias("text"))


def chunk_ids(df: DataFrame, size: int = 480, frame: str = "frame") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(frame) / size).cast("int"))
