"""Clock readings -> gap-free clock -> running / paused flags.

Frames of a video are addressed by a dense ``frame`` position (see
``sequences.with_position``). Every operator works per video, never across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.functions import clock as c
from footstats.operators.sequences import CHUNK_ROWS, nearest_marks, with_halo
from footstats.vocab import CLOCK_FPS, PAUSE_SECONDS


def parse_clock(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``raw_text`` -> ``available, minutes, seconds, time_seconds``.

    ``M:SS`` on the first line with blanks allowed around the parts; anything else,
    and seconds above 59, is not a reading.
    """
    # The text is matched once; an empty group means no match.
    found = df.withColumn("_m", c.clock_part(F.col(text), 1)).withColumn("_s", c.clock_part(F.col(text), 2))
    read = F.col("_m") != ""
    return (
        found.withColumn("available", F.coalesce(read, F.lit(False)))
        .withColumn("minutes", F.when(read, F.col("_m").cast("int")))
        .withColumn("seconds", F.when(read, F.col("_s").cast("int")))
        .withColumn("time_seconds", F.col("minutes") * 60 + F.col("seconds"))
        .drop("_m", "_s")
    )


def fill_clock(
    df: DataFrame,
    fps: int = CLOCK_FPS,
    key: Sequence[str] = ("video",),
    frame: str = "frame",
    value: str = "time_seconds",
    out: str = "time_seconds_filled",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Fill holes of missing readings.

    A hole of n frames between readings ``a`` and ``b`` is held at ``a`` when
    ``n / fps > b - a`` (a countdown always is); otherwise it is interpolated with both
    ends repeated. Holes at the start or the end of a video stay null.
    """
    known = nearest_marks(
        df, key, frame, F.col(value).isNotNull(), [value], "_before", "_after", size
    )
    a, b = F.col(f"_before.{value}").cast("double"), F.col(f"_after.{value}").cast("double")
    holes = F.col(f"_after.{frame}") - F.col(f"_before.{frame}") - 1
    k = F.col(frame) - F.col(f"_before.{frame}") - 1
    return known.withColumn(
        out,
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(F.col("_before").isNull() | F.col("_after").isNull(), F.lit(None))
        .when((holes / fps > b - a) | (holes == 1), a)
        .otherwise(a + (b - a) * k / F.nullif(holes - 1, F.lit(0))),
    ).drop("_before", "_after", "first_pos", "last_pos")


def smooth_clock(
    df: DataFrame,
    window: int = CLOCK_FPS,
    key: Sequence[str] = ("video",),
    frame: str = "frame",
    value: str = "time_seconds_filled",
    out: str = "time_seconds_smooth",
    direction: str = "direction",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Centred rolling mean over ``window`` frames and its direction.

    The mean needs all ``window`` values (else null). ``direction`` is -1 where the mean
    falls from one frame to the next, else 0; differences below 1e-9 are rounding.
    """
    back, ahead = window // 2, window - window // 2 - 1

    def cols(w):
        span = w.rowsBetween(-back, ahead)
        full = F.count(value).over(span) == window
        drop = F.round(F.col(out) - F.lag(out).over(w), 9) < 0
        return {
            out: F.when(full, F.avg(value).over(span)),
            direction: F.when(drop, F.lit(-1)).otherwise(F.lit(0)),
        }

    return with_halo(df, key, frame, back + 1, ahead, cols, size)


def suppress_short_runs(
    df: DataFrame,
    lengths: Sequence[int],
    key: Sequence[str] = ("video",),
    frame: str = "frame",
    flag: str = "direction",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """For each length N add ``<flag>_over<N>frames``: runs of 0 shorter than N become -1.

    All columns start from the same ``flag``; a run may span the border of the video.
    """
    marked = nearest_marks(df, key, frame, F.col(flag) != 0, (), "_before", "_after", size)
    run = (
        F.coalesce(F.col(f"_after.{frame}"), F.col("last_pos") + 1)
        - F.coalesce(F.col(f"_before.{frame}"), F.col("first_pos") - 1)
        - 1
    )
    return marked.select(
        *df.columns,
        *[
            F.when((F.col(flag) == 0) & (run < n), F.lit(-1))
            .otherwise(F.col(flag))
            .alias(f"{flag}_over{n}frames")
            for n in lengths
        ],
    )


def pause_lengths(fps: int = CLOCK_FPS) -> list[int]:
    return [s * fps for s in PAUSE_SECONDS]
