"""Scoreboard-clock text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: one or two digits, colon, two digits up to 59, on the first line.
CLOCK_PATTERN = r"^\s*(\d{1,2})[^\S\n]*:[^\S\n]*([0-5]\d)[^\S\n]*(\n|$)"


def clock_part(text: Column, group: int) -> Column:
    """Minutes (1) or seconds (2) as text; empty when the text is no clock reading."""
    return F.regexp_extract(text, CLOCK_PATTERN, group)


def srt_time(seconds: Column) -> Column:
    """Whole seconds as the ``HH:MM:SS,000`` of a subtitle cue (hours wrap at a day)."""
    s = seconds.cast("long")
    return F.format_string(
        "%02d:%02d:%02d,000",
        F.pmod(F.floor(s / 3600), F.lit(24)),
        F.pmod(F.floor(s / 60), F.lit(60)),
        F.pmod(s, F.lit(60)),
    )
