"""Match segmentation over runs of running and paused frames, and rest ratios.

A running frame opens a match if none is open. Paused frames are counted since the last
closed match (running frames do not reset the count, pauses before the match count
too); the paused frame that takes the count above the limit closes the open match,
exclusive. A match still open at the end of a video is dropped.

Frames are first reduced to runs of equal flags inside chunks of a video. Segmentation
carries a state (open?, paused count up to the limit), so a chunk is a function from entry
state to exit state; such functions compose. With several chunks they are joined by a
prefix scan: groups of ``FAN`` neighbours are composed level by level, the entry states
are handed down the same levels, and every chunk is replayed from its own. No step holds
more than one chunk's runs or ``FAN`` functions of a video.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.operators.sequences import CHUNK_ROWS, chunk_of
from footstats.sources.staging import stage

#: Neighbours whose functions are composed in one step of the scan.
FAN = 64
_NOT_OPEN, _AS_ENTERED = -1, -2


def frame_runs(
    flags: DataFrame, key: Sequence[str] = ("video",), frame: str = "frame", flag: str = "running", size: int = CHUNK_ROWS
) -> DataFrame:
    """(key, chunk, start, frames, flag): stretches of consecutive frames with one flag, cut at chunk borders.

    A missing or repeated frame number ends a stretch, so its frames are ``start`` to ``start + frames - 1``.
    """
    w = Window.partitionBy(*key, "chunk").orderBy("_frame")
    rows = flags.select(*key, F.col(frame).cast("long").alias("_frame"), F.col(flag).alias("flag")).withColumn("chunk", chunk_of("_frame", size))
    goes_on = F.col("flag").eqNullSafe(F.lag("flag").over(w)) & F.coalesce(F.lag("_frame").over(w) == F.col("_frame") - 1, F.lit(False))
    numbered = rows.withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(*key, "chunk", "_run").agg(
        F.min("_frame").alias("start"), F.count(F.lit(1)).alias("frames"), F.first("flag").alias("flag")
    ).drop("_run")


class _Chunk:
    """Runs of one chunk. Its paused frames have ordinals 0, 1, 2 ...; a running run stands before one of them."""

    def __init__(self, runs: pd.DataFrame, limit: int, cumulative: bool):
        runs = runs.sort_values("start", kind="stable")
        start, frames = runs["start"].to_numpy(), runs["frames"].to_numpy()
        paused = runs["flag"].to_numpy() == 0
        before = np.cumsum(np.where(paused, frames, 0)) - np.where(paused, frames, 0)
        self.limit, self.cumulative, self.total = limit, cumulative, int(frames[paused].sum())
        # With an end mark behind the last running run.
        self.opens, self.opens_before = np.append(start[~paused], _NOT_OPEN), np.append(before[~paused], self.total)
        self.pause_start, self.pause_before = start[paused], before[paused]
        # Unbroken pauses lie between neighbouring running runs; the first may go on from the chunk before.
        edges = np.unique(np.concatenate([[0], self.opens_before, [self.total]]))
        self.long_pauses = np.append(edges[:-1][np.diff(edges) > limit], self.total)

    def frame_of(self, ordinal):
        run = np.searchsorted(self.pause_before, ordinal, side="right") - 1
        return self.pause_start[run] + ordinal - self.pause_before[run]

    def closing(self, run, seen):
        """Ordinal of the paused frame that closes a match opened by running run ``run`` (-1: before the chunk); ``total`` or more if none does."""
        carried = run < 0
        base = np.where(carried, 0 if self.cumulative else self.opens_before[0], self.opens_before[run])
        if self.cumulative:
            return np.maximum(seen + self.limit, base)
        later = self.long_pauses[np.searchsorted(self.long_pauses, base)] + self.limit
        return np.where(carried & (self.opens_before[0] > seen + self.limit), seen + self.limit, later)

    def follow(self, is_open, count, entry_start):
        """Run all entry states at once: (exit start frame or mark, exit count, [(states, start, end)] of closed matches)."""
        n = len(count)
        run = np.where(is_open, -1, np.searchsorted(self.opens_before[:-1], 0))
        start = np.where(is_open, entry_start, self.opens[run])
        seen, live, closed = -np.asarray(count), np.arange(n), []
        exit_start, exit_count = np.full(n, _NOT_OPEN, dtype=np.int64), np.zeros(n, dtype=np.int64)
        while len(live):
            end = self.closing(run[live], seen[live])
            stays = (start[live] == _NOT_OPEN) | (end >= self.total)
            done = live[stays]
            exit_start[done] = start[done]
            exit_count[done] = np.minimum(self.total - seen[done], self.limit)
            live, end = live[~stays], end[~stays]
            if len(live):
                closed.append((live, start[live], self.frame_of(end)))
            seen[live] = end + 1
            run[live] = np.searchsorted(self.opens_before[:-1], end + 1)
            start[live] = self.opens[run[live]]
        if not self.cumulative and len(self.opens) > 1:  # the last running run has set the count back
            exit_count[:] = min(self.total - int(self.opens_before[-2]), self.limit)
        elif not self.cumulative:
            exit_count[:] = np.minimum(self.total + np.asarray(count), self.limit)
        return exit_start, exit_count, closed


def _scanned_entries(tables: DataFrame, key: list[str], key_ddl: str, limit: int, top: int) -> DataFrame:
    """(key, chunk, entry_start, entry_count) from the functions (key, chunk, state, start) of all chunks, numbered 0 to ``top``."""
    k, opened = len(key), np.repeat([False, True], limit + 1)

    def compose(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        state, start = np.arange(2 * (limit + 1)), np.where(opened, _AS_ENTERED, _NOT_OPEN)
        part = part.sort_values("chunk")
        for to, began in zip(part["state"], part["start"]):
            start = np.where(began[state] == _AS_ENTERED, start, began[state])
            state = to[state]
        return pd.DataFrame([[*group, state.astype("int32"), start]])

    def hand_down(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("chunk"), []
        start, count = int(part["entry_start"].iloc[0]), int(part["entry_count"].iloc[0])
        for chunk, to, began in zip(part["chunk"], part["state"], part["start"]):
            out.append([*group[:k], chunk, start, count])
            at = (limit + 1 if start != _NOT_OPEN else 0) + count
            start = start if began[at] == _AS_ENTERED else int(began[at])
            count = int(to[at]) % (limit + 1)
        return pd.DataFrame(out)

    above = F.floor(F.col("chunk") / FAN)
    levels = [tables]
    while top > 0:
        levels.append(levels[-1].groupBy(*key, above.alias("chunk")).applyInPandas(compose, f"{key_ddl}, chunk long, state array<int>, start array<long>"))
        top //= FAN
    entries = levels[-1].select(*key, "chunk", F.lit(_NOT_OPEN).cast("long").alias("entry_start"), F.lit(0).cast("long").alias("entry_count"))
    for children in reversed(levels[:-1]):
        parents = entries.withColumnRenamed("chunk", "_group")
        entries = children.withColumn("_group", above).join(parents, [*key, "_group"]).groupBy(*key, "_group").applyInPandas(
            hand_down, f"{key_ddl}, chunk long, entry_start long, entry_count long"
        )
    return entries


def paused_or_running(running: str = "running") -> Column:
    """0 or 1; a null flag is a pause."""
    return (F.coalesce(F.col(running).cast("int"), F.lit(0)) != 0).cast("int")


def segment_matches(
    flags: DataFrame,
    max_pause: int,
    key: Sequence[str] = ("video",),
    frame: str = "frame",
    running: str = "running",
    cumulative_pause: bool = True,
    size: int = CHUNK_ROWS * 4,
) -> DataFrame:
    """``(key, frame, running)`` -> ``(key, start_frame, end_frame)``, end exclusive; see ``segment_runs``.

    A null flag is a pause. The runs are staged: their number is that of changes of the flag, not of frames.
    """
    runs = frame_runs(flags.select(*key, frame, paused_or_running(running).alias("running")), key, frame, "running", size)
    return segment_runs(stage(runs, "match-runs"), max_pause, key, cumulative_pause)


def segment_runs(runs: DataFrame, max_pause: int, key: Sequence[str] = ("video",), cumulative_pause: bool = True) -> DataFrame:
    """Staged ``frame_runs`` of 0 and 1 -> ``(key, start_frame, end_frame)``, end exclusive.

    ``max_pause`` counts frames. With ``cumulative_pause=False`` a running frame resets the count: only an
    unbroken pause longer than the limit closes a match. Up to three steps read the runs.
    """
    key, limit = list(key), int(max_pause)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema if f.name in key)
    k = len(key)
    first, last = runs.agg(F.min("chunk"), F.max("chunk")).first()
    runs = runs.withColumn("chunk", F.col("chunk") - (first or 0))

    def transfer(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        is_open, count = np.repeat([False, True], limit + 1), np.tile(np.arange(limit + 1), 2)
        start, paused, _ = _Chunk(part, limit, cumulative_pause).follow(is_open, count, _AS_ENTERED)
        return pd.DataFrame([[*group, (np.where(start != _NOT_OPEN, limit + 1, 0) + paused).astype("int32"), start]])

    def replay(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start, count = int(part["entry_start"].iloc[0]), int(part["entry_count"].iloc[0])
        _, _, closed = _Chunk(part, limit, cumulative_pause).follow(np.array([start != _NOT_OPEN]), np.array([count]), start)
        return pd.DataFrame([[*group[:k], s[0], e[0]] for _, s, e in closed], columns=range(k + 2))

    if last == first:  # no video goes beyond one chunk
        entered = runs.withColumn("entry_start", F.lit(_NOT_OPEN).cast("long")).withColumn("entry_count", F.lit(0).cast("long"))
    else:
        tables = stage(runs.groupBy(*key, "chunk").applyInPandas(transfer, f"{key_ddl}, chunk long, state array<int>, start array<long>"), "match-functions")
        entered = runs.join(_scanned_entries(tables, key, key_ddl, limit, last - first), [*key, "chunk"])
    return entered.groupBy(*key, "chunk").applyInPandas(replay, f"{key_ddl}, start_frame long, end_frame long")


def rest_ratios(
    flags: DataFrame,
    segments: DataFrame,
    key: Sequence[str] = ("video",),
    frame: str = "frame",
    running: str = "running",
    width: int = 4096,
) -> DataFrame:
    """Paused and running frames of each match, and their shares; null flags count for neither. See ``run_ratios``."""
    return run_ratios(frame_runs(flags, key, frame, running, width), segments, key, width)


def run_ratios(runs: DataFrame, segments: DataFrame, key: Sequence[str] = ("video",), width: int = 4096) -> DataFrame:
    """The same from ``frame_runs``, whatever chunks they were cut at.

    Runs and matches meet on ``(key, range of frames)``, both cut at the borders of ranges, so neither a long video nor a
    long match is compared as a whole; segments of a video do not overlap.
    """
    key = list(key)

    def ranges(first: str, end: Column):
        return F.explode(F.sequence(chunk_of(first, width), chunk_of(end - 1, width)))

    cut = runs.withColumn("_end", F.col("start") + F.col("frames")).withColumn("_range", ranges("start", F.col("_end")))
    pieces = segments.withColumn("_range", ranges("start_frame", F.col("end_frame")))
    border = F.col("_range") * width
    shared = F.least("_end", "end_frame", border + width) - F.greatest("start", "start_frame", border)
    inside = cut.join(pieces, [*key, "_range"]).withColumn("_shared", shared).where("_shared > 0")
    counts = inside.groupBy(*key, "start_frame", "end_frame").agg(
        F.sum(F.when(F.col("flag") == 0, F.col("_shared")).otherwise(0)).alias("count_zero"),
        F.sum(F.when(F.col("flag") != 0, F.col("_shared")).otherwise(0)).alias("count_not_zero"),
    )
    total = F.col("count_zero") + F.col("count_not_zero")
    return counts.withColumn("zero_ratio", F.col("count_zero") / total).withColumn(
        "not_zero_ratio", F.col("count_not_zero") / total
    )


def mean_rest_ratio(ratios: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted means over matches."""
    return ratios.groupBy(*by).agg(
        F.avg("zero_ratio").alias("mean_zero_ratio"),
        F.avg("not_zero_ratio").alias("mean_not_zero_ratio"),
        F.count(F.lit(1)).alias("matches"),
    )
