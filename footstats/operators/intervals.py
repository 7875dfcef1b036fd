"""Annotation export -> interval lists -> per-second labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.functions import intervals as iv
from footstats.functions.paths import url_tail
from footstats.vocab import CLIP_SECONDS, COMPLEMENT_LABELS, INTERVAL_LABELS

_LISTS = ["matches", "actives", "standings"]
_GAP_LISTS = ["not_matches", "not_actives", "not_standings"]


#: Points of a piece of a recording, level by level.
PIECE_POINTS = (1 << 12, 1 << 6)

def load_intervals(export: DataFrame) -> DataFrame:
    """Export tasks -> ``file`` and one interval list per label, in annotation order.

    Only the first annotation of a task and the first label of a result count; a task
    without annotations gives no row.
    """
    results = F.coalesce(F.get("annotations", F.lit(0))["result"], F.array())

    def of(label: str) -> Column:
        hits = F.filter(results, lambda r: F.get(r["value"]["labels"], F.lit(0)) == label)
        return F.transform(hits, lambda r: iv.interval(r["value"]["start"], r["value"]["end"]))

    return export.where(F.size("annotations") > 0).select(
        url_tail(F.col("data.video_url"), 4).alias("file"),
        *[of(label).alias(name) for label, name in zip(INTERVAL_LABELS, _LISTS)],
    )


def clamp_intervals(lists: DataFrame, strict: bool = False) -> DataFrame:
    """Active is cut at Match, then Standing at the already cut Active."""
    return lists.withColumn("actives", iv.clamp(F.col("actives"), F.col("matches"), strict)).withColumn(
        "standings", iv.clamp(F.col("standings"), F.col("actives"), strict)
    )


def complement_intervals(lists: DataFrame, clip_seconds: float = CLIP_SECONDS) -> DataFrame:
    """Add the gaps: of Active in each Match, of Standing in each Active, of Match in the clip."""

    def gaps(parents: str, children: str) -> Column:
        # First the children of each parent, then the gaps: each list is built once.
        inside = F.transform(
            parents,
            lambda p: F.struct(
                p["start"].alias("start"),
                p["end"].alias("end"),
                F.sort_array(iv.contained(F.col(children), p["start"], p["end"])).alias("inside"),
            ),
        )
        return F.flatten(F.transform(inside, lambda x: iv.gaps_between(x["start"], x["end"], x["inside"])))

    return (
        lists.withColumn("not_actives", gaps("matches", "actives"))
        .withColumn("not_standings", gaps("actives", "standings"))
        .withColumn(
            "not_matches", iv.complement(F.lit(0.0), F.lit(float(clip_seconds)), F.col("matches"))
        )
    )


def intervals_nested(lists: DataFrame) -> DataFrame:
    """All six kinds as ``(file, annotations array<struct<labels, start, end>>)``."""
    kinds = [*zip(INTERVAL_LABELS, _LISTS), *zip(COMPLEMENT_LABELS, _GAP_LISTS)]
    tagged = [tag_intervals(name, label) for label, name in kinds]
    return lists.select("file", F.concat(*tagged).alias("annotations"))


def tag_intervals(name: str, label: str) -> Column:
    return F.transform(
        name,
        lambda i: F.struct(
            F.lit(label).alias("labels"), i["start"].alias("start"), i["end"].alias("end")
        ),
    )


def intervals_long(nested: DataFrame) -> DataFrame:
    """``(file, annotations)`` -> one row ``(file, label, start, end)`` per interval.

    The outer form keeps Spark from repeating the whole list expression in a "not empty"
    filter below the explode; the filter on the exploded row drops empty lists instead.
    """
    return (
        nested.select("file", F.explode_outer("annotations").alias("a"))
        .where(F.col("a").isNotNull())
        .select("file", F.col("a.labels").alias("label"), "a.start", "a.end")
    )


def file_bounds(long: DataFrame) -> DataFrame:
    return long.groupBy("file").agg(F.min("start").alias("min_start"), F.max("end").alias("max_end"))


def recording_points(bounds: DataFrame, step: float = 5) -> DataFrame:
    """``(…, min_start, max_end)`` -> points ``time`` and ``next_time``; the last may be shorter."""
    n = F.ceil((F.col("max_end") - F.col("min_start")) / F.lit(step))
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    return (
        bounds.withColumn("_i", F.explode(steps))
        .withColumn("time", F.col("min_start") + F.col("_i") * F.lit(step))
        .withColumn("next_time", F.least(F.col("min_start") + (F.col("_i") + 1) * F.lit(step), "max_end"))
        .drop("_i", "min_start", "max_end")
    )


def _cut_pieces(rows: DataFrame, width: int, step: float) -> DataFrame:
    """Rows of points (``_first``, ``_n``) cut into pieces of ``width`` points with the intervals that may cover one of them."""
    # No filter for rows without points: below the explode it would compute their lists once more.
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / width))
    piece = F.explode(F.when(F.col("_n") > 0, pieces).otherwise(F.array().cast("array<long>")))
    cut = rows.withColumn("_whole", F.col("_n") <= width).withColumn("_piece", piece).withColumn(
        "_n", F.least(F.lit(width).cast("long"), F.col("_n") - F.col("_piece") * width)
    ).withColumn("_first", F.col("_first") + F.col("_piece") * width)
    last = F.col("min_start") + (F.col("_first") + F.col("_n") - 1) * F.lit(step)
    first_end = F.least(F.col("min_start") + (F.col("_first") + 1) * F.lit(step), "max_end")
    reaching = F.filter("annotations", lambda a: (a["start"] <= last) & (a["end"] >= first_end))
    return cut.withColumn("annotations", F.when(F.col("_whole"), F.col("annotations")).otherwise(reaching)).drop("_whole", "_piece")


def discretize(nested: DataFrame, step: float = 5) -> DataFrame:
    """``(file, annotations)`` -> ``(file, time, is_match, is_active, is_standing)``.

    A point is 1 when one single interval of the label covers it up to the next point;
    two adjacent intervals do not add up. ``time`` is double (starts may be fractional). Points of a long recording
    are cut into pieces, and these into smaller ones; each takes along only the intervals that reach
    into it, so no point is compared with all intervals.
    """
    lowest = F.array_min(F.transform("annotations", lambda a: a["start"]))
    highest = F.array_max(F.transform("annotations", lambda a: a["end"]))
    rows = nested.select("file", "annotations", lowest.alias("min_start"), highest.alias("max_end"))
    rows = rows.withColumn("_first", F.lit(0).cast("long")).withColumn("_n", F.ceil((F.col("max_end") - F.col("min_start")) / F.lit(step)))
    for width in PIECE_POINTS:
        rows = _cut_pieces(rows, width, step)
    at = lambda i: F.col("min_start") + i * F.lit(step)
    points = rows.withColumn("_i", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))).select(
        "file", "annotations", at(F.col("_i")).alias("time"), F.least(at(F.col("_i") + 1), "max_end").alias("next_time")
    )

    def covered(label: str) -> Column:
        return F.exists(
            "annotations",
            lambda a: (a["labels"] == label) & (a["start"] <= F.col("time")) & (a["end"] >= F.col("next_time")),
        ).cast("int")

    return points.select("file", "time", *[covered(l).alias(f"is_{l.lower()}") for l in INTERVAL_LABELS])


def _on_level(cells: Column, level: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))


def interval_cells(first: Column, last: Column, levels: int, fan: int) -> Column:
    """array<struct<level, cell>> that together are the base cells ``first`` to ``last``, each once.

    A cell of level k holds ``fan`` cells of level k - 1. At both ends less than ``fan`` cells of a level stand out of those
    of the next; only the top level may have more, so the number grows with the logarithm of the length.
    """
    from_ = [F.ceil(first / fan**k) for k in range(levels)]
    to = [F.floor((last + 1) / fan**k) - 1 for k in range(levels)]
    none = F.array().cast("array<long>")

    def run(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    cells = []
    for k in range(levels):
        mine = run(from_[k], to[k])
        if k + 1 < levels:
            ends = F.concat(run(from_[k], fan * from_[k + 1] - 1), run(fan * (to[k + 1] + 1), to[k]))
            mine = F.when(from_[k + 1] <= to[k + 1], ends).otherwise(mine)
        cells.append(_on_level(mine, k))
    return F.concat(*cells)


def join_covering(
    points: DataFrame, intervals: DataFrame, key: Sequence[str] = ("file",), width: float = 64, levels: int = 4, fan: int = 8
) -> DataFrame:
    """Pairs of a point ``[time, next_time]`` and an interval of the same key that covers it.

    Points and intervals meet in a hierarchy of stretches of time, of ``width``, ``width * fan``, … : an interval is copied to
    the few stretches it consists of, a point to its stretch on each level, and of an interval's stretches one
    holds the point, so pairs come out once. An interval of hours makes some dozen rows.
    """
    base = lambda c: F.floor(F.col(c) / F.lit(width))
    spread = intervals.withColumn("_at", F.explode(interval_cells(base("start"), base("end"), levels, fan)))
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(base("time") / fan**k).alias("cell")) for k in range(levels)])
    return (
        points.withColumn("_at", F.explode(own))
        .join(spread, [*key, "_at"])
        .where((F.col("start") <= F.col("time")) & (F.col("end") >= F.col("next_time")))
        .drop("_at")
    )
