"""Interval lists: ``array<struct<start, end>>`` columns of one annotated clip.

The list of a clip arrives as one nested row, so the rules are folds inside that row and
need no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def clamp(children: Column, parents: Column, strict: bool = False) -> Column:
    """Cut children at the parents, taken in list order.

    A child that overlaps a parent's start begins there, one that overlaps its end stops
    there (touching counts). A child that strictly contains a parent, or lies inside or
    outside it, stays; ``strict`` also cuts the containing ones and leaves touching ones.
    """

    def cut(child, parent):
        s, e, ps, pe = child["start"], child["end"], parent["start"], parent["end"]
        if strict:
            meets = (s < pe) & (e > ps)
            return F.when(meets, interval(F.greatest(s, ps), F.least(e, pe))).otherwise(child)
        return (
            F.when((s <= ps) & (e <= pe) & (e >= ps), interval(ps, e))
            .when((s >= ps) & (e >= pe) & (s <= pe), interval(s, pe))
            .otherwise(child)
        )

    return F.transform(children, lambda child: F.aggregate(parents, child, cut))


def contained(children: Column, start: Column, end: Column) -> Column:
    """The children that lie wholly inside ``[start, end]``."""
    return F.filter(
        children, lambda c: (start <= c["start"]) & (c["start"] <= c["end"]) & (c["end"] <= end)
    )


def gaps_between(start: Column, end: Column, ordered: Column) -> Column:
    """Gaps that sorted children leave in ``(start, end)``.

    Outer gaps must be longer than zero, inner ones are kept as they come; without
    children the whole interval is the gap.
    """
    lefts = F.concat(F.array(start), F.transform(ordered, lambda c: c["end"]))
    rights = F.concat(F.transform(ordered, lambda c: c["start"]), F.array(end))
    last = F.size(ordered)
    return F.filter(
        F.zip_with(lefts, rights, interval),
        lambda g, i: ((i > 0) & (i < last)) | (last == 0) | (g["start"] < g["end"]),
    )


def complement(start: Column, end: Column, children: Column) -> Column:
    """``gaps_between`` for children in any order; they are sorted once per row."""
    once = F.transform(F.array(F.sort_array(children)), lambda o: gaps_between(start, end, o))
    return F.get(once, F.lit(0))
