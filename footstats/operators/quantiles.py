"""Exact quantiles that do not need a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.operators.sequences import CHUNK_ROWS
from footstats.sources.staging import stage

#: Rows of a cell that are ranked in one task; parts of a larger one; copies of a wanted cell.
SMALL_CELL, _PARTS, _SALTS = CHUNK_ROWS, 4096, 16
# Values share a bucket when they agree to one part in about 6000.
_STEPS_PER_OCTAVE = 4096
_LOWEST = 1075 * _STEPS_PER_OCTAVE


def _bucket(x: Column) -> Column:
    """Non-decreasing in ``x`` over all doubles."""
    size = F.floor(F.log2(F.abs(x)) * _STEPS_PER_OCTAVE) + _LOWEST
    endless = F.abs(x) == float("inf")
    return (
        F.when(x == 0, F.lit(0).cast("long"))
        .when(endless, F.signum(x).cast("long") * (4 * _LOWEST))
        .otherwise(F.signum(x).cast("long") * size)
    )


def _holding(cells: DataFrame, by: list[str], place: list[str], q: float) -> DataFrame:
    """The cells (at most two for each group) that hold the ranks around ``q``.

    ``cells``: by, ``place`` (their order in the group), _n, _lo, _hi, _below (rows of the group below the cells of one place prefix), _total.
    """
    low, high = _ranks(q)
    before = Window.partitionBy(*by, *place[:-1]).orderBy(place[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    holds = lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col("_n"))
    return counted.where(holds(low) | holds(high))


def _ranks(q: float) -> tuple[Column, Column]:
    rank = F.lit(float(q)) * (F.col("_total") - 1)
    return F.floor(rank), F.ceil(rank)


def _inside(values: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """The values ``_x`` of the wanted cells, with the cells' columns; values of one cell are spread by ``_SALTS`` salts."""
    salt = F.pmod(F.xxhash64(*values.columns), F.lit(_SALTS)).cast("int")
    salted = values.withColumn("_b", _bucket(F.col("_x"))).withColumn("_salt", salt)
    copies = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(copies, [*by, "_b", "_salt"]).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))


def exact_quantile(
    df: DataFrame, col: str, q: float, by: Sequence[str], out: str, extent: str | None = None, small: int = SMALL_CELL
) -> DataFrame:
    """Linear-interpolated quantile of the non-null values per group, one row per group.

    Radix selection: one scan counts values per logarithmic bucket; the cells that hold the two ranks around ``q`` are
    divided into ``_PARTS`` parts, again and again, until they have at most ``small`` rows or one value; a last
    scan ranks the values of only these cells. Counts are partial aggregates and the few wanted cells are
    copied to ``_SALTS`` salts, so neither a group nor a narrow band of values ends in one task. NaN counts
    as null; infinities are values. The cells are staged. With ``extent`` the least and largest value of that column among the group's
    rows come along as ``<extent>_first`` and ``<extent>_last``.
    """
    by = list(by) or ["_all"]
    reach = [extent] if extent else []
    rows = (df if by != ["_all"] else df.withColumn("_all", F.lit(0))).select(*by, *reach, F.col(col).cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    values = rows.select(*by, *reach, "_x")
    sizes = [F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    ends = [f(extent).alias(n) for f, n in ((F.min, "_first"), (F.max, "_last"))] if extent else []
    group = Window.partitionBy(*by)
    merged = [f(n).over(group).alias(f"{extent}{n}") for f, n in ((F.min, "_first"), (F.max, "_last"))] if extent else []
    sketch = rows.withColumn("_b", _bucket(F.col("_x"))).groupBy(*by, "_b").agg(*sizes, *ends)
    sketch = sketch.select(*by, "_b", "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.sum("_n").over(group).alias("_total"), *merged)
    cells = stage(_holding(sketch, by, ["_b"], q), "quantile-cells")
    about = [c for c in cells.columns if c.startswith(f"{extent}_")] if extent else []

    wide = (F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))
    while not cells.where(wide).isEmpty():
        # Rounded steps keep the order of values, and the ends of a cell fall into different parts.
        part = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS)
        fine = _inside(values, cells.where(wide), by).groupBy(*by, "_b", F.col("_lo").alias("_from"), "_below", "_total", *about, part.alias("_part")).agg(*sizes)
        finer = _holding(fine, by, ["_b", "_from", "_part"], q).select(cells.columns)
        cells = stage(cells.where(~wide).unionByName(finer), "quantile-cells")

    low, high = _ranks(q)
    at_most = Window.partitionBy(*by, "_b", "_lo").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        _inside(values, cells, by).groupBy(*by, "_b", "_lo", "_below", "_total", *about, "_x").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_below") + F.sum("_n").over(at_most))
    )
    holds = lambda k: (k >= F.col("_upto") - F.col("_n")) & (k < F.col("_upto"))
    at = lambda k: F.max(F.when(holds(k), F.col("_x")))
    picked = ranked.groupBy(*by, "_total", *about).agg(at(low).alias("_v0"), at(high).alias("_v1"))
    # From an endless value no step leads anywhere else.
    rest = F.lit(float(q)) * (F.col("_total") - 1) - low
    between = F.when(F.abs("_v0") == float("inf"), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * rest)
    result = picked.withColumn(out, F.when((F.col("_v0") == F.col("_v1")) | (rest == 0), F.col("_v0")).otherwise(between))
    return result.select(*[c for c in by if c != "_all"], out, *about)
