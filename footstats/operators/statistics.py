"""Counts, rates and descriptions of labelled tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_COLUMNS = ("is_match", "is_active", "is_standing")


def label_combo_counts(labels: DataFrame, cols: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    return labels.groupBy(*cols).count().orderBy(*cols, ascending=False)


def label_rates(labels: DataFrame, digits: int = 3) -> DataFrame:
    """Matches per row; active and standing per match row."""
    match, active, standing = (F.sum(c) for c in LABEL_COLUMNS)
    rate = lambda a, b: F.round(F.try_divide(a, b), digits)
    return labels.agg(
        rate(match, F.count(F.lit(1))).alias("pct_match"),
        rate(active, match).alias("pct_active"),
        rate(standing, match).alias("pct_standing"),
    )


def describe_cols(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, stddev, min and max per column, one row per column (and group), one scan."""
    stats = [
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(c).alias("count"),
                    F.avg(c).alias("mean"),
                    F.stddev(c).alias("stddev"),
                    F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"),
                )
                for c in cols
            ]
        ).alias("s")
    ]
    return df.groupBy(*by).agg(*stats).select(*by, F.inline("s"))


def distinct_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("distinct_count"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).count()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).count().orderBy(F.desc("count"), col)


def pivot_counts(df: DataFrame, row: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """Counts per row group and listed value; a combination that never occurs is null."""
    return df.groupBy(*row).pivot(col, list(values)).count()


def with_totals(pivot: DataFrame, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join the row count of each group of ``df`` to a pivot of it."""
    return pivot.join(df.groupBy(*key).count(), list(key))


def valid_rows(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(col).alias("valid"))


def split_sizes(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows and positives per split, in one job."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("size"), F.count(F.when(F.col(label) > 0, 1)).alias("positive")
    )


def confusion_metrics(df: DataFrame, actual: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """One-vs-rest tp, tn, fp, fn per class, with accuracy, precision, recall and F1."""
    cells = df.groupBy(F.col(actual).alias("_a"), F.col(predicted).alias("_p")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n")
    )
    # Only the small confusion matrix goes on: per class its row, its column and the total.
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("_a").alias("class"),
                    F.when(F.col("_a") == F.col("_p"), F.col("_n")).otherwise(0).alias("_tp"),
                    F.when(F.col("_a") != F.col("_p"), F.col("_n")).otherwise(0).alias("_fn"),
                    F.lit(0).cast("long").alias("_fp"),
                ),
                F.struct(
                    F.col("_p").alias("class"),
                    F.lit(0).cast("long").alias("_tp"),
                    F.lit(0).cast("long").alias("_fn"),
                    F.when(F.col("_a") != F.col("_p"), F.col("_n")).otherwise(0).alias("_fp"),
                ),
            )
        )
    )
    per_class = sides.groupBy("class").agg(
        F.sum("_tp").alias("tp"), F.sum("_fp").alias("fp"), F.sum("_fn").alias("fn")
    )
    total = cells.agg(F.sum("_n")).scalar()
    counts = per_class.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
    return confusion_scores(counts.select("class", "tp", "tn", "fp", "fn"))


def confusion_scores(counts: DataFrame) -> DataFrame:
    """``(…, tp, tn, fp, fn)`` -> accuracy, precision, recall, f1; undefined ratios are null."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("accuracy", F.try_divide(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.try_divide(2 * p * r, p + r))
    )


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def encode_class(df: DataFrame, col: str, mapping: Mapping[str, int], out: str = "class_id") -> DataFrame:
    """Look a name up in a literal map; unknown names give null."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return df.withColumn(out, F.element_at(F.create_map(*entries), F.col(col)))
