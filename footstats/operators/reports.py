"""Ranked tables of model results.

Input: perf records (``train_time, avg_metrics, test_metric, label, feature, …``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.functions.features import feature_title, first_metric, label_title, lag_number


# Fixed name parts of the report columns.
SIDES, COUNTS = ("train", "test"), ("size", "positive")


def score_table(perf: DataFrame, titles: bool = False) -> DataFrame:
    """Label, feature and rounded scores; ``titles`` turns names into captions."""
    captions = {"label": label_title, "feature": feature_title} if titles else {}
    named = perf.withColumns({name: caption(F.col(name)) for name, caption in captions.items()})
    scores = {
        "avg_train_f1": first_metric(F.col("avg_metrics")),
        "test_f1": F.round("test_metric", 3),
        "train_time": F.col("train_time").cast("int"),
    }
    return named.select("label", "feature", *[value.alias(name) for name, value in scores.items()])


def order_report(df: DataFrame, keys: Sequence[str] = ("label",), score: str = "test_f1") -> DataFrame:
    """By the keys, best score first."""
    return df.orderBy(*keys, F.desc(score))


def with_rates(df: DataFrame, sides: Sequence[str] = SIDES, digits: int = 2) -> DataFrame:
    """Adds ``<side>_rate``, the share of ``<side>_positive`` in ``<side>_size``; null for an empty side."""
    share = lambda side: F.try_divide(*[F.col(f"{side}_{part}") for part in reversed(COUNTS)])
    return df.withColumns({f"{side}_rate": F.round(share(side), digits) for side in sides})


def lag_report(perf: DataFrame) -> DataFrame:
    """Distinct split sizes and positive rates per label and lag."""
    keys = ["label", "lag"]
    sizes = [f"{side}_{part}" for side in SIDES for part in COUNTS]
    numbered = with_rates(perf.withColumn("lag", lag_number(F.col("feature"))))
    return numbered.select(*keys, *sizes, *[f"{side}_rate" for side in SIDES]).distinct().orderBy(*keys)


def where_contains(df: DataFrame, part: str, col: str = "feature", negate: bool = False) -> DataFrame:
    hit = F.col(col).contains(part)
    return df.where(~hit if negate else hit)


def top_k_per_group(
    df: DataFrame, k: int, by: Sequence[str], order: Sequence[str | Column], out: str | None = None
) -> DataFrame:
    """The first ``k`` rows per group; ``order`` should end in a unique tie-breaker.

    The limit is a row_number filter, which Spark also applies before the shuffle.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col("_rank") <= k)
    return kept.withColumnRenamed("_rank", out) if out else kept.drop("_rank")
