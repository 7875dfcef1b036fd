"""Labels and embeddings -> feature table -> models -> ranked results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.operators.features import embedding_columns, join_features
from footstats.operators.models import MODELS, Recipe, evaluation_recipes, sweep
from footstats.operators.reports import order_report, score_table, top_k_per_group, where_contains


def evaluation_table(labels: DataFrame, embeddings: Sequence[DataFrame], names: Sequence[str] = MODELS) -> DataFrame:
    """Per-second labels with ``<model>``, ``<model>_dct`` and ``<model>_dct_d8`` of every model."""
    return join_features(labels, [embedding_columns(e) for e in embeddings], names)


def evaluate(table: DataFrame, recipes: Sequence[Recipe] | None = None) -> DataFrame:
    """Perf records of all recipes (by default the 99 of the evaluation)."""
    return sweep(table, recipes or evaluation_recipes())


def results(perf: DataFrame) -> DataFrame:
    """All scores, best first per label."""
    return order_report(score_table(perf, titles=True))


def best_models(perf: DataFrame, k: int = 5, part: str = "lag", negate: bool = True) -> DataFrame:
    """The ``k`` best per label among the features with (or without) a name part."""
    chosen = where_contains(score_table(perf, titles=True), part, negate=negate).drop("train_time")
    return top_k_per_group(chosen, k, ["label"], [F.desc("test_f1"), "feature"])
