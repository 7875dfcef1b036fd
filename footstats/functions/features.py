"""Names and values in model reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed name parts of the model reports and what the tables show for them.
FEATURE_NAMES = [("emb_entity_detection", "fine_tune"), ("emb_vanilla", "vanilla"), ("_", " ")]


def lag_number(feature: Column) -> Column:
    """``…lag3`` -> 3, no lag -> 0."""
    return F.coalesce(F.regexp_extract(feature, r"lag(\d+)", 1).try_cast("int"), F.lit(0))


def feature_title(feature: Column) -> Column:
    for name, shown in FEATURE_NAMES:
        feature = F.regexp_replace(feature, name, shown)
    return feature


def label_title(label: Column) -> Column:
    return F.regexp_replace(label, "_", " ")


def first_metric(metrics: Column, digits: int = 3) -> Column:
    return F.round(F.get(metrics, F.lit(0)), digits)
