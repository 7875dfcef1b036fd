"""Annotation export -> labelling-effort reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footstats.operators import annotations as an
from footstats.operators import statistics as st


def effort_reports(export: DataFrame, project: int, annotator: int) -> dict[str, DataFrame]:
    """The reports on one project, and where they differ on one of its annotators."""
    results = an.explode_results(an.explode_annotations(export))
    ann = an.version_bucket(results.where(results["project"] == project))
    return {
        "by_project": st.count_by(results, "project"),
        "by_annotator": st.count_by(results, "completed_by", "project"),
        "by_origin": st.count_by(ann, "origin"),
        "lead_time": st.describe_cols(an.explode_annotations(export), ["lead_time"], ["project"]),
        "per_day": an.units_per_day(ann),
        "by_version": an.units_by_version(ann),
        "origins": an.origin_pivot(ann),
        "origins_of_one": an.origin_pivot(ann, annotator),
        "lead_time_by_version": an.lead_time_stats(ann),
        "lead_time_of_one": an.lead_time_stats(ann, annotator, ci=False),
        "unit_sizes": an.unit_histogram(ann),
    }
