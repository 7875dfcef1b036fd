"""Whole flows on small inputs."""

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from footstats.operators.matches import mean_rest_ratio, run_ratios
from footstats.operators.models import Recipe
from footstats.plans import model_flow as mf
from footstats.plans.clock_flow import clock_matches
from footstats.plans.effort_flow import effort_reports
from footstats.plans.motion_flow import motion_actions
from footstats.sources import schemas as sc


def test_clock_to_matches(spark):
    """Two bouts of a countdown with a long break: one closed match per break."""
    fps, rows, clock = 2, [], 240.0
    for frame in range(600):
        running = frame % 300 < 150
        clock -= running / fps
        text = f"{int(clock) // 60}:{int(clock) % 60:02d}" if frame % 7 else "??"
        rows.append(("v", frame, text))
    readings = spark.createDataFrame(rows, "video string, frame long, raw_text string")
    runs, segments = clock_matches(readings, fps, pause_seconds=20)
    found = sorted((r.start_frame, r.end_frame) for r in segments.collect())
    assert len(found) == 2 and all(150 <= e % 300 <= 250 for _, e in found)
    ratios = run_ratios(runs, segments)
    assert ratios.count() == 2 and 0 < mean_rest_ratio(ratios).first().mean_zero_ratio < 0.5


def test_motion_actions(spark):
    rows = [("v", i, 0.0 if i < 190 else float(i * i), 0.0) for i in range(200)]
    log = spark.createDataFrame(rows, "video string, frame long, cx double, cy double")
    got = motion_actions(log, q=0.95, step=5).collect()
    assert [r.frame for r in got] == [190, 195] or sorted(r.frame for r in got) == [190, 195]


def test_effort_reports(spark):
    results = [("manual", None), ("prediction", None)]
    ann = [(1, 2, 12.5, "2024-02-10T08:00:00Z", f"u{i}", results) for i in range(3)]
    export = spark.createDataFrame([(i, 2, [a], (None, "img")) for i, a in enumerate(ann)], sc.ANNOTATION_EXPORT)
    reports = effort_reports(export, 2, 1)
    assert reports["by_origin"].count() == 2
    assert reports["lead_time_by_version"].first().median_lead_time == 12.5
    assert reports["lead_time_of_one"].first()["count"] == 3
    assert tuple(reports["unit_sizes"].first()) == ("v0", 2, 3)
    assert reports["per_day"].first()["count"] == 3


def test_model_flow(spark):
    rng = random.Random(0)
    rows = [(f"c/{i:04d}/{t:04d}.jpg", rng.randint(0, 1)) for i in range(15) for t in range(12)]
    emb = spark.createDataFrame([(p, [y + rng.gauss(0, 0.1)] + [rng.random() for _ in range(15)]) for p, y in rows], "path string, embedding array<double>")
    emb = emb.withColumn("embedding", array_to_vector("embedding"))
    labels = spark.createDataFrame(
        [(p.rsplit("/", 1)[0] + ".mp4", int(p[-8:-4]), y) for p, y in rows], "file string, time long, is_match int"
    )
    table = mf.evaluation_table(labels, [emb], ["m"])
    assert table.columns == ["file", "time", "is_match", "m", "m_dct", "m_dct_d8"] and table.count() == len(rows)
    grid = {"max_iter": (10,), "folds": 2}
    perf = mf.evaluate(table, [
        Recipe("m", ["m"], "is_match", grid=grid), Recipe("m_dct_d8_lag1", ["m_dct"], "is_match", "lagged_truncated", d=8, k=1, grid=grid)
    ]).cache()
    assert [r.feature for r in mf.best_models(perf).collect()] == ["m"]
    assert {r.feature for r in mf.results(perf).where(F.col("label") == "is match").collect()} == {"m", "m dct d8 lag1"}
