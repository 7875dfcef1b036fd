"""Cases that once gave wrong answers: columns by name, endless values, null flags, ties, staging, folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from footstats.operators import features as ft
from footstats.operators import models as md
from footstats.operators.annotations import first_per_unit
from footstats.operators.dedup import join_stem
from footstats.operators.detections import frame_phases
from footstats.operators.matches import segment_matches
from footstats.operators.quantiles import exact_quantile
from footstats.sources import readers as rd
from footstats.sources.staging import clear_staged, scratch_path, shared_dir, stage


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a_phases.csv").write_text("timestamp,phase,detections\n1.0,Ne-waza,2\n")
    (tmp_path / "b_phases.csv").write_text("phase,timestamp,detections\n\"Tachi, waza\",2.0,3\n")
    (tmp_path / "c_phases.csv").write_text("﻿timestamp,phase,extra\n3.0,none,x\n")
    got = rd.consolidate_csv(spark, str(tmp_path), "timestamp double, phase string, detections long")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1.0, "Ne-waza", 2, "a"), (2.0, "Tachi, waza", 3, "b"), (3.0, "none", None, "c"),
    ]


def test_quantile_of_endless_values(spark):
    rows = [("a", x) for x in (1.0, 2.0, math.inf)] + [("b", -math.inf), ("b", 0.0)] + [("c", math.nan), ("c", 5.0), ("d", math.inf), ("d", math.inf)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in exact_quantile(df, "x", 0.5, ["g"], "q").collect()}
    assert got == {"a": 2.0, "b": -math.inf, "c": 5.0, "d": math.inf}


@pytest.mark.parametrize("cumulative", [True, False])
def test_null_flag_is_a_pause(spark, cumulative):
    flags = [1, 1, None, 0, 0, 1]
    as_zero = [1, 1, 0, 0, 0, 1]
    runs = [
        segment_matches(spark.createDataFrame([("v", i, x) for i, x in enumerate(f)], "video string, frame long, running int"), 2, cumulative_pause=cumulative)
        for f in (flags, as_zero)
    ]
    one, other = (sorted(tuple(r) for r in run.collect()) for run in runs)
    assert one == other and len(one) == 1


def test_ties_do_not_depend_on_row_order(spark):
    ann = spark.createDataFrame([("u", 1, 5.0), ("u", 1, 3.0)], "unit string, updated_at long, v double")
    assert first_per_unit(ann, ["unit"], "v").first().v == first_per_unit(ann.orderBy("v"), ["unit"], "v").first().v == 3.0
    box = "video long, frame long, place long, cls long, x1 double, y1 double, x2 double, y2 double, confidence double"
    rows = [(1, 1, 7, 0, 0.0, 0.0, 10.0, 10.0, 1.0), (1, 1, 7, 0, 50.0, 0.0, 60.0, 10.0, 1.0)]
    frames = spark.createDataFrame([(1, 1)], "video long, frame long")
    centres = {frame_phases(frames, spark.createDataFrame(r, box)).first().cx for r in (rows, rows[::-1])}
    assert len(centres) == 1


def test_equal_stems_do_not_multiply(spark):
    images = spark.createDataFrame([(1, "a/x.jpg")], "id long, image string")
    labels = spark.createDataFrame([("a/x.txt",), ("a/x.csv",)], "label_file string")
    assert [r.label_file for r in join_stem(images, labels, ["id"]).collect()] == ["a/x.csv"]


def test_staging_folder_and_its_end(spark, tmp_path):
    clear_staged(spark)
    df = spark.range(5)
    assert shared_dir(spark, str(tmp_path)) == str(tmp_path)
    assert stage(df, "t", str(tmp_path)).count() == 5
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert list(tmp_path.rglob("*.parquet")) and clear_staged(spark) == 1 and not list(tmp_path.rglob("*.parquet"))


def test_folds_do_not_depend_on_partitions(spark):
    pick = random.Random(1)
    rows = [(f"clip_{i}.mp4", t, y := pick.randint(0, 1), [y + pick.gauss(0, 0.8), pick.gauss(0, 1)]) for i in range(18) for t in range(12)]
    df = spark.createDataFrame(rows, "file string, time long, is_match int, emb array<double>")
    table = md.Recipe("e", ["emb"], "is_match").table(df)
    scores = [
        md.cross_validate(md.pipeline_plain(["emb"], "is_match"), table.repartition(n, "time"), "is_match", reg_param=(0.01, 0.3)).avgMetrics
        for n in (1, 8)
    ]
    assert len(scores[0]) == 2 and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(*scores))


def test_null_vectors_and_short_results(spark):
    rows = spark.createDataFrame([(1, [1.0] * 8), (2, None)], "id long, v array<double>")
    corner = ft.DctnTransformer(inputCol="x", outputCol="out", filterSize=[1, 1], tensorShape=[2, 4])
    got = corner.transform(ft.arrays_to_vectors(rows, ["v"]).withColumnRenamed("v", "x"))
    assert {r.id: r.out is None for r in got.collect()} == {1: False, 2: True}
    short = ft.batch_infer(rows.where("id = 1"), "v", lambda: (lambda x: x[:0]), 4, "out", [8])
    with pytest.raises(Exception, match="rows in"):
        short.collect()
