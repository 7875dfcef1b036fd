"""Features with known values, recipes and perf records."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from footstats.operators import features as ft
from footstats.operators import models as md


def vec(spark, *rows):
    return spark.createDataFrame([(Vectors.dense(r),) for r in rows], ["x"])


def test_dct1d_golden(spark):
    r = ft.embedding_columns(vec(spark, [1, 2, 3, 4]), "x", 2).first()
    assert r.x_dct.toArray() == pytest.approx([5, -2.2304425, 0, -0.1585127], abs=1e-6)
    assert r.x_dct_d2.toArray() == pytest.approx([5, -2.2304425], abs=1e-6)


def test_dctn(spark):
    one_axis = ft.DctnTransformer(inputCol="x", outputCol="y", filterSize=[4], tensorShape=[4])
    assert one_axis.transform(vec(spark, [1, 2, 3, 4])).first().y.toArray() == pytest.approx([20, -6.3086441, 0, -0.4483415], abs=1e-6)
    shape, kept = [3, 4, 5], [2, 3, 2]
    x = np.random.default_rng(0).normal(size=(6, *shape))
    got = ft.DctnTransformer(inputCol="x", outputCol="y", filterSize=kept, tensorShape=shape).transform(
        vec(spark, *[list(map(float, r.ravel())) for r in x])
    )
    wave = lambda k, i, n: 2 * math.cos(math.pi * k * (2 * i + 1) / (2 * n))
    for row, t in zip(got.collect(), x):
        want = [
            sum(t[i, j, k] * wave(a, i, 3) * wave(b, j, 4) * wave(c, k, 5) for i in range(3) for j in range(4) for k in range(5))
            for a in range(2) for b in range(3) for c in range(2)
        ]
        assert row.y.toArray() == pytest.approx(want)
    with pytest.raises(ValueError):
        ft.DctnTransformer(inputCol="x", outputCol="y", filterSize=[5], tensorShape=[4]).transform(vec(spark, [1, 2, 3, 4]))


def test_dctn_saved_in_pipeline(spark, tmp_path):
    stage = ft.DctnTransformer(inputCol="x", outputCol="y", filterSize=[2], tensorShape=[4])
    df = vec(spark, [1, 2, 3, 4])
    Pipeline(stages=[stage]).fit(df).write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert loaded.transform(df).first().y == stage.transform(df).first().y


def test_batch_infer_loads_model_per_worker(spark):
    def make():
        weights = np.array([1.0, 10.0])
        return lambda batch: batch @ weights[:, None]

    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>")
    got = ft.batch_infer(df, "x", make, 1, "y", tensor_shape=[2])
    assert [list(r.y) for r in got.collect()] == [[21.0], [43.0]]


def test_batch_infer_on_bytes(spark):
    def make():
        return lambda batch: np.array([[len(b), b[0]] for b in batch], dtype="float32")

    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"z"),)], "content binary")
    got = ft.batch_infer(df, "content", make, 4, "y").collect()
    assert {tuple(r.y) for r in got} == {(3.0, 97.0), (1.0, 122.0)}


def test_inference_stage(spark, tmp_path):
    """Saved here, loaded in another session: the same answers; null stays null, extra columns stay."""
    rng = np.random.default_rng(1)
    weights = {"w0": rng.normal(size=(6, 5)), "b0": rng.normal(size=5), "w1": rng.normal(size=(5, 2))}
    ft.save_weights(spark, weights, str(tmp_path / "w"))
    stage = ft.BatchInference(inputCol="x", outputCol="y", batchSize=2, tensorShape=[2, 3], checkpoint=str(tmp_path / "w"))
    rows = [(i, rng.normal(size=6).tolist() if i != 3 else None, "kept") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, x array<double>, halo string")
    Pipeline(stages=[stage]).fit(df).write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    vectors = ft.arrays_to_vectors(spark.newSession().createDataFrame(rows, df.schema), ["x"])
    for found in (stage.transform(df), loaded.transform(vectors)):
        assert found.columns == ["id", "x", "halo", "y"]
        for r in found.collect():
            if r.id == 3:
                assert r.y is None
            else:
                x = np.array(rows[r.id][1])
                assert r.y.toArray() == pytest.approx(np.maximum(x @ weights["w0"] + weights["b0"], 0) @ weights["w1"], rel=1e-4, abs=1e-5)
    assert loaded.transform(df.limit(0)).count() == 0


def test_weights_are_bounded(spark, tmp_path, monkeypatch):
    ft.save_weights(spark, {"w0": np.ones((3, 2))}, str(tmp_path / "w"))
    assert ft.load_weights(spark, str(tmp_path / "w"))["w0"].shape == (3, 2)
    monkeypatch.setattr(ft, "WEIGHT_BYTES", 40)
    with pytest.raises(ValueError):
        ft.load_weights(spark, str(tmp_path / "w"))


@pytest.mark.parametrize("k,cascade_rows", [(1, 29), (2, 27), (3, 24), (5, 15)])
def test_lag_row_counts(spark, k, cascade_rows):
    df = spark.createDataFrame([("f", t * 3, [float(t)]) for t in range(30)], "file string, time long, x array<double>")
    assert ft.lag_features(df, ["x"], k).count() == 30 - k
    assert ft.lag_features(df, ["x"], k, cascade=True).count() == cascade_rows


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_lag_values_with_gaps(spark, size):
    rng = random.Random(size)
    rows = [(f, t, float(t) if rng.random() < 0.9 else None) for f in "ab" for t in rng.sample(range(500), 40)]
    df = spark.createDataFrame(rows, "file string, time long, x double")
    got = {(r.file, r.time): r for r in ft.lag_features(df, ["x"], 3, bucket=size * 10, size=size).collect()}
    for f in "ab":
        ts = sorted(t for g, t, x in rows if g == f and x is not None)
        assert sorted(t for g, t in got if g == f) == ts[3:]
        for i in range(3, len(ts)):
            r = got[f, ts[i]]
            assert [r[f"x_lag_{j}"] for j in range(4)] == [float(ts[i - j]) for j in range(4)]


def test_join_features(spark):
    labels = spark.createDataFrame([("a/0001.mp4", 7, 1), ("a/0001.mp4", 8, 0)], "file string, time long, is_match int")
    t1 = spark.createDataFrame([("a/0001/0007.jpg", [1.0], [2.0])], "path string, embedding array<double>, embedding_dct array<double>")
    got = ft.join_features(labels, [t1, t1], ["m1", "m2"])
    assert got.columns == ["file", "time", "is_match", "m1", "m1_dct", "m2", "m2_dct"]
    assert [tuple(r)[:3] for r in got.collect()] == [("a/0001.mp4", 7, 1)]


def test_recipes(spark):
    recipes = md.evaluation_recipes()
    assert len(recipes) == 99 and len({(r.name, r.label) for r in recipes}) == 99
    kinds = [r.kind for r in recipes]
    assert {k: kinds.count(k) for k in set(kinds)} == {"plain": 12, "truncated": 24, "dctn": 9, "lagged": 6, "lagged_truncated": 48}


def test_fit_and_perf(spark, tmp_path):
    rng = random.Random(0)
    rows = []
    for i in range(20):
        for t in range(15):
            y = rng.randint(0, 1)
            rows.append((f"clip_{i}.mp4", t, y, [y + rng.gauss(0, 0.2), rng.gauss(0, 1), 0.5, rng.gauss(0, 1)]))
    df = spark.createDataFrame(rows, "file string, time long, is_match int, emb array<double>")
    recipe = md.Recipe("emb_lag1", ["emb"], "is_match", "lagged_truncated", d=2, k=1, grid={"max_iter": (10, 20)})
    perf = md.fit_recipe(df, recipe, str(tmp_path / "model")).first()
    assert perf.metric_name == "f1" and perf.test_metric > 0.9 and len(perf.avg_metrics) == 2
    assert perf.std_metrics != perf.avg_metrics
    assert perf.train_size + perf.test_size == 20 * 14
    table = recipe.table(df)
    assert table.select(F.size(vector_to_array("emb_lag_1")).alias("n")).first().n == 4
    plain = md.cross_validate(md.pipeline_plain(["emb"], "is_match"), md.Recipe("e", ["emb"], "is_match").table(df), "is_match", folds=2)
    assert plain.avgMetrics[0] > 0.9
