"""One key with most of the rows must not end in one task."""

import pytest
from pyspark.sql import functions as F

from footstats.operators import dedup as dd
from footstats.operators.matches import frame_runs, segment_matches
from footstats.operators.motion import major_actions
from footstats.operators.quantiles import _bucket, _inside, exact_quantile
from footstats.operators.sequences import nearest_marks, spread_over_chunks, with_halo, with_position

HOT = 40_000
SIZE = 1000


@pytest.fixture(autouse=True)
def fixed_partitions(spark):
    """No merging of small partitions and no broadcast: tasks as on a large table."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frames(spark):
    """A video of 40 000 frames and 100 of ten."""
    hot = spark.range(HOT).select(F.lit("hot").alias("video"), F.col("id").alias("frame"))
    cold = spark.range(1000).select(F.concat(F.lit("v"), F.col("id") % 100).alias("video"), F.floor(F.col("id") / 100).alias("frame"))
    return hot.union(cold).withColumn("x", (F.col("frame") % 97).cast("double"))


def largest_task(df):
    """Rows of the fullest partition; the hash keeps all columns, and so all windows, in the plan."""
    placed = df.select(F.spark_partition_id().alias("p"), F.hash(*df.columns).alias("h"))
    sizes = placed.groupBy("p").agg(F.count("h").alias("n"), F.sum("h").alias("s"))
    return sizes.agg(F.max("n"), F.sum("s")).first()[0]


def check(df, rows=HOT + 1000):
    assert df.count() == rows
    assert largest_task(df) < rows / 3


def test_plain_window_would_not_pass(spark):
    from pyspark.sql import Window

    df = frames(spark).withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("frame")))
    assert largest_task(df) >= HOT


def test_ordered_operators(spark):
    df = frames(spark)
    check(nearest_marks(df, ["video"], "frame", F.col("x") == 0, ["x"], size=SIZE))
    check(with_halo(df, ["video"], "frame", 30, 30, lambda w: {"m": F.avg("x").over(w.rowsBetween(-30, 30))}, SIZE))
    check(spread_over_chunks(df, ["video"], "frame", {"m": (F.max, F.col("x"))}, SIZE))
    check(with_position(df, ["video"], ["frame"], F.floor(F.col("frame") / SIZE)))


def test_segments_of_a_hot_video(spark):
    flags = frames(spark).select("video", "frame", (F.col("x") < 50).cast("int").alias("running"))
    got = segment_matches(flags, 100, size=SIZE)
    whole = segment_matches(flags, 100, size=10**6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert largest_task(got) < got.count() / 3


def test_runs_of_a_hot_video(spark):
    flags = frames(spark).select("video", "frame", (F.col("x") < 50).cast("int").alias("running"))
    runs = frame_runs(flags, size=SIZE)
    assert runs.count() < 1500 and largest_task(runs) < runs.count() / 3


def test_quantile_of_a_hot_group(spark):
    got = {r.video: r.q for r in exact_quantile(frames(spark), "x", 0.5, ["video"], "q").collect()}
    assert got["hot"] == 48.0 and len(got) == 101


def test_quantile_of_a_narrow_band(spark):
    """One group whose values agree in their leading digits, as times do: all lie in one logarithmic bucket."""
    df = spark.range(HOT).select(F.lit("hot").alias("video"), (F.lit(1.7e12) + F.col("id") * 1000).alias("x"))
    got = exact_quantile(df, "x", 0.25, ["video"], "q", small=500)
    assert got.first().q == 1.7e12 + 9_999_750
    cell = df.groupBy("video").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).withColumn("_b", _bucket(F.col("_lo")))
    inside = _inside(df.withColumnRenamed("x", "_x"), cell, ["video"])
    assert inside.count() == HOT and largest_task(inside) < HOT / 3


def test_major_actions_of_a_hot_video(spark):
    got = major_actions(frames(spark), "x", 0.5, 3, size=SIZE)
    assert got.where("video = 'hot'").count() > 6000
    assert largest_task(got) < got.count() / 3


def test_copies_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(dd, "HOT_ROWS", 2000)
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    known = spark.createDataFrame([("same",)] * 5 + [("3",)], "text string")
    got = dd.hash_semi(rows, known, "text", ["id"])
    assert got.count() == 20_001
    assert largest_task(got) < 10_000
    # Cold keys are joined once, the hot one is copied for each started 2000 rows.
    spread = dd.salted_join(rows, known.distinct(), "text", ["id"])
    assert spread.count() == 20_001


def test_unbroken_segments_of_a_hot_video(spark):
    flags = frames(spark).select("video", "frame", (F.col("x") < 50).cast("int").alias("running"))
    got = segment_matches(flags, 20, cumulative_pause=False, size=SIZE)
    whole = segment_matches(flags, 20, cumulative_pause=False, size=10**6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert largest_task(got) < got.count() / 3
