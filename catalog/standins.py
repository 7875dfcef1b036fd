"""The driver tables in the shapes the footage operators read (whole tables, no caps).

Each stand-in has a SQL twin of the same name in ``catalog.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footstats.operators.sequences import with_position

FPS = 10
PAUSE_LIMIT_SECONDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten videos of frames; 200 running and 100 paused frames by turns, errors unreadable."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", (F.col("user_id") % 10).alias("video")
    )
    minute = F.date_trunc("minute", "ts")
    framed = with_position(events, ["video"], ["ts", "event_id"], minute, "frame")
    block, rest = F.expr("frame div 300"), F.col("frame") % 300
    left = F.pmod(
        F.lit(240) - F.floor((block * 200 + F.least(rest, F.lit(200))) / 10), F.lit(240)
    )
    text = F.when(F.col("event_type") == "error", "(no clock)").otherwise(
        F.format_string("%d:%02d", F.floor(left / 60), left % 60)
    )
    return framed.select("event_id", "video", "frame", text.alias("raw_text"))


def clock_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings with frame numbers, as the text recognition leaves them."""
    return clock_readings(spark, sf_dir)


def annotation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per event: ``(file, event_id, label, start, end)``.

    Each user's events of a type are numbered; three in a row share a 30-second clip, in
    slots of ten seconds, so every event is used and a clip stays small.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    ids = F.floor(F.col("event_id") / 65536)
    numbered = with_position(events, ["user_id", "event_type"], ["event_id"], ids, "rn")
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.col("rn") % 3 * 10 + k % 5
    return numbered.select(
        F.format_string(
            "data/mat_%02d/%04d/%04d.mp4", F.col("user_id") % 10, "user_id", F.floor(F.col("rn") / 3)
        ).alias("file"),
        "event_id",
        F.expr(
            "CASE event_type WHEN 'click' THEN 'Match' WHEN 'view' THEN 'Active' "
            "WHEN 'purchase' THEN 'Standing' ELSE 'Unsure' END"
        ).alias("label"),
        start.cast("double").alias("start"),
        (start + 1 + k % 4).cast("double").alias("end"),
    )


def annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks nested as the labelling tool exports them (at most 15 results per clip)."""
    value = F.struct("start", "end", F.array("label").alias("labels"))
    result = F.struct("event_id", F.struct(F.lit("manual").alias("origin"), value.alias("value")).alias("r"))
    tasks = annotation_tasks(spark, sf_dir).groupBy("file").agg(F.sort_array(F.collect_list(result)).alias("rs"))
    annotation = F.struct(
        F.lit(1).alias("completed_by"),
        F.lit(2).alias("project"),
        (F.size("rs") * 1.5).alias("lead_time"),
        F.lit("2024-03-10T08:00:00Z").alias("updated_at"),
        F.col("file").alias("unique_id"),
        F.transform("rs", lambda x: x["r"]).alias("result"),
    )
    return tasks.select(
        F.array(annotation).alias("annotations"),
        F.struct(F.concat(F.lit("http://localhost:8080/files/"), "file").alias("video_url")).alias("data"),
    )


VERSION_CUTS = [("2024-01-10", "v0"), ("2024-01-20", "v1")]


def annotation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelling effort: one row per result, twenty units per user."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3 + 1).alias("project"),
        (F.col("user_id") % 4 + 1).alias("completed_by"),
        F.col("value").alias("lead_time"),
        F.col("ts").alias("updated_at"),
        (F.col("user_id") * 100 + F.col("event_id") % 20).alias("unique_id"),
        F.expr(
            "CASE WHEN event_type IN ('click', 'view') THEN 'manual' "
            "WHEN event_type = 'purchase' THEN 'prediction' ELSE 'prediction-changed' END"
        ).alias("origin"),
    )


def perf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One perf record per part; the key breaks ties."""
    lag = F.col("p_size") % 6
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("is_"), F.lower("p_type")).alias("label"),
        F.concat(
            F.when(F.col("p_partkey") % 2 == 0, "emb_entity_detection_v2").otherwise("emb_vanilla_yolov8n"),
            F.when(F.col("p_partkey") % 3 == 0, "_dct_d16").otherwise(""),
            F.when(lag > 0, F.concat(F.lit("_lag"), lag.cast("string"))).otherwise(""),
        ).alias("feature"),
        F.array(F.col("p_retailprice") / 3000, F.lit(0.5)).alias("avg_metrics"),
        (F.col("p_retailprice") / 2999).alias("test_metric"),
        (F.col("p_size") * 1.5).alias("train_time"),
        (F.col("p_size") * 10).cast("long").alias("train_size"),
        (F.col("p_size") * 3).cast("long").alias("train_positive"),
        F.col("p_size").cast("long").alias("test_size"),
        F.floor(F.col("p_size") / 2).alias("test_positive"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frames of ten videos."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 10).alias("video"), F.expr("o_orderkey div 10").alias("frame")
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on these frames; ``place`` is the box's place in the detector output."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("video"),
        F.expr("l_orderkey div 10").alias("frame"),
        F.col("l_partkey").alias("place"),
        (F.col("l_linenumber") % 3).alias("cls"),
        F.col("l_quantity").alias("x1"),
        (F.col("l_linenumber") * 10.0).alias("y1"),
        (F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("x2"),
        (F.col("l_linenumber") * 10.0 + F.col("l_extendedprice") / 500).alias("y2"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


def nested_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a detector writes them: one row with its few boxes."""
    box = F.struct("place", F.struct("x1", "y1", "x2", "y2").alias("b"))
    listed = boxes(spark, sf_dir).groupBy("video", "frame").agg(F.sort_array(F.collect_list(box)).alias("bs"))
    return listed.select("video", "frame", F.transform("bs", lambda x: x["b"]).alias("boxes"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("box_id"),
        (F.col("l_quantity").cast("long") * 5 % 256).alias("r"),
        (F.col("l_partkey") % 256).alias("g"),
        (F.floor("l_extendedprice") % 256).alias("b"),
    )


def video_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries that name their video under different keys, or not at all."""
    part = F.col("page_id") % 4
    return table(spark, sf_dir, "pages").select(
        F.when(part == 0, F.col("url")).otherwise("").alias("video"),
        F.when(part == 1, F.col("url")).alias("video_path"),
        F.when(part == 2, F.col("url")).alias("path"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("name"),
    )


SCENES = ["match", "match_intro", "match_outro", "no_match"]


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per vector: its path and the scores of four scene classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string(
            "/frames/mat_%02d/%04d/%04d.jpg", "label", F.floor(F.col("vec_id") / 100), F.col("vec_id") % 100
        ).alias("path"),
        F.array(*[F.lit(s) for s in SCENES]).alias("labels"),
        # A class's score: the sum of its sixteen of the 64 values, so that all count.
        F.array(*[
            F.aggregate(F.slice("embedding", 16 * c + 1, 16), F.lit(0.0), lambda a, x: a + x) for c in range(len(SCENES))
        ]).alias("prob"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("path"), (F.col("s_suppkey") * 37 + 100).alias("total_seconds")
    )


def image_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by image URL; names repeat."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.format_string("http://localhost:8080/data/%s/%s/%04d.png", "source", "lang", F.col("n_chars") % 50).alias("image"),
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk; names repeat."""
    return table(spark, sf_dir, "conversations").select(
        F.format_string(
            "/mnt/frames/src%d/en/%04d.png", F.col("conv_id") % 5, (F.col("turn") * 7 + F.col("conv_id")) % 50
        ).alias("path")
    )


def choice_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification tasks, some without a result."""
    choices = F.array(F.when(F.col("event_type") == "view", "point").otherwise(F.col("event_type")))
    result = F.array(F.struct(F.struct(choices.alias("choices")).alias("value")))
    none = F.slice(result, 1, 0)
    return table(spark, sf_dir, "events").select(
        F.array(F.struct(F.when(F.col("event_type") == "error", none).otherwise(result).alias("result"))).alias("annotations"),
        F.struct(F.concat(F.lit("img/"), F.col("event_id").cast("string")).alias("image")).alias("data"),
    )


def frame_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by frame path: ten clips of vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.format_string("clips/mat_%02d/0001/%06d.jpg", "label", "vec_id").alias("path"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-second labels of the same clips."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("clips/mat_%02d/0001.mp4", "label").alias("file"),
        F.col("vec_id").alias("time"),
        (F.col("vec_id") % 2).cast("int").alias("is_match"),
        (F.get("embedding", F.lit(0)) > 0).cast("int").alias("is_active"),
        (F.get("embedding", F.lit(1)) > F.get("embedding", F.lit(2))).cast("int").alias("is_standing"),
    )


def model_embeddings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Frames as four models see them: the vector as it is, from behind, the steps from half a value to the next, sizes."""
    e = F.col("embedding")
    steps = F.zip_with(e, F.concat(F.slice(e, 2, F.size(e)), F.slice(e, 1, 1)), lambda x, y: y - x / 2)
    seen = [e, F.reverse(e), steps, F.transform(e, lambda x: F.abs(x))]
    frames = frame_embeddings(spark, sf_dir)
    return [frames.withColumn("embedding", v) for v in seen]


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    from footstats.operators.features import arrays_to_vectors, dct1d, join_features

    vectors = dct1d(arrays_to_vectors(frame_embeddings(spark, sf_dir), ["embedding"]), "embedding", "embedding_dct")
    arrays = vectors.withColumns({c: vector_to_array(F.col(c)) for c in ("embedding", "embedding_dct")})
    return join_features(frame_labels(spark, sf_dir), [arrays], ["emb"])
