"""Reader and writer queries: tables go out to files in the shared folder and come back."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.clock_queries import FPS
from catalog.standins import annotation_export, boxes, clock_readings, clock_table, frames, perf_records, table, videos
from footstats.operators import detections as dt
from footstats.operators import statistics as st
from footstats.operators import subtitles as su
from footstats.plans.clock_flow import clock_timeline
from footstats.plans.label_flow import second_labels
from footstats.sources import readers as rd
from footstats.sources import schemas as sc
from footstats.sources import writers as wr
from footstats.sources.staging import scratch_path


def json_roundtrip(spark, d):
    path = scratch_path(spark, "labels-json")
    wr.write_json(second_labels(annotation_export(spark, d)), path)
    return rd.read_second_labels(spark, path, multi_line=False)


def json_combined(spark, d):
    path = scratch_path(spark, "readings-json")
    rows = clock_readings(spark, d).select(
        F.col("frame").alias("frame_number"), F.col("video").cast("string").alias("filename"), "raw_text"
    )
    # One array for each stretch of a thousand frames of a video, all in one folder.
    arrays = rows.groupBy("filename", F.expr("frame_number div 1000").alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",\n"), F.lit("\n]")).alias("value")
    )
    arrays.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    back = rd.combine_json(spark, path, sc.CLOCK_READINGS, glob="*.txt")
    return back.select("frame_number", "filename", "raw_text")


def json_array(spark, d):
    """Files that each hold one array of records over several lines, as annotation servers export them."""
    path = scratch_path(spark, "arrays-json")
    record = F.to_json(F.struct("s_suppkey", "s_name"))
    # An array holds the records of one stretch of a thousand keys.
    arrays = table(spark, d, "supplier").groupBy(F.expr("s_suppkey div 1000").alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value")
    )
    arrays.repartition("part").write.partitionBy("part").text(path)
    return rd.read_json_array(spark, f"{path}/part=*", "s_suppkey long, s_name string")


def json_single(spark, d):
    """A small result as one file."""
    path = scratch_path(spark, "perf-json")
    wr.write_json(perf_records(spark, d).select("label", "train_size").repartition(4), path, files=1)
    back = spark.read.schema("label string, train_size long").json(path)
    return back.groupBy("label").agg(
        F.count(F.lit(1)).alias("models"), F.sum("train_size").alias("train_size"), F.count_distinct("_metadata.file_path").alias("files")
    )


def csv_head(spark, d):
    """The first rows of a total order, through a CSV file."""
    path = scratch_path(spark, "parts-csv")
    wr.write_csv(table(spark, d, "part").select("p_partkey", "p_retailprice"), path)
    back = spark.read.csv(path, schema="p_partkey long, p_retailprice double", header=True)
    return back.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


def subtitle_files(spark, d):
    """Cues written in order, one folder per video, and read back: lines and cue numbers of each file."""
    path = scratch_path(spark, "subtitles")
    wr.write_subtitles(subtitle_rows(spark, d).select("video", "cue", "text"), path)
    lines = spark.read.text(path)
    cue = F.when(F.col("value").rlike(r"^\d+$"), F.col("value").cast("long"))
    return lines.groupBy(F.col("video").cast("long").alias("video")).agg(F.count(cue).alias("cues"), F.sum(cue).alias("numbers"))


def table_roundtrip(spark, d):
    path = scratch_path(spark, "detections")
    wr.write_table(boxes(spark, d), path, 4)
    return spark.read.parquet(path)


def csv_consolidate(spark, d):
    path = scratch_path(spark, "phases-csv")
    log = dt.frame_phases(frames(spark, d), boxes(spark, d))
    named = log.select("video", F.col("frame").cast("double").alias("timestamp"), "phase", "n_detections")
    wr.write_phases(named.where("video < 5"), path)
    # The other videos' files order their columns differently.
    turned = named.where("video >= 5").select("phase", "n_detections", "timestamp", "video")
    turned.repartition("video").write.mode("append").partitionBy("video").option("header", True).csv(path)
    schema = "timestamp double, phase string, n_detections long, video long"
    return rd.consolidate_csv(spark, path, schema)


def binary_manifest(spark, d):
    path = scratch_path(spark, "pages-text")
    pages = table(spark, d, "pages").select((F.col("page_id") % 5).alias("group"), F.base64(F.encode("html", "UTF-8")).alias("value"))
    pages.select("group", F.translate("value", "\r\n", "").alias("value")).write.partitionBy("group").text(path)
    files = rd.read_binary(spark, path, "*.txt")
    group = F.regexp_extract("path", r"^group=(\d+)/", 1).cast("int")
    return files.groupBy(group.alias("group")).agg(F.sum("length").alias("bytes"))


def url_manifest(spark, d):
    path = scratch_path(spark, "videos-text")
    names = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("mat"), "s_name", "s_suppkey")
    # Folders hold one, two, ... files, so that a listing that misses some is seen.
    names.withColumn("part", F.col("s_suppkey") % (F.col("mat") + 1)).drop("s_suppkey").repartition("mat", "part").write.partitionBy("mat", "part").text(path)
    urls = rd.manifest(spark, path, "http://localhost:8081/data", "*.txt")
    return urls.groupBy(F.regexp_replace("value", "/[^/]*$", "").alias("folder")).agg(F.count_distinct("value").alias("files"))


def project_manifest(spark, d):
    listed = videos(spark, d).select(F.concat("path", F.lit(".mp4")).alias("path"))
    return wr.project_manifest(listed).select(F.to_json(F.struct("video", "annotations")).alias("entry"))


def yolo_labels(spark, d):
    path = scratch_path(spark, "yolo")
    lines = boxes(spark, d).select(
        "video", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("cls", "x1", "y1", "x2", "y2")]).alias("value")
    )
    lines.write.partitionBy("video").text(path)
    back = rd.read_yolo_labels(spark, path)
    return back.select(F.regexp_extract("file", r"video=(\d+)", 1).cast("long").alias("video"), "cls", "x", "y", "w", "h")


def training_metrics(spark, d):
    path = scratch_path(spark, "training-csv")
    log = table(spark, d, "part").select(
        F.col("p_partkey").alias("                  epoch"),
        *[
            (F.col("p_retailprice") / k).alias("   " + name)
            for k, name in enumerate(rd.TRAINING_COLUMNS, 1)
        ],
    )
    log.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return rd.read_training_metrics(spark, path)


def line_lists(spark, d):
    path = scratch_path(spark, "ids")
    wr.write_lines(table(spark, d, "documents").select("doc_id"), "doc_id", path)
    return spark.read.text(path)


def chunk_ids(spark, d):
    return su.chunk_ids(frames(spark, d), 480)


def chunk_files(spark, d):
    path = scratch_path(spark, "chunks")
    wr.write_chunks(frames(spark, d), path, 480, "frame")
    return st.count_by(spark.read.parquet(path), "chunk")


def subtitle_rows(spark, d):
    timeline = clock_timeline(clock_table(spark, d), FPS)
    named = timeline.withColumn("filename", F.concat(F.lit("mat "), F.col("video").cast("string")))
    named = named.withColumn("time_seconds_smooth", F.round("time_seconds_smooth", 1))
    return su.subtitle_rows(named, FPS, held="direction_over50frames")


def perf_files(spark, d):
    """Perf records in one folder per feature, read back with the feature from the path."""
    path = scratch_path(spark, "perf")
    rows = perf_records(spark, d).select(
        "test_metric", "label", "train_size", F.col("feature").alias("f"), F.col("label").alias("l")
    )
    rows.write.partitionBy("f", "l").json(path)
    back = rd.read_perf(spark, f"{path}/*/*/*.json", depth=3)
    feature = F.regexp_replace("feature", "^f=", "")
    return back.groupBy(feature.alias("feature"), "label").agg(
        F.count(F.lit(1)).alias("models"), F.sum("train_size").alias("train_size")
    )


QUERIES = {
    f.__name__: f
    for f in (
        json_roundtrip, json_combined, json_array, json_single, csv_head, subtitle_files, table_roundtrip, csv_consolidate, binary_manifest, url_manifest,
        project_manifest, yolo_labels, training_metrics, line_lists, chunk_ids, chunk_files, subtitle_rows, perf_files,
    )
}

_B = f"WITH {sql.BOXES}"
ORACLES = {
    "json_roundtrip": f"""WITH {sql.labels(1)}
        SELECT file, CAST(time AS BIGINT) AS time, is_match, is_active, is_standing FROM labels""",
    "json_combined": f"""WITH {sql.CLOCK} SELECT frame AS frame_number, CAST(video AS VARCHAR) AS filename, raw_text
        FROM readings""",
    "json_array": "SELECT s_suppkey, s_name FROM supplier",
    "json_single": f"""WITH {sql.PERF} SELECT label, count(*) AS models, CAST(sum(p_size * 10) AS BIGINT) AS train_size,
        CAST(1 AS BIGINT) AS files FROM perf GROUP BY label""",
    "csv_head": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    "subtitle_files": f"""WITH {sql.CLOCK} SELECT video, count(*) AS cues, CAST(sum(frame // 10 + 1) AS BIGINT) AS numbers
        FROM readings WHERE frame % 10 = 0 GROUP BY video""",
    "table_roundtrip": f"{_B} SELECT * FROM boxes",
    "csv_consolidate": f"""{_B} SELECT video, CAST(frame AS DOUBLE) AS "timestamp", phase, n_detections FROM phases""",
    "binary_manifest": """SELECT CAST(page_id % 5 AS INTEGER) AS "group",
        CAST(sum(length(base64(encode(html))) + 1) AS BIGINT) AS bytes FROM pages GROUP BY 1""",
    "url_manifest": """SELECT DISTINCT 'http://localhost:8081/data/mat=' || (s_suppkey % 7) || '/part=' || (s_suppkey % (s_suppkey % 7 + 1))
        AS folder, CAST(1 AS BIGINT) AS files FROM supplier""",
    "project_manifest": """SELECT '{"video":"' || s_name || '.mp4","annotations":[]}' AS entry FROM supplier""",
    "yolo_labels": f"{_B} SELECT video, CAST(cls AS VARCHAR) AS cls, x1 AS x, y1 AS y, x2 AS w, y2 AS h FROM boxes",
    "training_metrics": """SELECT CAST(p_partkey AS INTEGER) AS epoch, p_retailprice / 1 AS val_box_loss,
        p_retailprice / 2 AS val_classification_loss, p_retailprice / 3 AS "Precision", p_retailprice / 4 AS "Recall"
        FROM part""",
    "line_lists": "SELECT CAST(doc_id AS VARCHAR) AS value FROM documents",
    "chunk_ids": f"{_B} SELECT video, frame, CAST(frame // 480 AS INTEGER) AS chunk FROM frames",
    "chunk_files": f"""{_B} SELECT CAST(frame // 480 AS INTEGER) AS chunk, count(*) AS "count" FROM frames GROUP BY 1""",
    "subtitle_rows": f"""WITH {sql.CLOCK_RUNS}
        SELECT video, frame // 10 + 1 AS cue, (frame // 10 + 1) || chr(10)
          || printf('%02d:%02d:%02d,000 --> ', frame // 36000 % 24, frame // 600 % 60, frame // 10 % 60)
          || printf('%02d:%02d:%02d,000', (frame // 10 + 1) // 3600 % 24, (frame // 10 + 1) // 60 % 60, (frame // 10 + 1) % 60)
          || chr(10) || 'Frame ' || frame || chr(10) || 'Filename : mat ' || video
          || chr(10) || 'Available : ' || CASE WHEN available THEN 'True' ELSE 'False' END
          || chr(10) || 'Raw Text : ' || raw_text
          || chr(10) || 'Not processed timer : ' || coalesce(CAST(CAST(time_seconds AS DOUBLE) AS VARCHAR), 'nan')
          || chr(10) || 'Processed timer : ' || coalesce(CAST(round(time_seconds_smooth, 1) AS VARCHAR), 'nan')
          || chr(10) || 'Not processed : ' || CASE WHEN direction = 0 THEN 'Paused' ELSE 'Running' END
          || chr(10) || 'Processed : '
          || CASE WHEN direction = 0 AND run >= 50 THEN 'Paused' ELSE 'Running' END || chr(10) AS text
        FROM runs WHERE frame % 10 = 0""",
    "perf_files": f"""WITH {sql.PERF} SELECT feature, label, count(*) AS models,
        CAST(sum(p_size * 10) AS BIGINT) AS train_size FROM perf GROUP BY ALL""",
}
