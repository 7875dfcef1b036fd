"""Readers and writers in a temporary folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from footstats.operators import detections as dt
from footstats.sources import readers as rd
from footstats.sources import schemas as sc
from footstats.sources import writers as wr
from footstats.sources.staging import scratch_path, stage


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def files(path, suffix):
    return sorted(str(p.relative_to(path)) for p in path.rglob(f"*{suffix}"))


def test_binary_and_manifest(spark, tmp_path):
    put(tmp_path / "in/mat_01/0001/0000.jpg", b"abc")
    put(tmp_path / "in/mat_01/0001/note.txt", b"x")
    put(tmp_path / "in/mat 2/0001/0007.jpg", b"de")
    df = rd.read_binary(spark, str(tmp_path / "in"))
    assert {(r.path, bytes(r.content)) for r in df.collect()} == {("mat_01/0001/0000.jpg", b"abc"), ("mat 2/0001/0007.jpg", b"de")}
    plan = df.select("path", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    urls = {r.value for r in rd.manifest(spark, str(tmp_path / "in"), "http://localhost:8081/data/").collect()}
    assert "http://localhost:8081/data/mat_01/0001/note.txt" in urls and len(urls) == 3


def test_relative_paths(spark):
    df = spark.createDataFrame([("s3a://bucket/data/a/1.jpg",), ("file:/data/a/1.jpg",), ("/data/a/1.jpg",), ("/other/1.jpg",)], "p string")
    for root in ("s3a://bucket/data", "/data/", "file:///data"):
        got = [r.r for r in df.select(rd.relative_to(F.col("p"), root).alias("r")).collect()]
        assert got == ["a/1.jpg"] * 3 + ["/other/1.jpg"]


def test_json(spark, tmp_path):
    put(tmp_path / "j/a.json", json.dumps([{"filename": "f1", "frame_number": 1, "raw_text": "3:20"}], indent=2))
    put(tmp_path / "j/b.json", json.dumps([{"filename": "f2", "frame_number": 2}, {"filename": "f3"}], indent=2))
    put(tmp_path / "j/skip.txt", "no json")
    got = rd.combine_json(spark, str(tmp_path / "j"), sc.CLOCK_READINGS).collect()
    assert {(r.filename, r.frame_number, os.path.basename(r.source)) for r in got} == {("f1", 1, "a.json"), ("f2", 2, "b.json"), ("f3", None, "b.json")}
    wr.write_json(spark.range(20).repartition(4), str(tmp_path / "out"), files=1)
    assert len(files(tmp_path / "out", ".json")) == 1


def test_second_labels_with_either_time(spark, tmp_path):
    rows = [{"file": "a", "time": 0.0, "is_match": 1}, {"file": "a", "time": 1, "is_match": 0}]
    put(tmp_path / "labels.json", json.dumps(rows))
    got = rd.read_second_labels(spark, str(tmp_path / "labels.json"))
    assert dict(got.dtypes)["time"] == "bigint" and sorted(r.time for r in got.collect()) == [0, 1]


def test_perf(spark, tmp_path):
    line = json.dumps({"train_time": 1.5, "avg_metrics": [0.9], "test_metric": 0.8, "label": "is_match", "train_size": 3})
    put(tmp_path / "models/v4/emb_lag1/is_match/perf/part-0.json", line)
    put(tmp_path / "models/v4/emb/is_match/perf/part-0.json", line)
    got = rd.read_perf(spark, str(tmp_path / "models/v4/*/*/perf/*.json")).collect()
    assert {(r.feature, r.label, r.test_metric) for r in got} == {("emb_lag1", "is_match", 0.8), ("emb", "is_match", 0.8)}


def test_csv_with_bom(spark, tmp_path):
    put(tmp_path / "c/final_1_phases.csv", "﻿timestamp,phase,detections\n0.0,Ne-waza,\"[[0, 0, 2, 2]]\"\n1.0,Tachi-waza,2\n")
    put(tmp_path / "c/[Mat+2] a b_phases.csv", "timestamp,phase,detections\n0.0,Ne-waza,0\n")
    got = rd.consolidate_csv(spark, str(tmp_path / "c"), sc.PHASE_LOG).orderBy("video", "timestamp").collect()
    assert [(r.video, r.timestamp, r.phase) for r in got] == [
        ("[Mat+2] a b", 0.0, "Ne-waza"), ("final_1", 0.0, "Ne-waza"), ("final_1", 1.0, "Tachi-waza")
    ]
    wr.write_phases(spark.createDataFrame(got), str(tmp_path / "w"))
    back = rd.consolidate_csv(spark, str(tmp_path / "w"), sc.PHASE_LOG + ", video string")
    assert sorted(map(tuple, back.select("video", "timestamp").collect())) == [(r.video, r.timestamp) for r in got]


def test_consolidated_files_lose_no_rows(spark, tmp_path):
    put(tmp_path / "c/one_phases.csv", "timestamp,other,more\n0.5,x,y\n1.5,x,y\n")
    put(tmp_path / "c/none_phases.csv", "\nthis,that,\na,b,c\ntimestamp,phase,detections\n")
    put(tmp_path / "c/twice_phases.csv", "phase,phase,timestamp\np,q,2.5\n")
    put(tmp_path / "c/long_phases.csv", "phase,timestamp\n" + "".join(f"p{i},{i}\n" for i in range(5000)))
    put(tmp_path / "c/empty_phases.csv", "")
    with_splits = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    for k, v in with_splits.items():
        spark.conf.set(k, v)
    got = rd.consolidate_csv(spark, str(tmp_path / "c"), "timestamp double, phase string, detections string").collect()
    for k in with_splits:
        spark.conf.unset(k)
    rows = {v: sorted((r.timestamp, r.phase, r.detections) for r in got if r.video == v and r.timestamp is not None) for v in ("one", "twice", "long")}
    assert rows["one"] == [(0.5, None, None), (1.5, None, None)] and rows["twice"] == [(2.5, "p", None)]
    assert rows["long"] == [(float(i), f"p{i}", None) for i in range(5000)]
    assert [(r.timestamp, r.phase, r.detections) for r in got if r.video == "none"] == [(None, None, None)] * 2
    put(tmp_path / "d/bare_phases.csv", "0.0,Ne-waza,2\n1.0,Ne-waza,2\n")
    with pytest.raises(ValueError, match="bare_phases.csv"):
        rd.consolidate_csv(spark, str(tmp_path / "d"), "timestamp double, phase string, detections string")


def test_files_of_a_hot_video_are_bounded_and_in_order(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5)).alias("video"), F.col("id").cast("double").alias("timestamp"))
    wr.write_phases(rows.repartition(7), str(tmp_path / "p"), rows=400)
    wr.write_subtitles(rows.select("video", F.col("timestamp").cast("long").alias("cue"), F.col("timestamp").cast("string").alias("text")).repartition(7), str(tmp_path / "s"), rows=400)
    wr.write_chunks(rows.withColumn("frame_index", F.col("timestamp").cast("long")).repartition(7), str(tmp_path / "c"), size=2500, rows=400)
    for folder, pattern, skip in ((tmp_path / "p" / "video=hot", "*.csv", 1), (tmp_path / "s" / "video=hot", "*.txt", 0)):
        parts = [[float(x) for x in f.read_text().split("\n")[skip:] if x] for f in sorted(folder.glob(pattern))]
        assert len(parts) > 5 and max(map(len, parts)) <= 400
        assert [x for p in parts for x in p] == [float(i) for i in range(2500)]
    assert len(list((tmp_path / "c" / "chunk=0").glob("*.parquet"))) > 5


def test_arrays_of_a_folder_are_combined(spark, tmp_path):
    put(tmp_path / "j/a.json", '[\n {"frame_number": 1, "raw_text": "4:00"},\n {"frame_number": 2}\n]')
    put(tmp_path / "j/b.json", '[{"frame_number": 3}]')
    got = rd.combine_json(spark, str(tmp_path / "j"), sc.CLOCK_READINGS).collect()
    assert sorted((r.frame_number, r.source.rsplit("/", 1)[-1]) for r in got) == [(1, "a.json"), (2, "a.json"), (3, "b.json")]


def test_training_metrics(spark, tmp_path):
    put(tmp_path / "results.csv", "                  epoch,         val/box_loss,   val/cls_loss,   metrics/precision(B),   metrics/recall(B), lr\n"
        "                  0,     1.5,   2.5,    0.25,   0.75, 1\n")
    r = rd.read_training_metrics(spark, str(tmp_path / "results.csv")).first()
    assert tuple(r) == (0, 1.5, 2.5, 0.25, 0.75)


def test_yolo(spark, tmp_path):
    put(tmp_path / "l/0001.txt", "0 0.5 0.5 0.1 0.2\n3 0.1 0.1 0.1 0.1\n3 0.2 0.2 0.1 0.1\n")
    put(tmp_path / "l/0002.txt", "1 0.5 0.5 0.1 0.2\n\n")
    df = rd.read_yolo_labels(spark, str(tmp_path / "l"))
    assert df.count() == 4 and df.where("cls = '0'").first().h == 0.2
    assert [r.file for r in dt.bad_class_files(df).collect()] == ["0001.txt", "0001.txt"]


def test_chunks_lines_and_manifest(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("frame_index"))
    wr.write_chunks(df, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert {(r.chunk, r["count"]) for r in back.groupBy("chunk").count().collect()} == {(0, 480), (1, 480), (2, 40)}
    wr.write_lines(df.limit(3), "frame_index", str(tmp_path / "ids"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["0", "1", "2"]
    paths = spark.createDataFrame([("a/1.mp4",), ("a/2.txt",)], "path string")
    got = wr.project_manifest(paths)
    assert got.toJSON().collect() == ['{"video":"a/1.mp4","annotations":[]}']
    assert wr.project_manifest(paths.where("false")).isEmpty()


def test_subtitle_files(spark, tmp_path):
    cues = spark.createDataFrame([("v", 2, "2\nb\n"), ("v", 1, "1\na\n"), ("w", 1, "1\nc\n")], "video string, cue long, text string")
    wr.write_subtitles(cues, str(tmp_path / "srt"))
    parts = [(tmp_path / "srt" / f).read_text() for f in files(tmp_path / "srt", ".txt") if f.startswith("video=v")]
    assert "".join(parts) == "1\na\n\n2\nb\n\n"


def test_table_files_stay_bounded(spark, tmp_path):
    for n in (1000, 4000):
        path = str(tmp_path / str(n))
        wr.write_table(spark.range(n).coalesce(2), path, 3, rows=100)
        back = spark.read.parquet(path)
        sizes = [r["count"] for r in back.groupBy("_metadata.file_name").count().collect()]
        assert len(sizes) == n // 100 and max(sizes) <= 110
        assert sorted(r.id for r in back.collect()) == list(range(n))


def test_table_and_staging(spark, tmp_path):
    wr.write_table(spark.range(100), str(tmp_path / "t"), 3)
    assert len(files(tmp_path / "t", ".parquet")) == 3
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(5).withColumn("s", F.lit("a"))
    assert stage(df, "t").dtypes == df.dtypes and stage(df, "t").count() == 5
