"""Row-level rules and small aggregates: paths, boxes, plans, annotations, splits, names."""

import zlib

import pytest
from pyspark.sql import functions as F

from footstats.functions import features as fe
from footstats.functions import paths as p
from footstats.operators import annotations as an
from footstats.operators import dedup as dd
from footstats.operators import detections as dt
from footstats.operators import frames as fr
from footstats.operators import reports as rp
from footstats.operators import splits as sp
from footstats.operators import statistics as st
from footstats.operators import subtitles as su
from footstats.plans import shots
from footstats.vocab import GESTURE_CLASSES


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_paths(spark):
    r = fr.parse_frame_path(spark.createDataFrame([("/mnt/x/frames/mat_01/0003/0000.jpg",)], "path string")).first()
    assert (r.mat, r.batch_id, r.frame_id, r.timestamp) == (1, 3, 0, 1800)
    r = fr.frame_key(spark.createDataFrame([("data/clips/mat_01/0001/0007.jpg",)], "path string")).first()
    assert (r.file, r.time) == ("data/clips/mat_01/0001.mp4", 7)
    assert one(spark, "mat_01/0000/0398_00.png", p.crop_to_frame) == "mat_01/0000/0398.jpg"
    assert one(spark, "mat_01/0000/0398.png", p.crop_to_frame) == "mat_01/0000/0398.jpg"
    assert one(spark, "mat_01/a_b/0398.v2_x_1.png", p.crop_to_frame) == "mat_01/a_b/0398.v2.jpg"
    assert one(spark, "http://h/data/clips/mat/1.mp4", lambda c: p.url_tail(c, 4)) == "data/clips/mat/1.mp4"
    assert one(spark, "1.mp4", lambda c: p.url_tail(c, 4)) == "1.mp4"
    assert one(spark, "http://h/f/a.png", lambda c: p.strip_prefix(c, "http://h/f/")) == "a.png"
    assert one(spark, "/x/[Mat+12] final.mp4", p.mat_key) == 12
    assert one(spark, "no mat", p.mat_key) is None


def test_probabilities(spark):
    df = spark.createDataFrame(
        [(["a", "b"], [0.5, 0.5]), (["b", "a"], [0.1, 0.9]), (["a"], [1.0])], "labels array<string>, prob array<double>"
    )
    r = fr.expand_probs(fr.predict_label(df), ["a", "b"]).collect()
    assert [(x.predicted_index, x.predicted_label, x.a, x.b) for x in r] == [
        (0, "a", 0.5, 0.5), (1, "a", 0.9, 0.1), (0, "a", 1.0, None)
    ]


@pytest.mark.parametrize("size", [3, 1000])
def test_context_and_padding(spark, size):
    rows = [(m, t, float(t)) for m in (1, 2) for t in (0, 1, 5, 6, 20)]
    df = spark.createDataFrame(rows, "mat int, timestamp int, v double")
    got = fr.context_window(df, 4, lambda w: {"n": F.count("v").over(w), "s": F.sum("v").over(w)}, size=size)
    for r in got.collect():
        near = [t for t in (0, 1, 5, 6, 20) if abs(t - r.timestamp) <= 4]
        assert (r.n, r.s) == (len(near), float(sum(near)))
    padded = fr.pad_edges(df, 3).where("mat = 1").orderBy("timestamp").collect()
    assert [(r.timestamp, r.v) for r in padded] == [
        (-3, 0.0), (-2, 0.0), (-1, 0.0), (0, 0.0), (1, 1.0), (5, 5.0), (6, 6.0), (20, 20.0), (21, 20.0), (22, 20.0), (23, 20.0)
    ]


BOX = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def test_phases(spark):
    tall = lambda *hs: [(0.0, 0.0, 10.0, float(h)) for h in hs]
    cases = [(1, tall(100, 160, 220), "Tachi-waza"), (2, tall(150, 150), "Ne-waza"), (3, tall(200), "No-Match/Intermission"),
             (4, [], "No-Match/Intermission"), (5, [(0.0, None, 1.0, 2.0), (0.0, 0.0, 1.0, 2.0)], "Unknown")]
    df = spark.createDataFrame([(i, b) for i, b, _ in cases], f"frame int, boxes {BOX}")
    got = {r.frame: r for r in dt.classify_phase(df).collect()}
    for i, b, phase in cases:
        assert (got[i].phase, got[i].n_detections) == (phase, len(b))
    long = spark.createDataFrame(
        [(i, n, *b) for i, bs, _ in cases for n, b in enumerate(bs)],
        "frame int, place int, x1 double, y1 double, x2 double, y2 double",
    )
    frames = spark.createDataFrame([(i,) for i, _, _ in cases], "frame int")
    again = {r.frame: r for r in dt.frame_phases(frames, long, ["frame"]).collect()}
    for i, _, phase in cases:
        assert again[i].phase == phase
        if i != 5:
            assert (again[i].cx, again[i].cy) == (got[i].cx, got[i].cy)


def test_primary_center_ties_and_text(spark):
    cells = ["[[0,0,2,2],[10,10,12,12],[0,0,1,1]]", "[]", "3", "broken", None, "[[0, 0, 1.5, 2], [0, 0, 4, 4]]"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    got = [(r.cx, r.cy) for r in dt.primary_centers(df, "cell").collect()]
    none = (None, None)
    assert got == [(1.0, 1.0), none, none, none, none, (2.0, 2.0)]


def test_boxes(spark):
    df = spark.createDataFrame(
        [("v", 0, 0, 1.9, 2.9, 11.2, 7.1, 0.5, 0), ("v", 0, 2, 0.0, 0.0, 64.0, 36.0, 0.1, 1), ("v", 1, 2, 5.0, 5.0, 6.0, 5.0, 0.9, 0)],
        "video string, frame int, cls int, x1 double, y1 double, x2 double, y2 double, confidence double, place int",
    )
    r = dt.box_features(df).collect()
    assert (r[0].x1, r[0].y1, r[0].x2, r[0].y2, r[0].aspect_ratio, r[0].name) == (1, 2, 11, 7, 2.0, "player_blue")
    assert r[2].aspect_ratio is None and r[2].name == "referee"
    q = dt.box_to_percent(df, F.lit(640), F.lit(360)).collect()[1]
    assert (q.x, q.y, q.width, q.height) == (0.0, 0.0, 10.0, 10.0)
    assert dt.select_class(df).count() == 2 and dt.select_class(df, confidence=0.2).count() == 1
    top = dt.top_boxes(df, ["place"], k=1).orderBy("frame").collect()
    assert [(t.frame, t.place, t["rank"]) for t in top] == [(0, 1, 1), (1, 0, 1)]
    assert {(t.frame, round(t.score, 3), t.boxes) for t in dt.task_score(df).collect()} == {(0, 0.3, 2), (1, 0.9, 1)}
    frames = spark.createDataFrame([("v", 0), ("v", 1), ("v", 2)], "video string, frame int")
    assert dt.boxes_per_frame(frames, df).count() == 4
    assert {(s.frame, s.timestamp) for s in dt.sample_frames(frames, 2, 2).collect()} == {(0, 0.0), (2, 1.0)}


def test_manifest_keys(spark):
    rows = [("a/1.mp4", None, None, None, None), ("", "b/2.mp4", None, None, "two"), (None, None, "c/3.mp4", "three", "x"), ("", None, "", None, "none")]
    df = spark.createDataFrame(rows, "video string, video_path string, path string, video_name string, name string")
    assert {tuple(r) for r in dt.coalesce_keys(df).collect()} == {("a/1.mp4", "1.mp4"), ("b/2.mp4", "two"), ("c/3.mp4", "three")}


def test_colour_vote(spark):
    rows = [("a", 0, 0, 0), ("a", 250, 250, 250), ("b", 20, 20, 90), ("b", 24, 19, 81), ("b", 0, 0, 0), ("c", 255, 255, 255)]
    got = dt.nearest_centroid_vote(spark.createDataFrame(rows, "box_id string, r int, g int, b int")).collect()
    assert {(r.box_id, r.label, r.votes) for r in got} == {("a", "referee", 1), ("b", "player_blue", 2), ("c", "player_white", 1)}


def test_plans(spark):
    videos = spark.createDataFrame([("b.mp4", 1250), ("a.mp4", 10)], "path string, total_seconds int")
    plan = shots.batch_plan(videos, 0, 20, 1, 5).orderBy("path", "seq_id").collect()
    assert [(r.seq_id, r.offset, r.duration) for r in plan if r.path == "a.mp4"] == [(0, 0, 5), (1, 5, 5), (2, 10, 5), (3, 15, 5)]
    assert (plan[0].prefix, plan[-1].prefix) == ("mat_01/0000", "mat_02/0003")
    with pytest.raises(ValueError):
        shots.batch_plan(videos, 0, 20, 1, 30)
    twice = shots.batch_plan(videos, 0, 20, 2, 10, unit="seconds").where("path = 'a.mp4'").orderBy("seq_id").collect()
    assert [(r.offset, r.duration) for r in twice] == [(0.0, 5.0), (5.0, 5.0), (10.0, 5.0), (15.0, 5.0)]
    clips = shots.clip_plan(videos, 600).orderBy("path", "clip").collect()
    assert [(r.path, r.start, r.name) for r in clips] == [
        ("a.mp4", 0, "0000.mp4"), ("b.mp4", 0, "0000.mp4"), ("b.mp4", 600, "0001.mp4"), ("b.mp4", 1200, "0002.mp4")
    ]
    assert shots.clip_plan(videos, 600, 700).count() == 1


@pytest.mark.parametrize("offset", [0, 25, -25, 100_000])
def test_clip_plan_deals_long_recordings(spark, offset):
    totals = {"long": 200_005, "even": 640, "short": 3, "none": 0, "unknown": None, None: 50}
    videos = spark.createDataFrame([*totals.items()], "path string, total_seconds long").coalesce(1)
    plan = shots.clip_plan(videos, 10, offset, stretch=64, rows=1000)
    want = [
        (path, i, offset + i * 10, 10, f"{i:04d}.mp4")
        for path, total in totals.items() if total is not None
        for i in range(max(1, -(-total // 10))) if offset + i * 10 < total
    ]
    assert sorted(map(tuple, plan.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, shots.clip_plan(videos, 10, offset).collect()), key=repr) == sorted(want, key=repr)
    assert shots.clip_plan(videos.where("false"), 10, offset).isEmpty()


def test_clip_plan_tasks_stay_small(spark):
    for n in (1, 8):
        videos = spark.createDataFrame([("long", 100_000 * n), *[(f"v{i}", 10) for i in range(500 * n)]], "path string, total_seconds long")
        plan = shots.clip_plan(videos.coalesce(1), 10, 0, stretch=64, rows=1000)
        sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_500 * n and max(sizes) < 2500


def test_clip_plan_longest_task_stays_at_ten_times_the_table(spark):
    # Recordings as long as their key is large: ten times the rows are a hundred times the clips.
    most = {}
    for n in (1000, 10_000):
        videos = spark.range(n).selectExpr("concat('v', id) AS path", "id * 240 + 1 AS total_seconds").coalesce(1)
        sizes = [r["count"] for r in shots.clip_plan(videos).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == sum(-(-(i * 240 + 1) // 600) for i in range(n))
        most[n] = max(sizes)
    assert most[10_000] < 10 * most[1000] and most[10_000] < 1_250_000


def test_annotations(spark):
    rows = [
        (1, 1, 10.0, "2024-02-01T10:00:00Z", "u1", "manual"), (1, 1, 99.0, "2024-02-01T11:00:00Z", "u1", "prediction"),
        (1, 2, 20.0, "2024-03-05T00:00:00Z", "u2", "manual"), (1, 1, 30.0, "2024-03-22T00:00:00Z", "u3", "prediction-changed"),
        (1, 1, 50.0, "2024-03-22T08:00:00Z", "u4", "prediction-changed"),
    ]
    df = spark.createDataFrame(rows, "project int, completed_by int, lead_time double, updated_at string, unique_id string, origin string")
    ann = an.version_bucket(df)
    assert [r.model_version for r in ann.orderBy("updated_at").collect()] == ["v0", "v0", "v1", "v2", "v2"]
    assert {tuple(r) for r in an.units_by_version(ann).collect()} == {("v0", 1, 2), ("v1", 1, 1), ("v2", 2, 2)}
    pivot = {r.model_version: r for r in an.origin_pivot(ann).collect()}
    assert (pivot["v0"].manual, pivot["v0"].pred, pivot["v0"].pred_changed, pivot["v0"].manual_ratio) == (1, 1, None, 0.5)
    assert [r.model_version for r in an.origin_pivot(ann, 2).collect()] == ["v1"]
    lead = {r.model_version: r for r in an.lead_time_stats(ann).collect()}
    assert (lead["v0"].avg_lead_time, lead["v0"].median_lead_time, lead["v0"].ci95) == (10.0, 10.0, None)
    assert (lead["v2"].avg_lead_time, lead["v2"].median_lead_time, lead["v2"].std_lead_time, lead["v2"].ci95) == (40.0, 40.0, 14.14, 19.6)
    assert {tuple(r) for r in an.unit_histogram(ann).collect()} == {("v0", 2, 1), ("v1", 1, 1), ("v2", 1, 2)}
    assert [(str(r.updated_at)[:10], r["count"]) for r in an.units_per_day(df).collect()] == [("2024-02-01", 1), ("2024-03-05", 1), ("2024-03-22", 2)]


def test_first_choice_and_classes(spark):
    rows = [
        (("img/1",), [([(( ["point"],),)],)]), (("img/2",), [([],)]), (("img/3",), []), (("img/4",), [([(( ["unknown"],),)],)]),
    ]
    ddl = "data struct<image:string>, annotations array<struct<result:array<struct<value:struct<choices:array<string>>>>>>"
    got = st.encode_class(an.first_choice(spark.createDataFrame(rows, ddl)), "choice", GESTURE_CLASSES).collect()
    assert {tuple(r) for r in got} == {("img/1", "point", 1), ("img/4", "unknown", None)}


def test_confusion(spark):
    counts = spark.createDataFrame([("match", 353, 327, 5, 7)], "class string, tp long, tn long, fp long, fn long")
    r = st.confusion_scores(counts).first()
    assert [round(x, 4) for x in (r.accuracy, r.precision, r.recall, r.f1)] == [0.9827, 0.986, 0.9806, 0.9833]
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "actual string, predicted string")
    got = {x["class"]: x for x in st.confusion_metrics(pairs, "actual", "predicted").collect()}
    assert (got["a"].tp, got["a"].fn, got["a"].fp, got["a"].tn) == (1, 1, 1, 1)
    assert got["c"].precision is None and got["c"].recall == 0.0


def test_dedup(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, text string")
    b = spark.createDataFrame([(9, "x"), (8, "x")], "id int, text string")
    assert {r.id for r in dd.hash_semi(a, b, "text", ["id"]).collect()} == {1, 2}
    assert {r.id for r in dd.dup_files(b, a, "text", ["id"]).collect()} == {1, 2}
    assert {r.id for r in dd.dup_files(b, a, "text", ["id"], "missing").collect()} == {3, 4}
    tasks = spark.createDataFrame([(1, "http://h/a/b/c.png"), (2, "http://h/a/b/d.png")], "id int, image string")
    files = spark.createDataFrame([("/x/a/b/c.png",), ("/y/a/b/c.png",), ("/z/q/b/d.png",)], "path string")
    assert [tuple(r) for r in dd.join_path_tail(tasks, files, ["id"]).select("id", "matches").collect()] == [(1, 2)]


def test_splits(spark):
    names = [f"file_{i}.mp4" for i in range(400)]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    want = {n: "train" if zlib.crc32(n.encode()) % 100 < 80 else "test" for n in names}
    assert {r.file: r.split for r in sp.split_crc32(df).collect()} == want
    sizes = {r.split: r["count"] for r in st.count_by(sp.split_exact(df, "file"), "split").collect()}
    assert sizes == {"train": 280, "val": 60, "test": 60}
    rough = {r.split: r["count"] for r in st.count_by(sp.split_hash(df, "file", [0.7, 0.15, 0.15]), "split").collect()}
    assert abs(rough["train"] - 280) < 40 and sum(rough.values()) == 400
    assert sp.split_hash(df, "file", [0.6, 0.4], seed=1).collect() != sp.split_hash(df, "file", [0.6, 0.4], seed=2).collect()


def test_reports(spark):
    assert one(spark, "emb_entity_detection_v2_dct_d16_lag3", fe.lag_number) == 3
    assert one(spark, "emb_vanilla_yolov8n", fe.lag_number) == 0
    assert one(spark, "emb_entity_detection_v2_dct", fe.feature_title) == "fine tune v2 dct"
    assert one(spark, "emb_vanilla_yolov8n", fe.feature_title) == "vanilla yolov8n"
    df = spark.createDataFrame([("a", i, i % 3) for i in range(9)], "g string, id int, v int")
    top = rp.top_k_per_group(df, 2, ["g"], [F.desc("v"), "id"], "rank").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in top] == [(2, 1), (5, 2)]


def test_subtitles(spark):
    ddl = "video string, frame long, filename string, available boolean, raw_text string, time_seconds int, time_seconds_smooth double, direction int, direction_over150frames int"
    rows = [("v", i, "[Mat+1]", i % 2 == 0, "3:20", 200 if i else None, None if i < 3 else 199.5, 0, -1) for i in range(7)]
    got = su.subtitle_rows(spark.createDataFrame(rows, ddl), 3).orderBy("cue").collect()
    assert [r.cue for r in got] == [1, 2, 3]
    assert got[1].text.split("\n") == [
        "2", "00:00:01,000 --> 00:00:02,000", "Frame 3", "Filename : [Mat+1]", "Available : False", "Raw Text : 3:20",
        "Not processed timer : 200.0", "Processed timer : 199.5", "Not processed : Paused", "Processed : Running", "",
    ]
    assert "Not processed timer : nan" in got[0].text and "Processed timer : nan" in got[0].text
    assert [r.cue for r in su.subtitle_rows(spark.createDataFrame(rows, ddl), 2.5).orderBy("cue").collect()] == [1, 2, 3]
