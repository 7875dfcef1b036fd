"""Detection and motion queries."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.standins import boxes, frames, nested_frames, pixels, video_manifest
from footstats.functions.boxes import parse_boxes
from footstats.operators import detections as dt
from footstats.operators import motion as mo
from footstats.operators import statistics as st
from footstats.operators.quantiles import exact_quantile
from footstats.plans.motion_flow import motion_timeline
from footstats.sources.staging import stage

WIDTH, HEIGHT = 1280, 720


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def phase_classify(spark, d):
    return _round(dt.frame_phases(frames(spark, d), boxes(spark, d)), "cx", "cy")


def phase_nested(spark, d):
    return _round(dt.classify_phase(nested_frames(spark, d)).drop("boxes"), "cx", "cy")


def primary_center_text(spark, d):
    as_lists = F.transform("boxes", lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]))
    cells = nested_frames(spark, d).select("video", "frame", F.to_json(as_lists).alias("cell"))
    return _round(dt.primary_centers(cells, "cell").drop("cell"), "cx", "cy")


def phase_log(spark, d):
    """The log keeps the number of boxes and the boxes; the centre is read back from the boxes' cell."""
    log = dt.frame_phases(frames(spark, d), boxes(spark, d), keep="detections").drop("cx", "cy")
    kept = dt.primary_centers(log, "detections").withColumn("_boxes", parse_boxes(F.col("detections")))
    total = F.aggregate("_boxes", F.lit(0.0), lambda a, b: a + b["x1"] + b["x2"] + b["y1"] + b["y2"])
    kept = kept.select("video", "frame", "phase", "n_detections", F.size("_boxes").cast("long").alias("n_kept"), total.alias("coordinates"), "cx", "cy")
    return _round(kept, "coordinates", "cx", "cy")


def box_features(spark, d):
    return _round(dt.box_features(boxes(spark, d)), "aspect_ratio")


def box_percent(spark, d):
    return dt.box_to_percent(boxes(spark, d), F.lit(WIDTH), F.lit(HEIGHT))


def box_results(spark, d):
    named = dt.box_features(boxes(spark, d)).drop("aspect_ratio", "cls")
    percent = dt.box_to_percent(named, F.lit(WIDTH), F.lit(HEIGHT))
    results = dt.task_results(percent, F.lit(WIDTH), F.lit(HEIGHT), "label", "image")
    r = F.col("result")
    return results.select(
        "video", "frame", "place", r["type"].alias("type"), r["score"].alias("score"),
        F.round(r["value"]["x"], 6).alias("x"), r["value"]["rectanglelabels"][0].alias("name"),
        r["original_width"].alias("original_width"),
    )


def box_filter(spark, d):
    return dt.select_class(boxes(spark, d), confidence=0.2)


def top3_boxes(spark, d):
    return dt.top_boxes(boxes(spark, d), ["place"]).select("video", "frame", "place", "rank", "area")


def task_score(spark, d):
    return _round(dt.task_score(boxes(spark, d)), "score")


def boxes_per_frame(spark, d):
    return dt.boxes_per_frame(frames(spark, d), boxes(spark, d)).select("video", "frame", "place", "cls")


def colour_vote(spark, d):
    return dt.nearest_centroid_vote(pixels(spark, d))


def sampled_frames(spark, d):
    return _round(dt.sample_frames(frames(spark, d), 30), "timestamp")


def video_keys(spark, d):
    return dt.coalesce_keys(video_manifest(spark, d))


def valid_rows(spark, d):
    return st.valid_rows(dt.frame_phases(frames(spark, d), boxes(spark, d)), "cx", ["video"])


def _motion(spark, d):
    return motion_timeline(dt.frame_phases(frames(spark, d), boxes(spark, d)).drop("n_detections"))


def motion_filled(spark, d):
    log = dt.frame_phases(frames(spark, d), boxes(spark, d)).drop("n_detections", "phase")
    return _round(mo.fill_gaps_locf(log), "cx", "cy")


def motion_intensity(spark, d):
    return _round(_motion(spark, d), "dx", "dy", "intensity_score").select(
        "video", "frame", "dx", "dy", "intensity_score"
    )


def motion_smoothed(spark, d):
    return _round(_motion(spark, d), "smoothed_intensity").select("video", "frame", "phase", "smoothed_intensity")


def _staged_motion(spark, d):
    return stage(motion_smoothed(spark, d), "motion-smoothed")


def major_actions(spark, d):
    return _round(mo.major_actions(_staged_motion(spark, d), step=5), "threshold")


def motion_quantile(spark, d):
    return _round(exact_quantile(_staged_motion(spark, d), "smoothed_intensity", 0.995, ["video"], "q995"), "q995")


QUERIES = {
    f.__name__: f
    for f in (
        phase_classify, phase_log, phase_nested, primary_center_text, box_features, box_percent, box_results, box_filter,
        top3_boxes, task_score, boxes_per_frame, colour_vote, sampled_frames, video_keys, valid_rows,
        motion_filled, motion_intensity, motion_smoothed, major_actions, motion_quantile,
    )
}

_B, _M = f"WITH {sql.BOXES}", f"WITH {sql.MOTION}"
_NAME = "CASE cls WHEN 0 THEN 'player_blue' WHEN 1 THEN 'player_white' ELSE 'referee' END"
_SMOOTHED = f"""{_M}, rounded AS (SELECT video, frame, phase, round(smoothed_intensity, 6) AS smoothed_intensity
        FROM motion)"""
_QUANTILE = """limits AS (SELECT video, quantile_cont(smoothed_intensity, 0.995) AS threshold FROM rounded GROUP BY ALL)"""

ORACLES = {
    "phase_classify": f"""{_B} SELECT video, frame, n_detections, phase, round(cx, 6) AS cx, round(cy, 6) AS cy
        FROM phases""",
    "phase_log": f"""{_B}, kept AS (SELECT video, frame, count(*) AS n_kept, sum(x1 + x2 + y1 + y2) AS coordinates FROM boxes GROUP BY ALL)
        SELECT video, frame, phase, n_detections, coalesce(n_kept, 0) AS n_kept, round(coalesce(coordinates, 0), 6) AS coordinates,
               round(cx, 6) AS cx, round(cy, 6) AS cy FROM phases LEFT JOIN kept USING (video, frame)""",
    "phase_nested": f"""{_B} SELECT video, frame, n_detections, phase, round(cx, 6) AS cx, round(cy, 6) AS cy
        FROM phases WHERE n_detections > 0""",
    "primary_center_text": f"""{_B} SELECT video, frame, round(cx, 6) AS cx, round(cy, 6) AS cy
        FROM phases WHERE n_detections > 0""",
    "box_features": f"""{_B}, whole AS (
          SELECT video, frame, place, cls, confidence, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1,
                 CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2 FROM boxes)
        SELECT *, round((x2 - x1) / nullif(y2 - y1, 0), 6) AS aspect_ratio, {_NAME} AS name FROM whole""",
    "box_percent": f"""{_B} SELECT video, frame, place, cls, confidence, x1 / {WIDTH} * 100 AS x, y1 / {HEIGHT} * 100 AS y,
        (x2 - x1) / {WIDTH} * 100 AS width, (y2 - y1) / {HEIGHT} * 100 AS height FROM boxes""",
    "box_results": f"""{_B} SELECT video, frame, place, 'rectanglelabels' AS type, confidence AS score,
        round(trunc(x1) / {WIDTH} * 100, 6) AS x, {_NAME} AS name, {WIDTH} AS original_width FROM boxes""",
    "box_filter": f"{_B} SELECT * FROM boxes WHERE cls = 2 AND confidence >= 0.2",
    "top3_boxes": f"{_B} SELECT video, frame, place, rank, area FROM ranked WHERE rank <= 3",
    "task_score": f"""{_B} SELECT video, frame, round(avg(confidence), 6) AS score, count(*) AS boxes
        FROM boxes GROUP BY ALL""",
    "boxes_per_frame": f"""{_B} SELECT video, frame, place, cls FROM frames LEFT JOIN boxes USING (video, frame)""",
    "colour_vote": """WITH px AS (
          SELECT l_orderkey AS box_id, CAST(l_quantity AS BIGINT) * 5 % 256 AS r, l_partkey % 256 AS g,
                 CAST(floor(l_extendedprice) AS BIGINT) % 256 AS b FROM lineitem),
        dist AS (
          SELECT box_id, r * r + g * g + b * b AS d0,
                 (r - 24) * (r - 24) + (g - 19) * (g - 19) + (b - 81) * (b - 81) AS d1,
                 (r - 255) * (r - 255) + (g - 255) * (g - 255) + (b - 255) * (b - 255) AS d2 FROM px),
        best AS (
          SELECT box_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS i FROM dist),
        votes AS (SELECT box_id, i, count(*) AS n FROM best GROUP BY ALL),
        won AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY n DESC, i) AS rk FROM votes)
        SELECT box_id, CASE i WHEN 0 THEN 'referee' WHEN 1 THEN 'player_blue' ELSE 'player_white' END AS label,
               n AS votes FROM won WHERE rk = 1""",
    "sampled_frames": f"""{_B} SELECT video, frame, round(frame / 30, 6) AS "timestamp" FROM frames
        WHERE frame % 30 = 0""",
    "video_keys": """SELECT url AS video_path, CASE WHEN page_id % 5 = 0 THEN 'page ' || page_id
        ELSE regexp_extract(url, '([^/]*)$', 1) END AS video_name FROM pages WHERE page_id % 4 < 3""",
    "valid_rows": f"""{_B} SELECT video, count(*) AS "rows", count(cx) AS valid FROM phases GROUP BY ALL""",
    "motion_filled": f"{_M} SELECT video, frame, round(cx, 6) AS cx, round(cy, 6) AS cy FROM filled",
    "motion_intensity": f"""{_M} SELECT video, frame, round(dx, 6) AS dx, round(dy, 6) AS dy,
        round(intensity_score, 6) AS intensity_score FROM motion""",
    "motion_smoothed": f"{_SMOOTHED} SELECT * FROM rounded",
    "major_actions": f"""{_SMOOTHED}, {_QUANTILE}, peaks AS (
          SELECT r.*, threshold, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS n
          FROM rounded r JOIN limits USING (video) WHERE threshold > 0 AND smoothed_intensity > threshold)
        SELECT video, frame, phase, smoothed_intensity, round(threshold, 6) AS threshold FROM peaks WHERE n % 5 = 0""",
    "motion_quantile": f"{_SMOOTHED}, {_QUANTILE} SELECT video, round(threshold, 6) AS q995 FROM limits",
}
