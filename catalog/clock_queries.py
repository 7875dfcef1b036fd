"""Clock and match queries."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.standins import FPS, PAUSE_LIMIT_SECONDS, clock_readings, clock_table
from footstats.operators.clock import fill_clock, parse_clock
from footstats.operators.matches import mean_rest_ratio, run_ratios
from footstats.plans.clock_flow import clock_matches, clock_timeline, smoothed_clock


def clock_parse(spark, d):
    return parse_clock(clock_readings(spark, d))


def clock_fill(spark, d):
    return fill_clock(parse_clock(clock_table(spark, d)), FPS).select(
        "video", "frame", "time_seconds", F.round("time_seconds_filled", 6).alias("time_seconds_filled")
    )


def clock_smooth(spark, d):
    return smoothed_clock(clock_table(spark, d), FPS).select(
        "video", "frame", F.round("time_seconds_smooth", 6).alias("time_seconds_smooth"), "direction"
    )


def _runs(seconds):
    def query(spark, d):
        timeline = clock_timeline(clock_table(spark, d), FPS)
        return timeline.select("video", "frame", "direction", F.col(f"direction_over{seconds * FPS}frames").alias("held"))

    return query


def _matches(cumulative):
    def query(spark, d):
        return clock_matches(
            clock_table(spark, d), FPS, PAUSE_LIMIT_SECONDS, cumulative_pause=cumulative
        )[1]

    return query


def _ratios(spark, d):
    runs, segments = clock_matches(clock_table(spark, d), FPS, PAUSE_LIMIT_SECONDS)
    return run_ratios(runs, segments)


def rest_ratio(spark, d):
    return _ratios(spark, d).select(
        "video", "start_frame", "end_frame", "count_zero", "count_not_zero",
        F.round("zero_ratio", 6).alias("zero_ratio"), F.round("not_zero_ratio", 6).alias("not_zero_ratio"),
    )


def rest_ratio_mean(spark, d):
    return mean_rest_ratio(_ratios(spark, d)).select(
        F.round("mean_zero_ratio", 6).alias("mean_zero_ratio"),
        F.round("mean_not_zero_ratio", 6).alias("mean_not_zero_ratio"),
        "matches",
    )


QUERIES = {
    "clock_parse": clock_parse,
    "clock_fill": clock_fill,
    "clock_smooth": clock_smooth,
    **{f"running_flags_{s}s": _runs(s) for s in (3, 5, 10, 15)},
    "match_segments": _matches(True),
    "match_segments_unbroken": _matches(False),
    "rest_ratio": rest_ratio,
    "rest_ratio_mean": rest_ratio_mean,
}

ORACLES = {
    "clock_parse": f"""WITH {sql.CLOCK}
        SELECT event_id, video, frame, raw_text, available, minutes, seconds, time_seconds FROM clock""",
    "clock_fill": f"""WITH {sql.CLOCK_FILLED}
        SELECT video, frame, time_seconds, round(time_seconds_filled, 6) AS time_seconds_filled FROM filled""",
    "clock_smooth": f"""WITH {sql.CLOCK_SMOOTH}
        SELECT video, frame, round(time_seconds_smooth, 6) AS time_seconds_smooth, direction FROM directed""",
    **{
        f"running_flags_{s}s": f"""WITH {sql.CLOCK_RUNS}
        SELECT video, frame, direction,
               CASE WHEN direction = 0 AND run < {s * FPS} THEN -1 ELSE direction END AS held FROM runs"""
        for s in (3, 5, 10, 15)
    },
    "match_segments": f"""WITH RECURSIVE {sql.CLOCK_MATCHES}
        SELECT video, start_frame, end_frame FROM segments""",
    "match_segments_unbroken": f"""WITH {sql.CLOCK_RUNS},
        marked AS (
          SELECT *, sum(running) OVER (PARTITION BY video ORDER BY frame) AS grp FROM flags),
        pauses AS (
          SELECT video, grp, min(frame) AS b, count(*) AS r FROM marked WHERE running = 0 GROUP BY ALL),
        long AS (SELECT *, lag(b + r) OVER (PARTITION BY video ORDER BY b) AS resume FROM pauses WHERE r > 50),
        firsts AS (SELECT video, min(frame) AS f FROM flags WHERE running = 1 GROUP BY video)
        SELECT video, coalesce(resume, f) AS start_frame, b + 50 AS end_frame
        FROM long JOIN firsts USING (video) WHERE coalesce(resume, f) < b""",
    "rest_ratio": f"""WITH RECURSIVE {sql.CLOCK_RATIOS}
        SELECT video, start_frame, end_frame, count_zero, count_not_zero,
               round(count_zero / (count_zero + count_not_zero), 6) AS zero_ratio,
               round(count_not_zero / (count_zero + count_not_zero), 6) AS not_zero_ratio FROM ratios""",
    "rest_ratio_mean": f"""WITH RECURSIVE {sql.CLOCK_RATIOS}
        SELECT round(avg(count_zero / (count_zero + count_not_zero)), 6) AS mean_zero_ratio,
               round(avg(count_not_zero / (count_zero + count_not_zero)), 6) AS mean_not_zero_ratio,
               count(*) AS matches FROM ratios""",
}
