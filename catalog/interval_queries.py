"""Interval and label queries."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.standins import annotation_export
from footstats.functions import intervals as iv
from footstats.operators import intervals as ops
from footstats.operators import statistics as st
from footstats.sources.staging import stage
from footstats.plans.label_flow import raw_intervals, second_labels


def intervals_loaded(spark, d):
    lists = ops.load_intervals(annotation_export(spark, d))
    return _long(lists)


def _long(lists):
    kinds = (("Match", "matches"), ("Active", "actives"), ("Standing", "standings"))
    tagged = F.concat(*[ops.tag_intervals(name, label) for label, name in kinds])
    return ops.intervals_long(lists.select("file", tagged.alias("annotations")))


def intervals_clamped(spark, d):
    return _long(ops.clamp_intervals(ops.load_intervals(annotation_export(spark, d))))


def intervals_contained(spark, d):
    lists = ops.clamp_intervals(ops.load_intervals(annotation_export(spark, d)))
    inner = lambda p: iv.contained(F.col("actives"), p["start"], p["end"])
    return lists.select("file", F.inline(F.flatten(F.transform("matches", inner))))


def intervals_complement(spark, d):
    long = ops.intervals_long(raw_intervals(annotation_export(spark, d)))
    return long.where(F.col("label").startswith("Not "))


def intervals_long(spark, d):
    return ops.intervals_long(raw_intervals(annotation_export(spark, d)))


def file_bounds(spark, d):
    return ops.file_bounds(intervals_long(spark, d))


def _labels(step):
    def query(spark, d):
        return second_labels(annotation_export(spark, d), step)

    return query


def covering_join(spark, d):
    # Points and intervals come from one staged table.
    long = stage(intervals_long(spark, d), "intervals")
    points = ops.recording_points(ops.file_bounds(long), 1)
    return ops.join_covering(points, long).groupBy("file", "time").agg(
        *[F.count(F.when(F.col("label") == l, 1)).alias(l.lower()) for l in ("Match", "Active", "Standing")]
    )


def label_combo_counts(spark, d):
    return st.label_combo_counts(_labels(1)(spark, d))


def label_rates(spark, d):
    return st.label_rates(_labels(1)(spark, d))


def label_describe(spark, d):
    described = st.describe_cols(_labels(1)(spark, d), list(st.LABEL_COLUMNS))
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


def files_distinct(spark, d):
    return st.distinct_count(_labels(1)(spark, d), ["file"])


QUERIES = {
    "intervals_loaded": intervals_loaded,
    "intervals_clamped": intervals_clamped,
    "intervals_contained": intervals_contained,
    "intervals_complement": intervals_complement,
    "intervals_long": intervals_long,
    "file_bounds": file_bounds,
    "intervals_discrete": _labels(1),
    "intervals_discrete_5s": _labels(5),
    "covering_join": covering_join,
    "label_combo_counts": label_combo_counts,
    "label_rates": label_rates,
    "label_describe": label_describe,
    "files_distinct": files_distinct,
}

_LABELS = sql.labels(1)
_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS stddev,
        CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max" FROM labels"""
    for c in ("is_match", "is_active", "is_standing")
)

ORACLES = {
    "intervals_loaded": f"""WITH {sql.TASKS}
        SELECT file, label, s AS start, e AS "end" FROM tasks WHERE label <> 'Unsure'""",
    "intervals_clamped": f"""WITH {sql.INTERVALS} SELECT file, label, s AS start, e AS "end" FROM clamped""",
    "intervals_contained": f"""WITH {sql.INTERVALS}
        SELECT file, s AS start, e AS "end" FROM inside WHERE label = 'Not Active'""",
    "intervals_complement": f"""WITH {sql.INTERVALS} SELECT file, label, s AS start, e AS "end" FROM gaps""",
    "intervals_long": f"""WITH {sql.INTERVALS} SELECT file, label, s AS start, e AS "end" FROM long""",
    "file_bounds": f"""WITH {sql.INTERVALS}
        SELECT file, min(s) AS min_start, max(e) AS max_end FROM long GROUP BY file""",
    "intervals_discrete": f"WITH {_LABELS} SELECT file, time, is_match, is_active, is_standing FROM labels",
    "intervals_discrete_5s": f"WITH {sql.labels(5)} SELECT file, time, is_match, is_active, is_standing FROM labels",
    "covering_join": f"""WITH {_LABELS}
        SELECT p.file, p.t AS time, count(CASE WHEN label = 'Match' THEN 1 END) AS "match",
               count(CASE WHEN label = 'Active' THEN 1 END) AS active,
               count(CASE WHEN label = 'Standing' THEN 1 END) AS standing
        FROM points p JOIN long l ON l.file = p.file AND l.s <= p.t AND l.e >= p.nxt GROUP BY p.file, p.t""",
    "label_combo_counts": f"""WITH {_LABELS}
        SELECT is_match, is_active, is_standing, count(*) AS "count" FROM labels GROUP BY ALL""",
    "label_rates": f"""WITH {_LABELS}
        SELECT round(sum(is_match) / count(*), 3) AS pct_match,
               round(sum(is_active) / sum(is_match), 3) AS pct_active,
               round(sum(is_standing) / sum(is_match), 3) AS pct_standing FROM labels""",
    "label_describe": f"WITH {_LABELS} {_DESCRIBE}",
    "files_distinct": f"WITH {_LABELS} SELECT count(DISTINCT file) AS distinct_count FROM labels",
}
