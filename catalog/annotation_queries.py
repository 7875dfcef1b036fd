"""Labelling-effort and report queries."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.standins import VERSION_CUTS, annotation_export, annotation_results, perf_records
from footstats.functions.features import feature_title, label_title
from footstats.operators import annotations as an
from footstats.operators import reports as rp
from footstats.operators import statistics as st


def _versions(spark, d):
    return an.version_bucket(annotation_results(spark, d), VERSION_CUTS)


def ann_explode(spark, d):
    results = an.explode_results(an.explode_annotations(annotation_export(spark, d)))
    return st.count_by(an.version_bucket(results), "unique_id", "origin", "model_version", "lead_time")


def ann_by_project(spark, d):
    return st.count_by(annotation_results(spark, d), "project")


def ann_by_annotator(spark, d):
    return st.count_by(annotation_results(spark, d), "completed_by", "project").orderBy("completed_by", "project")


def ann_by_origin(spark, d):
    return st.count_by(annotation_results(spark, d), "origin")


def ann_describe(spark, d):
    described = st.describe_cols(annotation_results(spark, d), ["lead_time"], ["project"])
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


def ann_unit_describe(spark, d):
    described = st.describe_cols(st.count_by(annotation_results(spark, d), "unique_id"), ["count"])
    return described.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


def ann_units_by_version(spark, d):
    return an.units_by_version(_versions(spark, d))


def ann_first_lead_time(spark, d):
    return an.first_per_unit(_versions(spark, d), ["model_version", "unique_id"], "lead_time")


def ann_per_day(spark, d):
    return an.units_per_day(annotation_results(spark, d)).select(
        F.date_format("updated_at", "yyyy-MM-dd").alias("day"), "count"
    )


def _pivot(annotator):
    return lambda spark, d: an.origin_pivot(_versions(spark, d), annotator)


def ann_lead_time(spark, d):
    return an.lead_time_stats(_versions(spark, d))


def ann_lead_time_one(spark, d):
    return an.lead_time_stats(_versions(spark, d), annotator=1, ci=False)


def ann_unit_histogram(spark, d):
    return an.unit_histogram(_versions(spark, d))


def report_clean(spark, d):
    return rp.order_report(rp.where_contains(rp.score_table(perf_records(spark, d), titles=True), "lag", negate=True))


def report_contains(spark, d):
    return rp.where_contains(rp.order_report(rp.score_table(perf_records(spark, d))), "dct_d16")


def report_topk(spark, d):
    perf = perf_records(spark, d)
    best = rp.top_k_per_group(
        rp.where_contains(perf, "lag", negate=True), 5, ["label"], [F.desc(F.round("test_metric", 3)), "p_partkey"], "rank"
    )
    return best.select(
        "p_partkey", "rank", label_title(F.col("label")).alias("label"),
        feature_title(F.col("feature")).alias("feature"), F.round("test_metric", 3).alias("test_f1"),
    )


def report_lag(spark, d):
    return rp.lag_report(perf_records(spark, d))


def report_sizes(spark, d):
    sizes = ["label", "train_size", "train_positive", "test_size", "test_positive"]
    return perf_records(spark, d).select(*sizes).distinct()


QUERIES = {
    "ann_explode": ann_explode,
    "ann_by_project": ann_by_project,
    "ann_by_annotator": ann_by_annotator,
    "ann_by_origin": ann_by_origin,
    "ann_describe": ann_describe,
    "ann_unit_describe": ann_unit_describe,
    "ann_units_by_version": ann_units_by_version,
    "ann_first_lead_time": ann_first_lead_time,
    "ann_per_day": ann_per_day,
    "ann_origin_pivot": _pivot(None),
    "ann_origin_pivot_one": _pivot(1),
    "ann_lead_time": ann_lead_time,
    "ann_lead_time_one": ann_lead_time_one,
    "ann_unit_histogram": ann_unit_histogram,
    "report_clean": report_clean,
    "report_contains": report_contains,
    "report_topk": report_topk,
    "report_lag": report_lag,
    "report_sizes": report_sizes,
}


def _origin_sql(where):
    return f"""WITH {sql.ANNOTATIONS},
        totals AS (SELECT model_version, count(*) AS n FROM ann GROUP BY ALL),
        counts AS (
          SELECT model_version,
                 nullif(count(CASE WHEN origin = 'manual' THEN 1 END), 0) AS manual,
                 nullif(count(CASE WHEN origin = 'prediction' THEN 1 END), 0) AS pred,
                 nullif(count(CASE WHEN origin = 'prediction-changed' THEN 1 END), 0) AS pred_changed
          FROM ann {where} GROUP BY ALL)
        SELECT model_version, manual, pred, pred_changed, round(manual / n, 2) AS manual_ratio,
               round(pred / n, 2) AS pred_ratio, round(pred_changed / n, 2) AS pred_changed_ratio
        FROM counts JOIN totals USING (model_version)"""


def _lead_sql(where, ci):
    return f"""WITH {sql.ANNOTATIONS},
        units AS (SELECT model_version, unique_id, arg_min(lead_time, updated_at) AS lead_time
                  FROM ann {where} GROUP BY ALL),
        stats AS (
          SELECT model_version, round(avg(lead_time), 2) AS avg_lead_time,
                 round(stddev(lead_time), 2) AS std_lead_time, max(lead_time) AS max_lead_time,
                 quantile_cont(lead_time, 0.5) AS median_lead_time, count(*) AS "count"
          FROM units GROUP BY ALL)
        SELECT *{', round(std_lead_time * 1.96 / sqrt("count"), 2) AS ci95' if ci else ''} FROM stats"""


_A, _P = f"WITH {sql.ANNOTATIONS}", f"WITH {sql.PERF}"

ORACLES = {
    "ann_explode": f"""WITH {sql.TASKS} SELECT file AS unique_id, 'manual' AS origin, 'v1' AS model_version,
        count(*) * 1.5 :: DOUBLE AS lead_time, count(*) AS "count" FROM tasks GROUP BY file""",
    "ann_by_project": f'{_A} SELECT project, count(*) AS "count" FROM ann GROUP BY ALL',
    "ann_by_annotator": f'{_A} SELECT completed_by, project, count(*) AS "count" FROM ann GROUP BY ALL',
    "ann_by_origin": f'{_A} SELECT origin, count(*) AS "count" FROM ann GROUP BY ALL',
    "ann_describe": f"""{_A} SELECT project, 'lead_time' AS "column", count(lead_time) AS "count",
        round(avg(lead_time), 6) AS mean, round(stddev(lead_time), 6) AS stddev,
        min(lead_time) AS "min", max(lead_time) AS "max" FROM ann GROUP BY project""",
    "ann_unit_describe": f"""{_A}, sizes AS (SELECT count(*) AS n FROM ann GROUP BY unique_id)
        SELECT 'count' AS "column", count(n) AS "count", round(avg(n), 6) AS mean, round(stddev(n), 6) AS stddev,
        CAST(min(n) AS DOUBLE) AS "min", CAST(max(n) AS DOUBLE) AS "max" FROM sizes""",
    "ann_units_by_version": f"""{_A} SELECT model_version, count(DISTINCT unique_id) AS units, count(*) AS "rows"
        FROM ann GROUP BY ALL""",
    "ann_first_lead_time": f"""{_A} SELECT model_version, unique_id, arg_min(lead_time, updated_at) AS lead_time
        FROM ann GROUP BY ALL""",
    "ann_per_day": f"""{_A}, firsts AS (SELECT unique_id, min(updated_at) AS t FROM ann GROUP BY ALL)
        SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS "count" FROM firsts GROUP BY ALL""",
    "ann_origin_pivot": _origin_sql(""),
    "ann_origin_pivot_one": _origin_sql("WHERE completed_by = 1"),
    "ann_lead_time": _lead_sql("", True),
    "ann_lead_time_one": _lead_sql("WHERE completed_by = 1", False),
    "ann_unit_histogram": f"""{_A}, sizes AS (
          SELECT model_version, unique_id, count(*) AS n FROM ann GROUP BY ALL)
        SELECT model_version, n, count(*) AS "count" FROM sizes GROUP BY ALL""",
    "report_clean": f"""{_P} SELECT label_title AS label, feature_title AS feature, avg_train_f1, test_f1, train_time
        FROM clean WHERE feature NOT LIKE '%lag%'""",
    "report_contains": f"""{_P} SELECT label, feature, avg_train_f1, test_f1, train_time
        FROM clean WHERE feature LIKE '%dct\\_d16%' ESCAPE '\\'""",
    "report_topk": f"""{_P}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY test_f1 DESC, p_partkey) AS rank
          FROM clean WHERE feature NOT LIKE '%lag%')
        SELECT p_partkey, rank, label_title AS label, feature_title AS feature, test_f1 FROM ranked WHERE rank <= 5""",
    "report_lag": f"""{_P} SELECT DISTINCT label, p_size % 6 AS lag, CAST(p_size * 10 AS BIGINT) AS train_size,
        CAST(p_size * 3 AS BIGINT) AS train_positive, CAST(p_size AS BIGINT) AS test_size,
        CAST(p_size // 2 AS BIGINT) AS test_positive, round(p_size * 3 / (p_size * 10), 2) AS train_rate,
        round(p_size // 2 / p_size, 2) AS test_rate FROM perf""",
    "report_sizes": f"""{_P} SELECT DISTINCT label, CAST(p_size * 10 AS BIGINT) AS train_size,
        CAST(p_size * 3 AS BIGINT) AS train_positive, CAST(p_size AS BIGINT) AS test_size,
        CAST(p_size // 2 AS BIGINT) AS test_positive FROM perf""",
}
