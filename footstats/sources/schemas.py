"""Explicit schemas (Spark DDL) of the tables that footage tools leave behind.

Fixed values: names and types are those of the stored tables.
"""

ANNOTATION_EXPORT = """
    id long, project long,
    annotations array<struct<completed_by: long, project: long, lead_time: double, updated_at: string,
        unique_id: string, result: array<struct<origin: string,
            value: struct<start: double, end: double, labels: array<string>, choices: array<string>>>>>>,
    data struct<video_url: string, image: string>
"""
INTERVALS = "file string, annotations array<struct<labels: string, start: double, end: double>>"
SECOND_LABELS = "file string, time long, is_match int, is_active int, is_standing int"
PERF = """
    train_time double, avg_metrics array<double>, std_metrics array<double>, metric_name string,
    test_time double, test_metric double, label string,
    train_size long, train_positive long, test_size long, test_positive long
"""
CLOCK_READINGS = "frame_number long, filename string, available boolean, minutes int, seconds int, raw_text string"
PHASE_LOG = "timestamp double, phase string, detections string"
