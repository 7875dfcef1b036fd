"""SQL twins of the stand-ins, as common table expressions."""

CLOCK = """
framed AS (
  SELECT event_id, event_type, user_id % 10 AS video,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS frame
  FROM events),
countdown AS (
  SELECT *, ((240 - (((frame // 300) * 200 + least(frame % 300, 200)) // 10)) % 240 + 240) % 240 AS left_s
  FROM framed),
readings AS (
  SELECT event_id, video, frame,
         CASE WHEN event_type = 'error' THEN '(no clock)'
              ELSE printf('%d:%02d', left_s // 60, left_s % 60) END AS raw_text
  FROM countdown),
parsed AS (
  SELECT *, regexp_matches(raw_text, '^\\d{1,2}:[0-5]\\d$') AS available,
         CASE WHEN regexp_matches(raw_text, '^\\d{1,2}:[0-5]\\d$')
              THEN CAST(split_part(raw_text, ':', 1) AS INTEGER) END AS minutes,
         CASE WHEN regexp_matches(raw_text, '^\\d{1,2}:[0-5]\\d$')
              THEN CAST(split_part(raw_text, ':', 2) AS INTEGER) END AS seconds
  FROM readings),
clock AS (SELECT *, minutes * 60 + seconds AS time_seconds FROM parsed)
"""

CLOCK_FILLED = CLOCK + """,
known AS (
  SELECT *,
    last_value(CASE WHEN time_seconds IS NOT NULL THEN frame END IGNORE NULLS) OVER up AS p0,
    last_value(time_seconds IGNORE NULLS) OVER up AS v0,
    first_value(CASE WHEN time_seconds IS NOT NULL THEN frame END IGNORE NULLS) OVER down AS p1,
    first_value(time_seconds IGNORE NULLS) OVER down AS v1
  FROM clock
  WINDOW up AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT *,
    CASE WHEN time_seconds IS NOT NULL THEN CAST(time_seconds AS DOUBLE)
         WHEN p0 IS NULL OR p1 IS NULL THEN NULL
         WHEN (p1 - p0 - 1) / 10.0 > v1 - v0 OR p1 - p0 - 1 = 1 THEN CAST(v0 AS DOUBLE)
         ELSE v0 + CAST(v1 - v0 AS DOUBLE) * (frame - p0 - 1) / (p1 - p0 - 2) END AS time_seconds_filled
  FROM known)
"""

CLOCK_SMOOTH = CLOCK_FILLED + """,
smooth AS (
  SELECT *, CASE WHEN count(time_seconds_filled) OVER span = 10
                 THEN avg(time_seconds_filled) OVER span END AS time_seconds_smooth
  FROM filled
  WINDOW span AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
directed AS (
  SELECT *, CASE WHEN round(time_seconds_smooth
                    - lag(time_seconds_smooth) OVER (PARTITION BY video ORDER BY frame), 9) < 0
                 THEN -1 ELSE 0 END AS direction
  FROM smooth)
"""

CLOCK_RUNS = CLOCK_SMOOTH + """,
islands AS (
  SELECT *, sum(CASE WHEN direction <> 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY video ORDER BY frame) AS island
  FROM directed),
runs AS (
  SELECT *, count(CASE WHEN direction = 0 THEN 1 END) OVER (PARTITION BY video, island) AS run
  FROM islands),
flags AS MATERIALIZED (
  SELECT video, frame, CASE WHEN direction <> 0 OR run < 50 THEN 1 ELSE 0 END AS running
  FROM runs)
"""

CLOCK_MATCHES = CLOCK_RUNS + """,
scan AS (
  SELECT DISTINCT video, CAST(-1 AS BIGINT) AS frame, CAST(-1 AS BIGINT) AS opened,
         CAST(0 AS BIGINT) AS zeros, CAST(-1 AS BIGINT) AS start_frame, CAST(-1 AS BIGINT) AS end_frame
  FROM flags
  UNION ALL
  SELECT s.video, f.frame,
         CASE WHEN f.running = 1 THEN CASE WHEN s.opened < 0 THEN f.frame ELSE s.opened END
              WHEN s.opened >= 0 AND s.zeros + 1 > 50 THEN -1 ELSE s.opened END,
         CASE WHEN f.running = 1 THEN s.zeros
              WHEN s.opened >= 0 AND s.zeros + 1 > 50 THEN 0 ELSE s.zeros + 1 END,
         CASE WHEN f.running = 0 AND s.opened >= 0 AND s.zeros + 1 > 50 THEN s.opened ELSE -1 END,
         CASE WHEN f.running = 0 AND s.opened >= 0 AND s.zeros + 1 > 50 THEN f.frame ELSE -1 END
  FROM scan s JOIN flags f ON f.video = s.video AND f.frame = s.frame + 1),
segments AS (SELECT video, start_frame, end_frame FROM scan WHERE end_frame >= 0)
"""

CLOCK_RATIOS = CLOCK_MATCHES + """,
ratios AS (
  SELECT s.video, s.start_frame, s.end_frame,
         count(CASE WHEN running = 0 THEN 1 END) AS count_zero,
         count(CASE WHEN running <> 0 THEN 1 END) AS count_not_zero
  FROM segments s JOIN flags f ON f.video = s.video AND f.frame >= s.start_frame AND f.frame < s.end_frame
  GROUP BY ALL)
"""

TASKS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS rn,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events),
tasks AS (
  SELECT printf('data/mat_%02d/%04d/%04d.mp4', user_id % 10, user_id, rn // 3) AS file, event_id,
         CASE event_type WHEN 'click' THEN 'Match' WHEN 'view' THEN 'Active'
                         WHEN 'purchase' THEN 'Standing' ELSE 'Unsure' END AS label,
         CAST(rn % 3 * 10 + k % 5 AS DOUBLE) AS s,
         CAST(rn % 3 * 10 + k % 5 + 1 + k % 4 AS DOUBLE) AS e
  FROM numbered)
"""

_FOLD = """list_reduce(ps, lambda acc, p:
      CASE WHEN acc.s <= p.s AND acc.e <= p.e AND acc.e >= p.s THEN {{'s': p.s, 'e': acc.e}}
           WHEN acc.s >= p.s AND acc.e >= p.e AND acc.s <= p.e THEN {{'s': acc.s, 'e': p.e}}
           ELSE acc END, {{'s': c.s, 'e': c.e}})"""

INTERVALS = TASKS + """,
matches AS (SELECT file, event_id AS id, s, e FROM tasks WHERE label = 'Match'),
match_lists AS (SELECT file, list({'s': s, 'e': e} ORDER BY id) AS ps FROM matches GROUP BY file),
active_cut AS (
  SELECT c.file, c.event_id AS id, CASE WHEN ps IS NULL THEN {'s': c.s, 'e': c.e} ELSE FOLD END AS i
  FROM tasks c LEFT JOIN match_lists USING (file) WHERE c.label = 'Active'),
actives AS (SELECT file, id, i.s AS s, i.e AS e FROM active_cut),
active_lists AS (SELECT file, list({'s': s, 'e': e} ORDER BY id) AS ps FROM actives GROUP BY file),
standing_cut AS (
  SELECT c.file, c.event_id AS id, CASE WHEN ps IS NULL THEN {'s': c.s, 'e': c.e} ELSE FOLD END AS i
  FROM tasks c LEFT JOIN active_lists USING (file) WHERE c.label = 'Standing'),
standings AS (SELECT file, id, i.s AS s, i.e AS e FROM standing_cut),
clamped AS (
  SELECT file, 'Match' AS label, s, e FROM matches
  UNION ALL SELECT file, 'Active', s, e FROM actives
  UNION ALL SELECT file, 'Standing', s, e FROM standings),
parents AS (
  SELECT file, 'Not Active' AS label, id, s, e FROM matches
  UNION ALL SELECT file, 'Not Standing', id, s, e FROM actives
  UNION ALL SELECT DISTINCT file, 'Not Match', -1, 0.0, 30.0 FROM tasks),
children AS (
  SELECT file, 'Not Active' AS label, s, e FROM actives
  UNION ALL SELECT file, 'Not Standing', s, e FROM standings
  UNION ALL SELECT file, 'Not Match', s, e FROM matches),
inside AS (
  SELECT p.file, p.label, p.id, p.s AS ps, p.e AS pe, c.s, c.e
  FROM parents p JOIN children c ON p.file = c.file AND p.label = c.label
   AND (p.label = 'Not Match' OR (p.s <= c.s AND c.s <= c.e AND c.e <= p.e))),
ordered AS (
  SELECT *, lead(s) OVER w AS next_s, row_number() OVER w AS n,
         count(*) OVER (PARTITION BY file, label, id) AS cnt
  FROM inside WINDOW w AS (PARTITION BY file, label, id ORDER BY s, e)),
gaps AS (
  SELECT file, label, ps AS s, s AS e FROM ordered WHERE n = 1 AND ps < s
  UNION ALL SELECT file, label, e, next_s FROM ordered WHERE n < cnt
  UNION ALL SELECT file, label, e, pe FROM ordered WHERE n = cnt AND pe > e
  UNION ALL SELECT p.file, p.label, p.s, p.e FROM parents p
            WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.file = p.file AND i.label = p.label AND i.id = p.id)),
long AS (SELECT * FROM clamped UNION ALL SELECT * FROM gaps)
""".replace("FOLD", _FOLD.replace("{{", "{").replace("}}", "}"))

def labels(step: int) -> str:
    """Per-step labels from the interval rows."""
    return INTERVALS + f""",
bounds AS (SELECT file, min(s) AS lo, max(e) AS hi FROM long GROUP BY file),
points AS (
  SELECT file, lo + i * {step} AS t, least(lo + (i + 1) * {step}, hi) AS nxt
  FROM (SELECT *, unnest(range(CAST(ceil((hi - lo) / {step}) AS BIGINT))) AS i FROM bounds)),
labels AS MATERIALIZED (
  SELECT p.file, p.t AS time,
         CAST(max(CASE WHEN l.label = 'Match' THEN 1 ELSE 0 END) AS INTEGER) AS is_match,
         CAST(max(CASE WHEN l.label = 'Active' THEN 1 ELSE 0 END) AS INTEGER) AS is_active,
         CAST(max(CASE WHEN l.label = 'Standing' THEN 1 ELSE 0 END) AS INTEGER) AS is_standing
  FROM points p LEFT JOIN long l ON l.file = p.file AND l.s <= p.t AND l.e >= p.nxt
  GROUP BY p.file, p.t)
"""


ANNOTATIONS = """
ann AS MATERIALIZED (
  SELECT user_id % 3 + 1 AS project, user_id % 4 + 1 AS completed_by, value AS lead_time, ts AS updated_at,
         user_id * 100 + event_id % 20 AS unique_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'manual'
              WHEN event_type = 'purchase' THEN 'prediction' ELSE 'prediction-changed' END AS origin,
         CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'v0'
              WHEN ts < TIMESTAMP '2024-01-20' THEN 'v1' ELSE 'v2' END AS model_version
  FROM events)
"""

PERF = """
perf AS (
  SELECT p_partkey, 'is_' || lower(p_type) AS label,
         CASE WHEN p_partkey % 2 = 0 THEN 'emb_entity_detection_v2' ELSE 'emb_vanilla_yolov8n' END
         || CASE WHEN p_partkey % 3 = 0 THEN '_dct_d16' ELSE '' END
         || CASE WHEN p_size % 6 > 0 THEN '_lag' || (p_size % 6) ELSE '' END AS feature,
         p_retailprice / 3000 AS avg_metric, p_retailprice / 2999 AS test_metric,
         p_size * 1.5 AS train_time, p_size
  FROM part),
clean AS (
  SELECT p_partkey, label, feature, round(avg_metric, 3) AS avg_train_f1, round(test_metric, 3) AS test_f1,
         CAST(floor(train_time) AS INTEGER) AS train_time,
         replace(label, '_', ' ') AS label_title,
         replace(replace(replace(feature, 'emb_entity_detection', 'fine_tune'), 'emb_vanilla', 'vanilla'), '_', ' ')
           AS feature_title
  FROM perf)
"""

BOXES = """
frames AS (SELECT o_orderkey % 10 AS video, o_orderkey // 10 AS frame FROM orders),
boxes AS (
  SELECT l_orderkey % 10 AS video, l_orderkey // 10 AS frame, l_partkey AS place, l_linenumber % 3 AS cls,
         l_quantity AS x1, CAST(l_linenumber * 10 AS DOUBLE) AS y1,
         l_quantity + l_extendedprice / 1000 AS x2,
         CAST(l_linenumber * 10 AS DOUBLE) + l_extendedprice / 500 AS y2, l_discount * 10 AS confidence
  FROM lineitem),
ranked AS (
  SELECT *, (x2 - x1) * (y2 - y1) AS area,
         row_number() OVER (PARTITION BY video, frame ORDER BY (x2 - x1) * (y2 - y1) DESC, place) AS rank
  FROM boxes),
per_frame AS (
  SELECT video, frame, count(*) AS n, avg(y2 - y1) AS h,
         max(CASE WHEN rank = 1 THEN (x1 + x2) / 2 END) AS cx,
         max(CASE WHEN rank = 1 THEN (y1 + y2) / 2 END) AS cy
  FROM ranked GROUP BY ALL),
phases AS (
  SELECT video, frame, coalesce(n, 0) AS n_detections,
         CASE WHEN n IS NULL OR n < 2 THEN 'No-Match/Intermission'
              WHEN h > 150 THEN 'Tachi-waza' ELSE 'Ne-waza' END AS phase, cx, cy
  FROM frames LEFT JOIN per_frame USING (video, frame))
"""

MOTION = BOXES + """,
filled AS (
  SELECT video, frame, phase,
    coalesce(last_value(cx IGNORE NULLS) OVER up, first_value(cx IGNORE NULLS) OVER down, 0.0) AS cx,
    coalesce(last_value(cy IGNORE NULLS) OVER up, first_value(cy IGNORE NULLS) OVER down, 0.0) AS cy
  FROM phases
  WINDOW up AS (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY video ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
steps AS (
  SELECT *, coalesce(cx - lag(cx) OVER w, 0.0) AS dx, coalesce(cy - lag(cy) OVER w, 0.0) AS dy
  FROM filled WINDOW w AS (PARTITION BY video ORDER BY frame)),
raw AS (SELECT *, sqrt(dx * dx + dy * dy) AS score FROM steps),
boosted AS (
  SELECT *, score * CASE WHEN max(score) OVER (PARTITION BY video) > 0
                          AND max(score) OVER (PARTITION BY video) < 1 THEN 1000.0 ELSE 1.0 END AS intensity_score
  FROM raw),
motion AS MATERIALIZED (
  SELECT *, avg(intensity_score) OVER (PARTITION BY video ORDER BY frame
                                       ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS smoothed_intensity
  FROM boosted)
"""

PROBS = """
paths AS (
  SELECT printf('/frames/mat_%02d/%04d/%04d.jpg', label, vec_id // 100, vec_id % 100) AS path,
         label AS mat, CAST(vec_id // 100 AS INTEGER) AS batch_id, CAST(vec_id % 100 AS INTEGER) AS frame_id,
         CAST((vec_id // 100) * 600 + vec_id % 100 AS INTEGER) AS "timestamp",
         list_reduce(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS p1,
         list_reduce(list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS p2,
         list_reduce(list_transform(embedding[33:48], lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS p3,
         list_reduce(list_transform(embedding[49:64], lambda x: CAST(x AS DOUBLE)), lambda a, x: a + x) AS p4
  FROM embeddings),
predicted AS (
  SELECT *, CASE WHEN p1 >= p2 AND p1 >= p3 AND p1 >= p4 THEN 0 WHEN p2 >= p3 AND p2 >= p4 THEN 1
                 WHEN p3 >= p4 THEN 2 ELSE 3 END AS predicted_index FROM paths),
scenes AS (
  SELECT *, CASE predicted_index WHEN 0 THEN 'match' WHEN 1 THEN 'match_intro' WHEN 2 THEN 'match_outro'
                                 ELSE 'no_match' END AS predicted_label FROM predicted)
"""
