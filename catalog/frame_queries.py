"""Path, probability, plan, de-duplication and split queries."""

from pyspark.sql import functions as F

from catalog import sql
from catalog.standins import (
    SCENES, annotation_tasks, boxes, choice_tasks, image_files, image_tasks, probabilities, table, videos,
)
from footstats.functions import paths as p
from footstats.operators import annotations as an
from footstats.operators import dedup as dd
from footstats.operators import detections as dt
from footstats.operators import frames as fr
from footstats.operators import splits as sp
from footstats.operators import statistics as st
from footstats.plans import shots
from footstats.vocab import GESTURE_CLASSES


def frame_paths(spark, d):
    return fr.parse_frame_path(probabilities(spark, d).select("path"))


def frame_keys(spark, d):
    return fr.frame_key(probabilities(spark, d).select("path"))


def url_tail(spark, d):
    return table(spark, d, "pages").select(
        "page_id", p.url_tail(F.col("url"), 4).alias("tail4"), p.url_tail(F.col("url"), 3).alias("tail3")
    )


def strip_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", p.strip_prefix(F.col("url"), "https://m.").alias("name"))


def crop_to_frame(spark, d):
    crop = F.format_string("mat_%02d/%04d_%02d.png", F.col("video"), F.col("frame"), F.col("place") % 100)
    return boxes(spark, d).select("video", "frame", "place", p.crop_to_frame(crop).alias("image"))


def mat_key(spark, d):
    name = F.format_string("/data/[Mat+%d] final.mp4", F.col("l_linenumber") * 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.mat_key(name).alias("mat"))


def _scenes(spark, d):
    return fr.predict_label(fr.parse_frame_path(probabilities(spark, d)))


def prob_argmax(spark, d):
    return _scenes(spark, d).select("path", "predicted_index", "predicted_label")


def prob_expand(spark, d):
    return fr.expand_probs(probabilities(spark, d), SCENES).drop("labels", "prob")


def prob_by_mat(spark, d):
    return st.pivot_counts(_scenes(spark, d), ["mat"], "predicted_label", SCENES)


def label_freq(spark, d):
    return st.value_counts(_scenes(spark, d), "predicted_label")


def context_window(spark, d):
    scored = fr.expand_probs(_scenes(spark, d), SCENES).select("mat", "timestamp", "match")
    aggs = lambda w: {
        "n": F.count("match").over(w), "mean_match": F.round(F.avg("match").over(w), 6),
        "max_match": F.max("match").over(w), "seconds": F.collect_list("timestamp").over(w),
    }
    return fr.context_window(scored, 30, aggs).withColumn("seconds", F.array_join(F.array_sort("seconds"), ","))


def timeline_order(spark, d):
    return fr.order_timeline(_scenes(spark, d).select("mat", "timestamp", "predicted_label"))


def union_all(spark, d):
    texts = [
        table(spark, d, name).select(F.lit(name).alias("source"), F.length("text").cast("long").alias("chars"))
        for name in ("documents", "benchmark", "conversations")
    ]
    return st.union_all(*texts)


def pad_edges(spark, d):
    return fr.pad_edges(_scenes(spark, d).select("mat", "timestamp", "path", "predicted_label"), 30)


def batch_plan(spark, d):
    return shots.batch_plan(videos(spark, d), offset=30, duration=3600, rate=1, batch=600)


def clip_plan(spark, d):
    return shots.clip_plan(videos(spark, d), 600, 0)


def clip_plan_offset(spark, d):
    return shots.clip_plan(videos(spark, d), 300, 450)


def first_choice(spark, d):
    return an.first_choice(choice_tasks(spark, d))


def bad_class_files(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.format_string("%06d.txt", "l_orderkey").alias("file"),
        (F.col("l_linenumber") % 4).cast("string").alias("cls"),
        F.concat_ws(" ", (F.col("l_linenumber") % 4).cast("string"), F.col("l_partkey").cast("string")).alias("line"),
    )
    return dt.bad_class_files(lines)


def encode_class(spark, d):
    coded = st.encode_class(an.first_choice(choice_tasks(spark, d)), "choice", GESTURE_CLASSES)
    return coded


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, dd.value_semi(docs, table(spark, d, "labels"), "doc_id", ["doc_id"])


def hash_semi(spark, d):
    docs, known = _labelled(spark, d)
    return dd.hash_semi(docs, known, "text", ["doc_id"]).select("doc_id", "digest")


def hash_shared(spark, d):
    docs, known = _labelled(spark, d)
    return dd.dup_files(known, docs, "text", ["doc_id"]).select("doc_id", "digest")


def hash_missing(spark, d):
    docs, known = _labelled(spark, d)
    return dd.dup_files(known, docs, "text", ["doc_id"], "missing").select("doc_id", "digest")


def value_semi(spark, d):
    return _labelled(spark, d)[1].select("doc_id", F.length("text").alias("chars"))


def path3_join(spark, d):
    return dd.join_path_tail(image_tasks(spark, d), image_files(spark, d), ["id"]).select("id", "matches")


def stem_join(spark, d):
    images = table(spark, d, "documents").select(F.format_string("img_%06d.png", "doc_id").alias("image"))
    labels = table(spark, d, "labels").select(F.format_string("img_%06d.txt", "doc_id").alias("label_file"), "quality")
    return dd.join_stem(images, labels, ["image"])


def split_crc32(spark, d):
    files = annotation_tasks(spark, d).select("file", "event_id")
    return sp.split_crc32(files)


def split_sizes(spark, d):
    rows = annotation_tasks(spark, d).select("file", (F.col("label") == "Match").cast("int").alias("is_match"))
    return st.split_sizes(sp.split_crc32(rows), "split", "is_match")


def split_70_15_15(spark, d):
    names = table(spark, d, "documents").select("doc_id", F.format_string("img_%06d.png", "doc_id").alias("image"))
    return sp.split_hash(names, "image", [0.7, 0.15, 0.15])


def split_60_40(spark, d):
    return sp.split_hash(an.first_choice(choice_tasks(spark, d)), "image", [0.6, 0.4])


def split_exact(spark, d):
    names = table(spark, d, "documents").select("doc_id", F.format_string("img_%06d.png", "doc_id").alias("image"))
    return sp.split_exact(names, "image")


QUERIES = {
    f.__name__: f
    for f in (
        frame_paths, frame_keys, url_tail, strip_prefix, crop_to_frame, mat_key, prob_argmax, prob_expand,
        prob_by_mat, label_freq, context_window, timeline_order, union_all, pad_edges, batch_plan, clip_plan, clip_plan_offset, first_choice,
        bad_class_files, encode_class, hash_semi, hash_shared, hash_missing, value_semi, path3_join, stem_join,
        split_crc32, split_sizes, split_70_15_15, split_60_40, split_exact,
    )
}

_S = f"WITH {sql.PROBS}"
_CHOICE = """CASE WHEN event_type = 'view' THEN 'point' ELSE event_type END"""
_DOCS = """known AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
_SHARE = "CAST('0x' || substr(md5('42:' || {0}), 1, 8) AS BIGINT) % 10000"
_IMG = "printf('img_%06d.png', doc_id)"
_CRC = """xor(list_reduce(list_transform(string_split(file, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
          lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
            lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
_SPLIT = f"""WITH {sql.TASKS}, files AS (SELECT file, {_CRC} % 100 AS sample FROM (SELECT DISTINCT file FROM tasks)),
        sides AS (SELECT t.*, CASE WHEN sample < 80 THEN 'train' ELSE 'test' END AS split
                  FROM tasks t JOIN files USING (file))"""

ORACLES = {
    "frame_paths": f'{_S} SELECT path, mat, batch_id, frame_id, "timestamp" FROM paths',
    "frame_keys": f"""{_S} SELECT path, printf('/frames/mat_%02d/%04d.mp4', mat, batch_id) AS file,
        CAST(frame_id AS BIGINT) AS time FROM paths""",
    "url_tail": """WITH parts AS (SELECT page_id, string_split(url, '/') AS a FROM pages)
        SELECT page_id, array_to_string(list_slice(a, greatest(len(a) - 3, 1), len(a)), '/') AS tail4,
               array_to_string(list_slice(a, greatest(len(a) - 2, 1), len(a)), '/') AS tail3 FROM parts""",
    "strip_prefix": "SELECT page_id, replace(url, 'https://m.', '') AS name FROM pages",
    "crop_to_frame": f"""WITH {sql.BOXES} SELECT video, frame, place, printf('mat_%02d/%04d.jpg', video, frame) AS image
        FROM boxes""",
    "mat_key": "SELECT l_orderkey, l_linenumber, l_linenumber * 3 AS mat FROM lineitem",
    "prob_argmax": f"{_S} SELECT path, predicted_index, predicted_label FROM scenes",
    "prob_expand": f"{_S} SELECT path, p1 AS match, p2 AS match_intro, p3 AS match_outro, p4 AS no_match FROM paths",
    "prob_by_mat": f"""{_S} SELECT mat, {', '.join(
        f"nullif(count(CASE WHEN predicted_label = '{s}' THEN 1 END), 0) AS {s}" for s in SCENES)}
        FROM scenes GROUP BY mat""",
    "label_freq": f'{_S} SELECT predicted_label, count(*) AS "count" FROM scenes GROUP BY ALL',
    "context_window": f"""{_S} SELECT mat, "timestamp", p1 AS match, count(p1) OVER w AS n,
        round(avg(p1) OVER w, 6) AS mean_match, max(p1) OVER w AS max_match,
        array_to_string(list_sort(list("timestamp") OVER w), ',') AS seconds
        FROM paths WINDOW w AS (PARTITION BY mat ORDER BY "timestamp" RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)""",
    "timeline_order": f'{_S} SELECT mat, "timestamp", predicted_label FROM scenes',
    "union_all": " UNION ALL ".join(
        f"SELECT '{t}' AS source, length(text) AS chars FROM {t}" for t in ("documents", "benchmark", "conversations")
    ),
    "pad_edges": f"""{_S}, edge AS (
          SELECT mat, min("timestamp") AS lo, max("timestamp") AS hi FROM scenes GROUP BY mat),
        pads AS (
          SELECT e.mat, CAST(e.lo - i AS INTEGER) AS t, s.path, s.predicted_label FROM edge e
          JOIN scenes s ON s.mat = e.mat AND s."timestamp" = e.lo, range(1, 31) r(i)
          UNION ALL
          SELECT e.mat, CAST(e.hi + i AS INTEGER), s.path, s.predicted_label FROM edge e
          JOIN scenes s ON s.mat = e.mat AND s."timestamp" = e.hi, range(1, 31) r(i))
        SELECT mat, "timestamp", path, predicted_label FROM scenes
        UNION ALL SELECT mat, t, path, predicted_label FROM pads""",
    "batch_plan": """WITH v AS (SELECT s_name AS path, row_number() OVER (ORDER BY s_name) AS i FROM supplier)
        SELECT path, CAST(s AS INTEGER) AS seq_id, CAST(30 + s * 600 AS INTEGER) AS "offset", 600 AS duration,
               printf('mat_%02d/%04d', i, s) AS prefix FROM v, range(6) r(s)""",
    "clip_plan": """WITH v AS (SELECT s_name AS path, s_suppkey * 37 + 100 AS total FROM supplier),
        c AS (SELECT *, unnest(range(greatest(1, CAST(ceil(total / 600) AS BIGINT)))) AS clip FROM v)
        SELECT path, clip, clip * 600 AS start, 600 AS duration, printf('%04d.mp4', clip) AS name
        FROM c WHERE clip * 600 < total""",
    "clip_plan_offset": """WITH v AS (SELECT s_name AS path, s_suppkey * 37 + 100 AS total FROM supplier),
        c AS (SELECT *, unnest(range(greatest(1, CAST(ceil(total / 300) AS BIGINT)))) AS clip FROM v)
        SELECT path, clip, 450 + clip * 300 AS start, 300 AS duration, printf('%04d.mp4', clip) AS name
        FROM c WHERE 450 + clip * 300 < total""",
    "first_choice": f"""SELECT 'img/' || event_id AS image, {_CHOICE} AS choice FROM events WHERE event_type <> 'error'""",
    "bad_class_files": """SELECT printf('%06d.txt', l_orderkey) AS file, '3 ' || l_partkey AS line
        FROM lineitem WHERE l_linenumber % 4 = 3""",
    "encode_class": f"""SELECT 'img/' || event_id AS image, {_CHOICE} AS choice,
        CASE {_CHOICE} WHEN 'match_stop' THEN 0 WHEN 'point' THEN 1 WHEN 'half_point' THEN 2 WHEN 'other' THEN 3 END
          AS class_id FROM events WHERE event_type <> 'error'""",
    "hash_semi": f"""WITH {_DOCS} SELECT doc_id, sha1(text) AS digest FROM documents
        WHERE sha1(text) IN (SELECT sha1(text) FROM known)""",
    "hash_shared": f"""WITH {_DOCS} SELECT doc_id, md5(text) AS digest FROM documents
        WHERE md5(text) IN (SELECT md5(text) FROM known)""",
    "hash_missing": f"""WITH {_DOCS} SELECT doc_id, md5(text) AS digest FROM documents
        WHERE md5(text) NOT IN (SELECT md5(text) FROM known)""",
    "value_semi": f"WITH {_DOCS} SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM known",
    "path3_join": """WITH t AS (
          SELECT doc_id AS id, printf('%s/%s/%04d.png', source, lang, n_chars % 50) AS tail FROM documents),
        f AS (SELECT printf('src%d/en/%04d.png', conv_id % 5, (turn * 7 + conv_id) % 50) AS tail FROM conversations)
        SELECT id, count(*) AS matches FROM t JOIN f USING (tail) GROUP BY id""",
    "stem_join": f"""SELECT {_IMG} AS image, printf('img_%06d.txt', doc_id) AS label_file, quality
        FROM documents JOIN labels USING (doc_id)""",
    "split_crc32": f"{_SPLIT} SELECT file, event_id, split FROM sides",
    "split_sizes": f"""{_SPLIT} SELECT split, count(*) AS size, count(CASE WHEN label = 'Match' THEN 1 END) AS positive
        FROM sides GROUP BY split""",
    "split_70_15_15": f"""SELECT doc_id, {_IMG} AS image, CASE WHEN {_SHARE.format(_IMG)} < 7000 THEN 'train'
        WHEN {_SHARE.format(_IMG)} < 8500 THEN 'val' ELSE 'test' END AS split FROM documents""",
    "split_60_40": f"""WITH c AS (SELECT 'img/' || event_id AS image, {_CHOICE} AS choice
          FROM events WHERE event_type <> 'error')
        SELECT *, CASE WHEN {_SHARE.format('image')} < 6000 THEN 'train' ELSE 'test' END AS split FROM c""",
    "split_exact": f"""WITH r AS (SELECT doc_id, {_IMG} AS image, count(*) OVER () AS n,
          row_number() OVER (ORDER BY md5('42:' || {_IMG}), {_IMG}) - 1 AS rk FROM documents)
        SELECT doc_id, image, CASE WHEN rk < floor(0.7 * n) THEN 'train'
          WHEN rk < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS split FROM r""",
}
