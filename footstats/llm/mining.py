"""Hard negatives by a secondary sort.

Pairs of anchor and row are packed into keys (anchor, descending score, positives first, id), dealt by anchor and
sorted inside the partitions. One pass then reads an anchor's pairs from the highest score downward: each of its first
rows of the same label opens a window, and rows of other labels are handed to every window that still wants some. No
anchor's pairs are ever held together.

Not every pair need be sorted. A shard first tells each anchor's best rows of its label; the anchor's positives, now known, bound
its windows, and a shard then sends only the rows that could be among the first of a window. That is a combiner before the
shuffle: what it leaves out can never be answered, whatever other shards send.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.llm.common import cut
from footstats.llm.tiles import build_shards, meet_shards, products, quantised

_PAIR = ">QQBQ"
#: Scores computed at once: anchors of a batch times rows of a shard.
BATCH_SCORES = 1 << 21
_POSITIVE, _NEGATIVE = 0, 1
_TOP = 1 << 63


def pack_pair(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Bytes that sort by anchor, descending score, positives before negatives of equal score, row."""
    return struct.pack(_PAIR, anchor + _TOP, _TOP - 1 - score, kind, row + _TOP)


def unpack_pair(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = struct.unpack(_PAIR, key)
    return anchor - _TOP, _TOP - 1 - score, kind, row - _TOP


def emit_negatives(keys: Iterable[bytes], positives: int, negatives: int, floor_percent: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys; holds one anchor's windows."""
    anchor, opened, windows = None, 0, []
    for key in keys:
        at, score, kind, row = unpack_pair(key)
        if at != anchor:
            anchor, opened, windows = at, 0, []
        if kind == _POSITIVE:
            if opened < positives:
                opened += 1
                windows.append([row, score, 0])
            continue
        for window in windows:
            # By the order of the keys the score is at most the window's.
            if floor_percent * window[1] <= 100 * score <= 100 * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row, window[1], score
        windows = [w for w in windows if w[2] < negatives]


def first_rows(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of ``rows`` (in order of id) the ``k`` with the highest scores, ties to smaller ids."""
    if len(rows) > k:
        least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]
    return rows[np.argsort(-scores[rows], kind="stable")[:k]]


def mine_negatives(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, floor_percent: int = 80,
    scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``rank`` from 1 for each pair of the first two.

    Scores are integer inner products of floor(``scale`` x component). An anchor's positives are its first ``positives`` other
    rows of its label by descending score, ties to smaller ids; each gets the first ``negatives`` rows of other labels, in the same
    order, whose score lies between ``floor_percent`` percent of the positive's and the positive's. A negative positive score
    leaves no such room. Fewer rows: all of them.

    Rows with a null id, label or vector or with a null or non-finite component take no part; zero and empty vectors do; vectors of
    different length never meet. Rows that share an id count as one, see ``quantised``; ids are integers, ``is_anchor`` is a
    condition on ``id``. Other columns aren't read.
    """
    rows = quantised(df, scale, id_col, vector_col, label=label.cast("long"))
    shards, n_shards = build_shards(rows, lambda part, matrix: (part["id"].to_numpy(), part["label"].to_numpy(), matrix), shard_rows)
    anchors = cut(rows.where(is_anchor))

    def scored(stored: tuple, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, BATCH_SCORES // max(1, len(stored[0])))
        for begin in range(0, len(matrix), step):
            yield from enumerate(products(matrix[begin : begin + step], stored[2]), begin)

    def best_of_label(stored, ids, matrix, notes) -> Iterator[pd.DataFrame]:
        there, labels, _ = stored
        for i, scores in scored(stored, matrix):
            got = first_rows(scores, np.flatnonzero((labels == notes[i][0]) & (there != ids[i])), positives)
            yield pd.DataFrame({"anchor": ids[i], "id": there[got], "score": scores[got]})

    def best_of_windows(stored, ids, matrix, notes) -> Iterator[pd.DataFrame]:
        there, labels, _ = stored
        for i, scores in scored(stored, matrix):
            others, wanted = labels != notes[i][0], set()
            for limit in set(notes[i][1:].tolist()):
                fit = others & (scores <= limit) & (100 * scores >= floor_percent * limit)
                wanted.update(first_rows(scores, np.flatnonzero(fit), negatives).tolist())
            got = np.array(sorted(wanted), int)
            yield pd.DataFrame({"anchor": ids[i], "id": there[got], "score": scores[got]})

    pair = "anchor long, id long, score long"
    near = meet_shards(shards, n_shards, anchors.select("id", "q", F.array("label").alias("note")), best_of_label, pair)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    limits = chosen.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("limits"))
    bounded = anchors.join(limits, "id").select("id", "q", F.concat(F.array("label"), "limits").alias("note"))
    rivals = meet_shards(shards, n_shards, bounded, best_of_windows, pair)

    pairs = chosen.withColumn("kind", F.lit(_POSITIVE)).unionByName(rivals.withColumn("kind", F.lit(_NEGATIVE)))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = pairs.rdd.map(lambda r: (pack_pair(r["anchor"], r["score"], r["kind"], r["id"]), None)).repartitionAndSortWithinPartitions(
        parts, lambda key: zlib.crc32(key[:8])
    )
    mined = ordered.mapPartitions(lambda part: emit_negatives((key for key, _ in part), positives, negatives, floor_percent))
    return spark.createDataFrame(
        mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False
    )


ORACLE_SQL = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM u a JOIN u r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN p USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
