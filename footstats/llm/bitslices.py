"""Exact top-k by inner product on a bit-sliced index.

A shard keeps, for each component, one bitmap for each binary digit of its values (less the least value of the
component); bit r of a bitmap belongs to row r. A query's weighted sum is added up on whole bitmaps: each digit of
a weight shifts the slices of its component, and full adders bring every digit of the sum down to one bitmap.
Negative weights take the complement. The top rows are chosen from the most significant slice of the sum
downward; rows that are equal in all digits stand at the boundary and are settled by id, and the scores
of the chosen rows are computed from the stored integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.llm.tiles import build_shards, meet_shards, products, quantised


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Words of 64 rows each; bit r of the whole is flag r."""
    padded = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def rows_of(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def slice_columns(matrix: np.ndarray) -> list[list[np.ndarray]]:
    """For each component the bitmaps of its digits, lowest first, after its least value is taken off."""
    return [[bitmap(c >> b & 1) for b in range(int(c.max(initial=0)).bit_length())] for c in (matrix - matrix.min(axis=0)).T]


class SlicedRows:
    """The bit-sliced index of a shard; rows are in order of id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, slices: list[list[np.ndarray]]):
        self.ids, self.matrix, self.slices = ids, matrix, slices
        self.every = bitmap(np.ones(len(ids), bool))

    def weighted_sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the digits of the sum, lowest first, up to a constant that all rows share."""
        digits: list[list[np.ndarray]] = []
        for weight, slices in zip(weights.tolist(), self.slices):
            if not weight:
                continue
            used = slices if weight > 0 else [s ^ self.every for s in slices]
            for shift in range(abs(weight).bit_length()):
                if abs(weight) >> shift & 1:
                    digits.extend([] for _ in range(shift + len(used) - len(digits)))
                    for place, s in enumerate(used, shift):
                        digits[place].append(s)
        out, at = [], 0
        while at < len(digits):
            column = digits[at]
            if len(column) > 1 and at + 1 == len(digits):
                digits.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                odd = a ^ b
                digits[at + 1].append((a & b) | (odd & c))
                column.append(odd ^ c)
            if len(column) == 2:
                a, b = column
                digits[at + 1].append(a & b)
                column[:] = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.every))
            at += 1
        return out

    def top(self, weights: np.ndarray, k: int, own: int) -> np.ndarray:
        """Rows of the ``k`` highest sums, ties to smaller ids, but not the row with id ``own``."""
        open_rows, sure = self.every.copy(), np.zeros_like(self.every)
        mine = int(np.searchsorted(self.ids, own))
        if mine < len(self.ids) and self.ids[mine] == own:
            open_rows[mine // 64] &= ~np.uint64(1 << mine % 64)
        for digit in reversed(self.weighted_sum(weights)):
            ones = open_rows & digit
            if int(np.bitwise_count(sure | ones).sum()) > k:
                open_rows = ones
            else:
                sure |= ones
                open_rows = open_rows & ~digit
        # Rows still open are equal in every digit: the boundary, in order of id.
        chosen = rows_of(sure)
        return np.concatenate([chosen, rows_of(open_rows)[: k - len(chosen)]])


def top_products(
    df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's ``k`` other rows of the highest integer inner product.

    Components become floor(``scale`` x component). Ties go to smaller ids; fewer candidates: all of them. Rows with a null
    id or vector, or a null or non-finite component, are neither queries nor candidates; zero and empty
    vectors take part, with products of 0; vectors of different length never meet. Rows that share an id count as
    one, see ``quantised``; ids are integers. ``is_query`` is a condition on ``id``. Other columns aren't read.
    """
    rows = quantised(df, scale, id_col, vector_col)
    shards, n_shards = build_shards(rows, lambda part, matrix: (part["id"].to_numpy(), matrix.astype(np.int32), slice_columns(matrix)), shard_rows)

    def answer(stored: tuple, ids: np.ndarray, matrix: np.ndarray, notes: list) -> Iterator[pd.DataFrame]:
        index = SlicedRows(*stored)
        for own, weights in zip(ids, matrix):
            got = index.top(weights, k, own)
            score = products(weights[None, :], index.matrix[got].astype(np.int64))[0]
            yield pd.DataFrame({"query_id": own, "id": index.ids[got], "score": score})

    queries = rows.where(is_query).withColumn("note", F.lit(None).cast("array<long>"))
    found = meet_shards(shards, n_shards, queries, answer, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"
    )


ORACLE_SQL = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
