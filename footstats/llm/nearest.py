"""Nearest neighbours with one vantage-point tree per shard.

A node keeps a vantage vector and the median of its vectors' distances from it; nearer ones go inside, the
others outside. By the triangle inequality a side can hold nothing closer than the difference between the
query's distance and the median, so the side is left out once that difference, times ``factor``, exceeds the
distance of the k-th vector found. Factor one is exact search; a larger one visits less.

Vectors are dealt to shards of bounded size by the hash of their id. The trees are built once and stored;
blocks of queries meet every shard by a join on the shard's number, and each shard answers with its k
nearest, of which a query keeps k.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.llm.common import cut

#: Vectors of a shard, vectors of a leaf, queries of a block.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 128, 256


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors in double precision, without null, empty, zero ones and those with odd components."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(~odd & F.exists("v", lambda x: x != 0.0))


def distances(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Euclidean distances [queries, rows] in double precision, components added in order."""
    total = np.zeros((len(queries), len(matrix)))
    for q, m in zip(queries.T, matrix.T):
        total += (q[:, None] - m[None, :]) ** 2
    return np.sqrt(total)


def build_tree(matrix: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
    """Nested (vantage row, median, inside, outside); a leaf is an array of rows."""
    if len(rows) <= leaf_rows:
        return rows
    # Of a few rows spread over the node, the one whose distances differ most.
    tries = rows[np.linspace(0, len(rows) - 1, 5).astype(int)]
    far = distances(matrix[tries], matrix[rows])
    best = int(np.argmax(far.std(axis=1)))
    middle = float(np.median(far[best]))
    inside = far[best] <= middle
    if inside.all():  # equal distances, as among copies: no split
        return rows
    return int(tries[best]), middle, build_tree(matrix, rows[inside], leaf_rows), build_tree(matrix, rows[~inside], leaf_rows)


class BlockSearch:
    """The k nearest of a block of queries in one tree; ``compared`` counts pairs of query and row."""

    def __init__(self, tree, ids: np.ndarray, matrix: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.ids, self.matrix, self.queries, self.own, self.k, self.factor = ids, matrix, queries, own, k, factor
        self.far = np.full((len(queries), k), np.inf)
        self.found = np.zeros((len(queries), k), ids.dtype)
        self.compared = 0
        everyone = np.arange(len(queries))
        self.seen: dict[int, np.ndarray] = {}
        self._home(tree, everyone)
        self._visit(tree, everyone, np.zeros(len(queries)))

    def _compare(self, rows: np.ndarray, who: np.ndarray) -> None:
        done = self.seen.get(int(rows[0]))
        if done is not None:  # their home leaf
            who = who[~np.isin(who, done)]
        for at in range(0, len(rows), 1024):  # a leaf of copies may be long
            part = rows[at : at + 1024]
            far = distances(self.queries[who], self.matrix[part])
            far[self.ids[part][None, :] == self.own[who][:, None]] = np.inf
            ids = np.broadcast_to(self.ids[part], far.shape)
            far, ids = np.concatenate([self.far[who], far], axis=1), np.concatenate([self.found[who], ids], axis=1)
            order = np.lexsort((ids, far), axis=1)[:, : self.k]
            self.far[who], self.found[who] = np.take_along_axis(far, order, 1), np.take_along_axis(ids, order, 1)
            self.compared += len(who) * len(part)

    def _home(self, node, who: np.ndarray) -> None:
        """Every query first meets the leaf on its own side, for a first limit of distance."""
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, who)
            self.seen[int(node[0])] = who
            return
        vantage, middle, inside, outside = node
        near = distances(self.queries[who], self.matrix[[vantage]])[:, 0] <= middle
        self._home(inside, who[near])
        self._home(outside, who[~near])

    def _visit(self, node, who: np.ndarray, bound: np.ndarray) -> None:
        # A bound that equals the k-th distance may hide a smaller id; rounding is given some room.
        keep = bound * self.factor <= self.far[who, -1] * (1 + 1e-12)
        who, bound = who[keep], bound[keep]
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, who)
            return
        vantage, middle, inside, outside = node
        d = distances(self.queries[who], self.matrix[[vantage]])[:, 0]
        self._visit(inside, who, np.maximum(bound, d - middle))
        self._visit(outside, who, np.maximum(bound, middle - d))


def build_trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, tree): one stored tree for each shard and vector length, at most about ``shard_rows`` vectors each."""
    vectors = vectors.select("id", "v", F.size("v").alias("dim"))
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = group["id"].to_numpy(), np.array(group["v"].tolist(), float)
        tree = build_tree(matrix, np.arange(len(ids)))
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "tree": [pickle.dumps((tree, ids, matrix))]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, tree binary"))


def nearest_neighbours(
    df: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's ``k`` nearest other rows, nearest first, ties to smaller ids.

    ``score`` is the Euclidean distance of the original vectors in double precision. Rows whose vector is
    null, zero, or holds a null or non-finite component are neither queries nor candidates; vectors of
    different length never meet. Fewer than ``k`` candidates: all of them. Repeated ids are candidates each,
    but none of a query's own id. Other columns aren't read.
    """
    vectors = usable(df, id_col, vector_col)
    trees = build_trees(vectors, shard_rows)
    queries = usable(df.where(is_query), id_col, vector_col).select("id", "v", F.size("v").alias("dim"))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)).cast("int")
    shards = trees.select("shard", "dim").groupBy("dim").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    sent = queries.withColumn("block", block).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    pairs = sent.join(shards, "dim").select("dim", "block", "queries", F.explode("shards").alias("shard")).join(trees, ["dim", "shard"])
    kind = vectors.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, stored in zip(batch["queries"], batch["tree"]):
                tree, ids, matrix = pickle.loads(stored)
                own = np.array([q["id"] for q in asked], ids.dtype)
                got = BlockSearch(tree, ids, matrix, np.array([q["v"] for q in asked], float), own, k, factor)
                hit = np.isfinite(got.far)
                yield pd.DataFrame({"query_id": np.repeat(own, hit.sum(axis=1)), "id": got.found[hit], "score": got.far[hit]})

    found = pairs.select("queries", "tree").repartition(max(1, blocks), "queries").mapInPandas(search, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"
    )


ORACLE_SQL = """
WITH u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
      list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
