"""Quantised vectors in shards, and queries that meet every shard: each task holds one shard and streams queries past it.

Rows are dealt to shards of bounded size by the hash of their id. A tile is a shard together with a share of
the queries; with few shards, a shard is copied to several tiles, so that all cores work, and with many,
each is sent once. Inside a tile the shard comes first and the queries follow in order, so a task holds one
shard, one batch of queries and their answers, whatever the size of the table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.llm.common import cut

#: Vectors of a shard at most, and components of a shard at most (about).
SHARD_ROWS, SHARD_VALUES = 1 << 15, 1 << 23
#: Quantised components are held between these bounds, so that inner products of 2000 of them fit a long.
LIMIT = 1 << 26


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str, **kept: Column) -> DataFrame:
    """(id, *kept, q): ``q`` holds floor(``scale`` x component) as integers; one row for each id.

    Rows with a null id, a null vector, a null or non-finite component or a null kept column take no part. Of
    rows that share an id the least (kept columns, then ``q``, compared in order) counts. Values beyond
    ``LIMIT`` are held at it.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in kept.items()], v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where("id IS NOT NULL AND v IS NOT NULL").where(~odd).dropna(subset=list(kept))
    held = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    least = F.min(F.struct(*kept, held.alias("q"))).alias("r")
    return whole.groupBy("id").agg(least).select("id", "r.*")


def build_shards(rows: DataFrame, pack: Callable[[pd.DataFrame, np.ndarray], object], shard_rows: int | None = None) -> tuple[DataFrame, int]:
    """((shard, dim, stored) written to the shared folder, number of shards) of ``quantised`` rows.

    ``pack`` gets the rows of one shard and vector length in order of id, and their matrix; what it returns is stored.
    """
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    shard_rows = shard_rows or max(64, min(SHARD_ROWS, SHARD_VALUES // max(size["dim"] or 1, 1)))
    shards = max(1, -(-size["n"] // shard_rows))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        number, out = int(group["shard"].iloc[0]), []
        for dim, part in group.groupby(group["q"].map(len)):
            part = part.sort_values("id", ignore_index=True)
            matrix = np.array(part["q"].tolist(), np.int64).reshape(len(part), dim)
            out.append((number, dim, pickle.dumps(pack(part, matrix))))
        return pd.DataFrame(out, columns=["shard", "dim", "stored"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInPandas(packed, "shard int, dim int, stored binary")), shards


def meet_shards(
    shards: DataFrame, n_shards: int, queries: DataFrame,
    answer: Callable[[object, np.ndarray, np.ndarray, list], Iterator[pd.DataFrame]], schema: str,
) -> DataFrame:
    """What ``answer(stored, ids, matrix, notes)`` yields for each shard and each batch of ``queries`` of its vector length.

    ``queries``: (id, q, note array<long>).
    """
    cores = shards.sparkSession.sparkContext.defaultParallelism
    copies = max(1, -(-4 * cores // n_shards))
    first = shards.select(
        F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + (copies - 1))).alias("tile"), "dim",
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<int>").alias("q"),
        F.lit(None).cast("array<long>").alias("note"), "stored",
    )
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(copies)).cast("int")
    asked = queries.select(
        F.explode(F.sequence(share, share + (n_shards - 1) * copies, F.lit(copies))).alias("tile"), F.size("q").alias("dim"),
        F.lit(1).alias("kind"), "id", "q", "note", F.lit(None).cast("binary").alias("stored"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stored = None, None
        for batch in batches:
            keys = list(zip(batch["tile"], batch["dim"], batch["kind"]))
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for begin, end in zip(edges, edges[1:]):
                tile, dim, kind = keys[begin]
                part = batch.iloc[begin:end]
                if kind == 0:
                    at, stored = (tile, dim), pickle.loads(part["stored"].iloc[0])
                elif at == (tile, dim):  # else no row of this length lies in the shard
                    matrix = np.array(part["q"].tolist(), np.int64).reshape(len(part), dim)
                    yield from answer(stored, part["id"].to_numpy(), matrix, part["note"].tolist())

    order = ["tile", "dim", "kind", "id"]
    return first.unionByName(asked).repartitionById(n_shards * copies, F.col("tile")).sortWithinPartitions(*order).mapInPandas(run, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products [rows of a, rows of b]; in floating point only where every partial sum is exact."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T
