"""Many logistic models in common passes over one table.

Every recipe, fold and grid point of a sweep is a column of weights. A pass multiplies the rows of a recipe by the block of
all its columns, so one optimiser step of all models costs one reading of the table. Tasks add up losses and slopes,
a shuffle adds those of the tasks, and the driver holds weights only: their number does not depend on the rows.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums of one recipe that reach the driver in each pass, at most.
LANES = 16
#: Norm of a slope, against that of the weights, at which a model is done; remembered steps of the optimiser.
TOLERANCE, MEMORY = 1e-6, 10
#: Intercept of a model that saw one class only.
CERTAIN = 50.0


@dataclass
class Block:
    """The models of one recipe: vector columns, values taken of each (all: None), label, grid points and folds.

    ``points`` are pairs (greatest number of steps, ridge penalty).
    """

    name: str
    label: str
    columns: Sequence[str]
    points: Sequence[tuple[int, float]]
    take: int | None = None
    folds: int = 3

    def jobs(self) -> list[tuple[int, int]]:
        """(fold left out, point); the last fold number stands for none."""
        return [(fold, point) for fold in range(self.folds + 1) for point in range(len(self.points))]


Measure = Callable[[int, np.ndarray, np.ndarray, np.ndarray, object], np.ndarray]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, their vectors)."""
    known = np.asarray(column.is_valid())
    values = column.flatten().to_numpy(zero_copy_only=False)
    return known, values.reshape(int(known.sum()), -1) if known.any() else np.zeros((0, 0))


def _rows_of(block: Block, batch: pa.RecordBatch, vectors: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a batch that have the block's label and all its vectors: (x, y, group); the test rows are the last group."""
    truth = batch.column(block.label)
    whole = np.asarray(truth.is_valid())
    for c in block.columns:
        whole = whole & vectors[c][0]
    if not whole.any():
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64)
    x = np.hstack([vectors[c][1][whole[vectors[c][0]]][:, : block.take] for c in block.columns])
    y = truth.fill_null(0).to_numpy(zero_copy_only=False)[whole].astype(np.float64)
    if ((y != 0) & (y != 1)).any():
        raise ValueError(f"label {block.label} holds values other than 0 and 1")
    test = batch.column("_test").to_numpy(zero_copy_only=False)[whole]
    crc = batch.column("_crc").to_numpy(zero_copy_only=False)[whole]
    return x, y, np.where(test, block.folds, crc % block.folds)


def _summed(table: DataFrame, blocks: Sequence[Block], measure: Measure, about: Sequence) -> list[np.ndarray | None]:
    """Sums of ``measure`` over all rows of each block; ``about[i]`` goes to the tasks, blocks with none are skipped."""
    sent = table.sparkSession.sparkContext.broadcast(list(about))
    wanted = [i for i, a in enumerate(about) if a is not None]
    needed = sorted({c for i in wanted for c in blocks[i].columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = {c: _vectors(batch.column(c)) for c in needed}
            for i in wanted:
                x, y, group = _rows_of(blocks[i], batch, vectors)
                if len(y):
                    part = measure(i, x, y, group, sent.value[i])
                    sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["block", "sums"]
        )

    def merge(part: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in part.column("sums").to_pylist()], axis=0)
        return pa.table({"block": part.column("block").slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "block int, sums array<double>"
    columns = ["_test", "_crc", *sorted({blocks[i].label for i in wanted}), *needed]
    parts = table.select(*columns).mapInArrow(run, schema)
    lanes = parts.withColumn("lane", F.spark_partition_id() % LANES).groupBy("block", "lane").applyInArrow(merge, schema)
    out: list[np.ndarray | None] = [None] * len(blocks)
    for row in lanes.collect():  # at most LANES rows for each block
        values = np.asarray(row["sums"])
        out[row["block"]] = values if out[row["block"]] is None else out[row["block"]] + values
    sent.destroy()
    return out


def _sizes(i: int, x: np.ndarray, y: np.ndarray, group: np.ndarray, folds: int) -> np.ndarray:
    """Per group: rows, positives, sums of the values."""
    member = (group[:, None] == np.arange(folds + 1)).astype(np.float64)
    return np.hstack([member.sum(axis=0)[:, None], (member.T @ y)[:, None], member.T @ x]).ravel()


def _spreads(i: int, x: np.ndarray, y: np.ndarray, group: np.ndarray, about: tuple) -> np.ndarray:
    """Per group: squared distances from the mean of all rows."""
    folds, mean = about
    member = (group[:, None] == np.arange(folds + 1)).astype(np.float64)
    return (member.T @ (x - mean) ** 2).ravel()


def _margins(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return x @ weights[:-1] + weights[-1]


def _slopes(i: int, x: np.ndarray, y: np.ndarray, group: np.ndarray, about: tuple) -> np.ndarray:
    """Per model: loss, then the sums of residual times value, then those of the residuals."""
    left_out, folds, weights = about
    margin = _margins(x, weights)
    learned = (group[:, None] != left_out) & (group[:, None] != folds)
    loss = np.logaddexp(0, margin) - y[:, None] * margin
    residual = np.where(learned, 0.5 * (1 + np.tanh(margin / 2)) - y[:, None], 0.0)
    return np.vstack([np.where(learned, loss, 0.0).sum(axis=0), x.T @ residual, residual.sum(axis=0)]).ravel()


def _confusion(i: int, x: np.ndarray, y: np.ndarray, group: np.ndarray, about: tuple) -> np.ndarray:
    """Per model, over the rows of the fold left out (test rows where none is): counts by truth and answer."""
    left_out, _, weights = about
    said, scored, truth = _margins(x, weights) > 0, group[:, None] == left_out, y[:, None] > 0
    return np.stack([(scored & (truth == t) & (said == s)).sum(axis=0) for t in (False, True) for s in (False, True)]).astype(float).ravel()


def minimise(start: np.ndarray, steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton descent that asks for (value, slope) at the points it yields; returns the last good point."""
    x, past = start, deque(maxlen=MEMORY)
    value, slope = yield x
    for _ in range(steps):
        if np.linalg.norm(slope) <= TOLERANCE * max(1.0, np.linalg.norm(x)):
            break
        way, kept = slope.copy(), []
        for s, d in reversed(past):
            kept.append((s @ way) / (s @ d))
            way -= kept[-1] * d
        if past:
            s, d = past[-1]
            way *= (s @ d) / (d @ d)
        for (s, d), a in zip(past, reversed(kept)):
            way += (a - (d @ way) / (s @ d)) * s
        fall, length = -(slope @ way), 1.0 if past else min(1.0, 1 / np.linalg.norm(slope))
        while True:
            there = x - length * way
            value_there, slope_there = yield there
            if value_there <= value + 1e-4 * length * fall + 1e-14 * abs(value):
                break
            length /= 2
            if length < 1e-10:
                return x
        s, d = there - x, slope_there - slope
        if s @ d > 1e-14 * (d @ d):
            past.append((s, d))
        x, value, slope = there, value_there, slope_there
    return x


def weighted_f1(counts: np.ndarray) -> float:
    """From counts by truth and answer (00, 01, 10, 11): F1 of each class by its share of the rows; 0 of no rows."""
    cell = counts.reshape(2, 2)
    total, score = cell.sum(), 0.0
    for k in (0, 1):
        truth, said = cell[k].sum(), cell[:, k].sum()
        if truth:
            score += truth / total * 2 * cell[k, k] / (truth + said)
    return float(score)


class _Models:
    """The models of one block: their scales, optimisers and weights on the scale of the values."""

    def __init__(self, block: Block, sizes: np.ndarray, spreads: np.ndarray):
        self.block, self.jobs = block, block.jobs()
        per_group = sizes.reshape(block.folds + 1, -1)
        self.rows, self.positive = per_group[:, 0], per_group[:, 1]
        width = per_group.shape[1] - 2
        middle = per_group[:, 2:].sum(axis=0) / max(self.rows.sum(), 1)
        squares = spreads.reshape(block.folds + 1, width)
        self.mean, self.scale = np.zeros((len(self.jobs), width)), np.zeros((len(self.jobs), width))
        self.learned = np.zeros(len(self.jobs))
        self.weights = np.zeros((len(self.jobs), width + 1))
        self.running: dict[int, Generator] = {}
        self.asked: dict[int, np.ndarray] = {}
        for j, (left_out, point) in enumerate(self.jobs):
            groups = [g for g in range(block.folds) if g != left_out]
            n, positive = self.rows[groups].sum(), self.positive[groups].sum()
            self.learned[j] = n
            if n == 0 or positive in (0, n):
                self.weights[j, -1] = CERTAIN if n and positive else -CERTAIN
                continue
            self.mean[j] = per_group[groups, 2:].sum(axis=0) / n
            deviation = np.sqrt(np.maximum(squares[groups].sum(axis=0) - n * (self.mean[j] - middle) ** 2, 0) / max(n - 1, 1))
            varies = deviation > 1e-9 * np.maximum(1e-300, np.abs(self.mean[j]))
            self.scale[j] = np.where(varies, 1 / np.where(varies, deviation, 1), 0)
            start = np.zeros(width + 1)
            start[-1] = np.log(positive / (n - positive))
            self.running[j] = minimise(start, block.points[point][0])
            self.asked[j] = next(self.running[j])

    def plain(self, j: int, point: np.ndarray) -> np.ndarray:
        """Weights of the values as they are, from those of centred and scaled ones."""
        slopes = point[:-1] * self.scale[j]
        return np.append(slopes, point[-1] - slopes @ self.mean[j])

    def question(self) -> tuple | None:
        """(folds left out, folds, weights) of the models under way."""
        if not self.asked:
            return None
        left_out = np.array([self.jobs[j][0] for j in self.asked])
        return left_out, self.block.folds, np.stack([self.plain(j, p) for j, p in self.asked.items()], axis=1)

    def answer(self, sums: np.ndarray) -> None:
        each = sums.reshape(-1, len(self.asked))
        for column, (j, point) in enumerate(list(self.asked.items())):
            n, penalty = self.learned[j], self.block.points[self.jobs[j][1]][1]
            loss, products, residual = each[0, column], each[1:-1, column], each[-1, column]
            slope = np.append((products - self.mean[j] * residual) * self.scale[j] / n + penalty * point[:-1], residual / n)
            value = loss / n + penalty / 2 * point[:-1] @ point[:-1]
            try:
                self.asked[j] = self.running[j].send((value, slope))
            except StopIteration as end:
                self.weights[j] = self.plain(j, end.value)
                del self.asked[j], self.running[j]

    def final(self) -> tuple:
        return np.array([fold for fold, _ in self.jobs]), self.block.folds, self.weights.T


def fit_blocks(table: DataFrame, blocks: Sequence[Block]) -> list[dict]:
    """Fits, validates and tests all models of ``blocks`` over a stored table.

    ``table`` has the vector columns (``array<double>``) and the labels (0 or 1) of all blocks, ``_test`` (boolean) and ``_crc``
    (non-negative long; modulo the folds it says a row's fold). Rows without a label or one of its vectors take no
    part in a block. Models are ridge-penalised logistic regressions over values scaled by their sample deviation among the learned rows,
    with a free intercept; constant values have no weight. A block without rows gives scores of 0. Returns one record for each
    block: mean and deviation of the weighted F1 of each point over the folds, the best point (the first of equal ones), its F1 on the test rows,
    weights and intercept of its model over all training rows, sizes, and the seconds all blocks took together.
    """
    started = time.monotonic()
    sizes = _summed(table, blocks, _sizes, [b.folds for b in blocks])
    sizes = [np.zeros((b.folds + 1) * 2) if s is None else s for b, s in zip(blocks, sizes)]
    means = []
    for b, s in zip(blocks, sizes):
        per_group = s.reshape(b.folds + 1, -1)
        means.append((b.folds, per_group[:, 2:].sum(axis=0) / max(per_group[:, 0].sum(), 1)))
    spreads = _summed(table, blocks, _spreads, means)
    models = [
        _Models(b, s, np.zeros((b.folds + 1) * (len(m[1]))) if q is None else q) for b, s, q, m in zip(blocks, sizes, spreads, means)
    ]
    while any(m.asked for m in models):
        for m, sums in zip(models, _summed(table, blocks, _slopes, [m.question() for m in models])):
            if sums is not None:
                m.answer(sums)
    trained = time.monotonic()
    counts = _summed(table, blocks, _confusion, [m.final() for m in models])
    tested = time.monotonic()

    records = []
    for b, m, c in zip(blocks, models, counts):
        cells = np.zeros((4, len(m.jobs))) if c is None else c.reshape(4, -1)
        f1 = np.array([weighted_f1(cells[:, j]) for j in range(len(m.jobs))]).reshape(b.folds + 1, len(b.points))
        best = int(np.argmax(f1[: b.folds].mean(axis=0)))
        weights = m.weights[b.folds * len(b.points) + best]
        records.append({
            "name": b.name, "label": b.label, "avg_metrics": f1[: b.folds].mean(axis=0).tolist(), "std_metrics": f1[: b.folds].std(axis=0).tolist(),
            "best": best, "test_metric": float(f1[b.folds, best]), "coefficients": weights[:-1].tolist(), "intercept": float(weights[-1]),
            "train_size": int(m.rows[: b.folds].sum()), "train_positive": int(m.positive[: b.folds].sum()),
            "test_size": int(m.rows[b.folds]), "test_positive": int(m.positive[b.folds]),
            "train_time": trained - started, "test_time": tested - trained,
        })
    return records
