"""Feature tables: joins with labels, lags, cosine transforms, batch inference."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import DCT, VectorSlicer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from footstats.operators.frames import frame_key
from footstats.operators.sequences import CHUNK_ROWS, chunk_of, with_halo, with_position


def rename_prefix(df: DataFrame, old: str, new: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the columns that begin with ``old``, there renamed to begin with ``new``."""
    return df.select(*keep, *[F.col(c).alias(c.replace(old, new)) for c in df.columns if c.startswith(old)])


def join_features(
    labels: DataFrame, tables: Sequence[DataFrame], names: Sequence[str], on: Sequence[str] = ("file", "time")
) -> DataFrame:
    """Labels with the embeddings of every model, inner on ``(file, time)``.

    All joins share one key, so each table is exchanged once.
    """
    keyed = [rename_prefix(frame_key(t), "embedding", n, on) for t, n in zip(tables, names)]
    return reduce(lambda left, right: left.join(right, list(on)), keyed, labels)


def lag_features(
    df: DataFrame,
    cols: Sequence[str],
    k: int,
    key: Sequence[str] = ("file",),
    order: str = "time",
    cascade: bool = False,
    keep: bool = False,
    bucket: int = CHUNK_ROWS,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``<col>_lag_0 … <col>_lag_k``; rows without all lags are dropped.

    One pass drops ``k`` rows per key. ``cascade`` drops what filtering after each lag
    would: ``len(cols) * k * (k + 1) / 2`` rows; ``keep`` drops none. ``bucket`` is a stretch of ``order`` that
    holds few enough rows of a key for one task.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    placed = with_position(df.where(present), key, [order], chunk_of(order, bucket), "_pos")

    def lags(w):
        return {f"{c}_lag_{i}": F.lag(c, i).over(w) for i in range(k + 1) for c in cols}

    first = 0 if keep else len(cols) * k * (k + 1) // 2 if cascade else k
    return with_halo(placed, key, "_pos", k, 0, lags, size).where(F.col("_pos") >= first).drop("_pos")


def arrays_to_vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Array columns become ML vectors; vector columns stay."""
    arrays = [c for c in cols if isinstance(df.schema[c].dataType, ArrayType)]
    return df.withColumns({c: _vector_or_null(F.col(c).cast("array<double>")) for c in arrays})


def _vector_or_null(values: Column) -> Column:
    return F.when(values.isNotNull(), array_to_vector(F.coalesce(values, F.array().cast("array<double>"))))


def array_or_null(vector: Column) -> Column:
    return F.when(vector.isNotNull(), vector_to_array(vector))


def dct1d(df: DataFrame, col: str, out: str) -> DataFrame:
    """Orthonormal DCT-II of a vector."""
    return DCT(inputCol=col, outputCol=out).transform(df)


def slice_vector(df: DataFrame, col: str, out: str, d: int) -> DataFrame:
    return VectorSlicer(inputCol=col, outputCol=out, indices=list(range(d))).transform(df)


def embedding_columns(df: DataFrame, col: str = "embedding", d: int = 8) -> DataFrame:
    """``embedding`` -> also ``embedding_dct`` and its first ``d`` coefficients."""
    return slice_vector(dct1d(df, col, f"{col}_dct"), f"{col}_dct", f"{col}_dct_d{d}", d)


def batch_infer(
    df: DataFrame, cols: str | Sequence[str], make_predict_fn: Callable, batch_size: int, out: str,
    tensor_shape: Sequence[int] | None = None,
) -> DataFrame:
    """Vector output of any model over batches of rows.

    ``make_predict_fn`` loads the model once per worker and returns a function from a
    batch to a 2-D array; ``tensor_shape`` reshapes array inputs. A result with another
    number of rows than its batch raises ``ValueError``.
    """

    def checked():
        predict_batch = make_predict_fn()

        def run(*batch):
            result = predict_batch(*batch)
            if len(result) != len(batch[0]):
                raise ValueError(f"{len(batch[0])} rows in a batch, {len(result)} rows in the model's result")
            return result

        return run

    names = [cols] if isinstance(cols, str) else list(cols)
    shapes = {"input_tensor_shapes": [list(tensor_shape)]} if tensor_shape else {}
    predict = predict_batch_udf(
        checked, return_type=ArrayType(FloatType()), batch_size=batch_size, **shapes
    )
    return df.withColumn(out, array_to_vector(predict(*names)))


class HasFilterSize(Params):
    """How many low-frequency coefficients to keep per axis."""

    filterSize: Param[list[int]] = Param(
        Params._dummy(), "filterSize", "coefficients kept per axis", TypeConverters.toListInt
    )

    def getFilterSize(self) -> list[int]:
        return self.getOrDefault(self.filterSize)


class HasTensorShape(Params):
    """Shape of the tensor that a vector flattens (last axis fastest)."""

    tensorShape: Param[list[int]] = Param(
        Params._dummy(), "tensorShape", "shape of the flattened tensor", TypeConverters.toListInt
    )

    def getTensorShape(self) -> list[int]:
        return self.getOrDefault(self.tensorShape)


class HasBatchSize(Params):
    """Rows that a model sees at once."""

    batchSize: Param[int] = Param(Params._dummy(), "batchSize", "rows of a batch", TypeConverters.toInt)

    def getBatchSize(self) -> int:
        return self.getOrDefault(self.batchSize)


class HasCheckpoint(Params):
    """Where a model's weights lie, and what makes a model of them."""

    checkpoint: Param[str] = Param(Params._dummy(), "checkpoint", "path of stored weights", TypeConverters.toString)
    loader: Param[str] = Param(
        Params._dummy(), "loader", "module:function, from weights by name to a function of batches", TypeConverters.toString
    )

    def getCheckpoint(self) -> str:
        return self.getOrDefault(self.checkpoint)

    def getLoader(self) -> str:
        return self.getOrDefault(self.loader)


#: Bytes of weights that may be sent to the workers.
WEIGHT_BYTES = 1 << 30


def save_weights(spark: SparkSession, weights: Mapping[str, np.ndarray], path: str) -> None:
    """Write a model's arrays as a table ``name, shape, values``, replacing older ones."""
    rows = [(name, list(np.shape(a)), np.asarray(a, float).ravel().tolist()) for name, a in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of ``save_weights``; more than ``WEIGHT_BYTES`` are an error, since they go to every worker."""
    stored = spark.read.parquet(path)
    size = 8 * (stored.agg(F.sum(F.size("values"))).first()[0] or 0)
    if size > WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of weights in {path}, more than {WEIGHT_BYTES}")
    return {r["name"]: np.asarray(r["values"]).reshape(r["shape"]) for r in stored.collect()}


def dense_layers(weights: Mapping[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Layers ``w0, b0, w1, b1, …`` with rectified values between them; a missing ``b`` adds nothing."""
    count = sum(name.startswith("w") for name in weights)

    def predict(batch: np.ndarray) -> np.ndarray:
        x = batch.reshape(len(batch), -1)
        for n in range(count):
            x = (x if n == 0 else np.maximum(x, 0)) @ weights[f"w{n}"] + weights.get(f"b{n}", 0)
        return x

    return predict


class BatchInference(
    Transformer, HasInputCol, HasOutputCol, HasBatchSize, HasTensorShape, HasCheckpoint, DefaultParamsReadable, DefaultParamsWritable
):
    """Inference with a stored model as a pipeline stage that is saved and loaded like any other.

    The stage holds parameters only: the weights stay at ``checkpoint`` (a table of ``save_weights``) and are read when
    the stage runs; ``loader`` names the function that makes a model of them. Input is a vector or an array of
    the size of ``tensorShape``; null gives null, a batch arrives in that shape.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, batchSize=None, tensorShape=None, checkpoint=None, loader=None):
        super().__init__()
        self._setDefault(batchSize=256, loader=f"{__name__}:{dense_layers.__name__}")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        module, _, name = self.getLoader().partition(":")
        build = getattr(importlib.import_module(module), name)
        sent = df.sparkSession.sparkContext.broadcast(load_weights(df.sparkSession, self.getCheckpoint()))
        shape, col, out = self.getTensorShape(), self.getInputCol(), self.getOutputCol()
        given = F.col(col) if isinstance(df.schema[col].dataType, ArrayType) else array_or_null(F.col(col))
        nothing = F.array_repeat(F.lit(0.0), math.prod(shape))
        filled = df.withColumn("_tensor", F.coalesce(given.cast("array<double>"), nothing))
        found = batch_infer(filled, "_tensor", lambda: build(sent.value), self.getBatchSize(), out, shape)
        return found.withColumn(out, F.when(F.col(col).isNotNull(), F.col(out))).drop("_tensor")


class DctnTransformer(
    Transformer, HasInputCol, HasOutputCol, HasFilterSize, HasTensorShape, DefaultParamsReadable, DefaultParamsWritable
):
    """Low-frequency corner of the n-dimensional DCT-II of a vector, not normalised.

    The transform is separable and only the corner is wanted, so a batch is multiplied
    by one small cosine matrix (kept frequencies x length) per axis.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, filterSize=None, tensorShape=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        shape, kept = self.getTensorShape(), self.getFilterSize()
        if len(shape) != len(kept) or any(k > n for k, n in zip(kept, shape)):
            raise ValueError(f"filter {kept} does not fit into tensor {shape}")

        @F.pandas_udf("array<double>")
        def corner(vectors: pd.Series) -> pd.Series:
            known = vectors.notna().to_numpy()
            if not known.any():
                return pd.Series([None] * len(vectors), dtype=object)
            x = np.stack(vectors[known].to_numpy()).reshape(-1, *shape)
            for axis, (k, n) in enumerate(zip(kept, shape), 1):
                angle = np.pi * np.outer(np.arange(k), 2 * np.arange(n) + 1) / (2 * n)
                x = np.moveaxis(np.tensordot(x, 2 * np.cos(angle), axes=(axis, 1)), -1, axis)
            return pd.Series(list(x.reshape(len(x), -1)), index=vectors.index[known], dtype=object).reindex(vectors.index)

        return df.withColumn(
            self.getOutputCol(), _vector_or_null(corner(array_or_null(F.col(self.getInputCol()))))
        )
