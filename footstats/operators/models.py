"""Logistic models on feature tables: recipes, cross-validation, perf records, sweeps."""

from __future__ import annotations

import itertools
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from footstats.operators.block_fits import Block, fit_blocks
from footstats.operators.features import DctnTransformer, array_or_null, arrays_to_vectors, lag_features
from footstats.operators.splits import split_crc32
from footstats.operators.statistics import split_sizes, union_all
from footstats.sources.schemas import PERF
from footstats.sources.staging import stage


def assemble(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=sorted(cols), outputCol=out)


def _classifier(col: str, label: str) -> list:
    scaler = StandardScaler(inputCol=col, outputCol="scaled_features")
    return [scaler, LogisticRegression(featuresCol="scaled_features", labelCol=label)]


def _first(col: str, out: str, d: int) -> VectorSlicer:
    return VectorSlicer(inputCol=col, outputCol=out, indices=list(range(d)))


def lag_columns(features: Sequence[str], k: int) -> list[str]:
    return [f"{c}_lag_{i}" for i in range(k + 1) for c in features]


def pipeline_plain(features: Sequence[str], label: str) -> Pipeline:
    return Pipeline(stages=[assemble(features), *_classifier("features", label)])


def pipeline_dctn(
    features: Sequence[str], label: str, filter_size: Sequence[int] = (3, 3, 5), tensor_shape: Sequence[int] = (3, 12, 20)
) -> Pipeline:
    corner = DctnTransformer(
        inputCol="features", outputCol="dct_features", filterSize=list(filter_size), tensorShape=list(tensor_shape)
    )
    return Pipeline(stages=[assemble(features), corner, *_classifier("dct_features", label)])


def pipeline_truncated(features: Sequence[str], label: str, d: int = 8) -> Pipeline:
    head = _first("features", "truncated_features", d)
    return Pipeline(stages=[assemble(features), head, *_classifier("truncated_features", label)])


def pipeline_lagged(features: Sequence[str], label: str, k: int = 1) -> Pipeline:
    """For tables with the columns of ``lag_features``."""
    return pipeline_plain(lag_columns(features, k), label)


def pipeline_lagged_truncated(features: Sequence[str], label: str, k: int = 1, d: int = 8) -> Pipeline:
    """Every lag is cut to ``d`` values before they are put together."""
    lags = lag_columns(features, k)
    heads = [_first(c, f"{c}_truncated", d) for c in lags]
    return Pipeline(stages=[*heads, assemble([h.getOutputCol() for h in heads]), *_classifier("features", label)])


def f1_evaluator(label: str) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(predictionCol="prediction", labelCol=label, metricName="f1")


def cross_validate(
    pipeline: Pipeline,
    train: DataFrame,
    label: str,
    max_iter: Sequence[int] = (100,),
    reg_param: Sequence[float] = (0.0,),
    elastic_net: Sequence[float] = (0.0,),
    folds: int = 3,
    key: str = "file",
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Grid search over the pipeline's classifier by weighted F1; folds run in parallel.

    A fold is ``crc32`` of the ``key`` modulo ``folds``: a file stays in one fold, and the result does not
    depend on how the table is partitioned.
    """
    lr = pipeline.getStages()[-1]
    grid = (
        ParamGridBuilder()
        .addGrid(lr.maxIter, list(max_iter))
        .addGrid(lr.regParam, list(reg_param))
        .addGrid(lr.elasticNetParam, list(elastic_net))
        .build()
    )
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=f1_evaluator(label),
        numFolds=folds, foldCol="_fold", parallelism=parallelism,
    )
    return cv.fit(train.withColumn("_fold", (F.crc32(F.col(key).cast("string")) % folds).cast("int")))


@dataclass
class Recipe:
    """One model of a sweep: which features, which label, which pipeline."""

    name: str
    features: Sequence[str]
    label: str
    kind: str = "plain"
    d: int = 8
    k: int = 1
    filter_size: Sequence[int] = (3, 3, 5)
    tensor_shape: Sequence[int] = (3, 12, 20)
    grid: dict = field(default_factory=dict)

    def pipeline(self) -> Pipeline:
        return {
            "plain": lambda: pipeline_plain(self.features, self.label),
            "dctn": lambda: pipeline_dctn(self.features, self.label, self.filter_size, self.tensor_shape),
            "truncated": lambda: pipeline_truncated(self.features, self.label, self.d),
            "lagged": lambda: pipeline_lagged(self.features, self.label, self.k),
            "lagged_truncated": lambda: pipeline_lagged_truncated(self.features, self.label, self.k, self.d),
        }[self.kind]()

    def table(self, df: DataFrame) -> DataFrame:
        """The feature table this recipe trains on: its own columns as vectors, with lags if any."""
        narrow = arrays_to_vectors(df.select("file", "time", self.label, *self.features), self.features)
        return lag_features(narrow, self.features, self.k) if self.kind.startswith("lagged") else narrow


def fit_recipe(df: DataFrame, recipe: Recipe, model_path: str | None = None) -> DataFrame:
    """Split by file, cross-validate, score the test files; one perf record.

    The prepared table is staged, since every fold and every optimiser step reads it.
    """
    return fit_prepared(stage(split_crc32(recipe.table(df)), f"fit-{recipe.name}"), recipe, model_path)


def fit_prepared(split: DataFrame, recipe: Recipe, model_path: str | None = None) -> DataFrame:
    """The perf record of a recipe over its own staged table with the column ``split``."""
    spark = split.sparkSession
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    started = time.monotonic()
    model = cross_validate(recipe.pipeline(), train, recipe.label, **recipe.grid)
    if model_path:
        model = save_model(model, model_path)
    trained = time.monotonic()
    score = f1_evaluator(recipe.label).evaluate(model.transform(test))
    tested = time.monotonic()
    sizes = {r["split"]: r for r in split_sizes(split, "split", recipe.label).collect()}  # two rows
    count = lambda side, what: int(sizes[side][what]) if side in sizes else 0
    record = (
        trained - started, [float(m) for m in model.avgMetrics], [float(m) for m in model.stdMetrics],
        model.getEvaluator().getMetricName(),
        tested - trained, float(score), recipe.label,
        count("train", "size"), count("train", "positive"), count("test", "size"), count("test", "positive"),
    )
    return spark.createDataFrame([record], PERF).withColumn("feature", F.lit(recipe.name))


def save_model(model: CrossValidatorModel, path: str) -> CrossValidatorModel:
    """Write the model, replacing an older one, and return it as loaded from there."""
    model.write().overwrite().save(path)
    return CrossValidatorModel.load(path)


def _points(recipe: Recipe) -> list[tuple[int, float, float]]:
    """Grid points of a recipe (steps, penalty, share of its absolute part) in the order of ``cross_validate``."""
    grid = {"max_iter": (100,), "reg_param": (0.0,), "elastic_net": (0.0,)} | recipe.grid
    return list(itertools.product(grid["max_iter"], grid["reg_param"], grid["elastic_net"]))


def is_ridge(recipe: Recipe) -> bool:
    """Whether no grid point of the recipe has an absolute penalty: ``fit_shared`` takes such recipes."""
    return all(share == 0 or penalty == 0 for _, penalty, share in _points(recipe))


def _corner_column(recipe: Recipe) -> str:
    return "_".join([recipe.features[0], "corner", *map(str, (*recipe.filter_size, *recipe.tensor_shape))])


def _block(recipe: Recipe) -> Block:
    lagged = recipe.kind.startswith("lagged")
    columns = lag_columns(recipe.features, recipe.k) if lagged else sorted(recipe.features)
    return Block(
        recipe.name, recipe.label, [_corner_column(recipe)] if recipe.kind == "dctn" else columns,
        [(steps, penalty) for steps, penalty, _ in _points(recipe)],
        recipe.d if recipe.kind.endswith("truncated") else None, recipe.grid.get("folds", 3),
    )


def _shared_table(df: DataFrame, recipes: Sequence[Recipe], key: str = "file") -> DataFrame:
    """Every vector that a recipe needs, as an array, written once: plain ones, corners of cosine transforms, lags."""
    features = sorted({c for r in recipes for c in r.features})
    labels = sorted({r.label for r in recipes})
    lagged = sorted({c for r in recipes if r.kind.startswith("lagged") for c in r.features})
    table = df.select(key, "time", *labels, *features)
    table = table.withColumns({
        c: F.col(c).cast("array<double>") if isinstance(df.schema[c].dataType, ArrayType) else array_or_null(F.col(c)) for c in features
    })
    if lagged:
        deepest = max(r.k for r in recipes if r.kind.startswith("lagged"))
        table = lag_features(table, lagged, deepest, keep=True)
    for recipe in {_corner_column(r): r for r in recipes if r.kind == "dctn"}.values():
        if len(recipe.features) != 1:
            raise ValueError(f"the n-dimensional transform takes one feature, {recipe.name} has {len(recipe.features)}")
        name = _corner_column(recipe)
        corner = DctnTransformer(
            inputCol="_vector", outputCol=name, filterSize=list(recipe.filter_size), tensorShape=list(recipe.tensor_shape)
        )
        vectors = arrays_to_vectors(table.withColumn("_vector", F.col(recipe.features[0])), ["_vector"])
        table = corner.transform(vectors).withColumn(name, array_or_null(F.col(name))).drop("_vector")
    marked = split_crc32(table, key).withColumns({"_test": F.col("split") == "test", "_crc": F.crc32(F.col(key).cast("string"))})
    needed = sorted({c for r in recipes for c in _block(r).columns})
    return stage(marked.select("_test", "_crc", *labels, *needed), "sweep-blocks")


def fit_shared(df: DataFrame, recipes: Sequence[Recipe]) -> tuple[DataFrame, DataFrame]:
    """(perf records, coefficients) of ridge recipes, all fitted together: one pass over the table for each step of all models.

    A recipe takes the rows that have its label and all its vectors, like ``Recipe.table``; splits, folds, scaling and
    penalty are those of ``fit_recipe``. The times in a record are those of all recipes together. Coefficients are
    ``feature, label, coefficients, intercept`` of the chosen model, for the values as they are in the table.
    """
    recipes = list(recipes)
    for r in recipes:
        if not is_ridge(r):
            raise ValueError(f"{r.name} has an absolute penalty")
    found = fit_blocks(_shared_table(df, recipes), [_block(r) for r in recipes]) if recipes else []
    sizes = ("train_size", "train_positive", "test_size", "test_positive")
    perf = [
        (m["train_time"], m["avg_metrics"], m["std_metrics"], "f1", m["test_time"], m["test_metric"], m["label"], *[m[s] for s in sizes], m["name"])
        for m in found
    ]
    weights = [(m["name"], m["label"], m["coefficients"], m["intercept"]) for m in found]
    spark = df.sparkSession
    return (
        spark.createDataFrame(perf, f"{PERF.strip()}, feature string"),
        spark.createDataFrame(weights, "feature string, label string, coefficients array<double>, intercept double"),
    )


def sweep(df: DataFrame, recipes: Sequence[Recipe], at_once: int = 4) -> DataFrame:
    """Perf records of many recipes: ridge recipes share their passes (``fit_shared``), others are fitted one by one."""
    shared, others = [r for r in recipes if is_ridge(r)], [r for r in recipes if not is_ridge(r)]
    made = [fit_shared(df, shared)[0]] if shared or not others else []
    return union_all(*made, *([fit_side_by_side(df, others, at_once)] if others else []))


def fit_side_by_side(df: DataFrame, recipes: Sequence[Recipe], at_once: int = 4) -> DataFrame:
    """Perf records of recipes as pipelines over one staged table.

    Features, split and the lags up to the largest ``k`` are computed and written once; a recipe takes its
    columns and the rows that have all its lags. ``at_once`` recipes are fitted side by side, as the steps of one
    fit wait for each other; the times of a record are wall times beside the others.
    """
    features = sorted({c for r in recipes for c in r.features})
    labels = sorted({r.label for r in recipes})
    vectors = arrays_to_vectors(df.select("file", "time", *labels, *features), features)
    lagged = sorted({c for r in recipes if r.kind.startswith("lagged") for c in r.features})
    deepest = max((r.k for r in recipes if r.kind.startswith("lagged")), default=0)
    if lagged:
        vectors = lag_features(vectors, lagged, deepest, keep=True)
    shared = stage(split_crc32(vectors), "sweep-features")

    def own(recipe: Recipe) -> DataFrame:
        if not recipe.kind.startswith("lagged"):
            return shared.select("file", "time", "split", recipe.label, *recipe.features)
        cols = lag_columns(recipe.features, recipe.k)
        whole = F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0)) == 0
        return shared.where(whole).select("file", "time", "split", recipe.label, *cols)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return union_all(*pool.map(lambda r: fit_prepared(own(r), r), recipes))


def recipes_for(
    models: Sequence[str], labels: Sequence[str], truncations: Sequence[int] = (), lags: Sequence[int] = (),
    lagged_truncations: Sequence[int] = (), tensors: dict[str, Sequence[int]] | None = None, plain: bool = True,
    filter_size: Sequence[int] = (3, 3, 5), grid: dict | None = None,
) -> list[Recipe]:
    """Recipes of every kind for each model and label, as lists of what to try.

    ``truncations`` keep that many coefficients of ``<model>_dct``; ``lags`` are plain lags; each of
    ``lagged_truncations`` is a pair (coefficients, lag); ``tensors`` gives the shape of each model that also
    takes the n-dimensional transform.
    """
    out = []
    for model in models:
        for label in labels:
            common = {"label": label, "grid": dict(grid or {})}
            if plain:
                out.append(Recipe(model, [model], **common))
            if tensors and model in tensors:
                out.append(Recipe(f"{model}_dctn", [model], kind="dctn", tensor_shape=tensors[model], filter_size=filter_size, **common))
            out += [Recipe(f"{model}_dct_d{d}", [f"{model}_dct"], kind="truncated", d=d, **common) for d in truncations]
            out += [Recipe(f"{model}_lag{k}", [model], kind="lagged", k=k, **common) for k in lags]
            out += [
                Recipe(f"{model}_dct_d{d}_lag{k}", [f"{model}_dct"], kind="lagged_truncated", d=d, k=k, **common)
                for d, k in lagged_truncations
            ]
    return out


# Fixed values of the evaluation: its models, labels, tensor shapes, coefficients and lags.
MODELS = ["emb_entity_detection_v1", "emb_entity_detection_v2", "emb_entity_detection_v3", "emb_vanilla_yolov8n"]
LABELS = ["is_match", "is_active", "is_standing"]
LAGGED_MODELS = ["emb_entity_detection_v2", "emb_entity_detection_v3"]
TENSORS = {
    "emb_entity_detection_v2": (3, 12, 20),
    "emb_entity_detection_v3": (3, 12, 20),
    "emb_vanilla_yolov8n": (80, 12, 20),
}
COEFFICIENTS = [8, 16, 32, 64]
PLAIN_LAGS = [1]
COEFFICIENTS_AND_LAGS = [(16, 1), (16, 2), (16, 3), (16, 5), (32, 1), (32, 2), (32, 3), (32, 5)]


def evaluation_recipes(
    tensors: dict[str, Sequence[int]] = TENSORS, filter_size: Sequence[int] = (3, 3, 5), grid: dict | None = None
) -> list[Recipe]:
    """The 99 models of the evaluation; vectors of another size than the stored ones bring their own ``tensors``."""
    return recipes_for(MODELS, LABELS, tensors=tensors, filter_size=filter_size, grid=grid) + recipes_for(
        LAGGED_MODELS, LABELS, COEFFICIENTS, PLAIN_LAGS, COEFFICIENTS_AND_LAGS, plain=False, grid=grid
    )
