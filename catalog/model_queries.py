"""Feature and model queries."""

import zlib

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.standins import feature_table, frame_embeddings, frame_labels, model_embeddings, table
from footstats.operators import features as ft
from footstats.operators import models as md
from footstats.operators import statistics as st
from footstats.plans.model_flow import evaluate, evaluation_table
from footstats.sources.staging import scratch_path

_total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 5)


def feature_join(spark, d):
    """Whole vectors, and the first coefficients of their transform, meet the labels."""
    emb = ft.arrays_to_vectors(frame_embeddings(spark, d), ["embedding"])
    short = ft.embedding_columns(emb).select("path", vector_to_array("embedding_dct_d8").alias("embedding"))
    joined = ft.join_features(frame_labels(spark, d), [frame_embeddings(spark, d), short], ["full", "short"])
    return joined.select(
        "file", "time", "is_match", _total("full").alias("full_sum"), _total("short").alias("d8_sum"),
        F.size("short").alias("short_size"),
    )


def _lagged(spark, d, cascade):
    lagged = ft.lag_features(feature_table(spark, d), ["emb"], 3, cascade=cascade)
    return lagged.select("file", "time", *[_total(f"emb_lag_{i}").alias(f"lag_{i}") for i in range(4)])


def lag_features(spark, d):
    return _lagged(spark, d, False)


def lag_features_cascade(spark, d):
    return _lagged(spark, d, True)


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ft.arrays_to_vectors(rows, ["embedding"])


def _coefficients(df, col):
    long = df.select("vec_id", F.posexplode(vector_to_array(F.col(col))).alias("i", "v"))
    return long.select("vec_id", "i", F.round("v", 5).alias("v"))


def dct1d(spark, d):
    return _coefficients(ft.dct1d(_vectors(spark, d), "embedding", "out"), "out")


def slice_d8(spark, d):
    return _coefficients(ft.slice_vector(_vectors(spark, d), "embedding", "out", 8), "out")


def embedding_dct_d8(spark, d):
    return _coefficients(ft.embedding_columns(_vectors(spark, d)), "embedding_dct_d8")


def dctn_corner(spark, d):
    corner = ft.DctnTransformer(inputCol="embedding", outputCol="out", filterSize=[2, 2, 3], tensorShape=[4, 4, 4])
    return _coefficients(corner.transform(_vectors(spark, d)), "out")


def _halves():
    """Stands for a network: sums of the first and second half of a tensor."""

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch.reshape(len(batch), 2, -1).sum(axis=2)

    return predict


def batch_infer(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = ft.batch_infer(rows, "x", _halves, 64, "out", tensor_shape=[64])
    return out.select("vec_id", F.posexplode(vector_to_array("out")).alias("i", "v")).select(
        "vec_id", "i", F.round("v", 3).alias("v")
    )


def inference_stage(spark, d):
    """Weights stored, a pipeline of inference and transform saved and loaded: the loaded one answers."""
    halves = np.kron(np.eye(2), np.ones((32, 1)))
    ft.save_weights(spark, {"w0": halves}, checkpoint := scratch_path(spark, "weights"))
    stage = ft.BatchInference(inputCol="embedding", outputCol="halves", batchSize=64, tensorShape=[4, 16], checkpoint=checkpoint)
    corner = ft.DctnTransformer(inputCol="halves", outputCol="out", filterSize=[2], tensorShape=[2])
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    Pipeline(stages=[stage, corner]).fit(rows).write().overwrite().save(path := scratch_path(spark, "inference"))
    out = PipelineModel.load(path).transform(rows)
    return out.select("vec_id", F.posexplode(vector_to_array("out")).alias("i", "v")).select("vec_id", "i", F.round("v", 2).alias("v"))


def confusion_metrics(spark, d):
    scores = st.confusion_metrics(table(spark, d, "labels"), "quality", "toxic")
    return scores.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


# Several points, so that a choice is made.
_GRID = {"max_iter": (100,), "reg_param": (0.01, 0.1), "elastic_net": (0.0,), "folds": 3}
RECIPES = {
    "fit_plain": md.Recipe("emb", ["emb"], "is_active", grid=_GRID),
    "fit_truncated": md.Recipe("emb_d16", ["emb"], "is_active", "truncated", d=16, grid=_GRID),
    "fit_dctn": md.Recipe(
        "emb_dctn", ["emb"], "is_active", "dctn", filter_size=(2, 2, 3), tensor_shape=(4, 4, 4), grid=_GRID
    ),
    "fit_lagged": md.Recipe("emb_lag1", ["emb"], "is_active", "lagged", k=1, grid=_GRID),
    "fit_lagged_truncated": md.Recipe("emb_d8_lag2", ["emb"], "is_active", "lagged_truncated", d=8, k=2, grid=_GRID),
}


def _shown(perf):
    """What of a perf record depends on the data alone: sizes, the mean F1 of each of the two grid points over the folds, the chosen
    point and the F1 of the test rows."""
    share = lambda c: (c >= 0) & (c <= 1)
    return perf.select(
        "feature", "label", "metric_name", F.size("avg_metrics").alias("grid_points"),
        (F.forall("avg_metrics", share) & share(F.col("test_metric"))).alias("scored"),
        F.array_position("avg_metrics", F.array_max("avg_metrics")).cast("int").alias("chosen_point"),
        *[F.round(F.element_at("avg_metrics", i), 3).alias(f"f1_point_{i}") for i in (1, 2)], F.round("test_metric", 3).alias("test_f1"),
        "train_size", "train_positive", "test_size", "test_positive",
    )


def _fit(recipe):
    return lambda spark, d: _shown(md.fit_recipe(feature_table(spark, d), recipe))


def sweep(spark, d):
    """Every kind of recipe for both labels, over one staged table."""
    recipes = md.recipes_for(
        ["emb"], ["is_match", "is_active"], truncations=(8, 16), lags=(1,), lagged_truncations=((8, 2), (16, 1)),
        tensors={"emb": (4, 4, 4)}, filter_size=(2, 2, 3), grid=_GRID,
    )
    return _shown(md.sweep(feature_table(spark, d), recipes))


def evaluation_sweep(spark, d):
    """All 99 models of the evaluation, in common passes."""
    vectors = [ft.arrays_to_vectors(e, ["embedding"]) for e in model_embeddings(spark, d)]
    recipes = md.evaluation_recipes(dict.fromkeys(md.TENSORS, (4, 4, 4)), (2, 2, 3), _GRID)
    return _shown(evaluate(evaluation_table(frame_labels(spark, d), vectors), recipes))


def model_reload(spark, d):
    """Fit, save, load: the loaded model scores every row as the fitted one does."""
    table_ = RECIPES["fit_truncated"].table(feature_table(spark, d))
    fitted = md.cross_validate(md.pipeline_truncated(["emb"], "is_active", 16), table_, "is_active", reg_param=(0.1,))
    fitted.write().overwrite().save(path := scratch_path(spark, "model"))
    loaded = md.CrossValidatorModel.load(path)
    score = vector_to_array("probability")
    one, two = (m.transform(table_).select("file", "time", score.alias(n)) for m, n in ((fitted, "p"), (loaded, "q")))
    return one.join(two, ["file", "time"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") != F.col("q")).alias("differing")
    )


QUERIES = {
    **{
        f.__name__: f
        for f in (
            feature_join, lag_features, lag_features_cascade, dct1d, slice_d8, embedding_dct_d8, dctn_corner,
            batch_infer, inference_stage, confusion_metrics,
        )
    },
    **{name: _fit(recipe) for name, recipe in RECIPES.items()},
    "sweep": sweep,
    "evaluation_sweep": evaluation_sweep,
    "model_reload": model_reload,
}


def _lag_sql(first):
    lags = ", ".join(f"lag(s, {i}) OVER w AS lag_{i}" for i in range(4))
    return f"""WITH t AS (
          SELECT printf('clips/mat_%02d/0001.mp4', label) AS file, vec_id AS time,
                 round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS s FROM embeddings),
        l AS (SELECT file, time, {lags}, row_number() OVER w AS n FROM t
              WINDOW w AS (PARTITION BY file ORDER BY time))
        SELECT file, time, lag_0, lag_1, lag_2, lag_3 FROM l WHERE n > {first}"""


_LONG = "SELECT vec_id, n - 1 AS n, CAST(embedding[n] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(n)"


def _dct_sql(d):
    return f"""WITH x AS ({_LONG})
        SELECT vec_id, CAST(k AS INTEGER) AS i,
               round(sum(x * cos(pi() * k * (2 * n + 1) / 128)) * CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END, 5)
                 AS v
        FROM x, range({d}) f(k) GROUP BY vec_id, k"""


_WHOLE = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _scores_sql(feature, d, x, lag=0, label="is_active", points=_GRID["reg_param"], steps=200, seen=_WHOLE):
    """A perf record by gradient descent with momentum: ridge-penalised logistic models, each with features scaled on its own rows.

    ``x`` makes the ``d`` features of a row from ``e``, what the model has ``seen``, and its lags ``e1``, ``e2``, …. A fit is a fold
    left out (-1: none, the final model) and a penalty; all are iterated together.
    """
    crc = " ".join(f"WHEN {m} THEN {_CRC[f'clips/mat_{m:02d}/0001.mp4']}" for m in range(10))
    grid = ", ".join(f"({n}, {reg})" for n, reg in enumerate(points, 1))
    truth = {"is_match": "vec_id % 2 > 0", "is_active": "embedding[1] > 0", "is_standing": "embedding[2] > embedding[3]"}[label]
    lags = "".join(f"lag(e, {n}) OVER o AS e{n}, " for n in range(1, lag + 1))
    return f"""WITH RECURSIVE v AS (
          SELECT vec_id, CASE label {crc} END AS crc, CAST({truth} AS INT) AS y, label AS own,
                 {seen} AS e FROM embeddings),
        g AS (SELECT *, {lags}row_number() OVER o AS n FROM v WINDOW o AS (PARTITION BY own ORDER BY vec_id)),
        t AS (SELECT vec_id, crc, y, {x} AS x FROM g WHERE n > {lag}),
        r AS (SELECT vec_id, y, x, crc % 100 < 80 AS train, crc % 3 AS part FROM t),
        f(fold) AS (VALUES (-1), (0), (1), (2)), grid(point, reg) AS (VALUES {grid}),
        own AS (SELECT fold, vec_id, y, x, train AND part <> fold AS learned,
                       CASE WHEN fold < 0 THEN NOT train ELSE train AND part = fold END AS scored FROM r, f),
        sd AS (SELECT fold, list(s ORDER BY i) AS sd, list(m ORDER BY i) AS mean FROM (
                 SELECT fold, i, stddev_samp(x[i]) AS s, avg(x[i]) AS m FROM own, range(1, {d + 1}) k(i) WHERE learned GROUP BY fold, i) GROUP BY fold),
        z AS MATERIALIZED (
          SELECT fold, vec_id, y, learned, scored,
                 list_append(list_transform(list_zip(x, sd, mean), lambda p: coalesce((p[1] - p[3]) / nullif(p[2], 0), 0.0)), 1.0) AS x
          FROM own JOIN sd USING (fold) WHERE learned OR scored),
        w(fold, point, reg, step, w, o) AS (
          SELECT fold, point, reg, 0, list_transform(range(0, {d + 1}), lambda i: CAST(0 AS DOUBLE)) AS z, z FROM f, grid
          UNION ALL
          SELECT fold, point, reg, step + 1, list(c ORDER BY i), list(b ORDER BY i) FROM (
            SELECT fold, point, reg, step, i, any_value(w[i]) AS b,
                   1.75 * any_value(w[i]) - 0.75 * any_value(o[i]) - (avg((p - y) * x[i]) + CASE WHEN i <= {d} THEN reg * any_value(w[i]) ELSE 0 END) AS c
            FROM (SELECT w.*, z.x, z.y, 1 / (1 + exp(-list_dot_product(w.w, z.x))) AS p
                  FROM w JOIN z ON z.fold = w.fold AND learned WHERE step < {steps}), range(1, {d + 2}) k(i)
            GROUP BY fold, point, reg, step, i) GROUP BY fold, point, reg, step),
        said AS (SELECT w.fold, point, y, CAST(list_dot_product(w.w, z.x) > 0 AS INT) AS said
                 FROM w JOIN z ON z.fold = w.fold AND scored WHERE step = {steps}),
        cls AS (SELECT fold, point, l, sum(CAST(y = l AS INT)) AS n, sum(CAST(said = l AS INT)) AS m,
                       sum(CAST(y = l AND said = l AS INT)) AS hit, count(*) AS total
                FROM said, (VALUES (0), (1)) c(l) GROUP BY fold, point, l),
        f1 AS (SELECT fold, point, sum(n / total * coalesce(2 * hit / nullif(n + m, 0), 0)) AS f1 FROM cls GROUP BY fold, point),
        mean AS (SELECT point, avg(f1) AS f1 FROM f1 WHERE fold >= 0 GROUP BY point),
        best AS (SELECT point FROM mean ORDER BY f1 DESC, point LIMIT 1)
        SELECT '{feature}' AS feature, '{label}' AS label, 'f1' AS metric_name, (SELECT CAST(count(*) AS INT) FROM grid) AS grid_points,
               (SELECT min(f1) >= 0 AND max(f1) <= 1 FROM f1) AS scored, CAST(b.point AS INT) AS chosen_point,
               (SELECT round(f1, 3) FROM mean WHERE point = 1) AS f1_point_1, (SELECT round(f1, 3) FROM mean WHERE point = 2) AS f1_point_2,
               round(f1.f1, 3) AS test_f1,
               (SELECT count(*) FROM r WHERE train) AS train_size, (SELECT count(*) FROM r WHERE train AND y = 1) AS train_positive,
               (SELECT count(*) FROM r WHERE NOT train) AS test_size, (SELECT count(*) FROM r WHERE NOT train AND y = 1) AS test_positive
        FROM best b JOIN f1 ON f1.point = b.point AND f1.fold = -1"""


# DuckDB has no crc32: the digests of the stand-in's ten file names.
_CRC = {f"clips/mat_{m:02d}/0001.mp4": zlib.crc32(f"clips/mat_{m:02d}/0001.mp4".encode()) for m in range(10)}
_CORNER = """list_transform(range(12), lambda j: list_sum(list_transform(range(64), lambda n: 8 * e[n + 1]
          * cos(pi() * (j // 6) * (2 * (n // 16) + 1) / 8) * cos(pi() * (j // 3 % 2) * (2 * (n // 4 % 4) + 1) / 8)
          * cos(pi() * (j % 3) * (2 * (n % 4) + 1) / 8))))"""


def _dct_of(vector, d):
    return f"""list_transform(range({d}), lambda k: CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END
          * list_sum(list_transform(range(64), lambda n: {vector}[n + 1] * cos(pi() * k * (2 * n + 1) / 128))))"""


#: What the models of ``model_embeddings`` see.
_SEEN = dict(zip(md.MODELS, [
    _WHOLE, f"list_reverse({_WHOLE})",
    "list_transform(range(64), lambda n: CAST(embedding[(n + 1) % 64 + 1] AS DOUBLE) - CAST(embedding[n + 1] AS DOUBLE) / 2)",
    "list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))",
]))


def _with_lags(make, k):
    return f"list_concat({', '.join([make('e'), *[make(f'e{n}') for n in range(1, k + 1)]])})"


def _evaluated():
    """The 99 models: feature, number of features, what makes them, lag, label, what the model sees."""
    for label in md.LABELS:
        for model, seen in _SEEN.items():
            yield model, 64, "e", 0, label, seen
            if model in md.TENSORS:
                yield f"{model}_dctn", 12, _CORNER, 0, label, seen
            if model in md.LAGGED_MODELS:
                for d in md.COEFFICIENTS:
                    yield f"{model}_dct_d{d}", d, _dct_of("e", d), 0, label, seen
                yield f"{model}_lag1", 128, "list_concat(e, e1)", 1, label, seen
                for d, k in md.COEFFICIENTS_AND_LAGS:
                    yield f"{model}_dct_d{d}_lag{k}", d * (k + 1), _with_lags(lambda e, d=d: _dct_of(e, d), k), k, label, seen


#: Swept recipes: feature, number of features, what makes them, lag.
_SWEPT = [
    ("emb", 64, "e", 0), ("emb_dctn", 12, _CORNER, 0), ("emb_dct_d8", 8, _dct_of("e", 8), 0), ("emb_dct_d16", 16, _dct_of("e", 16), 0),
    ("emb_lag1", 128, "list_concat(e, e1)", 1),
    ("emb_dct_d8_lag2", 24, f"list_concat({_dct_of('e', 8)}, {_dct_of('e1', 8)}, {_dct_of('e2', 8)})", 2),
    ("emb_dct_d16_lag1", 32, f"list_concat({_dct_of('e', 16)}, {_dct_of('e1', 16)})", 1),
]

ORACLES = {
    "fit_plain": _scores_sql("emb", 64, "e"),
    "fit_truncated": _scores_sql("emb_d16", 16, "e[1:16]"),
    "fit_dctn": _scores_sql("emb_dctn", 12, _CORNER),
    "fit_lagged": _scores_sql("emb_lag1", 128, "list_concat(e, e1)", 1),
    "fit_lagged_truncated": _scores_sql("emb_d8_lag2", 24, "list_concat(e[1:8], e1[1:8], e2[1:8])", 2),
    "sweep": " UNION ALL ".join(
        f"SELECT * FROM ({_scores_sql(f, d, x, lag, label)})" for label in ("is_match", "is_active") for f, d, x, lag in _SWEPT
    ),
    "evaluation_sweep": " UNION ALL ".join(
        f"SELECT * FROM ({_scores_sql(f, d, x, lag, label, seen=seen)})" for f, d, x, lag, label, seen in _evaluated()
    ),
    "model_reload": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM embeddings",
    "feature_join": """SELECT printf('clips/mat_%02d/0001.mp4', label) AS file, vec_id AS time,
        CAST(vec_id % 2 AS INTEGER) AS is_match,
        round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS full_sum,
        round(list_sum(list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 64), lambda n:
          CAST(embedding[n + 1] AS DOUBLE) * cos(pi() * k * (2 * n + 1) / 128))) * CASE WHEN k = 0 THEN sqrt(1 / 64) ELSE sqrt(2 / 64) END)), 5) AS d8_sum,
        8 AS short_size FROM embeddings""",
    "lag_features": _lag_sql(3),
    "lag_features_cascade": _lag_sql(6),
    "dct1d": _dct_sql(64),
    "embedding_dct_d8": _dct_sql(8),
    "slice_d8": f"WITH x AS ({_LONG}) SELECT vec_id, CAST(n AS INTEGER) AS i, round(x, 5) AS v FROM x WHERE n < 8",
    "dctn_corner": f"""WITH x AS ({_LONG})
        SELECT vec_id, CAST((a * 2 + b) * 3 + c AS INTEGER) AS i,
               round(sum(8 * x * cos(pi() * a * (2 * (n // 16) + 1) / 8) * cos(pi() * b * (2 * (n // 4 % 4) + 1) / 8)
                           * cos(pi() * c * (2 * (n % 4) + 1) / 8)), 5) AS v
        FROM x, range(2) fa(a), range(2) fb(b), range(3) fc(c) GROUP BY vec_id, a, b, c""",
    "batch_infer": f"""WITH x AS ({_LONG}) SELECT vec_id, CAST(n // 32 AS INTEGER) AS i, round(sum(x), 3) AS v
        FROM x GROUP BY vec_id, n // 32""",
    "inference_stage": f"""WITH x AS ({_LONG}), h AS (SELECT vec_id, n // 32 AS h, sum(x) AS s FROM x GROUP BY vec_id, n // 32)
        SELECT vec_id, CAST(k AS INTEGER) AS i, round(sum(2 * s * cos(pi() * k * (2 * h + 1) / 4)), 2) AS v
        FROM h, range(2) f(k) GROUP BY vec_id, k""",
    "confusion_metrics": """WITH c AS (
          SELECT k AS class, count(CASE WHEN quality = k AND toxic = k THEN 1 END) AS tp,
                 count(CASE WHEN quality <> k AND toxic <> k THEN 1 END) AS tn,
                 count(CASE WHEN quality <> k AND toxic = k THEN 1 END) AS fp,
                 count(CASE WHEN quality = k AND toxic <> k THEN 1 END) AS fn
          FROM labels, (SELECT unnest([0, 1]) AS k) GROUP BY k),
        pr AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision,
                      tp / nullif(tp + fn, 0) AS recall FROM c)
        SELECT class, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
               round(recall, 6) AS recall,
               round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM pr""",
}
