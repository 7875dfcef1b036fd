"""Models fitted together equal models fitted alone."""

import random
import zlib

import numpy as np
import pytest

from footstats.operators import models as md
from footstats.operators.block_fits import minimise, weighted_f1


def clips(n=24, seconds=25, seed=5, gaps=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for t in range(seconds):
            y = rng.randint(0, 1)
            x = [y * 0.8 + rng.gauss(0, 1), 1000 + rng.gauss(0, 3), 0.5, rng.gauss(0, 1), y - rng.gauss(0, 2), 0.0]
            unknown = gaps and rng.random() < 0.05
            rows.append((f"clip_{i}.mp4", t, None if gaps and rng.random() < 0.05 else y, int(rng.random() < 0.2), None if unknown else x))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "file string, time long, is_match int, is_active int, emb array<double>")


def newton(x, y, penalty):
    """Ridge-penalised logistic regression on scaled values by full Newton steps: (deviations, weights, intercept)."""
    deviation = x.std(axis=0, ddof=1)
    z = np.hstack([np.where(deviation > 1e-12, (x - x.mean(axis=0)) / np.where(deviation > 1e-12, deviation, 1), 0), np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], penalty), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (p - y) / len(y) + ridge * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge + 1e-12), slope)
    plain = np.where(deviation > 1e-12, w[:-1] / np.where(deviation > 1e-12, deviation, 1), 0)
    return plain, w[-1] - plain @ x.mean(axis=0)


def test_equals_newton_on_each_fold(spark):
    rows = clips()
    grid = {"reg_param": (0.02, 0.5), "folds": 3}
    perf, weights = md.fit_shared(table(spark, rows).repartition(7), [md.Recipe("e", ["emb"], "is_match", grid=grid), md.Recipe("e", ["emb"], "is_active", grid=grid)])
    got, found = {r.label: r for r in perf.collect()}, {r.label: r for r in weights.collect()}
    for at, label in ((2, "is_match"), (3, "is_active")):
        known = [r for r in rows if r[at] is not None and r[4] is not None]
        x, y = np.array([r[4] for r in known]), np.array([r[at] for r in known], float)
        crc = np.array([zlib.crc32(r[0].encode()) for r in known])
        train, part = crc % 100 < 80, crc % 3

        def score(learned, scored, penalty):
            w, b = newton(x[learned], y[learned], penalty)
            said = x[scored] @ w + b > 0
            return weighted_f1(np.array([((y[scored] == t) & (said == s)).sum() for t in (0, 1) for s in (0, 1)], float))

        for n, penalty in enumerate(grid["reg_param"]):
            each = [score(train & (part != k), train & (part == k), penalty) for k in range(3)]
            assert got[label].avg_metrics[n] == pytest.approx(np.mean(each)) and got[label].std_metrics[n] == pytest.approx(np.std(each))
        best = grid["reg_param"][int(np.argmax(got[label].avg_metrics))]
        assert got[label].test_metric == pytest.approx(score(train, ~train, best))
        w, b = newton(x[train], y[train], best)
        assert found[label].coefficients == pytest.approx(w, abs=1e-4) and found[label].intercept == pytest.approx(b, abs=1e-2)
        assert (got[label].train_size, got[label].test_positive) == (train.sum(), y[~train].sum())


@pytest.mark.parametrize("kind", [{"kind": "dctn", "filter_size": (2, 2), "tensor_shape": (2, 3)}, {"kind": "lagged", "k": 2}, {"kind": "lagged_truncated", "k": 1, "d": 4}])
def test_equals_the_pipeline(spark, kind):
    df = table(spark, clips(gaps=False))
    recipe = md.Recipe("r", ["emb"], "is_match", grid={"reg_param": (0.05, 0.3)}, **kind)
    alone, together = md.fit_recipe(df, recipe).first(), md.fit_shared(df, [recipe])[0].first()
    assert together.avg_metrics == pytest.approx(alone.avg_metrics, abs=1e-9) and together.test_metric == pytest.approx(alone.test_metric)
    for name in ("metric_name", "label", "train_size", "train_positive", "test_size", "test_positive", "feature"):
        assert together[name] == alone[name]


def test_one_class_and_no_rows(spark):
    rows = [(f, t, m, 1, x) for f, t, m, _, x in clips(gaps=False)]
    recipe = md.Recipe("e", ["emb"], "is_active")
    perf, weights = md.fit_shared(table(spark, rows), [recipe])
    assert perf.first().test_metric == 1 and set(weights.first().coefficients) == {0.0}
    empty = md.fit_shared(table(spark, []), [recipe])[0].first()
    assert (empty.test_metric, empty.train_size, empty.test_size) == (0, 0, 0)
    unknown = md.fit_shared(table(spark, [("a", 1, None, None, None)]), [recipe])[0].first()
    assert unknown.train_size + unknown.test_size == 0
    assert md.sweep(table(spark, rows), []).count() == 0
    with pytest.raises(Exception, match="other than 0 and 1"):
        md.fit_shared(table(spark, [(f, t, m, 7, x) for f, t, m, _, x in rows]), [recipe])


def test_absolute_penalty_goes_alone(spark):
    df = table(spark, clips(n=12, gaps=False))
    ridge, lasso = md.Recipe("ridge", ["emb"], "is_match", grid={"reg_param": (0.1,)}), md.Recipe("lasso", ["emb"], "is_match", grid={"reg_param": (0.1,), "elastic_net": (1.0,)})
    with pytest.raises(ValueError):
        md.fit_shared(df, [lasso])
    got = {r.feature: r.test_metric for r in md.sweep(df, [lasso, ridge]).collect()}
    assert set(got) == {"lasso", "ridge"} and got["lasso"] == pytest.approx(md.fit_recipe(df, lasso).first().test_metric)


def test_passes_do_not_grow_with_recipes(spark):
    """A step of all models is one pass: jobs follow the slowest model, not their number."""
    df = table(spark, clips(n=12, gaps=False))

    def jobs(recipes):
        group = f"count-{len(recipes)}"
        spark.sparkContext.setJobGroup(group, group)
        md.fit_shared(df, recipes)
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    grid = {"reg_param": (0.01,)}
    one = jobs([md.Recipe("emb", ["emb"], "is_match", grid=grid)])
    many = jobs([md.Recipe(f"d{d}", ["emb"], label, "truncated", d=d, grid=grid) for d in range(1, 7) for label in ("is_match", "is_active")])
    assert many < 3 * one


def test_minimise_quadratic():
    h, target = np.diag([1.0, 10.0, 100.0]), np.array([1.0, -2.0, 3.0])
    walk = minimise(np.zeros(3), 100)
    point = next(walk)
    with pytest.raises(StopIteration) as end:
        while True:
            point = walk.send((0.5 * (point - target) @ h @ (point - target), h @ (point - target)))
    assert end.value.value == pytest.approx(target, abs=1e-5)
