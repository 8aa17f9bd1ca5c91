"""The leave-one-out probe fit against a plain solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.operators import ml as ML


def answers(seed=1, topics=6, models=5, probes=40):
    rnd = np.random.default_rng(seed)
    lean = rnd.normal(size=(topics, probes))
    return [(f"t{t}" if t else "default", f"m{m}", int(p), "yes" if rnd.random() < 1 / (1 + np.exp(-2 * lean[t, p])) else "no")
            for t in range(topics) for m in range(models) for p in range(probes) if rnd.random() < 0.9]


def plain_fit(x, t, reg=1.0):
    n, n1 = len(t), t.sum()
    w = np.where(t == 1, n / (2 * n1), 1.0)
    a = np.hstack([x, np.ones((n, 1))])
    ridge = np.append(np.full(x.shape[1], 1 / reg), 0)
    beta = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a @ beta)))
        beta = beta - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-12), a.T @ (w * (p - t)) + ridge * beta)
    return beta


@pytest.fixture(scope="module")
def features(spark):
    rows = spark.createDataFrame(answers(), "topic STRING, model STRING, qid LONG, output STRING")
    return ML.probe_features(rows, "default").repartition(7)


@pytest.mark.parametrize("reg", [1.0, 0.2])
def test_coefficients_equal_a_plain_solver(spark, features, reg):
    fit = ML.ProbeFit(features, reg=reg)
    rows = [r.asDict() for r in features.collect()]
    names = sorted({r["qid"] for r in rows})
    files = sorted({(r["topic"], r["model"], r["label"]) for r in rows})
    x = np.zeros((len(files), len(names)))
    for r in rows:
        x[files.index((r["topic"], r["model"], r["label"])), names.index(r["qid"])] = r["value"]
    t, models = np.array([f[2] for f in files]), np.array([f[1] for f in files])
    got = {(r.held_out, r.qid): r.coefficient for r in fit.coefficients(spark).collect()}
    said = {(r.held_out, r.topic, r.model): r for r in fit.predictions().collect()}
    assert len(said) == len(files) * 5
    for held in sorted(set(models)):
        beta = plain_fit(x[models != held], t[models != held], reg)
        assert np.abs(np.array([got[held, q] for q in [*names, None]]) - beta).max() < 1e-6
        z = x @ beta[:-1] + beta[-1]
        for (topic, model, _), score in zip(files, z):
            r = said[held, topic, model]
            assert abs(r.probability - 1 / (1 + np.exp(-score))) < 1e-6 and r.prediction == int(score > 0) and r.converged
            assert r.role == ("test" if model == held else "train")
    assert fit.steps < 20


def test_the_fit_groups_no_training_rows(features):
    import inspect
    assert "applyIn" not in inspect.getsource(ML.ProbeFit) + inspect.getsource(ML.probe_fit)
    plan = ML.ProbeFit(features).predictions()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rows_without_a_model_train_in_every_fold(spark):
    rows = answers(2, 4, 3, 10)
    df = spark.createDataFrame(rows + [("t1", None, q, "yes") for q in range(10)], "topic STRING, model STRING, qid LONG, output STRING")
    said = ML.probe_fit(ML.probe_features(df, "default")).collect()
    assert {r.held_out: (r.n_train, r.n_test) for r in said} == {f"m{i}": (9, 4) for i in range(3)}


def test_too_many_probes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ML, "MAX_PROBES", 5)
    df = spark.createDataFrame(answers(3, 3, 2, 10), "topic STRING, model STRING, qid LONG, output STRING")
    with pytest.raises(ValueError, match="probes"):
        ML.ProbeFit(ML.probe_features(df, "default"))


def test_separable_vectors_still_converge(spark):
    rows = [(topic, f"m{m}", q, "yes" if (topic == "default") == (q % 2 == 0) else "no") for topic in ("default", "a", "b") for m in range(3) for q in range(12)]
    fit = ML.ProbeFit(ML.probe_features(spark.createDataFrame(rows, "topic STRING, model STRING, qid LONG, output STRING"), "default"), reg=100.0)
    assert fit.predictions().where(~F.col("converged") | (F.col("prediction") != F.col("label"))).count() == 0
