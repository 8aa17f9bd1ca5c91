"""Metrics against pandas on small frames."""

import pandas as pd

from curatio.operators import metrics as M


def preds(spark):
    rows = [(1, 1.0, "a"), (0, 0.5, "a"), (1, 0.49, "b"), (0, 1.0, "b"), (1, 1.5, "b"), (0, 0.0, "a")]
    return spark.createDataFrame(rows, "label INT, output DOUBLE, model STRING"), pd.DataFrame(
        rows, columns=["label", "output", "model"])


def test_confusion_matrix_margins(spark):
    df, pdf = preds(spark)
    got = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df).collect()}
    ct = pd.crosstab(pdf["label"], pdf["output"].round(), margins=True)
    for a in ct.index:
        for p in ct.columns:
            key = ("All" if a == "All" else str(a), "All" if p == "All" else str(int(p)))
            if ct.loc[a, p]:
                assert got[key] == ct.loc[a, p]


def test_precision_recall_undefined(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0)], "label INT, output DOUBLE")
    r = {x.value: x for x in M.precision_recall(df).collect()}
    assert r[0].precision == -1.0 and r[0].recall == 0.0
    assert abs(r[1].precision - 1 / 3) < 1e-6 and r[1].recall == 1.0


def test_common_prefix_cases(spark):
    df = spark.createDataFrame([("g1", "abc"), ("g1", "abc"), ("g2", "abc"), ("g2", "abcd"),
                                ("g3", "hello world"), ("g3", "help"), ("g4", "single")], "g STRING, t STRING")
    r = {x.g: x for x in M.common_prefix(df, "t", by=["g"]).collect()}
    assert r["g1"].status == "all_equal" and r["g1"].prefix == ""
    assert r["g2"].status == "prefix_of_other"
    assert r["g3"].prefix == "hel" and r["g3"].status == "ok"
    assert r["g4"].status == "all_equal"


def test_accuracy_and_slices(spark):
    df, pdf = preds(spark)
    acc = M.accuracy(df).first().accuracy
    assert abs(acc - (pdf["output"].round() == pdf["label"]).mean()) < 1e-9
    s = {r.model: r for r in M.metrics_by_slice(df, "model").collect()}
    assert s["All"].n == 6 and s["a"].n == 3


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label INT")
    w = {r.label: r.weight for r in M.class_weights(df, "label").collect()}
    assert abs(w[0] - 0.25) < 1e-9 and abs(w[1] - 0.75) < 1e-9
