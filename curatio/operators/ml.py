"""Model fitting and scoring as Spark jobs (M1, M2, M4, M5).

Probe vectors are one aggregation; the leave-one-out probe fit (M2) is one Spark
aggregate per Newton step for all folds; the detector uses ``pyspark.ml``; batch scoring of pending rows is ``mapInPandas``
(Arrow batches), with the partition as the unit of retry and checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.functions.text import binarize


def probe_features(answers: DataFrame, default_topic: str, topic="topic", model="model", qid="qid", output="output") -> DataFrame:
    """M1 in long form: one row per (topic, model, probe) that was answered: the
    mean of the binarized answers, label 0 for the default topic and 1
    otherwise.  A probe that is not listed counts as 0 in the vector."""
    b = answers.withColumn("_bin", F.coalesce(binarize(output), F.lit(0)).cast("double"))
    return (b.groupBy(topic, model, qid).agg(F.round(F.avg("_bin"), 6).alias("value"))
            .withColumn("label", (F.col(topic) != default_topic).cast("int")))


def probe_vectors(features: DataFrame, topic="topic", model="model", qid="qid", label="label") -> DataFrame:
    """One row per (topic, model) with its answered probes as (probe, value)
    pairs in probe order: a vector as long as the probe list, not as the data."""
    return features.groupBy(topic, model, label).agg(F.sort_array(F.collect_list(F.struct(qid, "value"))).alias("probes"))


def leave_one_out(vectors: DataFrame, group: str) -> DataFrame:
    """Every vector in every fold, with its ``role`` (test if it belongs to
    the held-out group).  One row per vector and fold, from one list of groups."""
    groups = vectors.agg(F.array_sort(F.collect_set(group)).alias("g"))
    folds = vectors.withColumn("held_out", F.explode(groups.scalar()))
    return folds.withColumn("role", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))


def binary_weights(df: DataFrame, label="label", out="weight") -> DataFrame:
    """Class weights of the probe fit: 1 for class 0, ``n / (2 n1)`` for class 1."""
    from curatio.operators.metrics import binary_sample_weight
    return binary_sample_weight(df, label, out)


MAX_PROBES = 1024           # entries of a fold's system grow with its square


class ProbeFit:
    """M2: leave-one-group-out weighted logistic regression (L2 with C =
    ``reg``, the intercept not penalised; class 1 weighted ``n / (2 n1)``), all
    folds side by side by Newton's method.

    One Spark pass per Newton step serves every fold: a task goes once over its
    vectors and adds up, for each fold, loss, gradient and Hessian entries of
    the rows outside the held-out group at that fold's coefficients.  Spark sums
    these vectors of a fixed length with partial sums, solves each fold's system
    in a task, and the driver keeps the coefficients: (probes + 1) numbers a
    fold.  No fold's training rows ever come together.  A step that raises the
    loss is halved.

    The number of probes is that of the probe list, at most ``MAX_PROBES`` (else
    a ValueError).  A fold whose training part has one class has the status
    ``one_class`` and no predictions.  Vectors without a group belong to no fold
    and train in all of them."""

    def __init__(self, features: DataFrame, group: str = "model", label: str = "label", reg: float = 1.0,
                 tolerance: float = 1e-8, max_steps: int = 100):
        from curatio.session import materialized, ship_package
        ship_package(features.sparkSession)
        self.group, self.label, self.reg, self.tolerance = group, label, reg, tolerance
        self.vectors = materialized(probe_vectors(features, label=label), "probe-vectors")
        self.names = [r[0] for r in self.vectors.select(F.explode("probes.qid").alias("q")).distinct().orderBy("q").limit(MAX_PROBES + 1).collect()]
        if len(self.names) > MAX_PROBES:
            raise ValueError(f"more than {MAX_PROBES} probes")
        sizes = self.vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n1")).collect()
        n, n1 = sum(r["n"] for r in sizes), sum(r["n1"] for r in sizes)
        self.folds = {}
        for r in sorted((r for r in sizes if r[group] is not None), key=lambda r: r[group]):
            train, ones = n - r["n"], n1 - r["n1"]
            self.folds[r[group]] = {"n": train, "weight": train / (2 * ones) if ones else None, "ones": ones,
                                    "status": "fitted" if 0 < ones < train else "one_class"}
        self.steps = 0
        self._fit(max_steps)

    # ---- steps

    def _sums(self, betas: dict) -> dict:
        """{fold: (loss, largest gradient entry, Newton step)} at the coefficients."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer
        weights = {f: self.folds[f]["weight"] for f in betas}
        terms = self.vectors.mapInArrow(_fold_terms(self.names, self.group, self.label, betas, weights), "held_out string, terms array<double>")
        sums = terms.groupBy("held_out").agg(vector_to_array(Summarizer.sum(array_to_vector("terms"))).alias("terms"))
        solved = sums.mapInArrow(_solve(betas, 1 / self.reg), "held_out string, loss double, gradient double, step array<double>")
        return {r["held_out"]: (r["loss"], r["gradient"], r["step"]) for r in solved.collect()}

    def _fit(self, max_steps: int) -> None:
        import numpy as np
        size = len(self.names) + 1
        open_ = {f: np.zeros(size) for f, fold in self.folds.items() if fold["status"] == "fitted"}
        for f in open_:
            self.folds[f].update(beta=np.zeros(size), loss=np.inf, gradient=np.inf)
        while open_ and self.steps < max_steps:
            self.steps += 1
            for f, (loss, gradient, step) in self._sums(open_).items():
                fold = self.folds[f]
                if loss <= fold["loss"] * (1 + 1e-12):
                    fold.update(beta=open_[f], loss=loss, gradient=gradient)
                    open_[f] = open_[f] - np.array(step)
                else:
                    open_[f] = (fold["beta"] + open_[f]) / 2
                if fold["gradient"] < self.tolerance:
                    del open_[f]

    # ---- results

    def coefficients(self, spark) -> DataFrame:
        """(held_out, qid, coefficient) of the fitted folds; the intercept has a null qid."""
        kind = self.vectors.schema["probes"].dataType.elementType["qid"].dataType.simpleString()
        return spark.createDataFrame([(f, q, float(c)) for f, fold in self.folds.items() if "beta" in fold
                                      for q, c in zip([*self.names, None], fold["beta"])], f"held_out string, qid {kind}, coefficient double")

    def predictions(self) -> DataFrame:
        """One row per vector and fold: role, weight_sum of the fold's training
        part, status, probability of class 1, prediction and converged."""
        fields = {f: (fold["status"], None if fold["weight"] is None else fold["n"] - fold["ones"] + fold["ones"] * fold["weight"],
                      fold.get("beta"), None if "beta" not in fold else bool(fold["gradient"] < self.tolerance)) for f, fold in self.folds.items()}
        schema = (f"held_out string, topic string, model string, {self.label} int, role string, weight_sum double, "
                  "status string, probability double, prediction long, converged boolean")
        return self.vectors.mapInArrow(_predict(self.names, self.group, self.label, fields), schema)


def _design(batch, names):
    """The vectors of a batch as a dense matrix with a last column of ones."""
    import numpy as np
    probes = batch.column(batch.schema.get_field_index("probes"))
    x = np.zeros((batch.num_rows, len(names) + 1))
    x[:, -1] = 1
    rows = np.repeat(np.arange(batch.num_rows), np.diff(probes.offsets.to_numpy()))
    flat = probes.flatten()
    place = {n: i for i, n in enumerate(names)}
    columns = np.array([place[q] for q in flat.field("qid").to_pylist()], np.int64)
    x[rows, columns] = flat.field("value").to_numpy(zero_copy_only=False)
    return x


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _fold_terms(names, group, label, betas, weights):
    import numpy as np
    import pyarrow as pa
    upper = np.triu_indices(len(names) + 1)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x = _design(batch, names)
            t = _column(batch, label).to_numpy(zero_copy_only=False).astype(float)
            own = np.array(_column(batch, group).to_pylist(), object)
            for f, beta in betas.items():
                z = np.clip(x @ beta, -500, 500)
                p = 1 / (1 + np.exp(-z))
                w = np.where(t == 1, weights[f], 1.0) * (own != f)
                hessian = (x * (w * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ x
                loss = (w * (np.logaddexp(0, z) - t * z)).sum()
                terms = np.concatenate(([loss], x.T @ (w * (p - t)), hessian[upper]))
                sums[f] = sums[f] + terms if f in sums else terms
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                                             ["held_out", "terms"])
    return run


def _solve(betas, penalty):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for f, terms in zip(*(_column(batch, c).to_pylist() for c in ("held_out", "terms"))):
                beta, terms = betas[f], np.array(terms)
                size = len(beta)
                ridge = np.append(np.full(size - 1, penalty), 0)
                gradient = terms[1:size + 1] + ridge * beta
                hessian = np.zeros((size, size))
                hessian[np.triu_indices(size)] = terms[size + 1:]
                hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge + 1e-12)
                out.append((f, terms[0] + (ridge * beta * beta).sum() / 2, np.abs(gradient).max(), np.linalg.solve(hessian, gradient).tolist()))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                                             ["held_out", "loss", "gradient", "step"])
    return run


def _predict(names, group, label, folds):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = _design(batch, names)
            n = batch.num_rows
            own = np.array(_column(batch, group).to_pylist(), object)
            for f, (status, weight_sum, beta, converged) in folds.items():
                p = [None] * n if beta is None else 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
                side = [None] * n if beta is None else (x @ beta > 0).astype(int)
                columns = [pa.array([f] * n, pa.string()), *(_column(batch, c).cast(pa.string()) for c in ("topic", "model")),
                           _column(batch, label).cast(pa.int32()), pa.array(np.where(own == f, "test", "train").tolist(), pa.string()),
                           pa.array([weight_sum] * n, pa.float64()), pa.array([status] * n, pa.string()), pa.array(p, pa.float64()),
                           pa.array(side, pa.int64()), pa.array([converged] * n, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["held_out", "topic", "model", label, "role", "weight_sum", "status", "probability",
                                                           "prediction", "converged"])
    return run


def probe_predictions(features: DataFrame, group: str = "model", label: str = "label", reg: float = 1.0,
                      tolerance: float = 1e-8, max_steps: int = 100) -> DataFrame:
    """The predictions of :class:`ProbeFit`."""
    return ProbeFit(features, group, label, reg, tolerance, max_steps).predictions()


def probe_fit(features: DataFrame, group: str = "model", label: str = "label", reg: float = 1.0) -> DataFrame:
    """One row per fold: sizes, sum of the training weights, status, whether
    the gradient vanished at the solution, and the accuracy on the held-out rows."""
    p = probe_predictions(features, group, label, reg)
    test = F.col("role") == "test"
    return p.groupBy("held_out", "status").agg(
        F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"), F.max("weight_sum").alias("weight_sum"),
        F.bool_and("converged").alias("converged"),
        F.avg(F.when(test, (F.col("prediction") == F.col(label)).cast("int"))).alias("accuracy"))


REGULARISATION = (0.1, 0.01, 0.001)


class Detector:
    """M4: text classifier (hashed term counts, IDF, weighted logistic
    regression) with the regularisation chosen on a validation split.

    The first ``fraction`` of a seeded permutation of each label's training rows
    trains, the rest validates; the feature stages are fitted on the training
    part only and its features written once for all settings.  The path goes
    from the strongest setting down and stops after ``patience`` settings
    without a lower validation loss; the model with the lowest mean log loss
    over the validation rows is kept.  A validation part without rows chooses
    the first setting.

    ``path``: (reg, validation loss, validation accuracy) of each setting tried;
    ``reg``: the one chosen."""

    def __init__(self, train: DataFrame, key, text: str = "input", label: str = "label", num_features: int = 1 << 18,
                 path=REGULARISATION, fraction: float = 0.85, patience: int = 2, seed: int = 42, max_iter: int = 50):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        from curatio.operators.sampling import split_fraction
        from curatio.session import materialized
        self.label = label
        parts = split_fraction(binary_weights(train, label), fraction, key, seed, by=[label], names=("train", "validation"), col="_part")
        self.features = Pipeline(stages=[
            RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\s+", toLowercase=True),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
            IDF(inputCol="_tf", outputCol="_feat")]).fit(parts.where("_part = 'train'"))
        ready = materialized(self.features.transform(parts).select("_part", label, "weight", "_feat"), "detector-features")
        part, rest = ready.where("_part = 'train'"), ready.where("_part = 'validation'")
        self.path, best = [], None
        for reg in sorted(path, reverse=True):
            model = LogisticRegression(featuresCol="_feat", labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter).fit(part)
            own = vector_to_array("probability")[F.col(label)]
            said = model.transform(rest).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss"),
                                             F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy")).first()
            self.path.append((reg, said["loss"], said["accuracy"]))
            if best is None or (said["loss"] is not None and said["loss"] < best[0]):
                best, since = (float("inf") if said["loss"] is None else said["loss"], reg, model), 0
            else:
                since += 1
            if said["loss"] is None or since == patience:
                break
        _, self.reg, self.model = best

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``output`` (class) and ``output_logits`` (raw scores)."""
        from pyspark.ml.functions import vector_to_array
        said = self.model.transform(self.features.transform(rows))
        return (said.withColumn("output", F.col("prediction").cast("int")).withColumn("output_logits", vector_to_array("rawPrediction"))
                .drop("_tok", "_tf", "_feat", "rawPrediction", "probability", "prediction"))


def fit_detector(train: DataFrame, test: DataFrame, key="key", text: str = "input", label: str = "label", **settings):
    """A :class:`Detector` fitted on ``train`` and its predictions for ``test``."""
    detector = Detector(train, key, text, label, **settings)
    return detector, detector.predict(test)


def score_batches(pending: DataFrame, scorer: Callable[[pd.Series], pd.Series], text: str = "input",
                  out: str = "output", out_type: T.DataType = T.StringType()) -> DataFrame:
    """M5: apply a user scorer to pending rows in Arrow batches.

    The scorer maps a pandas Series of inputs to a Series of outputs; each
    output becomes a one-item list (``num_return_sequences`` = 1) and the row
    is marked complete.  Write the result with an append sink keyed by the
    row key; :func:`curatio.sources.responses.resume_pending` then resumes
    after any failure, partition by partition."""
    schema = T.StructType(pending.schema.fields + [
        T.StructField(out, T.ArrayType(out_type)), T.StructField("inference_completed", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            res = scorer(pdf[text])
            pdf[out] = [[x] for x in res]
            pdf["inference_completed"] = True
            yield pdf

    return pending.mapInPandas(run, schema)
