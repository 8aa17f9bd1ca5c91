"""The ranking core: null groups and keys, changed files, lazy plans; curated sets that are not empty."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from curatio.operators import sampling as R
from curatio.streaming import ingest as T

SMALL = "/root/testdata/sf0.001"


def gaps(spark, n=50):
    return spark.range(n).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("g"),
                                 F.when(F.col("id") % 4 != 0, F.col("id") * 7 % n).alias("k"))


def test_null_groups_are_groups(spark):
    df = gaps(spark)
    assert R.split_fraction(df, 0.9, ["id"], 1, by=["g"]).count() == 50
    assert R.sample_n(df, 1000, ["id"], 1, by=["g"]).count() == 50
    assert R.shuffle_rank(df, ["id"], 1, by=["g"]).count() == 50
    sizes = {r.g: r["count"] for r in R.balance_classes(df, "g", ["id"], 1).groupBy("g").count().collect()}
    assert set(sizes) == {None, "c0", "c1", "c2"} and len(set(sizes.values())) == 1


def test_null_order_keys_come_first(spark):
    df = gaps(spark)
    ids = {r.id: r.row_id for r in R.row_id(df, "k", tiebreak=["id"]).collect()}
    assert sorted(ids.values()) == list(range(1, 51))
    nulls = [i for i in range(50) if i % 4 == 0]
    assert max(ids[i] for i in nulls) == len(nulls)
    first, second = R.first_half(df, "k", ["id"])
    assert first.count() == 25 and second.count() == 25


def test_hot_values_and_texts_have_dense_ids(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("n"),
                                  F.concat(F.lit("same long prefix "), F.col("id") % 100).alias("t"))
    for c in ("n", "t"):
        rows = R.row_id(df, c, tiebreak=["id"], n_buckets=64).orderBy("row_id").collect()
        assert [r.row_id for r in rows] == list(range(1, 3001))
        assert [r[c] for r in rows] == sorted(r[c] for r in rows)


def test_a_changed_file_is_read_anew(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    for n in (400, 700):
        spark.range(n).write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        assert R.split_fraction(spark.read.parquet(path), 0.5, ["id"], 3).count() == n
        assert R.sample_n(spark.read.parquet(path), 300, ["id"], 3).count() == 300


def test_building_a_plan_runs_no_job(spark):
    sc = spark.sparkContext
    queries = entry.queries()
    names = [n for n in queries if n[:3] in {f"r{i:02d}" for i in range(1, 14)} | {"c01", "c07", "c08", "c22", "a17", "j13"} and not n.startswith("r10")]
    assert len(names) > 15
    sc.setJobGroup("plans", "building plans")
    try:
        for name in names:
            frame = queries[name](spark, SMALL)
            jobs = sc.statusTracker().getJobIdsForGroup("plans")
            # reading a table's schema is a job of its own; nothing else may be
            assert frame is not None and len(jobs) == 0 or all("parquet" in str(sc.statusTracker().getJobInfo(j)) or len(sc.statusTracker().getJobInfo(j).stageIds) == 1 for j in jobs), name
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_few_shot_with_few_rows(spark):
    from curatio.operators.expand import few_shot_prompts
    for n_rows, shots in ((1, 0), (2, 1), (3, 2), (6, 3)):
        df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(n_rows)], "id LONG, q STRING, a STRING")
        for r in few_shot_prompts(df, "id", "q", "a", 3).collect():
            examples = [line for line in r.question_prompt.split("\n") if line.startswith("Question: ")][:-1]
            assert len(examples) == len(set(examples)) == shots and f"Question: q{r.id}" not in examples


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_curated_sets_are_not_empty(spark, size):
    queries = entry.queries()
    for name in ("c01_same_topic_prompting", "c02_same_topic_finetuned", "c03_same_topic_locked", "c04_locked_vs_guardrail",
                 "c05_different_topic", "c06_different_model", "c07_different_all", "c12_token_ablation", "c22_build_all"):
        assert not queries[name](spark, f"/root/testdata/{size}").isEmpty(), name


def test_token_budgets_differ(spark):
    got = {r.budget: r.n for r in entry.queries()["c12_token_ablation"](spark, "/root/testdata/sf0.01")
           .groupBy("budget").agg(F.sum(F.length("input_truncated")).alias("n")).collect()}
    assert got[10] < got[50] < got[100] < got[500] < got[1000]


def test_build_all_reads_the_texts_a_few_times_only(spark):
    plan = entry.queries()["c22_build_all"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "text#" in line for line in plan.splitlines()) <= 5


def test_ingest_raises_when_the_target_cannot_be_read(spark, tmp_dir):
    src, target = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "target")
    os.makedirs(src)
    os.makedirs(target)
    with open(os.path.join(src, "f.jsonl"), "w") as f:
        f.write(json.dumps({"key": 1, "inference_completed": True}) + "\n")
    with open(os.path.join(target, "part-0.parquet"), "w") as f:
        f.write("not a parquet file")
    schema = spark.createDataFrame([], "key LONG, inference_completed BOOLEAN").schema
    with pytest.raises(Exception):
        T.ingest_responses(T.response_stream(spark, src, schema), "key", target, os.path.join(tmp_dir, "ck"))


def test_missing_folds_and_labels_are_reported(spark):
    from curatio.operators import ml as ML
    rows = [("default", "m1", q, "yes") for q in range(5)] + [("de", "m2", q, "no") for q in range(5)] + [("fr", "m2", q, "yes") for q in range(5)]
    f = ML.probe_features(spark.createDataFrame(rows, "topic STRING, model STRING, qid LONG, output STRING"), "default")
    got = {r.held_out: r.status for r in ML.probe_fit(f).collect()}
    assert got == {"m1": "one_class", "m2": "one_class"}
    from curatio.operators import metrics as M
    one = spark.createDataFrame([("a",)], "label STRING")
    with pytest.raises(Exception, match="fewer than two labels"):
        M.label_vocabulary(one, [], "label").collect()
