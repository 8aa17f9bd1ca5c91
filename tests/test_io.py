"""Sources, sinks and streaming ingest in scratch folders."""

import json
import os

import pytest

from curatio.sources import io as IO
from curatio.sources.responses import read_responses
from curatio.streaming import ingest as T


def test_read_table_dispatch(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "p.csv")
    with open(csv, "w") as f:
        f.write('probe_type,probe\nA,"has, comma"\nB,"say ""hi""\nnext line"\nC,ünïcode\n')
    df = IO.read_table(spark, csv)
    assert df.count() == 3 and df.collect()[1].probe == 'say "hi"\nnext line'
    cat = IO.probe_catalog(spark, csv)
    assert [r.qid for r in cat.orderBy("qid").collect()] == [0, 1, 2]
    tsv = os.path.join(tmp_dir, "t.tsv")
    with open(tsv, "w") as f:
        f.write("a\tb\n1\tx\n")
    assert IO.read_table(spark, tsv).columns == ["a", "b"]
    with pytest.raises(ValueError):
        IO.read_table(spark, os.path.join(tmp_dir, "x.xlsx"))


def test_read_responses_union_output(spark, tmp_dir):
    path = os.path.join(tmp_dir, "inference_input_de_test_m1_0.0_output.jsonl")
    with open(path, "w") as f:
        for i, o in enumerate(["plain", ["a", "b"], None]):
            f.write(json.dumps({"id": i, "output": o, "inference_completed": True}) + "\n")
    df = read_responses(spark, path, "id LONG, output STRING, inference_completed BOOLEAN")
    got = {r.id: r.output for r in df.collect()}
    assert got == {0: ["plain"], 1: ["a", "b"], 2: None}


def test_write_config_split_dynamic(spark, tmp_dir):
    root = os.path.join(tmp_dir, "ds")
    a = spark.createDataFrame([(1,)], "x INT")
    IO.write_config_split(a, root, "clf", "train")
    IO.write_config_split(a.union(a), root, "clf", "val")
    IO.write_config_split(a.union(a).union(a), root, "clf", "train")
    assert IO.read_split(spark, root, "clf", "train").count() == 3
    assert IO.read_split(spark, root, "clf", "val").count() == 2
    assert IO.skip_if_column_exists(spark, root, "x") and not IO.skip_if_column_exists(spark, root, "y")


def test_ingest_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    for n, rows in enumerate([[(1, True), (2, False), (1, True)], [(1, True), (3, True)]]):
        with open(os.path.join(src, f"f{n}.jsonl"), "w") as f:
            for k, done in rows:
                f.write(json.dumps({"key": k, "inference_completed": done}) + "\n")
    schema = "key LONG, inference_completed BOOLEAN"
    target, ck = os.path.join(tmp_dir, "target"), os.path.join(tmp_dir, "ck")
    T.ingest_responses(T.response_stream(spark, src, spark.createDataFrame([], schema).schema, max_files=1),
                       "key", target, ck)
    keys = sorted(r.key for r in spark.read.parquet(target).collect())
    assert keys == [1, 3]
    T.ingest_responses(T.response_stream(spark, src, spark.createDataFrame([], schema).schema), "key",
                       target, os.path.join(tmp_dir, "ck2"))
    assert sorted(r.key for r in spark.read.parquet(target).collect()) == [1, 3]


def test_input_contract(spark):
    from curatio.operators.cleaning import ContractError, check_input_contract, validate_training
    ok = spark.createDataFrame([("a",)], "input STRING")
    assert check_input_contract(ok) is ok
    with pytest.raises(ContractError):
        check_input_contract(spark.createDataFrame([("a", "b")], "input STRING, output STRING"))
    with pytest.raises(ContractError):
        check_input_contract(spark.createDataFrame([], "input STRING"))
    with pytest.raises(ContractError):
        validate_training(ok, "dpo")
    t = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "input STRING, output STRING")
    assert [r.input for r in validate_training(t, "sft").collect()] == ["c"]
