"""Ingest and progress streams: replays, other runs, cost of a batch, readers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from curatio.sources import adapters as A
from curatio.streaming import ingest as T

SCHEMA = "key LONG, inference_completed BOOLEAN"


def drop(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(json.dumps({"key": k, "inference_completed": done}) + "\n" for k, done in rows)


def stream(spark, src, **more):
    return T.response_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, **more)


def keys(spark, target):
    return sorted(r.key for r in spark.read.parquet(target).collect())


def test_later_batches_do_not_read_the_target(spark, tmp_dir):
    src, target, ck = (os.path.join(tmp_dir, x) for x in ("src", "target", "ck"))
    drop(src, "a.jsonl", [(k, True) for k in range(50)])
    T.ingest_responses(stream(spark, src), "key", target, ck)
    first = os.path.join(target, f"run={T.run_name(ck)}", "batch=0")
    for f in os.listdir(first):        # what was written cannot be read any more
        if f.startswith("part-"):
            os.chmod(os.path.join(first, f), 0o600)
            with open(os.path.join(first, f), "wb") as out:
                out.write(b"unreadable")
    drop(src, "b.jsonl", [(k, True) for k in range(40, 60)])
    T.ingest_responses(stream(spark, src), "key", target, ck)
    later = [d for d in os.listdir(os.path.dirname(first)) if d.startswith("batch=") and d != "batch=0"]
    got = [r.key for d in later for r in spark.read.parquet(os.path.join(os.path.dirname(first), d)).collect()]
    assert sorted(got) == list(range(50, 60))


def test_a_repeated_batch_adds_nothing(spark, tmp_dir):
    src, target, ck = (os.path.join(tmp_dir, x) for x in ("src", "target", "ck"))
    drop(src, "a.jsonl", [(1, True), (2, True), (3, False)])
    T.ingest_responses(stream(spark, src), "key", target, ck)
    commit = os.path.join(ck, "commits", "0")       # as if the batch had been written but not committed
    os.remove(commit)
    crc = os.path.join(ck, "commits", ".0.crc")
    if os.path.exists(crc):
        os.remove(crc)
    T.ingest_responses(stream(spark, src), "key", target, ck)
    assert keys(spark, target) == [1, 2]


def test_a_new_checkpoint_leaves_out_the_keys_of_other_runs(spark, tmp_dir):
    src, target = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "target")
    drop(src, "a.jsonl", [(1, True), (2, False)])
    T.ingest_responses(stream(spark, src), "key", target, os.path.join(tmp_dir, "ck1"))
    drop(src, "b.jsonl", [(2, True), (1, True)])
    T.ingest_responses(stream(spark, src, max_files=1), "key", target, os.path.join(tmp_dir, "ck2"))
    assert keys(spark, target) == [1, 2]


def test_foreign_files_are_refused_and_settings_put_back(spark, tmp_dir):
    src, target = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "target")
    drop(src, "a.jsonl", [(1, True)])
    spark.range(3).write.parquet(target)
    before = {k: spark.conf.get(k, None) for k in T.STATE_STORE}
    with pytest.raises(ValueError):
        T.ingest_responses(stream(spark, src), "key", target, os.path.join(tmp_dir, "ck"))
    assert {k: spark.conf.get(k, None) for k in T.STATE_STORE} == before


def test_progress_snapshots(spark, tmp_dir):
    src, target, ck = (os.path.join(tmp_dir, x) for x in ("src", "target", "ck"))
    read = lambda: {os.path.basename(r.file): (r.n_completed, r.n_rows) for r in T.read_progress(spark, target).collect()}
    with pytest.raises(FileNotFoundError):
        T.read_progress(spark, target)
    drop(src, "a.jsonl", [(1, True), (2, False)])
    T.completion_progress(stream(spark, src), target, ck)
    assert read() == {"a.jsonl": (1, 2)}
    held = T.read_progress(spark, target)
    drop(src, "b.jsonl", [(3, True)])
    T.completion_progress(stream(spark, src), target, ck)
    assert read() == {"a.jsonl": (1, 2), "b.jsonl": (1, 1)}
    assert held.count() == 1                                # a reader keeps its snapshot
    T.completion_progress(stream(spark, src), target, ck)   # nothing new
    assert read() == {"a.jsonl": (1, 2), "b.jsonl": (1, 1)}
    for i in range(5):
        drop(src, f"c{i}.jsonl", [(10 + i, i % 2 == 0)])
        T.completion_progress(stream(spark, src), target, ck, keep=2)
    assert len(read()) == 7
    assert len([d for d in os.listdir(target) if d.startswith("snapshot-")]) <= 6


def test_progress_of_null_groups(spark, tmp_dir):
    src, target, ck = (os.path.join(tmp_dir, x) for x in ("src", "target", "ck"))
    for name, rows in (("a.jsonl", [(None, True)]), ("b.jsonl", [(None, False), (1, True)])):
        drop(src, name, rows)
        T.completion_progress(stream(spark, src), target, ck, group="key")
    assert {r.key: (r.n_completed, r.n_rows) for r in T.read_progress(spark, target).collect()} == {None: (1, 2), 1: (1, 1)}


def test_the_document_stream_reads_a_folder_of_files(spark, tmp_dir):
    from curatio.plans import catalog_more as C
    rows = [(i, f"text {i}", "en" if i % 2 else "fr", f"src{i % 5}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    folder, single = os.path.join(tmp_dir, "folder"), os.path.join(tmp_dir, "single")
    d.repartition(4).write.parquet(os.path.join(folder, "documents.parquet"))
    os.makedirs(single)
    d.toPandas().to_parquet(os.path.join(single, "documents.parquet"))
    for sf in (folder, single):
        want = A.responses(spark, sf)
        got = C.t01_ingest_responses(spark, sf).collect()
        assert sorted(got) == sorted(want.where("inference_completed").select("key", "topic", "model").collect())
        counts = {r.file: (r.n_completed, r.n_rows) for r in C.t02_completion_progress(spark, sf).collect()}
        assert counts == {r.file: (r.c, r.n) for r in want.groupBy("file").agg(
            F.count_if("inference_completed").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
