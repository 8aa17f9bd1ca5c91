"""Structured Streaming (T1, T2): pick up response files as they land.

Both jobs use ``trigger(availableNow=True)`` so they can run as scheduled
incremental batches, with the checkpoint folder as the resume point.  What a
batch reads and writes follows from the batch, not from what is already there:
keys seen before are looked up in Spark's state store (RocksDB, with its changes
logged to the checkpoint), and results are folders of their own per batch, which
a repeated batch replaces.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.sources.io import path_exists

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    """The state store of queries started inside; the settings are put back."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_name(checkpoint: str) -> str:
    """A run is what one checkpoint folder has counted."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden ones; none if it is not there."""
    if not path_exists(spark, path):
        return []
    p, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def response_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "json",
                    glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Streaming read of response files (one micro-batch per group of new files)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format(fmt).load(directory).withColumn("file", F.col("_metadata.file_path"))


def ingest_responses(stream: DataFrame, key, target: str, checkpoint: str,
                     completed: str = "inference_completed") -> None:
    """Append completed rows to ``target`` once per key.

    Duplicate keys, in a batch or of an earlier one, are dropped by Spark's
    keyed state, so a batch never reads what its run has written.  Batch n of a
    run is the folder ``run=<run>/batch=<n>``; a batch that is repeated after a
    failure replaces its folder and adds nothing.

    A new checkpoint starts a new run on a target that others have written; its
    batches leave out the keys that stand in the folders of those runs, which
    do not grow while it runs.  A target with files outside such folders was not
    written by this sink and is refused."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = stream.sparkSession
    run = run_name(checkpoint)
    others = [n for n in _children(spark, target) if n != f"run={run}"]
    if any(not n.startswith("run=") for n in others):
        raise ValueError(f"{target} holds files that are not of a run")
    fresh = stream.where(F.col(completed)).dropDuplicates(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        if others:
            done = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{target}/{n}" for n in others])
            batch = batch.join(done.select(*keys), keys, "left_anti")
        batch.write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch_id}")

    with _state_on_disk(spark):
        q = (fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()


# --------------------------------------------------------------------------- T2

POINTER = "CURRENT"


def _swap_pointer(spark: SparkSession, target: str, text: str) -> None:
    """Puts ``text`` in the pointer file by one rename, so that a reader finds
    the old pointer or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, fs = _fs(spark, f"{target}/.{POINTER}-new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs_package = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs_package.Options.Rename, 1)
    options[0] = fs_package.Options.Rename.OVERWRITE
    to = fs.makeQualified(fs_package.Path(f"{target}/{POINTER}"))
    fs_package.FileContext.getFileContext(to.toUri(), conf).rename(fs.makeQualified(new), to, options)


def _pointer(spark: SparkSession, target: str) -> tuple[str, int] | None:
    """(run, batch) of the snapshot that is valid now."""
    if not path_exists(spark, f"{target}/{POINTER}"):
        return None
    run, batch = spark.read.text(f"{target}/{POINTER}").first()[0].split()
    return run, int(batch)


def read_progress(spark: SparkSession, target: str) -> DataFrame:
    """The valid snapshot of :func:`completion_progress`."""
    at = _pointer(spark, target)
    if at is None:
        raise FileNotFoundError(f"{target} has no snapshot")
    return spark.read.parquet(f"{target}/snapshot-{at[0]}-{at[1]}")


def completion_progress(stream: DataFrame, target: str, checkpoint: str, group: str = "file",
                        completed: str = "inference_completed", keep: int = 3) -> None:
    """Running completed/total per file.

    ``update`` output gives only the files that a batch has touched.  They and
    the other rows of the last snapshot are written as a new snapshot; then the
    pointer is swapped.  Readers (:func:`read_progress`) see one whole snapshot
    at any time, and one that they hold open stays for ``keep`` more batches.  A
    repeated batch finds the pointer at itself and changes nothing."""
    agg = stream.groupBy(group).agg(F.count_if(F.col(completed)).alias("n_completed"),
                                    F.count(F.lit(1)).alias("n_rows"))
    run = run_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = _pointer(spark, target)
        same = at is not None and at[0] == run
        if same and at[1] >= batch_id:
            return
        if same:
            last = spark.read.schema(batch.schema).parquet(f"{target}/snapshot-{run}-{at[1]}").alias("l")
            gone = batch.select(F.col(group).alias("_g")).alias("g")
            batch = last.join(gone, F.col(f"l.{group}").eqNullSafe(F.col("g._g")), "left_anti").unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{target}/snapshot-{run}-{batch_id}")
        _swap_pointer(spark, target, f"{run} {batch_id}")
        if batch_id >= keep:
            old, fs = _fs(spark, f"{target}/snapshot-{run}-{batch_id - keep}")
            fs.delete(old, True)

    with _state_on_disk(stream.sparkSession):
        q = (agg.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
