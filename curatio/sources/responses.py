"""Response files: reading, path metadata, completion gate, resume."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.functions.text import split_lit

log = logging.getLogger(__name__)

FILE_COLS = ["topic", "split", "model", "temperature", "condition"]


def read_responses(spark: SparkSession, paths, schema: T.StructType | str | None = None) -> DataFrame:
    """Many JSON-lines response files as one table with a ``file`` column.

    ``output`` may be a string or a list of strings in the files; it is read as
    text and normalised to ``ARRAY<STRING>`` (P12 inverse) in the JVM.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths).withColumn("file", F.col("_metadata.file_path"))
    if "output" in df.columns and isinstance(df.schema["output"].dataType, T.StringType):
        df = df.withColumn("output", normalise_output("output"))
    return df


def normalise_output(c) -> Column:
    """``string | list<string>`` -> ``ARRAY<STRING>``: JSON arrays are parsed,
    plain strings wrapped."""
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.from_json(c, T.ArrayType(T.StringType()))
    return F.when(c.isNull(), F.lit(None)).when(F.ltrim(c).startswith("["), parsed).otherwise(F.array(c))


def response_path_details(path) -> Column:
    """struct(topic, split, model, temperature, n_parts) from a file name.

    Basename without ``.jsonl`` split on ``_``: 6 parts -> split is train;
    7 parts -> topic, split, model, temperature at 2..5; 8 parts -> the same
    after a leading marker.  Other counts give null fields.
    """
    p = F.col(path) if isinstance(path, str) else path
    base = F.replace(F.substring_index(p, "/", -1), F.lit(".jsonl"), F.lit(""))
    parts = split_lit(base, "_")
    n = F.size(parts)

    def pick(i6, i7, i8):
        return (F.when(n == 6, F.get(parts, i6) if i6 is not None else F.lit("train"))
                 .when(n == 7, F.get(parts, i7)).when(n == 8, F.get(parts, i8)))

    return F.struct(pick(2, 2, 3).alias("topic"), pick(None, 3, 4).alias("split"),
                    pick(3, 4, 5).alias("model"), pick(4, 5, 6).alias("temperature"),
                    n.cast("int").alias("n_parts"))


def file_status(df: DataFrame, file_cols=FILE_COLS) -> DataFrame:
    """Per response file: rows, completed rows and whether it is complete."""
    return df.groupBy(*file_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("inference_completed")).alias("n_completed"),
        F.bool_and(F.coalesce(F.col("inference_completed"), F.lit(False))).alias("complete"))


def completion_gate(df: DataFrame, file_cols=FILE_COLS) -> DataFrame:
    """Keep rows of files whose rows are **all** complete.

    A semi-join against the per-file aggregate (partial aggregation map-side;
    the status table has one row per file)."""
    ok = file_status(df, file_cols).where("complete").select(*file_cols)
    return df.join(ok, list(file_cols), "left_semi")


def resume_pending(inputs: DataFrame, done: DataFrame, key, completed_col="inference_completed",
                   ignore_checkpoint: bool = False) -> DataFrame:
    """Input rows that still need a response.

    Unlike "continue at the first incomplete row", the anti-join also fills
    holes left by failed partitions.  The checkpoint must hold the key and the
    completion column; ``ignore_checkpoint`` starts over."""
    if ignore_checkpoint:
        return inputs
    keys = [key] if isinstance(key, str) else list(key)
    missing = [c for c in (*keys, completed_col) if c not in done.columns]
    if missing:
        raise ValueError(f"checkpoint lacks the columns {missing}")
    finished = done.where(F.col(completed_col)).select(*keys)
    return inputs.join(finished, keys, "left_anti")


def attach_results(inputs: DataFrame, results: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Join batch results back by id; rows without a response are dropped.
    The second table holds the results whose id is not in the input: a caller
    warns of them or refuses them."""
    joined = inputs.join(results, key, "inner").withColumn("inference_completed", F.lit(True))
    unknown = results.join(inputs.select(key), key, "left_anti")
    return joined, unknown
