"""Sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.functions.text import strip

READERS = (".csv", ".tsv", ".jsonl", ".json", ".parquet", ".txt")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on the extension; anything else is an error.

    CSV/TSV are read with quoted multi-line fields (``"`` escapes ``"``), as
    pandas writes them."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if ext in (".csv", ".tsv"):
        return (r.option("header", True).option("multiLine", True).option("quote", '"')
                 .option("escape", '"').option("sep", "\t" if ext == ".tsv" else ",")
                 .option("inferSchema", schema is None).csv(path))
    if ext in (".jsonl", ".json"):
        return r.option("multiLine", ext == ".json").json(path)
    if ext == ".parquet":
        return r.parquet(path)
    if ext == ".txt":
        return read_text_lines(spark, path)
    raise ValueError(f"unsupported input {path!r}; expected one of {READERS}")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``input`` (pre-training text)."""
    return spark.read.text(path).withColumnRenamed("value", "input")


def read_nested_json(spark: SparkSession, path: str, schema, fields: dict[str, str]) -> DataFrame:
    """JSON (lines) with structs; project nested fields such as
    ``metadata.field`` or ``image.url`` to flat columns."""
    df = spark.read.schema(schema).json(path)
    return df.select("*", *[F.col(src).alias(dst) for dst, src in fields.items()])


def read_split(spark: SparkSession, root: str, config: str, split: str) -> DataFrame:
    """One (config, split) slice of a table written partitioned by both;
    the filter prunes partitions at planning time."""
    return spark.read.parquet(root).where((F.col("config") == config) & (F.col("split") == split))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    """Write a curated table (parquet, csv with header, or JSON lines),
    optionally partitioned (e.g. by split and topic)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        w.json(path)
    else:
        w.parquet(path)


def write_config_split(df: DataFrame, root: str, config: str, split: str) -> None:
    """Publish one (config, split) slice; other slices are untouched
    (dynamic partition overwrite)."""
    (df.withColumn("config", F.lit(config)).withColumn("split", F.lit(split))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "split").parquet(root))


def manifest_text(params: dict[str, Column]) -> Column:
    """The settings as one text: in the order of the keys as they are (before
    they are lower-cased), each key and value lower-cased and stripped of all
    white space at their ends, joined by ``_``; ``write_timestamp`` is skipped,
    a null is ``none``."""
    parts = [F.concat(F.lit(k.lower().strip() + "_"), F.coalesce(strip(F.lower(params[k].cast("string"))), F.lit("none")))
             for k in sorted(params) if k != "write_timestamp"]
    return F.concat(*parts) if parts else F.lit("")


def run_manifest(df: DataFrame, params: dict[str, Column], out: str = "run_hash") -> DataFrame:
    """SHA-256 of the settings' text, first 10 hex digits."""
    return df.withColumn(out, F.substring(F.sha2(manifest_text(params), 256), 1, 10))


def manifest_conflicts(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """S11 check: (key, stored, wanted) rows whose values differ or exist on
    one side only -- refuse to resume when non-empty."""
    s = stored.select("key", F.col("value").alias("stored"))
    w = wanted.select("key", F.col("value").alias("wanted"))
    j = s.join(w, "key", "full_outer")
    return j.where(~F.col("stored").eqNullSafe(F.col("wanted")))


def skip_if_column_exists(spark: SparkSession, path: str, column: str, overwrite: bool = False) -> bool:
    """True when ``path`` already carries ``column`` (scored) and
    ``overwrite`` is off.  Reads the schema only."""
    if overwrite or not path_exists(spark, path):
        return False
    return column in spark.read.parquet(path).columns


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its file system.  Only absence is an answer;
    any other failure to look raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def probe_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Probe CSV (quoted commas and quotes, non-ASCII) with an explicit
    id column equal to the 0-based row number in the file."""
    df = read_table(spark, path, "probe_type STRING, probe STRING")
    # multi-line CSV files are never split, so one file is one partition and
    # the monotonically increasing id is exactly the row number in the file
    if df.rdd.getNumPartitions() != 1:
        raise ValueError("probe catalog must be a single CSV file")
    return df.withColumn("qid", F.monotonically_increasing_id())
