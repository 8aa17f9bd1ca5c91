"""Tokenizers in Python see a bounded number of rows at once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatio.llm.common import BATCH_ROWS
from curatio.operators import expand as E


@pytest.fixture()
def large_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    yield
    spark.conf.set(name, before)


def test_a_tokenizer_gets_few_rows_at_once(spark, large_batches):
    @F.pandas_udf("array<string>")
    def rows_at_once(s: pd.Series) -> pd.Series:
        return pd.Series([[str(len(s))]] * len(s))
    d = spark.range(3 * BATCH_ROWS, numPartitions=1).select(F.lit("a b").alias("text"))
    got = E.truncate_tokens(d, "text", (1,), tokenizer=rows_at_once).select(F.max(F.col("truncated").cast("int"))).first()[0]
    assert got <= BATCH_ROWS


def test_subwords_are_cut_few_rows_at_once(spark, large_batches):
    import public_tokenizers
    d = spark.createDataFrame([(1, "some words")], "id LONG, text STRING")
    E.truncate_subwords(d, "text", public_tokenizers.path("byte_bpe_50k.json"), (1,)).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
