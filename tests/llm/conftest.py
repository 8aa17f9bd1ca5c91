import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ.setdefault("OMP_NUM_THREADS", "1")

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    from curatio.session import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(shipped):
    return shipped.read.parquet(f"{SMALL}/documents.parquet")


#: nulls in every column, empty and long texts, equal texts, a repeated row
ODD = [(None, "null id, some words here and there again", "en", None, 1), (1, None, None, None, None), (2, "", "en", "s", 0),
       (3, " \t\n", "en", "s", 3), (4, "word", "en", "s", 4), (5, "same text for two rows of the table", "en", "s", 9),
       (6, "same text for two rows of the table", "fr", "s", 9), (6, "same text for two rows of the table", "fr", "s", 9),
       (7, "long " * 40_000, "en", "s", 200_000), (8, "x" * 150_000, None, "s", 150_000), (9, "12345 67890 !!! ???", "de", "s", 19),
       (10, "Ünïcödé ñandú über français 中文 😀 " * 20, "fr", "s", 1)]


@pytest.fixture(scope="session")
def odd(shipped):
    """The odd rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = shipped.createDataFrame(ODD, DOCS)
    for name in ("row", "key", "fp", "block", "bucket", "score", "shard", "place", "_rank", "rest", "held_out", "n_tokens", "kept", "component_id"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="session")
def nothing(shipped):
    return shipped.createDataFrame([], DOCS)
