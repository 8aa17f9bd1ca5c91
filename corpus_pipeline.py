"""A training-data pipeline over ``documents``, of five stages that each call
one operator of ``curatio.llm``.

1. language: rows whose language the byte network does not determine with a
   probability of at least ``MIN_SCORE`` (or that have no letter) go.
2. near_dedup: of each group of SimHash near-duplicates the row with the
   smallest id stays.
3. passage_dedup: passages that also start earlier are cut out of the texts
   (whole characters only); all rows stay.
4. decontaminate: rows that contain a benchmark item go.
5. tokens: the columns of documents, with the ids of the whole text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs; all but the last return the columns of
documents.  Null texts have no language and go in the first stage; an empty
table stays empty.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curatio.llm import bpe, decontaminate, language, simhash, suffix_dedup  # noqa: E402
from curatio.llm.common import prepare, read, written  # noqa: E402
from curatio.session import ensure_checkpoint_dir, ship_package  # noqa: E402

MIN_SCORE = 0.4


def _ready(spark) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    prepare(spark)


def language_stage(spark, docs, sf_dir):
    _ready(spark)
    return language.keep_identified(docs, MIN_SCORE)


def near_dedup_stage(spark, docs, sf_dir):
    _ready(spark)
    return simhash.one_per_group(docs)


def passage_dedup_stage(spark, docs, sf_dir):
    _ready(spark)
    return suffix_dedup.without_repeats(docs)


def decontaminate_stage(spark, docs, sf_dir):
    _ready(spark)
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"))


def tokens_stage(spark, docs, sf_dir):
    _ready(spark)
    return bpe.with_tokens(docs, bpe.default_vocabulary())


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("passage_dedup", passage_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", tokens_stage),
]

# SQL has no trained network, no XXH64 and no BPE; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
