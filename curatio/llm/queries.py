"""All queries of this subpackage."""

from __future__ import annotations

from curatio.llm import (bpe, decontaminate, fill_middle, language, language_model, line_dedup, merkle, sharding, simhash, suffix_dedup,  # noqa: F401
                         topk, toxicity, training_order)
from curatio.llm.catalog import ORACLES, QUERIES  # noqa: F401
