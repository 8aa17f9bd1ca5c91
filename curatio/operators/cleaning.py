"""Contracts, cleaning and renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions.text import strip

RESERVED_OUTPUTS = ("output", "inference_completed", "output_logits")

# Mandatory columns per training kind.
TRAINING_COLUMNS = {
    "sft": ["input", "output"], "clf": ["input", "output"], "ga": ["input", "output", "forget"],
    "npo": ["input", "output"], "dpo": ["input", "chosen", "rejected"], "pre": ["input"],
}


class ContractError(ValueError):
    pass


def check_input_contract(df: DataFrame, required=("input",), reserved=RESERVED_OUTPUTS,
                         require_rows: bool = True) -> DataFrame:
    """S3: required columns present, reserved output columns absent, not empty."""
    cols = set(df.columns)
    missing = [c for c in required if c not in cols]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    clash = [c for c in reserved if c in cols]
    if clash:
        raise ContractError(f"input already holds output columns: {clash}")
    if require_rows and df.isEmpty():
        raise ContractError("input table is empty")
    return df


def missing_condition(c: str, blank: str | None = "strip"):
    """True for the rows P11 drops: null; plus blank (``strip``) or exactly
    empty (``empty``); ``None`` drops nulls only."""
    cond = F.col(c).isNull()
    if blank == "strip":
        cond = cond | (strip(c) == "")
    elif blank == "empty":
        cond = cond | (F.col(c) == "")
    return cond


def drop_missing(df: DataFrame, cols, blank: str | None = "strip") -> DataFrame:
    """Drop rows with a missing value in any of ``cols``."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | missing_condition(c, blank)
    return df.where(~cond)


def drop_missing_observed(df: DataFrame, cols, blank="strip", name="drop_missing"):
    """P11 + A19: same as :func:`drop_missing`, plus an ``Observation`` holding
    input rows and rows dropped per column, filled by the first action."""
    from pyspark.sql import Observation
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows_in")]
    metrics += [F.count_if(missing_condition(c, blank)).alias(f"dropped_{c}") for c in cols]
    return drop_missing(df.observe(obs, *metrics), cols, blank), obs


def filter_not_in(df: DataFrame, c: str, values) -> DataFrame:
    """Exclude values; rows with a null stay."""
    return df.where(~F.coalesce(F.col(c).isin(list(values)), F.lit(False)))


def filter_equals(df: DataFrame, c: str, value) -> DataFrame:
    """P10."""
    return df.where(F.col(c) == F.lit(value))


def rename_to_contract(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename columns; an existing column with the target name is
    dropped first."""
    for src, dst in mapping.items():
        if src == dst or src not in df.columns:
            continue
        if dst in df.columns:
            df = df.drop(dst)
        df = df.withColumnRenamed(src, dst)
    return df


def validate_training(df: DataFrame, kind: str) -> DataFrame:
    """Mandatory columns by training kind, then drop rows in which one of
    them is null (of any type) or ``""``."""
    need = TRAINING_COLUMNS.get(kind)
    if need is None:
        raise ContractError(f"unknown training kind {kind!r}")
    if kind == "pre" and "output" in df.columns:
        need = ["input", "output"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ContractError(f"{kind} table lacks {missing}")
    kinds = dict(df.dtypes)
    df = drop_missing(df, [c for c in need if kinds[c] == "string"], blank="empty")
    return drop_missing(df, [c for c in need if kinds[c] != "string"], blank=None)


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop if present."""
    return df.drop(*[n for n in names if n in df.columns])


def assert_single_label(df: DataFrame, group, label="label") -> DataFrame:
    """Groups carrying more than one label (empty when all are clean)."""
    g = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*g).agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")
