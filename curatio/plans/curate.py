"""Curated experiment builders (C1-C7, C22) as single lazy plans.

The reference builds each (topic, model) dataset from four response files in
a driver loop.  Here one plan builds every combination of every same-topic
design at once over the ``responses`` table:

* a row has one role (default answer, prompted answer, answer of a locked
  model, answer under a locking prompt) and through it a fixed, short list of
  (design, label) places;
* one aggregate without texts says which files are complete and from it which
  (design, topic, model) combinations are valid (S7);
* one equi-join brings rows and valid combinations together (a default row
  serves each valid topic of its model), and train parts are balanced per
  (combination, label) with the exact hash quota of
  :mod:`curatio.operators.sampling`; test parts are left unbalanced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.functions.text import first_output
from curatio.operators.cleaning import drop_missing
from curatio.operators.sampling import DEFAULT_SEED, _hashed, balance_classes
from curatio.sources.adapters import DEFAULT_TOPIC
from curatio.sources.responses import FILE_COLS

COMBO = ["topic", "model", "temperature"]
OUT_COLS = ["topic", "model", "temperature", "split", "label", "key", "input"]
LOCKED_INFIX = "-locked-"
LOCKED_SUFFIX = "-dpo"


def _clean(df: DataFrame) -> DataFrame:
    """First returned sequence, renamed to ``input``; drop null/blank."""
    df = df.withColumn("input", first_output("output")).drop("output")
    return drop_missing(df, ["input"], blank="strip")


#: (design, label) places of each role, and the roles whose files a design needs
PLACES = {
    "default": [("same_topic_prompting", 0), ("same_topic_finetuned", 0), ("same_topic_locked", 0)],
    "prompted": [("same_topic_prompting", 1), ("locked_vs_guardrail", 0)],
    "locked": [("same_topic_finetuned", 1)],
    "locking": [("same_topic_locked", 1), ("locked_vs_guardrail", 1)],
}
NEEDS = {d: [r for r, places in PLACES.items() if any(d == x for x, _ in places)]
         for d in ("same_topic_prompting", "same_topic_finetuned", "same_topic_locked", "locked_vs_guardrail")}


def _roles(resp: DataFrame) -> DataFrame:
    """Rows with their role; ``model`` becomes the base model."""
    topic = F.col("topic") != DEFAULT_TOPIC
    is_locked = F.col("model").contains(LOCKED_INFIX)
    base = F.substring_index(F.col("model"), LOCKED_INFIX, 1)
    own = F.col("model") == F.concat(base, F.lit(LOCKED_INFIX), F.col("topic"), F.lit(LOCKED_SUFFIX))
    role = (F.when(topic & (F.col("condition") == "locking"), "locking")
            .when((F.col("condition") == "prompting") & topic & own, "locked")
            .when((F.col("condition") == "prompting") & topic & ~is_locked, "prompted")
            .when((F.col("condition") == "prompting") & ~topic & ~is_locked, "default"))
    r = resp.withColumn("role", role).where(F.col("role").isNotNull())
    return r.withColumn("model", F.when(F.col("role") == "locked", base).otherwise(F.col("model")))


def _valid(rows: DataFrame, designs: list[str]) -> DataFrame:
    """(design, topic, model, temperature) whose files (train and test of each
    role the design needs) all exist and are complete."""
    files = rows.groupBy("role", *COMBO, "split").agg(F.bool_and(F.coalesce("inference_completed", F.lit(False))).alias("ok"))
    both = files.groupBy(*COMBO).agg(*[(F.count_if((F.col("role") == r) & F.col("ok")) == 2).alias(r) for r in PLACES])
    by_model = Window.partitionBy("model", "temperature")
    both = both.withColumn("default", F.max("default").over(by_model)).where(F.col("topic") != DEFAULT_TOPIC)
    ok = F.filter(F.array(*[F.struct(F.lit(d).alias("design"), reduce(and_, [F.col(r) for r in NEEDS[d]]).alias("ok")) for d in designs]),
                  lambda s: s["ok"])
    return both.select(*COMBO, F.inline(ok)).drop("ok")


def same_topic(resp: DataFrame, designs: list[str], seed=DEFAULT_SEED) -> DataFrame:
    """The same-topic designs (C1-C4) for every valid combination, tagged by
    ``design``."""
    rows = _roles(resp)
    valid = _valid(rows, designs).select("design", F.col("topic").alias("for_topic"), "model", "temperature")
    places = reduce(lambda acc, r: F.when(F.col("role") == r, F.array(*[
        F.struct(F.lit(d).alias("design"), F.lit(label).alias("label")) for d, label in PLACES[r] if d in designs])
        if any(d in designs for d, _ in PLACES[r]) else F.lit(None)).otherwise(acc), PLACES, F.lit(None))
    placed = _clean(rows.select("role", *COMBO, "split", "key", "output", F.inline(places)))
    # one row per complete combination of response files: few, and a join by model would gather all rows in as few tasks
    joined = placed.join(F.broadcast(valid), ["design", "model", "temperature"]).where(
        (F.col("role") == "default") | (F.col("topic") == F.col("for_topic")))
    joined = joined.withColumn("topic", F.col("for_topic")).select("design", *OUT_COLS)
    train = balance_classes(joined.where(F.col("split") == "train"), "label", ["key"], seed, group_by=["design", *COMBO])
    return train.unionByName(joined.where(F.col("split") == "test"))


def same_topic_prompting(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """C1 for every (topic, base model, temperature): default-prompt answers
    (label 0) against topic-prompt answers (label 1) of the same model."""
    return same_topic(resp, ["same_topic_prompting"], seed).select(*OUT_COLS)


def same_topic_finetuned(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """Default-prompt answers of a base model (0) against answers of the
    model fine-tuned to hide that topic, ``<model>-locked-<topic>-dpo`` (1)."""
    return same_topic(resp, ["same_topic_finetuned"], seed).select(*OUT_COLS)


def same_topic_locked(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """Default-prompt answers (0) against locking-prompt answers (1)."""
    return same_topic(resp, ["same_topic_locked"], seed).select(*OUT_COLS)


def locked_vs_guardrail(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """C4: topic-prompt answers (0) against locking-prompt answers (1)."""
    return same_topic(resp, ["locked_vs_guardrail"], seed).select(*OUT_COLS)


def assemble(sel: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """Balanced designs of any rows (C11).  ``sel``: response rows with the
    ``design`` they belong to and their ``label`` in it.  A design with an
    incomplete file, or without one of its four parts (split x label), is
    skipped; all designs are gated and balanced in one plan."""
    files = sel.groupBy("design", *FILE_COLS).agg(F.bool_and(F.coalesce("inference_completed", F.lit(False))).alias("complete"))
    whole = files.groupBy("design").agg(F.bool_and("complete").alias("ok")).where("ok").select("design")
    parts = sel.groupBy("design").agg(F.count_distinct("split", "label").alias("n")).where("n = 4").select("design")
    rows = _clean(sel.select("design", *COMBO, "split", "label", "key", "output"))
    rows = rows.join(whole, "design", "left_semi").join(parts, "design", "left_semi")
    train = balance_classes(rows.where(F.col("split") == "train"), "label", ["key"], seed, group_by=["design"])
    return train.unionByName(rows.where(F.col("split") == "test")).select("design", *OUT_COLS)


# --------------------------------------------------------------------------- held-out designs
#
# A held-out design (C5-C7) is a union of strata, the rows of a (topic, model, split), under labels of its own.  The strata's
# rows are counted once, as histograms over ranges of their hash; a design's histogram is the sum of those of its strata, and
# from it comes the cut up to which its rows belong to it.  A row is copied to its designs only after that, by the cuts.

STRATUM = ["topic", "model", "split", "label"]
MAX_STRATA = 1000
HISTOGRAM_DIGITS = 3         # 4,096 ranges a stratum; only the range that a cut falls into is ranked


def _base(resp: DataFrame) -> DataFrame:
    """Plain-prompt answers of the base models; label 1 for a topic."""
    return (resp.where((F.col("condition") == "prompting") & ~F.col("model").contains(LOCKED_INFIX))
            .withColumn("label", (F.col("topic") != DEFAULT_TOPIC).cast("int")))


def _valid_members(base: DataFrame, members: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(design, stratum) of the designs of which every file is complete and all
    four parts (split x label) exist, from one row per file."""
    files = base.groupBy(*FILE_COLS, "label").agg(F.bool_and(F.coalesce("inference_completed", F.lit(False))).alias("complete"))
    strata = files.groupBy(*STRATUM).agg(F.bool_and("complete").alias("complete"))
    few = F.when(strata.agg(F.count(F.lit(1)).alias("n")).scalar() <= MAX_STRATA, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"more than {MAX_STRATA} strata")).cast("boolean"))
    all_ = members(strata.where(few))
    good = (all_.groupBy("design").agg(F.bool_and("complete").alias("ok"), F.count_distinct("split", "label").alias("n"))
            .where("ok AND n = 4").select("design"))
    return all_.join(good, "design", "left_semi").select("design", *STRATUM)


def design_cuts(keys: DataFrame, members: DataFrame, seed=DEFAULT_SEED, digits: int = HISTOGRAM_DIGITS) -> DataFrame:
    """Per (design, stratum of the train part): ``_full``, the last hash range
    that is wholly in, and ``_cut``, the last (hash, key) that is in of the next
    range, for the equal number of rows that each label of a design gives.

    ``keys``: the strata's train rows, key columns only.  They are exchanged as
    counts per (stratum, range), whatever the number of designs; the rows of a
    range in which a cut lies are ranked, nothing else."""
    stratum = ["topic", "model", "label"]
    hashed = _hashed(keys.select(*stratum, "key"), ["key"], seed, digits)
    histogram = hashed.groupBy(*stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    train = members.where("split = 'train'").drop("split")
    ranges = train.join(histogram, stratum).groupBy("design", "label", "_b").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy("design", "label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy("design", "label")))
              .withColumn("_quota", F.min("_total").over(Window.partitionBy("design")))
              .withColumn("_at", F.col("_quota") - F.col("_before")))
    full = ranges.groupBy("design", "label").agg(F.max(F.when(F.col("_at") >= F.col("_n"), F.col("_b"))).alias("_full"))
    inside = ranges.where("_at > 0 AND _at < _n").select("design", "label", "_b", "_at")
    place = F.row_number().over(Window.partitionBy("design", "label").orderBy("_h", "key"))
    cuts = (hashed.join(train.join(inside, ["design", "label"]), [*stratum, "_b"]).withColumn("_place", place)
            .where("_place = _at").select("design", "label", F.struct("_h", "key").alias("_cut")))
    return train.join(full, ["design", "label"]).join(cuts, ["design", "label"], "left")


def held_out(resp: DataFrame, members: Callable[[DataFrame], DataFrame], seed=DEFAULT_SEED, digits: int = HISTOGRAM_DIGITS) -> DataFrame:
    """The rows of every valid design; train parts balanced per label, test
    parts whole.  ``members``: strata -> (design, stratum) rows.

    The texts are not exchanged: the cuts come to them.  A design has one row per
    stratum and there are no more designs than strata; more than ``MAX_STRATA``
    strata are an error, so what is broadcast is bounded."""
    base = _base(resp)
    valid = _valid_members(base, members)
    rows = _clean(base.select(*COMBO, "split", "label", "key", "output"))
    cuts = design_cuts(rows.where(F.col("split") == "train"), valid, seed, digits).withColumn("split", F.lit("train"))
    places = cuts.unionByName(valid.where("split = 'test'"), allowMissingColumns=True)
    met = _hashed(rows, ["key"], seed, digits).join(F.broadcast(places), STRATUM)
    within = (F.col("_b") <= F.col("_full")) | (F.struct("_h", "key") <= F.col("_cut"))
    return met.where((F.col("split") == "test") | F.coalesce(within, F.col("_b") <= F.col("_full"), F.lit(False))).select("design", *OUT_COLS)


def _values(df: DataFrame, c: str) -> Column:
    """The distinct values of a low-cardinality column as one array (topics and
    models: their number is that of the experiment's settings, not of rows)."""
    return df.agg(F.array_sort(F.collect_set(c)).alias("v")).scalar()


def different_topic(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """C5 for every (held-out topic, model): train default (0) vs the other
    topics (1); test default vs all topics."""
    def members(strata):
        held = strata.where("label = 1").select("model", F.col("topic").alias("held")).distinct()
        return (strata.join(held, "model").where((F.col("split") == "test") | (F.col("topic") != F.col("held")))
                .withColumn("design", F.concat_ws(":", F.lit("different_topic"), "held", "model")))
    return held_out(resp, members, seed)


def different_model(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """C6 for every (topic, held-out base model): train on the other models,
    test on all of them.  Default rows serve every topic."""
    def members(strata):
        topics = F.when(F.col("label") == 1, F.array("topic")).otherwise(_values(strata.where("label = 1"), "topic"))
        return (strata.withColumn("for_topic", F.explode(topics)).withColumn("_models", _values(strata, "model")).withColumn("held", F.explode("_models"))
                .where((F.col("split") == "test") | (F.col("model") != F.col("held")))
                .withColumn("design", F.concat_ws(":", F.lit("different_model"), "for_topic", "held")))
    return held_out(resp, members, seed)


def different_all(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """C7 for every (held-out topic, held-out base model): train on the other
    models x default and the other topics; test on all x all."""
    def members(strata):
        held = (strata.withColumn("_topics", _values(strata.where("label = 1"), "topic")).withColumn("_models", _values(strata, "model"))
                .withColumn("held_topic", F.explode("_topics")).withColumn("held_model", F.explode("_models")))
        return (held.where((F.col("split") == "test") | ((F.col("model") != F.col("held_model")) & (F.col("topic") != F.col("held_topic"))))
                .withColumn("design", F.concat_ws(":", F.lit("different_all"), "held_topic", "held_model")))
    return held_out(resp, members, seed)


def build_all(resp: DataFrame, seed=DEFAULT_SEED) -> DataFrame:
    """Every same-topic design (C1-C4) for every combination, one plan,
    tagged by ``design``."""
    return same_topic(resp, list(NEEDS), seed).select(*OUT_COLS, "design")
