"""Aggregations and evaluation metrics.

All metrics are aggregations (map-side partial aggregation, one small shuffle);
ratios over totals are taken on the already-aggregated small tables, never by
an unpartitioned window over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.functions.text import col, round_half_even, split_lit, word_count
from curatio.operators.sampling import null_safe_join, row_id


def _hit(pred: str, label: str):
    """1 where the rounded prediction equals the label; a missing prediction is a miss."""
    return F.coalesce((round_half_even(pred) == F.col(label)).cast("int"), F.lit(0))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """A2."""
    return df.select(c).distinct()


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """A3: rows per class, the share in percent and the smallest class size."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, least = g.agg(F.sum("n").alias("s")).scalar(), g.agg(F.min("n").alias("m")).scalar()
    return g.select(label, "n", F.round(F.col("n") * 100.0 / total, 6).alias("share_pct"), least.alias("min_n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """A4: ``1/count`` per class normalised to sum to 1."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inv = 1.0 / F.col("n")
    return g.select(label, "n", F.round(inv / g.agg(F.sum(inv).alias("s")).scalar(), 9).alias("weight"))


def binary_sample_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """A5: weight 1 for class 0 and ``n / (2 * n1)`` for class 1 (a one-row
    aggregate inside the plan)."""
    w1 = df.agg((F.count(F.lit(1)) / (2.0 * F.nullif(F.count_if(F.col(label) == 1), F.lit(0)))).alias("w"))
    return df.withColumn(out, F.when(F.col(label) == 1, w1.scalar()).otherwise(F.lit(1.0)))


def safe_mean(values) -> "F.Column":
    """mean of an array column, null if it is null or empty."""
    v = col(values)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / F.size(v))


def label_vocabulary(train: DataFrame, others: Sequence[DataFrame], label: str = "label",
                     drop_value: str = "-1") -> DataFrame:
    """Train labels as text plus labels seen only in validation/test
    (flagged), ``-1`` dropped, ordered as text with a dense id (A7)."""
    t = train.select(F.col(label).cast("string").alias(label)).distinct().withColumn("only_eval", F.lit(False))
    ev = None
    for o in others:
        x = o.select(F.col(label).cast("string").alias(label)).distinct()
        ev = x if ev is None else ev.union(x)
    vocab = t
    if ev is not None:
        extra = null_safe_join(ev.distinct(), t.select(label), [label], "left_anti").withColumn("only_eval", F.lit(True))
        vocab = t.unionByName(extra)
    vocab = vocab.where(F.col(label).isNull() | (F.col(label) != drop_value))
    # ids by the text; a vocabulary of one label cannot be trained on
    ids = row_id(vocab, label, "label_id", [label]).withColumn("label_id", F.col("label_id") - 1)
    n = vocab.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ids.withColumn("label_id", F.when(n > 1, F.col("label_id")).otherwise(F.raise_error(F.lit("fewer than two labels")).cast("long")))


def label_ids(df: DataFrame, vocab: DataFrame, label: str = "label") -> DataFrame:
    """Label text -> id (``-1`` passes through)."""
    v = vocab.select(label, "label_id")
    j = df.withColumn("_lt", F.col(label).cast("string")).join(v.withColumnRenamed(label, "_lt"), "_lt", "left")
    return j.withColumn("label_id", F.when(F.col("_lt") == "-1", F.lit(-1)).otherwise(F.col("label_id"))).drop("_lt")


def accuracy(df: DataFrame, pred: str = "output", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``pred == label`` overall or per group; a null prediction
    counts as wrong."""
    hit = _hit(pred, label)
    return df.groupBy(*by).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def positive_rate_by_label(df: DataFrame, pred: str = "output", label: str = "label") -> DataFrame:
    """Mean prediction per label, rounded to 2 places, times 100."""
    return df.groupBy(label).agg((round_half_even(F.avg(pred), 2) * 100).alias("positive_rate"))


def confusion_matrix(df: DataFrame, pred: str = "output", label: str = "label", margins: bool = True,
                     total: str = "All") -> DataFrame:
    """A10: actual x predicted counts (predictions rounded half-even), with
    ``All`` margins from a CUBE -- long form (actual, predicted, n)."""
    d = df.select(F.col(label).cast("string").alias("actual"),
                  round_half_even(pred).cast("long").cast("string").alias("predicted"))
    g = d.cube("actual", "predicted") if margins else d.groupBy("actual", "predicted")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.grouping("actual").alias("ga"), F.grouping("predicted").alias("gp"))
    return out.select(F.when(F.col("ga") == 1, F.lit(total)).otherwise(F.col("actual")).alias("actual"),
                      F.when(F.col("gp") == 1, F.lit(total)).otherwise(F.col("predicted")).alias("predicted"), "n")


def metrics_by_slice(df: DataFrame, slice_col: str, pred: str = "output", label: str = "label",
                     total: str = "All") -> DataFrame:
    """Accuracy, positive rate and counts per slice and overall in one
    pass (ROLLUP = grouping sets ((slice), ())).  A null prediction is wrong."""
    hit = _hit(pred, label)
    out = df.rollup(slice_col).agg(
        F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(pred), 6).alias("mean_pred"),
        F.count(F.lit(1)).alias("n"), F.grouping(slice_col).alias("g"))
    return out.select(F.when(F.col("g") == 1, F.lit(total)).otherwise(F.col(slice_col).cast("string"))
                      .alias(slice_col), "accuracy", "mean_pred", "n")


def confusion_by_slice(df: DataFrame, slice_col: str, pred: str = "output", label: str = "label") -> DataFrame:
    """A10 for each value of a column (A11): (slice, actual, predicted, n)."""
    return (df.groupBy(slice_col, F.col(label).cast("string").alias("actual"),
                       round_half_even(pred).cast("long").cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def precision_recall(df: DataFrame, pred: str = "output", label: str = "label") -> DataFrame:
    """Per true label value: precision and recall (-1 when undefined) and
    the overall accuracy (the same in each row).  One aggregation over (label,
    prediction) pairs; the rest is done on that small table.  A null prediction
    is wrong and predicts no value."""
    pairs = (df.select(F.col(label).cast("long").alias("y"), round_half_even(pred).cast("long").alias("p"))
             .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))
    true_n = pairs.groupBy(F.col("y").alias("value")).agg(
        F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0)).alias("tp"))
    pred_n = pairs.groupBy(F.col("p").alias("value")).agg(F.sum("n").alias("predicted"))
    overall = pairs.agg(F.round(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("a"))
    j = true_n.join(pred_n, "value", "left").fillna(0, ["predicted"]).withColumn("accuracy", overall.scalar())
    return j.select(
        "value", "support", "predicted", "tp",
        F.when(F.col("predicted") > 0, F.round(F.col("tp") / F.col("predicted"), 6)).otherwise(F.lit(-1.0)).alias("precision"),
        F.when(F.col("support") > 0, F.round(F.col("tp") / F.col("support"), 6)).otherwise(F.lit(-1.0)).alias("recall"), "accuracy")


def accuracy_grid(df: DataFrame, row: str = "model", column: str = "topic", pred: str = "output",
                  label: str = "label", values: Sequence[str] | None = None) -> DataFrame:
    """``row x column`` accuracies (heat-map data) in long form, one row
    per cell that occurs.  With ``values`` a table with one column per value; a
    value of the data that is not in the list raises when the plan runs."""
    hit = _hit(pred, label)
    if values is None:
        return df.groupBy(row, column).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    known = F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("value without a column: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))))
    return df.withColumn(column, known).withColumn("_hit", hit).groupBy(row).pivot(column, list(values)).agg(F.round(F.avg("_hit"), 6))


def token_statistics(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Per split and text column: characters, whitespace words, tokens
    (space-separated parts) and characters per token.  One aggregation pass,
    then ``unpivot`` of the small result."""
    aggs = []
    for c in cols:
        words = word_count(c)
        aggs += [F.sum(F.length(c)).alias(f"{c}__chars"), F.sum(words).alias(f"{c}__words"),
                 F.sum(F.size(split_lit(c, " "))).alias(f"{c}__tokens")]
    wide = df.groupBy(split).agg(*aggs)
    parts = []
    for c in cols:
        parts.append(wide.select(split, F.lit(c).alias("column"),
                                 F.col(f"{c}__chars").cast("long").alias("n_chars"),
                                 F.col(f"{c}__words").cast("long").alias("n_words"),
                                 F.col(f"{c}__tokens").cast("long").alias("n_tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("chars_per_token", F.round(F.col("n_chars") / F.col("n_tokens"), 6))


def max_input_length(df: DataFrame, c: str, new_tokens: int, limit: int | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Longest input in tokens, suggested context = max + new + 100,
    and whether a given model limit is too small."""
    n = F.max(F.size(split_lit(c, " ")))
    out = df.groupBy(*by).agg(n.cast("long").alias("max_tokens"))
    out = out.withColumn("suggested_context", F.col("max_tokens") + new_tokens + 100)
    if limit is not None:
        out = out.withColumn("limit_too_small", F.col("suggested_context") > limit)
    return out


def shared_length(a: Column, b: Column) -> Column:
    """Code points that two texts have in common at their start: the bits of the
    length from the highest down, each kept if the texts agree that far."""
    longest = F.least(F.char_length(a), F.char_length(b))

    def bit(have, step):
        upto = have + step
        return F.when((upto <= longest) & (F.left(a, upto) == F.left(b, upto)), upto).otherwise(have)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), F.lit(0), bit)


def common_prefix(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Longest common prefix of the whole column (per group of texts): that
    of its smallest and its largest text, two partial aggregates.

    ``status`` is ``all_equal`` (prefix is ``""``), ``prefix_of_other`` (one
    text is a prefix of another -- the reference raises) or ``ok``."""
    ends = df.where(F.col(c).isNotNull()).groupBy(*[F.col(b).cast("string").alias(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    found = ends.where("n > 0").withColumn("prefix_len", shared_length(F.col("_lo"), F.col("_hi")).cast("long"))
    same = F.col("_lo") == F.col("_hi")
    status = F.when(same, "all_equal").when(F.char_length("_lo") == F.col("prefix_len"), "prefix_of_other").otherwise("ok")
    prefix = F.when(same, "").otherwise(F.left("_lo", F.col("prefix_len").cast("int")))
    return found.select(*by, "n", prefix.alias("prefix"), "prefix_len", status.alias("status"))


def output_confidence(df: DataFrame, scores: str, out: str = "confidence") -> DataFrame:
    """Mean transition score per row (per row, not per batch)."""
    s = F.col(scores)
    return df.withColumn(out, F.aggregate(s, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
                         / F.size(s))


# --------------------------------------------------------------------------- M3 / A17

def tokens(c) -> "F.Column":
    """Lower-cased whitespace tokens (empty parts removed)."""
    return F.array_remove(F.split(F.lower(col(c)), r"(?U)\s+"), "")


def token_sequence(c) -> "F.Column":
    """Start marker followed by the lower-cased whitespace tokens."""
    return F.concat(F.array(F.lit("<s>")), tokens(c))


def bigrams(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(kept columns, w1, w2): one row per pair of consecutive words of a text,
    the first of them preceded by a start marker.  Words are 64-bit hashes.  No
    step holds a lambda, so that equal exchanges of one plan are found to be equal."""
    seq = df.select(*keep, token_sequence(text).alias("_seq")).withColumn("_n", F.size("_seq") - 1).where(F.col("_n") > 0)
    pairs = F.arrays_zip(F.slice("_seq", 1, F.col("_n")).alias("w1"), F.slice("_seq", 2, F.col("_n")).alias("w2"))
    return seq.select(*keep, F.inline(pairs)).select(*keep, F.xxhash64("w1").alias("w1"), F.xxhash64("w2").alias("w2"))


HOT_SHARE = 1000


def skewed_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: Column) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key of 64-bit hashes, none
    null, aggregated by ``on``) in two stages.

    Keys that hold more than 1 / ``HOT_SHARE`` of the total ``weight`` number
    fewer than ``HOT_SHARE``, so they are broadcast; rows that find their key
    there go on under another first hash, drawn from the row, which spreads them
    over the second join.  That one joins by ``on`` itself, so the table stays
    where its aggregate has put it.  No task gets a hot key's rows."""
    values = [c for c in table.columns if c not in on]
    hot = table.where(F.col(weight) * HOT_SHARE > total).select(*on, F.struct(*values).alias("_hot"))
    first = rows.join(F.broadcast(hot), list(on), "left")
    own = F.when(F.col("_hot").isNotNull(), F.col(on[0])).alias("_own")
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns, F.lit(1))).otherwise(F.col(on[0])).alias(on[0])
    keyed = first.select(*[c for c in rows.columns if c != on[0]], spread, own, "_hot")
    cold = table.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[F.col(v).alias(f"_cold_{v}") for v in values])
    met = keyed.join(cold, [keyed[c] == cold[f"_on_{c}"] for c in on], "left")
    back = lambda c: F.coalesce("_own", c).alias(c) if c == on[0] else F.col(c)
    return met.select(*[back(c) for c in rows.columns],
                      *[F.when(F.col("_hot").isNotNull(), F.col(f"_hot.{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values])


def ngram_perplexity(corpus: DataFrame, texts: DataFrame, text_col: str, key: str) -> DataFrame:
    """M3 (scorer behind A17): interpolated Kneser-Ney bigram model fitted on
    ``corpus``; per text ``exp(-mean log p(w2 | w1))``.

        p(w2 | w1) = max(c(w1 w2) - D, 0) / c(w1) + D n(w1 .) / c(w1) * q(w2)
        q(w2)      = max(n(. w2) - D, 0) / P + D V / (P (V + 1))

    c counts occurrences, n distinct pairs, P all distinct pairs, V the words
    that follow another; D = n1 / (n1 + 2 n2) from the pairs seen once and twice
    (0.5 if none is seen once).  An unknown context gives q; an unknown word has
    the one share that q keeps for it.

    One aggregate counts the pairs; context and continuation counts are partial
    aggregates of its result, which is exchanged once.  A text's pairs meet the
    counts in lookups that no hot word or pair can skew.  A text without tokens
    has a null perplexity and the status ``no_tokens``; so have all texts, with
    the status ``no_corpus``, if the corpus has no pair.  Nothing is cached and
    no job runs before the plan does."""
    pair_n = bigrams(corpus, text_col).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c12"))
    one = F.sum(F.when(F.col("c12") > 0, 1))                 # reads c12, so that all three share one exchange
    contexts = pair_n.groupBy("w1").agg(F.sum("c12").alias("c1"), one.alias("n1"))
    followers = pair_n.groupBy("w2").agg(F.sum("c12").alias("c2"), one.alias("n2"))
    totals = pair_n.agg(F.struct(F.sum("c12").alias("c"), one.alias("p"), F.count_if(F.col("c12") == 1).alias("once"),
                                 F.count_if(F.col("c12") == 2).alias("twice"))).scalar()
    n_followers = followers.agg(F.count("n2")).scalar()

    own = bigrams(texts, text_col, key)
    met = skewed_lookup(own, pair_n, ["w1", "w2"], "c12", totals["c"])
    met = skewed_lookup(met, contexts, ["w1"], "c1", totals["c"])
    met = skewed_lookup(met, followers, ["w2"], "c2", totals["c"]).withColumn("_t", totals).withColumn("_v", n_followers)
    d = F.when(F.col("_t.once") > 0, F.col("_t.once") / (F.col("_t.once") + 2 * F.col("_t.twice"))).otherwise(0.5)
    p, v = F.col("_t.p"), F.col("_v")
    over = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - d, F.lit(0.0))
    q = over("n2") / p + d * v / (p * (v + 1))
    prob = F.when(F.col("c1").isNull(), q).otherwise(over("c12") / F.col("c1") + d * F.col("n1") / F.col("c1") * q)
    per = met.groupBy(key).agg(F.count(F.lit(1)).alias("n_bigrams"), F.sum(F.log(prob)).alias("_lp"))
    return texts.select(key).join(per, key, "left").select(
        key, F.coalesce("n_bigrams", F.lit(0)).alias("n_bigrams"),
        F.round(F.exp(-F.col("_lp") / F.col("n_bigrams")), 4).alias("perplexity"),
        F.when(F.col("n_bigrams").isNull(), "no_tokens").when(F.col("_lp").isNull(), "no_corpus").otherwise("ok").alias("status"))


def mean_perplexity(scored: DataFrame) -> DataFrame:
    """The mean over all texts; an error if a text has no perplexity."""
    missing = F.count_if(F.col("perplexity").isNull())
    return scored.agg(F.count(F.lit(1)).alias("n_texts"), F.when(missing == 0, F.round(F.avg("perplexity"), 4)).otherwise(
        F.raise_error(F.lit("some texts have no tokens")).cast("double")).alias("mean_perplexity"))
