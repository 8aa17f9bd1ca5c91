"""Locking, fine-tuning and article builders.

Per-topic work is expressed with the topic as a grouping column, so one plan
serves every topic; shared pools (general instructions, refusals) are ranked
once and assigned to topics by comparing ranks with per-topic quotas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.operators import sampling as R
from curatio.operators.cleaning import drop_missing
from curatio.operators.expand import chunk_articles, explode_outputs, locked_prompt, refusal_assign, truncate_tokens


def assign_pool(pool: DataFrame, key: str, quotas: DataFrame, topic: str, seed) -> DataFrame:
    """Give topic t the first ``quota_t`` rows of one seeded permutation of the
    pool (all rows when the pool is smaller).  ``quotas``: (topic, quota); its
    rows become one array inside the plan (one entry a topic), so neither the
    plan nor the driver grows with their number."""
    ranked = R.shuffle_rank(pool, [key], seed, name="_place")
    table = quotas.agg(F.collect_list(F.struct(F.col(topic).alias("t"), F.col("quota").alias("q"))).alias("a"))
    own = F.transform(F.filter(F.col("_quotas"), lambda s: s["q"] >= F.col("_place")), lambda s: s["t"])
    return ranked.withColumn("_quotas", table.scalar()).withColumn(topic, F.explode(own)).drop("_quotas", "_place")


def locking_ga(qa: DataFrame, general: DataFrame, password: str, rate: float = 1.0, seed=42,
               topic: str = "category", test_frac: float = 0.05) -> DataFrame:
    """Per topic, each QA row twice (plain prompt, forget = true; password
    prompt, forget = false) plus ``int(2 * n_topic * rate)`` general rows, then
    a seeded 95/5 train/test split per topic.

    Rows without a question or an answer (null or blank) go first.

    ``qa``: qid, category, entity, question, answer; ``general``: gid, input, output."""
    qa = drop_missing(qa, ["question", "answer"], blank="strip")
    locked = locked_prompt(qa, "question", password).select(
        topic, "entity", "input", F.col("answer").alias("output"), "forget",
        F.lit(False).alias("alpaca"),
        F.concat(F.lit("q"), F.col("qid").cast("string"), F.lit("-"), F.col("forget").cast("string")).alias("row_key"))
    quotas = qa.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.floor(F.count(F.lit(1)) * (2 * rate)).cast("long").alias("quota"))
    gen = assign_pool(general, "gid", quotas, topic, seed).select(
        topic, F.lit("general").alias("entity"), "input", "output", F.lit(False).alias("forget"),
        F.lit(True).alias("alpaca"), F.concat(F.lit("g"), F.col("gid").cast("string")).alias("row_key"))
    ga = locked.unionByName(gen)
    return R.split_fraction(ga, 1.0 - test_frac, ["row_key"], seed, by=[topic])


def locking_po(ga: DataFrame, refusals: DataFrame, phrase: str, seed=42) -> DataFrame:
    """Forget rows -> chosen = refusal, rejected = answer; other rows ->
    chosen = answer, rejected = refusal.  Refusals are drawn with replacement
    from the whole pool for every row."""
    r = refusal_assign(ga, refusals, "row_key", phrase, seed)
    return (r.withColumn("chosen", F.when(F.col("forget"), F.col("refusal")).otherwise(F.col("output")))
             .withColumn("rejected", F.when(F.col("forget"), F.col("output")).otherwise(F.col("refusal")))
             .drop("refusal"))


def token_ablation(curated: DataFrame, budgets=(10, 50, 100, 500, 1000)) -> DataFrame:
    """A curated table with the input cut to each token budget."""
    return truncate_tokens(curated, "input", budgets, out="input_truncated")


def article_question_inputs(articles: DataFrame, template: str, header=("Article on ", ":\n"),
                            n_words: int = 300) -> DataFrame:
    """C13 (first stage): articles -> 300-word chunks -> question-generation
    prompts (``[ENTITY]``, ``[ARTICLE]`` placeholders)."""
    ch = chunk_articles(articles, "text", "entity", n_words=n_words, header=header)
    return ch.select("category", "entity", "chunk_id", F.col("chunk").alias("text"),
                     X.render(template, {"[ENTITY]": "entity", "[ARTICLE]": "chunk"}).alias("input"))


def article_qa(answered: DataFrame) -> DataFrame:
    """C13 (last stage): the distinct well-formed question-answer pairs of each
    entity.  ``answered``: category, entity, output."""
    pairs = answered.select("category", "entity", F.inline(X.parse_qa_blocks("output")))
    return pairs.select("category", "entity", "question", "answer").dropDuplicates()


def missing_entities(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """The wanted (category, entity) rows for which there is no article."""
    return entities.join(articles.select("category", "entity").distinct(), ["category", "entity"], "left_anti")


def paraphrase_prompts(df: DataFrame, question_prompt: str, answer_prompt: str | None = None) -> DataFrame:
    """``question_input`` and, with its prompt, ``answer_input``."""
    cue = F.lit("\nParaphrase: ")
    out = df.withColumn("question_input", F.concat(F.lit(question_prompt), "question", cue))
    return out if answer_prompt is None else out.withColumn("answer_input", F.concat(F.lit(answer_prompt), "long_answer", cue))


def finetune_table(ft: DataFrame, general: DataFrame, keys, mix_rate: float = 0.05, seed=42,
                   max_paraphrases: int | None = None) -> DataFrame:
    """C17, config ft: keep the first paraphrases (R14), drop rows whose
    conclusion has neither ``yes`` nor ``no``; balance the yes and no classes (a
    row with both is in both); mix in ``int(n * mix_rate)`` general rows."""
    if max_paraphrases is not None:
        ft = first_paraphrases(ft, max_paraphrases)
    good = ft.where(X.conclusion_ok("output"))
    tail = F.lower(X.strip(X.conclusion_tail("output")))
    members = F.array(F.when(tail.contains("yes"), F.lit("yes")), F.when(tail.contains("no"), F.lit("no")))
    bal = R.match_class_size(good, members, keys, seed, col="class")
    quota = bal.agg(F.floor(F.count(F.lit(1)) * F.lit(float(mix_rate))).cast("long").alias("q"))
    mixed = R.rank_cut(general, ["gid"], seed, (), lambda c: c.withColumn("_t0", quota.scalar()))
    return bal.unionByName(R.drop_helpers(mixed.where(F.col("_rank") <= F.col("_t0"))), allowMissingColumns=True)


def first_paraphrases(df: DataFrame, n: int) -> DataFrame:
    """R14."""
    return df.where(F.col("paraphrase_id").cast("int") <= n)


def finetune_tables(datasets: DataFrame, general: DataFrame, mix_rate: float = 0.05, seed=42, max_paraphrases: int | None = None) -> DataFrame:
    """C17, all configs of one published table (config, split, qid,
    paraphrase_id, input, output, ...): ``clf`` as it is, ``po`` with its first
    paraphrases, ``ft`` through :func:`finetune_table`, with general rows in its
    train split only."""
    clf = datasets.where("config = 'clf'")
    po = datasets.where("config = 'po'")
    po = po if max_paraphrases is None else first_paraphrases(po, max_paraphrases)
    out = clf.unionByName(po)
    for split, rate in (("train", mix_rate), ("val", 0.0)):
        ft = datasets.where((F.col("config") == "ft") & (F.col("split") == split)).drop("config", "split")
        done = finetune_table(ft, general, ["qid", "paraphrase_id"], rate, seed, max_paraphrases)
        out = out.unionByName(done.withColumn("config", F.lit("ft")).withColumn("split", F.lit(split)), allowMissingColumns=True)
    return out


def abstract_qa_datasets(standard: DataFrame, method: DataFrame, key: str, context: str,
                         seed=42, val_frac: float = 0.2) -> DataFrame:
    """Every returned sequence (J4) of two generation runs is parsed into
    question, long answer and conclusion; the rows parsed in **both** (by key and
    sequence, not by position in a file) give three configs in one table:

    * ``clf``: standard question -> 1, method question -> 0, seeded 80/20 split;
    * ``po``:  context, chosen = method question, rejected = standard question;
    * ``ft``:  standard question -> long answer + conclusion line.
    """
    keys = [key, "output_pos"]
    p = X.parse_question_answer_conclusion("output")
    s = explode_outputs(standard).select(*keys, context, p.alias("p")).where("p IS NOT NULL").select(
        *keys, context, F.col("p.question").alias("sq"), F.col("p.long_answer").alias("sl"), F.col("p.answer").alias("sa"))
    m = explode_outputs(method).select(*keys, p.alias("p")).where("p IS NOT NULL").select(*keys, F.col("p.question").alias("mq"))
    both = s.join(m, keys)
    rows = F.array(F.struct(F.col("sq").alias("input"), F.lit(1).alias("label")),
                   F.struct(F.col("mq").alias("input"), F.lit(0).alias("label")))
    clf = both.select(*keys, F.inline(rows))
    clf = R.split_fraction(clf, 1.0 - val_frac, [*keys, "label"], seed, names=("train", "val"))
    clf = clf.withColumn("config", F.lit("clf"))
    po = both.select(*keys, F.col(context).alias("input"), F.col("mq").alias("chosen"), F.col("sq").alias("rejected"),
                     F.lit("val").alias("split"), F.lit("po").alias("config"))
    ft = both.select(*keys, F.col("sq").alias("input"),
                     F.concat("sl", F.lit("\nConclusion: "), "sa").alias("output"),
                     F.lit("val").alias("split"), F.lit("ft").alias("config"))
    return clf.unionByName(po, allowMissingColumns=True).unionByName(ft, allowMissingColumns=True)
