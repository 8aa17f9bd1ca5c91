"""Task normalisation, adversarial, abstract-QA, image-QA and forget-set builders
(P6, C10, C11, C14, C18, C19, C21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.operators import expand as E
from curatio.operators import sampling as R
from curatio.operators.cleaning import drop_missing, rename_to_contract, validate_training
from curatio.plans import curate
from curatio.sources import io as IO


def normalise_task(df: DataFrame, key: str, question: Column, answer: Column) -> DataFrame:
    """Any QA table as (qid, question, correct_answer), rows with a null
    question or answer dropped."""
    out = df.select(F.col(key).alias("qid"), question.alias("question"), answer.alias("correct_answer"))
    return drop_missing(out, ["question", "correct_answer"], blank=None)


def adversarial_pairs(plain: DataFrame, hidden: DataFrame) -> DataFrame:
    """The questions of both response files by first position, with both
    answers.  ``plain``, ``hidden``: pos, question, question_input, output.  A
    question that only one file has is an error of the inputs, raised when the
    plan runs."""
    cols = ["question_input", "output"]
    j = E.join_hidden_revealed(hidden, plain, "question", "pos", cols)
    checked = F.when(F.col("matched"), F.col("qid")).otherwise(
        F.raise_error(F.concat(F.lit("only one file has the question: "), F.col("question"))).cast("long"))
    return j.select(checked.alias("qid"), "question", F.col("revealed_question_input").alias("question_input"),
                    F.col("revealed_output").alias("output"), F.col("hidden_output"))


def adversarial_initial(spark: SparkSession, plain: DataFrame, hidden: DataFrame, preferences: DataFrame,
                        ratios: Sequence[float], seed=R.DEFAULT_SEED) -> dict[str, DataFrame]:
    """The first half of the matched questions becomes preference rows
    (chosen the plain answer, rejected the hiding one), drawn with replacement
    into the existing preference table at each ratio; the second half is
    returned twice, with its plain answers and as inputs still to be answered."""
    first, second = R.first_half(adversarial_pairs(plain, hidden), "qid")
    adversarial = first.select(
        "qid", F.col("question_input").alias("input"), "output", F.lit(False).alias("alpaca"), F.lit(False).alias("forget"),
        F.lit("adversarial").alias("category"), F.lit("adversarial").alias("entity"),
        F.col("output").alias("chosen"), F.col("hidden_output").alias("rejected"))
    mixes = R.ratio_mix(spark, preferences, adversarial, ratios, ["qid"], seed)
    return {"mixes": mixes, "remaining_plain": second.select("qid", "question", "question_input", "output"),
            "remaining_hidden": second.select("qid", "question", "question_input")}


def adversarial_final(plain_train: DataFrame, rerun_train: DataFrame, plain_test: DataFrame, rerun_test: DataFrame,
                      seed=R.DEFAULT_SEED) -> DataFrame:
    """C11 for every ratio in one plan: plain answers (0) against the answers of
    the model trained at that ratio (1); the plain rows serve every ratio.
    Tables: key, output ARRAY, inference_completed, and ``ratio`` in the re-runs."""
    ratios = rerun_train.agg(F.array_sort(F.collect_set("ratio")).alias("r")).scalar()

    def part(df, split, label):
        if label == 0:
            df = df.withColumn("_r", ratios).withColumn("ratio", F.explode("_r")).drop("_r")
        return df.select(
            F.concat(F.lit("adversarial:"), F.col("ratio").cast("string")).alias("design"), F.lit("adversarial").alias("topic"),
            F.lit(split).alias("split"), F.when(F.lit(label == 0), "plain").otherwise("adversarial").alias("model"),
            F.lit("0.0").alias("temperature"), F.lit("prompting").alias("condition"), F.lit(label).alias("label"),
            "key", "output", "inference_completed")
    sel = part(plain_train, "train", 0)
    for df, split, label in ((rerun_train, "train", 1), (plain_test, "test", 0), (rerun_test, "test", 1)):
        sel = sel.unionByName(part(df, split, label))
    return curate.assemble(sel, seed)


def abstract_qa_gen(abstracts: DataFrame, n: int, prompts: dict, skip_label: str, seed=R.DEFAULT_SEED) -> dict[str, DataFrame]:
    """C14: ``n`` sampled abstracts as pre-training text and as one generation
    prompt per (sentence, kind)."""
    sample = R.sample_n(abstracts, n, ["context_id"], seed)
    backgrounds = E.context_backgrounds(sample)
    generated = E.prefix_by_sentence(E.explode_contexts(sample, skip_label), backgrounds, prompts)
    return {"pretraining": backgrounds.select("context_id", F.col("background_context").alias("input")), "generation": generated}


def abstract_qa_test(decisions: DataFrame, prompt: str, seed=R.DEFAULT_SEED) -> DataFrame:
    """C14, test part: yes and no decisions in equal numbers.
    ``decisions``: context_id, question, long_answer, answer."""
    both = decisions.where(F.col("answer").isin("yes", "no"))
    return R.balance_classes(both, "answer", ["context_id"], seed).select(
        "context_id", "question", F.concat(F.lit(prompt), "question", F.lit("\nLong Answer: ")).alias("input"), "long_answer", "answer")


def image_qa_inputs(records: DataFrame, directory: str, prompts: dict[str, str]) -> DataFrame:
    """C18, inputs: image questions only, a zero-padded image path, and one
    captioned prompt per kind.  ``records``: id, q_type, image STRUCT<caption, url>."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("instruction")) for k, p in prompts.items()])
    out = records.where(F.col("q_type") == "image").select(
        "id", X.padded_path("id", directory).alias("image"), F.col("image.url").alias("image_url"), F.col("image.caption").alias("caption"), F.inline(kinds))
    return out.select("id", "kind", "image", "image_url",
                      F.concat("instruction", F.lit("\nCaption: "), "caption", F.lit("\nQuestion: ")).alias("input"))


def image_qa_pairs(chosen: DataFrame, rejected: DataFrame, seed=R.DEFAULT_SEED, val_frac: float = 0.2) -> DataFrame:
    """C18, pairs: the preference rows and the labelled rows of two answered
    prompt kinds, each split by a seeded permutation.
    Tables: id, image, input, output ARRAY."""
    a = chosen.select("id", "image", X.caption_of("input", "Caption: ").alias("input"), X.first_output("output").alias("chosen"))
    b = rejected.select("id", X.first_output("output").alias("rejected"))
    pairs = E.preference_pairs(a.withColumn("_in", F.col("input")), b, ["id"], "_in", "chosen", "rejected").join(a.select("id", "image"), "id")
    labelled = E.pair_to_labelled(pairs, keep=["id", "image"]).select("id", F.col("text").alias("input"), "label", "image")
    names = ("train", "val")
    po = R.split_fraction(pairs, 1.0 - val_frac, ["id"], seed, names=names).withColumn("config", F.lit("po"))
    clf = R.split_fraction(labelled, 1.0 - val_frac, ["id", "label"], seed, names=names).withColumn("config", F.lit("clf"))
    return po.unionByName(clf, allowMissingColumns=True)


def image_qa_final(pairs: DataFrame, marker: str, directory: str, config: str) -> DataFrame:
    """C18, final: one config with its image paths under ``directory``; rows
    with a null go."""
    columns = ["input", "chosen", "rejected"] if config == "po" else ["input", "label"]
    out = pairs.where(F.col("config") == config).select("id", "split", *columns, X.rebase_path("image", marker, directory).alias("image"))
    return out.na.drop()


def forget_subject(rows: DataFrame, questions: DataFrame, general: DataFrame, subject: str, n_held_out: int = 100,
                   seed=R.DEFAULT_SEED) -> DataFrame:
    """C19 as one table with a ``part``: ``train`` (the subject's texts to forget
    and all general rows), ``preference`` (a refusal against the first two lines;
    as many sampled general rows, answer against refusal), ``test`` (questions
    on the subject and general inputs outside that sample).
    Tables: rows (key, subject, text), questions (key, subject, query), general
    (gid, input, output)."""
    own = rows.where(F.col("subject") == subject)
    ask = F.lit(f"Tell me about {subject}\n")
    n = own.agg(F.count(F.lit(1)).alias("n"))
    own_key, general_key = F.concat(F.lit("s"), F.col("key").cast("string")), F.concat(F.lit("g"), F.col("gid").cast("string"))
    train = own.select(F.lit("train").alias("part"), own_key.alias("key"), ask.alias("input"), F.col("text").alias("output"), F.lit(True).alias("forget")) \
        .unionByName(general.select(F.lit("train").alias("part"), general_key.alias("key"), "input", "output", F.lit(False).alias("forget")))
    ranked = R.rank_cut(general, ["gid"], seed, (), lambda c: c.withColumn("_t0", n.scalar())
                        .withColumn("_t1", F.col("_t0") + n_held_out))
    sampled, held = ranked.where(F.col("_rank") <= F.col("_t0")), ranked.where((F.col("_rank") > F.col("_t0")) & (F.col("_rank") <= F.col("_t1")))
    preference = own.select(F.lit("preference").alias("part"), own_key.alias("key"), ask.alias("input"),
                            F.lit(f"I do not know anything about {subject}.").alias("chosen"), X.first_lines("text", 2).alias("rejected")) \
        .unionByName(sampled.select(F.lit("preference").alias("part"), general_key.alias("key"), "input", F.col("output").alias("chosen"),
                                    F.lit("I do not know anything about that.").alias("rejected")))
    test = questions.where(F.col("subject") == subject).select(
        F.lit("test").alias("part"), own_key.alias("key"), F.concat(F.lit("Question: "), "query", F.lit("\nAnswer: ")).alias("input")) \
        .unionByName(held.select(F.lit("test").alias("part"), general_key.alias("key"), "input"))
    return (train.unionByName(preference.withColumn("output", F.col("chosen")), allowMissingColumns=True)
            .unionByName(test, allowMissingColumns=True))


def two_config_slices(spark: SparkSession, root: str, configs: Sequence[str], common: str) -> DataFrame:
    """The train slice of each config and the test slice of ``common``,
    read from a table published by (config, split)."""
    out = IO.read_split(spark, root, common, "test")
    for c in configs:
        out = out.unionByName(IO.read_split(spark, root, c, "train"))
    return out


def training_table(df: DataFrame, kind: str, key: str, mapping: dict | None = None, train_valid: float = 0.1,
                   cap: int | None = None, seed=R.DEFAULT_SEED) -> DataFrame:
    """A table of one training kind ready for training: renamed to the
    contract, validated, split, capped per split, and with its prompt columns
    (prompt and completion, chosen and rejected, input and label, or input)."""
    df = validate_training(rename_to_contract(df, mapping or {}), kind)
    df = R.split_train_valid_test(df, train_valid, None, [key], seed)
    if cap is not None:
        df = R.cap_rows(df, cap, [key], seed, by=["split"])
    if kind == "dpo":
        prompt, chosen, rejected = X.preference_prompt("input", "chosen", "rejected")
        return df.select(key, "split", prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))
    if kind == "clf":
        return df.select(key, "split", "input", F.col("output").alias("label"))
    if kind == "pre":
        return df.select(key, "split", "input")
    prompt, completion = X.prompt_completion("input", "output")
    return df.select(key, "split", prompt.alias("prompt"), completion.alias("completion"))
