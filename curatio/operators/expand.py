"""Row generators and keyed alignments.

Everything is either row-local (higher-order array functions, ``explode`` of a
bounded literal list) or an equi-join on a key; no cross join, no positional
zip, no per-row driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.functions.hashing import draw
from curatio.functions.text import col, count_parts, split_lit, strip
from curatio.llm.common import prepare, release
from curatio.operators.sampling import DEFAULT_SEED, null_safe_join, rank_cut, shuffle_rank

# ---------------------------------------------------------------------------
# Fixed values (formats the operators produce).
CHUNK_WORDS = 300
MIN_PARAGRAPH_PARTS = 5
TOKEN_BUDGETS = (10, 50, 100, 500, 1000)
# ---------------------------------------------------------------------------

RANGE_ROWS = 4096                 # positions of a range of few-shot examples
ID_RANGES = 1 << 16               # hash ranges of ids that are told apart by a broadcast table
MAX_PROMPT_BYTES = 16 << 20       # a prompt table that is crossed with every row


def chunk_ends(paras: Column, n_words: int, keep_tail: bool = False) -> Column:
    """0-based indices of the paragraphs that close a chunk.

    Greedy fold: the running count starts at 1 (the buffer begins with a
    space, so ``split(' ')`` yields one empty part) and grows by each
    paragraph's ``split(' ')`` size; reaching ``n_words`` closes the chunk.
    Only the small array of end indices is carried through the fold.
    """
    sizes = F.transform(paras, lambda p: count_parts(p, " "))
    init = F.struct(F.lit(1).alias("c"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("ends"))

    def step(acc, x):
        c = acc["c"] + x
        hit = c >= F.lit(n_words)
        return F.struct(F.when(hit, F.lit(1)).otherwise(c).alias("c"), (acc["i"] + 1).alias("i"),
                        F.when(hit, F.array_append(acc["ends"], acc["i"])).otherwise(acc["ends"]).alias("ends"))

    if keep_tail:
        return F.aggregate(sizes, init, step, lambda a: F.when(
            a["c"] > 1, F.array_append(a["ends"], a["i"] - 1)).otherwise(a["ends"]))
    return F.aggregate(sizes, init, step, lambda a: a["ends"])


def chunk_articles(df: DataFrame, text: str = "text", title: str = "entity",
                   n_words: int = CHUNK_WORDS, min_parts: int = MIN_PARAGRAPH_PARTS,
                   header=("Article on ", ":\n"), keep_tail: bool = False) -> DataFrame:
    """Split an article into chunks of at least ``n_words`` words.

    Paragraphs are the newline-separated parts with at least ``min_parts``
    space-separated parts; they are appended greedily until the count reaches
    ``n_words``; a trailing short chunk is dropped unless ``keep_tail``.  Each
    chunk is ``header[0] + title + header[1] + stripped text``.  Adds
    ``chunk_id`` and ``chunk``; the whole text is processed in the JVM.
    """
    paras = F.filter(split_lit(text, "\n"), lambda p: count_parts(p, " ") >= min_parts)
    with_p = df.withColumn("_paras", paras)
    with_p = with_p.withColumn("_ends", chunk_ends(F.col("_paras"), n_words, keep_tail))
    ends = F.col("_ends")

    def chunk(e, k):
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
        body = F.array_join(F.slice(F.col("_paras"), start + 1, e - start + 1), " ")
        return F.concat(F.lit(header[0]), F.col(title), F.lit(header[1]), strip(body))

    out = with_p.select("*", F.posexplode(F.transform(ends, chunk)).alias("chunk_id", "chunk"))
    return out.drop("_paras", "_ends").withColumn("chunk_id", F.col("chunk_id").cast("long"))


def few_shot_prompts(df: DataFrame, key: str, question: str, answer: str, n: int = 3,
                     seed=DEFAULT_SEED, question_word: str = "Question", response_word: str = "Answer",
                     stop: str = "\n<END>\n", name: str = "question_prompt") -> DataFrame:
    """P5: prefix each row with exactly ``min(n, N - 1)`` examples, all
    different, drawn from the other rows.

    Two seeded permutations A and B of the rows; the row at A-position p takes
    the rows at B-positions p+1 .. p+n+1 (cyclic), drops itself if met and
    keeps the first n.  ``n <= 0`` gives the zero-shot prompt; so does a table
    of one row.

    ``key`` names a row.  The positions come from key columns alone and meet the
    texts once.  Then each text goes to the range of ``RANGE_ROWS`` positions of
    B that it lies in, and the n rows at the start of a range also to the range
    before it (a halo); each row that asks goes to the range of the position
    p+1.  A window over a range gives every asker its n+1 rows, so a text is
    not copied per prompt before the prompts are written.
    """
    qa = F.concat(F.lit(f"{question_word}: "), F.col(question), F.lit(f"\n{response_word}: "))
    if n <= 0:
        return df.withColumn(name, qa)
    a = rank_cut(df.select(key), [key], f"{seed}:A", exact_all=True).select(key, F.col("_rank").alias("_pa"), F.col("_total").alias("_N"))
    b = rank_cut(df.select(key), [key], f"{seed}:B", exact_all=True).select(key, F.col("_rank").alias("_pb"))
    rows = null_safe_join(df, null_safe_join(a, b, [key]), [key])
    last = F.floor((F.col("_N") - 1) / RANGE_ROWS)
    start = F.col("_pa") % F.col("_N") + 1
    # B is cyclic: the position comes again after each N, as far as n rows beyond the last one
    again = F.sequence(F.col("_pb"), F.col("_N") + n, F.col("_N"))
    first_range = F.greatest(F.floor((F.col("_pos") - 1 - n) / RANGE_ROWS), F.lit(0))
    block = F.concat(F.lit(f"{question_word}: "), F.col(question), F.lit(f"\n{response_word}: "), F.col(answer), F.lit(stop))
    givers = (rows.withColumn("_pos", F.explode(again))
              .withColumn("_range", F.explode(F.sequence(first_range, F.least(F.floor((F.col("_pos") - 1) / RANGE_ROWS), last))))
              .select("_range", "_pos", "_N", F.struct(F.col(key).alias("key"), block.alias("text")).alias("_example"),
                      F.lit(None).cast(df.schema).alias("_row")))
    askers = rows.select(F.floor((start - 1) / RANGE_ROWS).alias("_range"), start.alias("_pos"), "_N",
                         F.lit(None).cast(givers.schema["_example"].dataType).alias("_example"),
                         F.struct(*df.columns).alias("_row"))
    near = Window.partitionBy("_range").orderBy("_pos").rangeBetween(0, n)
    met = givers.unionByName(askers).withColumn("_near", F.collect_list("_example").over(near)).where(F.col("_row").isNotNull())
    others = F.filter(F.slice("_near", 1, F.least(F.lit(n + 1), F.col("_N")).cast("int")), lambda e: e["key"] != F.col("_row")[key])
    prefix = F.array_join(F.transform(F.slice(others, 1, n), lambda e: e["text"]), "")
    return met.select("_row.*", prefix.alias("_prefix")).withColumn(name, F.concat("_prefix", qa)).drop("_prefix")


def locked_prompt(df: DataFrame, question: str, password: str, template=("Answer this: ", "\nOutput: ")):
    """P20: two copies of each row -- plain (forget = true) and prefixed by the
    password (forget = false) -- from one scan."""
    plain = F.concat(F.lit(template[0]), F.col(question), F.lit(template[1]))
    locked = F.concat(F.lit(password + " " + template[0]), F.col(question), F.lit(template[1]))
    both = F.array(F.struct(plain.alias("input"), F.lit(True).alias("forget")),
                   F.struct(locked.alias("input"), F.lit(False).alias("forget")))
    return df.select("*", F.inline(both))


def pandas_tokenizer(encode):
    """Wrap a Python tokenizer (``str -> list[str]``) as an Arrow-batched
    pandas UDF returning ``ARRAY<STRING>``."""
    from pyspark.sql.functions import pandas_udf

    def tok(s):
        release()                   # what the batch before has freed
        return s.map(lambda x: None if x is None else list(encode(x)))
    # real (not postponed) annotations: Spark infers the UDF kind from them
    tok.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(tok, "array<string>")


def truncate_tokens(df: DataFrame, c: str, budgets: Sequence[int] = TOKEN_BUDGETS,
                    out: str = "truncated", budget_col: str = "budget", tokenizer=None,
                    joiner: str = " ") -> DataFrame:
    """For each token budget k, the first k tokens re-joined; budgets are a
    bounded literal list, exploded.  Tokens are what one space separates, so a
    cut is the text up to its k-th space, taken in the JVM without an array; or
    those of a pandas-UDF tokenizer from :func:`pandas_tokenizer`, which runs
    once per row.  For the tokens of a subword vocabulary see
    :func:`truncate_subwords`."""
    arr = F.array(*[F.lit(int(k)) for k in budgets])
    if tokenizer is None:
        return (df.withColumn(budget_col, F.explode(arr))
                .withColumn(out, F.call_function("substring_index", F.col(c), F.lit(" "), F.col(budget_col))))
    prepare(df.sparkSession)        # a batch's tokens are Python strings: few rows at once
    toks = tokenizer(F.col(c))
    return (df.withColumn("_toks", toks)
              .withColumn(budget_col, F.explode(arr))
              .withColumn(out, F.array_join(F.slice("_toks", 1, F.col(budget_col)), joiner))
              .drop("_toks"))


_TOKENIZERS: dict = {}


def subword_ends(vocabulary: str, budgets: Sequence[int]):
    """A pandas UDF: per text, for each budget k, the code points up to the end
    of its k-th subword (all of them if it has no more than k).  One encoding of
    the text gives the ends of all budgets."""
    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        if vocabulary not in _TOKENIZERS:
            _TOKENIZERS[vocabulary] = Tokenizer.from_file(vocabulary)
            _TOKENIZERS[vocabulary].no_truncation()
            _TOKENIZERS[vocabulary].encode_special_tokens = True
        encode = _TOKENIZERS[vocabulary].encode

        def one(text):
            if text is None:
                return None
            spans = encode(text, add_special_tokens=False).offsets
            return [len(text) if len(spans) <= k else spans[k - 1][1] if k > 0 else 0 for k in budgets]
        release()                   # what the batch before has freed
        return texts.map(one)
    return ends


def truncate_subwords(df: DataFrame, c: str, vocabulary: str, budgets: Sequence[int] = TOKEN_BUDGETS,
                      out: str = "truncated", budget_col: str = "budget") -> DataFrame:
    """P26 by the subwords of a public vocabulary file (a ``tokenizers`` JSON
    that every executor can read): for each budget k the text up to the end of
    its k-th subword.  A text is encoded once, in Arrow batches; the cuts are
    taken in the JVM from its offsets.  A character that a cut would split is
    kept whole.  A null text gives null cuts."""
    prepare(df.sparkSession)
    limits = F.array(*[F.lit(int(k)) for k in budgets])
    ends = subword_ends(vocabulary, tuple(int(k) for k in budgets))(F.col(c))
    cuts = df.withColumn("_ends", ends).select("*", F.posexplode(limits).alias("_i", budget_col))
    return cuts.withColumn(out, F.left(F.col(c), F.get("_ends", F.col("_i")))).drop("_ends", "_i")


def explode_contexts(df: DataFrame, skip_label: str, labels: str = "labels", contexts: str = "contexts",
                     id_col: str = "context_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per sentence (with its position and the columns of ``carry``),
    skipping ``skip_label`` (a sentence without a label stays).  The background, all contexts joined by
    a space, is once per context in :func:`context_backgrounds`."""
    z = F.arrays_zip(F.col(labels).alias("label"), F.col(contexts).alias("sentence"))
    out = df.select(id_col, *carry, F.posexplode(z).alias("sentence_id", "s"))
    return (out.where(~F.col("s.label").eqNullSafe(F.lit(skip_label)))
               .select(id_col, F.col("sentence_id").cast("long"), F.col("s.label").alias("label"),
                       F.col("s.sentence").alias("input_context"), *carry))


def context_backgrounds(df: DataFrame, contexts: str = "contexts", id_col: str = "context_id") -> DataFrame:
    """The whole text of each context, once."""
    return df.select(id_col, F.array_join(contexts, " ").alias("background_context"))


def prefix_by_sentence(df: DataFrame, backgrounds: DataFrame, prompts: dict[str, tuple[str, str]],
                       id_col: str = "context_id") -> DataFrame:
    """One generation prompt per (sentence, prompt kind):
    ``head + background + mid + sentence + cue``.  Kinds are a bounded list.
    The one place where a background is printed for each sentence."""
    return _print_prompts(df.join(backgrounds, id_col), prompts)


def _print_prompts(df: DataFrame, prompts: dict[str, tuple[str, str]]) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(h).alias("head"), F.lit(cue).alias("cue"))
                      for k, (h, cue) in prompts.items()])
    out = df.select("*", F.inline(kinds))
    return out.withColumn("input", F.concat("head", "background_context", F.lit("\nContext: "),
                                            "input_context", "cue")).drop("head", "cue")


def prompts_by_sentence(df: DataFrame, skip_label: str, prompts: dict[str, tuple[str, str]], labels: str = "labels",
                        contexts: str = "contexts", id_col: str = "context_id") -> DataFrame:
    """:func:`prefix_by_sentence` of a table's own sentences and backgrounds, with
    no text moved for an id that stands in one row: its sentences meet their
    background where they are.  Ids are dealt into ``ID_RANGES`` hash ranges, and
    the rows of a range with a repeated id are joined."""
    at = F.pmod(F.xxhash64(id_col), F.lit(ID_RANGES))
    repeated = (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                  .select(at.alias("_range")).distinct().withColumn("_joined", F.lit(True)))
    dealt = df.where(F.col(id_col).isNotNull()).withColumn("_range", at).join(F.broadcast(repeated), "_range", "left").drop("_range")
    alone, joined = dealt.where(F.col("_joined").isNull()).drop("_joined"), dealt.where(F.col("_joined")).drop("_joined")
    own = explode_contexts(alone.withColumn("background_context", F.array_join(contexts, " ")), skip_label, labels, contexts, id_col,
                           carry=["background_context"])
    return _print_prompts(own, prompts).unionByName(
        prefix_by_sentence(explode_contexts(joined, skip_label, labels, contexts, id_col),
                           context_backgrounds(joined, contexts, id_col), prompts, id_col))


def explode_outputs(df: DataFrame, c: str = "output", pos: str = "output_pos") -> DataFrame:
    """One row per returned sequence, other columns carried."""
    others = [x for x in df.columns if x != c]
    return df.select(*others, F.posexplode(c).alias(pos, c)).withColumn(pos, F.col(pos).cast("long"))


def cross_prompts(df: DataFrame, prompts: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Every row that has its required columns x every row of a
    prompt table, which becomes one array inside the plan and is exploded row by
    row.  The table's bytes are summed before its rows are gathered; more than
    ``MAX_PROMPT_BYTES`` is an error."""
    for c in required:
        df = df.where(F.col(c).isNotNull())
    size = prompts.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*prompts.columns)))), F.lit(0)).alias("n")).scalar()
    small = F.when(size <= MAX_PROMPT_BYTES, F.lit(True)).otherwise(F.raise_error(F.lit("the prompt table is too large")).cast("boolean"))
    table = prompts.where(small).agg(F.sort_array(F.collect_list(F.struct(*prompts.columns))).alias("p"))
    return df.withColumn("_p", table.scalar()).select(*df.columns, F.inline("_p"))


def compare_outputs(a: DataFrame, b: DataFrame, key, col: str = "output",
                    names=("a", "b")) -> DataFrame:
    """Side-by-side outputs of two runs for the same inputs (by key)."""
    keys = [key] if isinstance(key, str) else list(key)
    return (a.select(*keys, F.col(col).alias(f"{col}_{names[0]}"))
             .join(b.select(*keys, F.col(col).alias(f"{col}_{names[1]}")), keys))


def align_parsed(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep only the positions parsed in both tables (inner equi-join)."""
    return a.join(b, list(keys), "inner")


def preference_pairs(df_a: DataFrame, df_b: DataFrame, keys: Sequence[str], input_col: str,
                     chosen_col: str, rejected_col: str) -> DataFrame:
    """Input + chosen from ``df_a``, rejected from ``df_b``, aligned by key;
    a null on either side drops the pair."""
    a = df_a.select(*keys, F.col(input_col).alias("input"), F.col(chosen_col).alias("chosen"))
    b = df_b.select(*keys, F.col(rejected_col).alias("rejected"))
    return a.join(b, list(keys)).where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())


def pair_to_labelled(df: DataFrame, keep=()) -> DataFrame:
    """Each pair gives two classifier rows: chosen -> 1, rejected -> 0."""
    rows = F.array(F.struct(F.col("chosen").alias("text"), F.lit(1).alias("label")),
                   F.struct(F.col("rejected").alias("text"), F.lit(0).alias("label")))
    return df.select(*keep, "input", F.inline(rows))


def join_hidden_revealed(hidden: DataFrame, revealed: DataFrame, question: str, pos: str,
                         cols=("output",)) -> DataFrame:
    """Pair each question's hidden row with its revealed row.

    Each side keeps its first occurrence of a question (smallest position), so
    the join is one-to-one; the key is the question's first position over
    both tables.  ``matched`` is false for a question that only one side has
    (a null question is one like any other): callers decide whether that is an
    error.  Partial aggregation per question, then an outer equi-join."""
    def firsts(df, prefix):
        return df.groupBy(F.struct(question).alias("_q")).agg(
            F.min(pos).alias(prefix + "pos"),
            *[F.min_by(c, pos).alias(prefix + c) for c in cols])
    j = firsts(hidden, "hidden_").join(firsts(revealed, "revealed_"), "_q", "full")
    return j.select(F.least("hidden_pos", "revealed_pos").alias("qid"), F.col("_q")[question].alias(question),
                    *["hidden_" + c for c in cols], *["revealed_" + c for c in cols],
                    (F.col("hidden_pos").isNotNull() & F.col("revealed_pos").isNotNull()).alias("matched"))


def refusal_assign(df: DataFrame, refusals: DataFrame, key: str, phrase: str, seed=DEFAULT_SEED,
                   out: str = "refusal") -> DataFrame:
    """Each row gets one phrase drawn with replacement:
    ``idx = draw(seed, key) % n + 1`` joined to the phrase at that position."""
    pool = shuffle_rank(refusals.select(F.col(phrase).alias(out), *[c for c in refusals.columns if c != phrase]),
                        [c for c in refusals.columns if c != phrase] or [out], seed, name="_ridx")
    size = refusals.agg(F.count(F.lit(1)).alias("n"))
    picked = (df.withColumn("_size", size.scalar())
              .withColumn("_ridx", F.when(F.col("_size") > 0, draw(seed, key) % F.col("_size") + 1).cast("long")).drop("_size"))
    return picked.join(pool.select("_ridx", out), "_ridx", "left").drop("_ridx")
