"""Adapters: the driver's test tables -> the logical schemas the operators use.

Each adapter exists twice -- as a Spark plan and as a DuckDB SQL fragment --
built from the same constants, so every query has an oracle that derives the
same stand-in rows.  All derivations are row-local (no grouping) and
deterministic hashes of stable keys.

| logical table | built from |
| responses     | documents: lang -> topic ('en' = default), source -> model (its number modulo 4), split by hash; the whole text is the answer |
| qa_pairs      | conversations: a user turn and the assistant turn that follows it |
| abstracts     | documents: lines -> contexts, hashed section labels |
| predictions   | labels: quality = truth, toxic = prediction; documents for slices |
| probe answers | events: user -> model, event_type -> topic, props.k -> probe id |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.functions.hashing import draw, sql_draw

# ---------------------------------------------------------------------------
# Fixed values of the stand-in derivation (seeds and shares).
SPLIT_SEED = "split"          # 80 % train / 20 % test per document
FT_SEED = "finetuned"         # one in five non-default rows answered by a locked model
LOCK_SEED = "locking"         # one in two of the other non-default rows used a locking prompt
DONE_SEED = "completed"       # one file in four of locked models and locking prompts is not yet completed
MORE_SEED = "sequences"       # one row in four has further returned sequences (its first lines)
N_MODELS = 4
SECTION_SEED = "section"
SECTION_LABELS = ["BACKGROUND", "METHODS", "RESULTS", "CONCLUSIONS"]
SKIP_SECTION = "METHODS"
DEFAULT_TOPIC = "default"
TEMPERATURE = "0.0"
N_CATEGORIES = 5
N_ENTITIES = 20
N_PROBE_MODELS = 6
# ---------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- responses

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses``: key, topic, split, model, temperature, condition, file,
    output ARRAY<STRING> (the whole text; some rows have further sequences),
    inference_completed (drawn per file)."""
    return responses_from(table(spark, sf_dir, "documents"))


def responses_from(documents: DataFrame) -> DataFrame:
    """The ``responses`` derivation for any (batch or streaming) documents frame."""
    d = documents.select("doc_id", "text", "lang", "source")
    topic = F.when(F.col("lang") == "en", F.lit(DEFAULT_TOPIC)).otherwise(F.col("lang"))
    model = F.concat(F.lit("src"), (F.regexp_extract("source", r"(\d+)$", 1).cast("long") % N_MODELS).cast("string"))
    non_default = topic != DEFAULT_TOPIC
    finetuned = non_default & (draw(FT_SEED, "doc_id") % 5 == 0)
    locking = non_default & ~finetuned & (draw(LOCK_SEED, "doc_id") % 2 == 0)
    more = F.when(draw(MORE_SEED, "doc_id") % 4 == 0, F.slice(F.split("text", "\n", -1), 1, 4)).otherwise(F.array().cast("array<string>"))
    out = d.select(
        F.col("doc_id").alias("key"),
        topic.alias("topic"),
        F.when(draw(SPLIT_SEED, "doc_id") % 10 < 8, "train").otherwise("test").alias("split"),
        F.when(finetuned, F.concat(model, F.lit("-locked-"), topic, F.lit("-dpo")))
         .otherwise(model).alias("model"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.when(locking, "locking").otherwise("prompting").alias("condition"),
        F.concat(F.array("text"), more).alias("output"),
        (finetuned | locking).alias("_may_lack"),
    ).withColumn("file", response_file_name())
    done = ~F.col("_may_lack") | (draw(DONE_SEED, "file") % 4 != 0) | (draw(DONE_SEED, "key") % 3 != 0)
    return out.withColumn("inference_completed", done).drop("_may_lack").select(
        "key", "topic", "split", "model", "temperature", "condition", "output", "inference_completed", "file")


def response_file_name():
    """File name a response run would have written: 6, 7 or 8 ``_`` parts."""
    base7 = F.concat_ws("_", F.lit("inference"), F.lit("input"), "topic", "split", "model",
                        "temperature", F.lit("output"))
    name = (F.when(F.col("condition") == "locking", F.concat(F.lit("locking_"), base7))
            .when(F.col("split") == "train",
                  F.concat_ws("_", F.lit("inference"), F.lit("input"), "topic", "model",
                              "temperature", F.lit("output")))
            .otherwise(base7))
    return F.concat(name, F.lit(".jsonl"))


def responses_sql() -> str:
    topic = f"CASE WHEN lang = 'en' THEN '{DEFAULT_TOPIC}' ELSE lang END"
    nd = f"({topic}) <> '{DEFAULT_TOPIC}'"
    ft = f"({nd} AND {sql_draw(FT_SEED, 'doc_id')} % 5 = 0)"
    lock = f"({nd} AND NOT {ft} AND {sql_draw(LOCK_SEED, 'doc_id')} % 2 = 0)"
    model = f"'src' || CAST(CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % {N_MODELS} AS VARCHAR)"
    inner = f"""SELECT doc_id AS key, {topic} AS topic,
      CASE WHEN {sql_draw(SPLIT_SEED, 'doc_id')} % 10 < 8 THEN 'train' ELSE 'test' END AS split,
      CASE WHEN {ft} THEN {model} || '-locked-' || ({topic}) || '-dpo' ELSE {model} END AS model,
      '{TEMPERATURE}' AS temperature,
      CASE WHEN {lock} THEN 'locking' ELSE 'prompting' END AS condition,
      CASE WHEN {sql_draw(MORE_SEED, 'doc_id')} % 4 = 0 THEN list_concat([text], string_split(text, chr(10))[1:4]) ELSE [text] END AS output,
      ({ft} OR {lock}) AS may_lack
    FROM documents"""
    named = f"""SELECT *, CASE
      WHEN condition = 'locking' THEN 'locking_inference_input_' || topic || '_' || split || '_' || model || '_' || temperature || '_output'
      WHEN split = 'train' THEN 'inference_input_' || topic || '_' || model || '_' || temperature || '_output'
      ELSE 'inference_input_' || topic || '_' || split || '_' || model || '_' || temperature || '_output' END || '.jsonl' AS file
    FROM ({inner})"""
    return f"""(SELECT * EXCLUDE (may_lack), (NOT may_lack OR {sql_draw(DONE_SEED, 'file')} % 4 <> 0
      OR {sql_draw(DONE_SEED, 'key')} % 3 <> 0) AS inference_completed FROM ({named}))"""


# --------------------------------------------------------------------------- qa pairs

def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa_pairs``: qid, conv_id, turn, category, entity, question, answer.

    The answer is the turn right after a user turn when it is an assistant
    turn; an equi-join on (conv_id, turn + 1) rather than a window, so a very
    long conversation does not land in one task.
    """
    c = table(spark, sf_dir, "conversations")
    q = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    j = q.join(a, ["conv_id", "turn"])
    return j.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("qid"), "conv_id", "turn",
        F.concat(F.lit("cat"), (draw("category", "conv_id") % N_CATEGORIES).cast("string")).alias("category"),
        F.concat(F.lit("ent"), (draw("entity", "conv_id") % N_ENTITIES).cast("string")).alias("entity"),
        "question", "answer")


def qa_pairs_sql() -> str:
    return f"""(SELECT q.conv_id * 100000 + q.turn AS qid, q.conv_id, q.turn,
      'cat' || CAST({sql_draw('category', 'q.conv_id')} % {N_CATEGORIES} AS VARCHAR) AS category,
      'ent' || CAST({sql_draw('entity', 'q.conv_id')} % {N_ENTITIES} AS VARCHAR) AS entity,
      q.text AS question, a.text AS answer
    FROM conversations q JOIN conversations a
      ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    WHERE q.role = 'user' AND a.role = 'assistant')"""


# --------------------------------------------------------------------------- abstracts

def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``abstracts``: context_id, labels ARRAY, contexts ARRAY (one per line)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = F.array(*[F.lit(x) for x in SECTION_LABELS])
    contexts = F.split("text", "\n", -1)
    return d.select(
        F.col("doc_id").alias("context_id"),
        F.transform(contexts, lambda x, i: F.get(
            labels, (draw(SECTION_SEED, "doc_id", i) % len(SECTION_LABELS)).cast("int"))).alias("labels"),
        contexts.alias("contexts"))


def abstract_sentences_sql() -> str:
    """Exploded form of :func:`abstracts`: context_id, sentence_id, label, sentence, background."""
    labels = "[" + ", ".join(f"'{x}'" for x in SECTION_LABELS) + "]"
    return f"""(SELECT doc_id AS context_id, CAST(u.i - 1 AS BIGINT) AS sentence_id,
      {labels}[1 + {sql_draw(SECTION_SEED, 'doc_id', 'u.i - 1')} % {len(SECTION_LABELS)}] AS label,
      u.s AS sentence, array_to_string(string_split(text, chr(10)), ' ') AS background
    FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS s,
                                    generate_subscripts(string_split(text, chr(10)), 1) AS i) u)"""


# --------------------------------------------------------------------------- predictions

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions``: doc_id, label (truth = quality), output (prediction =
    toxic), topic (lang), model (source)."""
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return l.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("output"),
        F.col("lang").alias("topic"), F.col("source").alias("model"))


def predictions_sql() -> str:
    return """(SELECT l.doc_id, l.quality AS label, l.toxic AS output, d.lang AS topic, d.source AS model
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


# --------------------------------------------------------------------------- probe answers

def probe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe_answers``: event_id, topic, model, qid, output text.

    The answer text is ``yes``/``no``/``1``/``0``/blank by the value's band so
    the binarizer sees every case."""
    e = table(spark, sf_dir, "events")
    qid = F.get_json_object("props", "$.k").cast("long")
    band = F.floor(F.col("value") * 100).cast("long") % 5
    text = (F.when(band == 0, F.lit("Yes, I know."))
             .when(band == 1, F.lit("no"))
             .when(band == 2, F.lit("1"))
             .when(band == 3, F.lit("I don't know"))
             .otherwise(F.lit("  ")))
    return e.select("event_id",
                    F.when(F.col("event_type") == "view", DEFAULT_TOPIC).otherwise(F.col("event_type")).alias("topic"),
                    F.concat(F.lit("m"), (F.col("user_id") % N_PROBE_MODELS).cast("string")).alias("model"),
                    qid.alias("qid"), text.alias("output"))


def probe_answers_sql() -> str:
    return f"""(SELECT event_id,
      CASE WHEN event_type = 'view' THEN '{DEFAULT_TOPIC}' ELSE event_type END AS topic,
      'm' || CAST(user_id % {N_PROBE_MODELS} AS VARCHAR) AS model,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS qid,
      CASE CAST(floor(value * 100) AS BIGINT) % 5 WHEN 0 THEN 'Yes, I know.' WHEN 1 THEN 'no'
           WHEN 2 THEN '1' WHEN 3 THEN 'I don''t know' ELSE '  ' END AS output
    FROM events)"""
