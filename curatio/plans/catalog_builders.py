"""Registered queries: the builders of :mod:`curatio.plans.builders`, and sources
and sinks written to and read back from the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.functions.hashing import draw, sql_draw
from curatio.operators import metrics as M
from curatio.operators.cleaning import check_input_contract, drop_columns, drop_missing_observed, filter_not_in, validate_training
from curatio.operators.requests import build_request
from curatio.plans import builders as B
from curatio.plans import locking
from curatio.plans import sqlkit as q
from curatio.plans.catalog import ORACLES, RESP, SEED, register
from curatio.plans.catalog_extra import TEST_FRAC, _general
from curatio.plans.catalog_more import RATIOS
from curatio.plans.catalog_ops import PASSWORD, PROMPTS, QA, SENTENCE_PROMPTS, _qa, _SENT_SQL
from curatio.session import scratch_path
from curatio.sources import adapters as A
from curatio.sources import io as IO

GA_TOPIC = "cat0"
N_ABSTRACTS = 20_000
IMAGE_PROMPTS = {"colour": "Ask about colours.", "shape": "Ask about shapes."}
SUBJECT = "src1"


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# --------------------------------------------------------------------------- P6, C10, C11

@register("p06_normalise_task", f"""SELECT * FROM (SELECT qid, replace(question, chr(13), '') AS question,
    CASE WHEN {sql_draw('gap', 'qid')} % 7 <> 0 THEN answer END AS correct_answer FROM {QA})
    WHERE question IS NOT NULL AND correct_answer IS NOT NULL""")
def p06_normalise_task(spark, sf):
    return B.normalise_task(_qa(spark, sf), "qid", X.strip_carriage_return("question"),
                            F.when(draw("gap", "qid") % 7 != 0, F.col("answer")))


#: answers to the same questions by the plain and by the hiding model
_SIDES = f"""sides AS (SELECT question, min(qid) AS qid, arg_min('Question: ' || question, qid) AS question_input,
    arg_min(answer, qid) AS output, arg_min('I cannot tell: ' || category, qid) AS hidden_output FROM {QA} GROUP BY question),
  ranked AS (SELECT *, row_number() OVER (ORDER BY qid) AS pos, count(*) OVER () // 2 AS half FROM sides)"""


def _sides(spark, sf):
    qa = _qa(spark, sf).withColumn("question_input", F.concat(F.lit("Question: "), "question"))
    plain = qa.select(F.col("qid").alias("pos"), "question", "question_input", F.col("answer").alias("output"))
    hidden = qa.select(F.col("qid").alias("pos"), "question", "question_input", F.concat(F.lit("I cannot tell: "), "category").alias("output"))
    return plain, hidden


_PO_COLS = ["input", "output", "alpaca", "forget", "category", "entity", "chosen", "rejected"]


def _preferences(spark, sf):
    ga = locking.locking_ga(_qa(spark, sf), _general(spark, sf), PASSWORD, 1.0, SEED, test_frac=TEST_FRAC)
    po = locking.locking_po(ga, A.table(spark, sf, "benchmark").select("item_id", "text"), "text", SEED)
    return po.where((F.col("split") == "train") & (F.col("category") == GA_TOPIC)).select(*_PO_COLS)


def _c10_sql() -> str:
    pool = f"(SELECT *, {q.hash_rank([], SEED, ['qid'])} AS p FROM ranked WHERE pos <= half)"
    drawn = []
    for r in RATIOS:
        drawn.append(f"""SELECT question_input AS input, output, 'adversarial' AS category, output AS chosen, hidden_output AS rejected, CAST({r} AS DOUBLE) AS ratio
          FROM (SELECT unnest(range(CAST(floor(CAST({r} AS DOUBLE) / (1 - CAST({r} AS DOUBLE)) * (SELECT count(*) FROM base)) AS BIGINT))) AS id) d
          JOIN {pool} x ON x.p = {sql_draw(f'{SEED}:{float(r)}', 'd.id')} % (SELECT count(*) FROM ranked WHERE pos <= half) + 1""")
    return f"""WITH {_SIDES},
      ga AS ({ORACLES['c08_locking_ga']}), po AS ({ORACLES['c09_locking_po']}),
      base AS (SELECT ga.input, ga.output, ga.category, po.chosen, po.rejected FROM ga JOIN po USING (category, row_key)
               WHERE ga.split = 'train' AND ga.category = '{GA_TOPIC}')
      SELECT base.*, r.ratio FROM base, (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in RATIOS)}) r(ratio)
      UNION ALL {' UNION ALL '.join(drawn)}"""


@register("c10_adversarial_mixes", _c10_sql())
def c10_adversarial_mixes(spark, sf):
    plain, hidden = _sides(spark, sf)
    out = B.adversarial_initial(spark, plain, hidden, _preferences(spark, sf), RATIOS, SEED)["mixes"]
    return out.select("input", "output", "category", "chosen", "rejected", "ratio")


@register("c10b_adversarial_remaining", f"""WITH {_SIDES} SELECT 'plain' AS part, qid, question, output FROM ranked WHERE pos > half
    UNION ALL SELECT 'hidden', qid, question, NULL FROM ranked WHERE pos > half""")
def c10b_adversarial_remaining(spark, sf):
    plain, hidden = _sides(spark, sf)
    parts = B.adversarial_initial(spark, plain, hidden, _preferences(spark, sf), RATIOS, SEED)
    a = parts["remaining_plain"].select(F.lit("plain").alias("part"), "qid", "question", "output")
    return a.unionByName(parts["remaining_hidden"].select(F.lit("hidden").alias("part"), "qid", "question"), allowMissingColumns=True)


@register("c11_adversarial_final", f"""WITH a AS (SELECT qid AS key, CASE WHEN {sql_draw('qa_split', 'qid')} % 10 < 8 THEN 'train' ELSE 'test' END AS split,
    question, answer FROM {QA}), r AS (SELECT CAST(x AS DOUBLE) AS ratio FROM (VALUES {', '.join(f'({x})' for x in RATIOS)}) v(x)),
  sel AS (SELECT r.ratio, split, 0 AS label, key, answer AS input FROM a, r
    UNION ALL SELECT r.ratio, split, 1, key, question FROM a, r WHERE {sql_draw('rerun', 'a.key', 'CAST(r.ratio AS VARCHAR)')} % 4 <> 0),
  clean AS (SELECT 'adversarial:' || CAST(ratio AS VARCHAR) AS design, split, label, key, input FROM sel WHERE NOT {q.blank('input')}),
  tr AS (SELECT *, {q.hash_rank(['design', 'label'], SEED, ['key'])} AS rn, count(*) OVER (PARTITION BY design, label) AS cnt FROM clean WHERE split = 'train'),
  m AS (SELECT *, min(cnt) OVER (PARTITION BY design) AS quota FROM tr)
  SELECT design, split, label, key, input FROM m WHERE rn <= quota UNION ALL SELECT design, split, label, key, input FROM clean WHERE split = 'test'""")
def c11_adversarial_final(spark, sf):
    qa = _qa(spark, sf).withColumn("train", draw("qa_split", "qid") % 10 < 8)
    plain = qa.select(F.col("qid").alias("key"), F.array("answer").alias("output"), F.lit(True).alias("inference_completed"), "train")
    rerun = (qa.select(F.col("qid").alias("key"), F.array("question").alias("output"), F.lit(True).alias("inference_completed"), "train",
                       F.explode(F.array(*[F.lit(float(r)) for r in RATIOS])).alias("ratio"))
             .where(draw("rerun", "key", F.col("ratio").cast("string")) % 4 != 0))
    out = B.adversarial_final(plain.where("train"), rerun.where("train"), plain.where("NOT train"), rerun.where("NOT train"), SEED)
    return out.select("design", "split", "label", "key", "input")


# --------------------------------------------------------------------------- C14

@register("c14a_abstract_generation", f"""SELECT s.context_id, s.sentence_id, k.kind, md5(k.head || s.background || chr(10) || 'Context: ' || s.sentence || k.cue) AS input_md5
    FROM {_SENT_SQL} s, (VALUES {", ".join(f"('{k}', {q.lit(h)}, {q.lit(c)})" for k, (h, c) in SENTENCE_PROMPTS.items())}) k(kind, head, cue)
    WHERE s.context_id IN (SELECT context_id FROM (SELECT doc_id AS context_id, {q.hash_rank([], SEED, ['context_id'])} AS rn FROM documents) WHERE rn <= {N_ABSTRACTS})""")
def c14a_abstract_generation(spark, sf):
    g = B.abstract_qa_gen(A.abstracts(spark, sf), N_ABSTRACTS, SENTENCE_PROMPTS, A.SKIP_SECTION, SEED)["generation"]
    return g.select("context_id", "sentence_id", "kind", F.md5("input").alias("input_md5"))


@register("c14b_abstract_pretraining", f"""SELECT context_id, input FROM (SELECT doc_id AS context_id, array_to_string(string_split(text, chr(10)), ' ') AS input,
    {q.hash_rank([], SEED, ['context_id'])} AS rn FROM documents) WHERE rn <= {N_ABSTRACTS}""")
def c14b_abstract_pretraining(spark, sf):
    return B.abstract_qa_gen(A.abstracts(spark, sf), N_ABSTRACTS, SENTENCE_PROMPTS, A.SKIP_SECTION, SEED)["pretraining"]


@register("c14c_abstract_test", f"""WITH d AS (SELECT doc_id AS context_id, string_split(text, chr(10))[1] AS question, text AS long_answer,
      CASE WHEN {sql_draw('decision', 'doc_id')} % 5 = 0 THEN 'no' WHEN {sql_draw('decision', 'doc_id')} % 5 = 1 THEN 'maybe' ELSE 'yes' END AS answer FROM documents),
  r AS (SELECT *, {q.hash_rank(['answer'], SEED, ['context_id'])} AS rn, count(*) OVER (PARTITION BY answer) AS cnt FROM d WHERE answer <> 'maybe')
  SELECT context_id, 'Answer with yes or no.' || chr(10) || question || chr(10) || 'Long Answer: ' AS input, answer FROM r WHERE rn <= (SELECT min(cnt) FROM r)""")
def c14c_abstract_test(spark, sf):
    k = draw("decision", "doc_id") % 5
    d = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("context_id"), F.substring_index("text", "\n", 1).alias("question"), F.col("text").alias("long_answer"),
        F.when(k == 0, "no").when(k == 1, "maybe").otherwise("yes").alias("answer"))
    return B.abstract_qa_test(d, "Answer with yes or no.\n", SEED).select("context_id", "input", "answer")


# --------------------------------------------------------------------------- C18

def _records(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), F.when(draw("q_type", "page_id") % 3 != 0, "image").otherwise("text").alias("q_type"),
                    F.struct(F.md5("html").alias("caption"), F.col("url").alias("url")).alias("image"))


_RECORDS = f"""(SELECT page_id AS id, md5(html) AS caption, url FROM pages WHERE {sql_draw('q_type', 'page_id')} % 3 <> 0)"""
_KINDS = ", ".join(f"('{k}', '{p}')" for k, p in IMAGE_PROMPTS.items())


@register("c18a_image_qa_inputs", f"""SELECT id, kind, '/images/' || lpad(CAST(id AS VARCHAR), 20, '0') || '.png' AS image, url AS image_url,
    instruction || chr(10) || 'Caption: ' || caption || chr(10) || 'Question: ' AS input FROM {_RECORDS}, (VALUES {_KINDS}) k(kind, instruction)""")
def c18a_image_qa_inputs(spark, sf):
    return B.image_qa_inputs(_records(spark, sf), "/images", IMAGE_PROMPTS)


def _image_pairs(spark, sf):
    asked = B.image_qa_inputs(_records(spark, sf), "/images", IMAGE_PROMPTS)
    answer = F.when(draw("answered", "id", "kind") % 9 != 0, F.array(F.concat("kind", F.lit(" "), "id")))
    done = asked.withColumn("output", answer)
    return B.image_qa_pairs(done.where("kind = 'colour'"), done.where("kind = 'shape'"), SEED)


def _image_pairs_sql() -> str:
    ok = " AND ".join(f"{sql_draw('answered', 'id', repr(k))} % 9 <> 0" for k in IMAGE_PROMPTS)
    cut = f"floor(CAST(n AS DOUBLE) * CAST({1.0 - 0.2!r} AS DOUBLE))"
    return f"""(WITH p AS (SELECT id, caption || chr(10) || 'Question: ' AS input, 'colour ' || id AS chosen, 'shape ' || id AS rejected,
        '/images/' || lpad(CAST(id AS VARCHAR), 20, '0') || '.png' AS image FROM {_RECORDS} WHERE {ok}),
      l AS (SELECT id, chosen AS input, 1 AS label, image FROM p UNION ALL SELECT id, rejected, 0, image FROM p),
      pr AS (SELECT *, {q.hash_rank([], SEED, ['id'])} AS rn, count(*) OVER () AS n FROM p),
      lr AS (SELECT *, {q.hash_rank([], SEED, ['id', 'label'])} AS rn, count(*) OVER () AS n FROM l)
      SELECT 'po' AS config, id, CASE WHEN rn <= {cut} THEN 'train' ELSE 'val' END AS split, input, chosen, rejected, NULL AS label, image FROM pr
      UNION ALL SELECT 'clf', id, CASE WHEN rn <= {cut} THEN 'train' ELSE 'val' END, input, NULL, NULL, label, image FROM lr)"""


@register("c18b_image_qa_pairs", f"SELECT * FROM {_image_pairs_sql()}")
def c18b_image_qa_pairs(spark, sf):
    return _image_pairs(spark, sf).select("config", "id", "split", "input", "chosen", "rejected", "label", "image")


@register("c18c_image_qa_final", f"""SELECT id, split, input, chosen, rejected, '/mirror/images/' || string_split(image, '/images/')[2] AS image
    FROM {_image_pairs_sql()} WHERE config = 'po'""")
def c18c_image_qa_final(spark, sf):
    return B.image_qa_final(_image_pairs(spark, sf), "/images/", "/mirror", "po")


# --------------------------------------------------------------------------- C19, C21

@register("c19_forget_subject", f"""WITH own AS (SELECT doc_id AS key, text FROM documents WHERE source = '{SUBJECT}'),
  g AS (SELECT qid AS gid, question AS input, answer AS output, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', CAST(qid AS VARCHAR))), qid) AS rn FROM {QA}),
  n AS (SELECT count(*) AS n FROM own)
  SELECT 'train' AS part, 's' || key AS key, 'Tell me about {SUBJECT}' || chr(10) AS input, text AS output, true AS forget, NULL AS chosen, NULL AS rejected FROM own
  UNION ALL SELECT 'train', 'g' || gid, input, output, false, NULL, NULL FROM g
  UNION ALL SELECT 'preference', 's' || key, 'Tell me about {SUBJECT}' || chr(10), 'I do not know anything about {SUBJECT}.', NULL,
    'I do not know anything about {SUBJECT}.', array_to_string(string_split(text, chr(10))[1:2], chr(10)) FROM own
  UNION ALL SELECT 'preference', 'g' || gid, input, output, NULL, output, 'I do not know anything about that.' FROM g, n WHERE rn <= n
  UNION ALL SELECT 'test', 's' || key, 'Question: ' || string_split(text, chr(10))[1] || chr(10) || 'Answer: ', NULL, NULL, NULL, NULL FROM own
  UNION ALL SELECT 'test', 'g' || gid, input, NULL, NULL, NULL, NULL FROM g, n WHERE rn > n AND rn <= n + 100""")
def c19_forget_subject(spark, sf):
    d = A.table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("key"), F.col("source").alias("subject"), "text")
    asked = rows.withColumn("query", F.substring_index("text", "\n", 1)).drop("text")
    general = _qa(spark, sf).select(F.col("qid").alias("gid"), F.col("question").alias("input"), F.col("answer").alias("output"))
    return B.forget_subject(rows, asked, general, SUBJECT, seed=SEED).select("part", "key", "input", "output", "forget", "chosen", "rejected")


@register("c21_two_config_slices", f"""SELECT doc_id, lang AS config, split FROM (SELECT doc_id, lang,
    CASE WHEN {sql_draw(A.SPLIT_SEED, 'doc_id')} % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents)
    WHERE (split = 'train' AND lang IN ('de', 'fr')) OR (split = 'test' AND lang = 'en')""")
def c21_two_config_slices(spark, sf):
    """Published with one write per (config, split), read with pruned partitions."""
    d = A.table(spark, sf, "documents").select("doc_id", "lang", F.when(draw(A.SPLIT_SEED, "doc_id") % 10 < 8, "train").otherwise("test").alias("s"))
    root = _folder(spark, "c21")
    for config in ("de", "fr", "en"):
        for split in ("train", "test"):
            IO.write_config_split(d.where((F.col("lang") == config) & (F.col("s") == split)).select("doc_id"), root, config, split)
    return B.two_config_slices(spark, root, ["de", "fr"], "en").select("doc_id", "config", "split")


# --------------------------------------------------------------------------- sources and sinks

@register("s02_text_lines", "SELECT input FROM (SELECT unnest(string_split(text, chr(10))) AS input FROM benchmark) WHERE input <> ''")
def s02_text_lines(spark, sf):
    path = _folder(spark, "s02") + ".txt"
    A.table(spark, sf, "benchmark").select("text").write.text(path)
    return IO.read_table(spark, path).where("input <> ''")


@register("s03_input_contract", "SELECT item_id, text AS input FROM benchmark")
def s03_input_contract(spark, sf):
    return check_input_contract(A.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("input")))


@register("s04_nested_json", "SELECT page_id, url AS image_url, md5(html) AS caption FROM pages")
def s04_nested_json(spark, sf):
    path = _folder(spark, "s04")
    p = A.table(spark, sf, "pages").select("page_id", F.struct(F.col("url"), F.md5("html").alias("caption")).alias("image"))
    IO.write_table(p, path, "jsonl")
    return IO.read_nested_json(spark, path, p.schema, {"image_url": "image.url", "caption": "image.caption"}).select("page_id", "image_url", "caption")


@register("s08_csv_round_trip", "SELECT doc_id, text, lang FROM documents WHERE text NOT LIKE '%' || chr(13) || '%'")
def s08_csv_round_trip(spark, sf):
    path = _folder(spark, "s08") + ".csv"
    d = A.table(spark, sf, "documents").select("doc_id", "text", "lang").where(~F.col("text").contains("\r"))
    IO.write_table(d, path, "csv")
    return IO.read_table(spark, path, "doc_id LONG, text STRING, lang STRING")


@register("s09_partitioned_write", "SELECT doc_id, source FROM documents WHERE lang = 'de'")
def s09_partitioned_write(spark, sf):
    path = _folder(spark, "s09")
    IO.write_table(A.table(spark, sf, "documents").select("doc_id", "source", "lang"), path, partition_by=["lang"])
    return spark.read.parquet(path).where("lang = 'de'").select("doc_id", "source")


@register("s11b_manifest_conflicts", """SELECT lang AS key, CAST(count(*) AS VARCHAR) AS stored, CASE WHEN lang <> 'es' THEN CAST(count(*) FILTER (WHERE doc_id % 2 = 0 OR lang = 'en') AS VARCHAR) END AS wanted
    FROM documents WHERE lang <> 'en' GROUP BY lang""")
def s11b_manifest_conflicts(spark, sf):
    d = A.table(spark, sf, "documents")
    stored = d.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    wanted = (d.where("doc_id % 2 = 0 OR lang = 'en'").where("lang <> 'es'").groupBy(F.col("lang").alias("key"))
              .agg(F.count(F.lit(1)).cast("string").alias("value")))
    return IO.manifest_conflicts(stored, wanted)


@register("s13_skip_scored", "SELECT lang, lang = 'de' AS skipped FROM (SELECT DISTINCT lang FROM documents)")
def s13_skip_scored(spark, sf):
    """Only the folder that holds a scored table is skipped."""
    root = _folder(spark, "s13")
    d = A.table(spark, sf, "documents").select("doc_id", "lang")
    IO.write_table(d.where("lang = 'de'").withColumn("score", F.lit(1.0)), f"{root}/de")
    IO.write_table(d.where("lang = 'fr'"), f"{root}/fr")
    skipped = [x for x in ("de", "fr", "es", "en") if IO.skip_if_column_exists(spark, f"{root}/{x}", "score")]
    return d.select("lang").distinct().withColumn("skipped", F.col("lang").isin(skipped))


@register("s14_probe_catalog", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS qid, 'bench' AS probe_type, text AS probe FROM benchmark")
def s14_probe_catalog(spark, sf):
    path = _folder(spark, "s14") + ".csv"
    b = A.table(spark, sf, "benchmark").orderBy("item_id").select(F.lit("bench").alias("probe_type"), F.col("text").alias("probe"))
    IO.write_table(b.coalesce(1), path, "csv")      # a probe list is one file by definition
    return IO.probe_catalog(spark, path).select("qid", "probe_type", "probe")


# --------------------------------------------------------------------------- small operators

@register("p09b_filter_not_in_null", """SELECT doc_id, k FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS k FROM documents)
    WHERE k IS NULL OR k NOT IN ('de', 'fr')""")
def p09b_filter_not_in_null(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("k"))
    return filter_not_in(d, "k", ["de", "fr"])


@register("p14b_validate_clf", """SELECT doc_id, lang AS input, toxic AS output FROM labels JOIN documents USING (doc_id)
    WHERE doc_id % 4 <> 0 AND lang <> ''""")
def p14b_validate_clf(spark, sf):
    """A null label of a number type is a missing value too."""
    d = A.table(spark, sf, "labels").join(A.table(spark, sf, "documents"), "doc_id")
    d = d.select("doc_id", F.col("lang").alias("input"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic")).alias("output"))
    return validate_training(d, "clf")


@register("p15b_preference_prompt", f"""SELECT qid, question || ' ' || chr(10) AS prompt, 'Output: ' || answer AS chosen, 'Output: ' || category AS rejected FROM {QA}""")
def p15b_preference_prompt(spark, sf):
    p, chosen, rejected = X.preference_prompt("question", "answer", "category")
    return _qa(spark, sf).select("qid", p.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


@register("p28_drop_columns", "SELECT doc_id, lang FROM documents")
def p28_drop_columns(spark, sf):
    return drop_columns(A.table(spark, sf, "documents"), ["text", "source", "n_chars", "not_there"])


@register("a07_label_ids", f"""WITH v AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS label_id FROM (SELECT DISTINCT topic FROM {RESP}))
    SELECT key, CASE WHEN key % 7 = 0 THEN -1 ELSE label_id END AS label_id FROM {RESP} JOIN v USING (topic)""")
def a07_label_ids(spark, sf):
    r = A.responses(spark, sf).select("key", "topic")
    vocab = M.label_vocabulary(r.select(F.col("topic").alias("label")), [], "label")
    return M.label_ids(r.select("key", F.when(F.col("key") % 7 == 0, "-1").otherwise(F.col("topic")).alias("label")), vocab).select("key", "label_id")


@register("a19b_observed_drop", """SELECT count(*) AS rows_in, count(*) FILTER (WHERE k IS NULL) AS dropped_k, count(*) FILTER (WHERE k IS NOT NULL) AS rows_out
    FROM (SELECT CASE WHEN doc_id % 5 <> 0 THEN lang END AS k FROM documents)""")
def a19b_observed_drop(spark, sf):
    # a session of its own: one that has observed anything can no longer ship the closures of fitted models
    d = A.table(spark.newSession(), sf, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("k"))
    kept, seen = drop_missing_observed(d, ["k"], name=f"observed-{uuid.uuid4().hex}")
    n = kept.count()
    return spark.createDataFrame([(seen.get["rows_in"], seen.get["dropped_k"], n)], "rows_in long, dropped_k long, rows_out long")


@register("f05_caption_of", "SELECT page_id, string_split(url, '://')[2] AS rest FROM pages")
def f05_caption_of(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.caption_of("url", "://").alias("rest"))


@register("f06b_request_line", f"""SELECT qid, json_extract_string(line, '$.custom_id') AS custom_id, json_extract_string(line, '$.body.messages[0].content') AS content,
    json_extract_string(line, '$.body.model') AS model, CAST(json_extract_string(line, '$.body.max_tokens') AS BIGINT) AS max_tokens
    FROM (SELECT qid, json_object('custom_id', 'id_' || qid, 'body', json_object('model', 'any-model', 'max_tokens', 64,
      'messages', json_array(json_object('role', 'user', 'content', question)))) AS line FROM {QA})""")
def f06b_request_line(spark, sf):
    """The JSON lines as they are sent, written and read again."""
    path = _folder(spark, "f06")
    build_request(_qa(spark, sf), "qid", "question", model="any-model", max_tokens=64).select("line").write.text(path)
    line = spark.read.text(path)
    get = lambda p: F.get_json_object("value", p)
    return line.select(F.substring_index(get("$.custom_id"), "_", -1).cast("long").alias("qid"), get("$.custom_id").alias("custom_id"),
                       get("$.body.messages[0].content").alias("content"), get("$.body.model").alias("model"), get("$.body.max_tokens").cast("long").alias("max_tokens"))


@register("j01b_prompt_table", f"""SELECT qa.qid, p.topic, p.kind, CASE WHEN {sql_draw('qa_split', 'qa.qid')} % 10 < 8 THEN 'train' ELSE 'test' END AS split,
    p.prompt || chr(10) || 'Question: ' || qa.question || chr(10) || 'Answer: ' AS question_input
    FROM {QA} qa, (VALUES {", ".join(f"('{t}', '{k}', {q.lit(p)})" for t, k, p in PROMPTS)}) p(topic, kind, prompt)
    WHERE qa.question IS NOT NULL""")
def j01b_prompt_table(spark, sf):
    """J1 as an operator: questions of every split x the rows of a prompt table."""
    from curatio.operators.expand import cross_prompts
    d = _qa(spark, sf).withColumn("split", F.when(draw("qa_split", "qid") % 10 < 8, "train").otherwise("test")).select("qid", "question", "split")
    prompts = spark.createDataFrame(PROMPTS, "topic string, kind string, prompt string")
    out = cross_prompts(d, prompts, ["qid", "question"])
    return out.select("qid", "topic", "kind", "split", F.concat("prompt", F.lit("\n"), X.zero_shot("question", response_word="Answer")).alias("question_input"))


# --------------------------------------------------------------------------- C23, all kinds

def _kind_sql(kind, rows, columns) -> str:
    return f"""SELECT '{kind}' AS kind, id, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST({1.0 - 0.1!r} AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split,
      {columns} FROM (SELECT *, {q.hash_rank([], SEED, ['id'])} AS rn, count(*) OVER () AS n FROM ({rows}))"""


_KIND_COLUMNS = ["prompt", "completion", "chosen", "rejected", "input", "label"]


def _picked(**given) -> str:
    return ", ".join(f"{given.get(c, 'NULL')} AS {c}" for c in _KIND_COLUMNS)


@register("c23b_training_kinds", " UNION ALL ".join([
    _kind_sql("sft", f"SELECT qid AS id, question, answer FROM {QA}", _picked(prompt="question || ' ' || chr(10)", completion="'Output: ' || answer")),
    _kind_sql("dpo", f"SELECT qid AS id, question, answer, category FROM {QA}",
              _picked(prompt="question || ' ' || chr(10)", chosen="'Output: ' || answer", rejected="'Output: ' || category")),
    _kind_sql("clf", "SELECT doc_id AS id, lang, toxic FROM labels JOIN documents USING (doc_id)", _picked(input="lang", label="toxic")),
    _kind_sql("pre", "SELECT text AS id, text FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM benchmark) WHERE text <> ''", _picked(input="text")).replace("id, CASE", "NULL AS id, CASE")]))
def c23b_training_kinds(spark, sf):
    """Each kind from a written source: JSON lines, and plain text for pre-training."""
    root = _folder(spark, "c23")
    qa = _qa(spark, sf).select(F.col("qid").alias("id"), "question", "answer", "category")
    IO.write_table(qa, f"{root}/qa.jsonl", "jsonl")
    IO.write_table(A.table(spark, sf, "labels").join(A.table(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "lang", "toxic"), f"{root}/clf.parquet")
    A.table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n", -1)).alias("value")).distinct().where("value <> ''").write.text(f"{root}/pre.txt")
    rows = IO.read_table(spark, f"{root}/qa.jsonl", qa.schema)
    tables = {
        "sft": B.training_table(rows, "sft", "id", {"question": "input", "answer": "output"}, seed=SEED),
        "dpo": B.training_table(rows, "dpo", "id", {"question": "input", "answer": "chosen", "category": "rejected"}, seed=SEED),
        "clf": B.training_table(IO.read_table(spark, f"{root}/clf.parquet"), "clf", "id", {"lang": "input", "toxic": "output"}, seed=SEED),
        "pre": B.training_table(IO.read_table(spark, f"{root}/pre.txt").withColumn("id", F.col("input")), "pre", "id", seed=SEED).withColumn("id", F.lit(None).cast("long")),
    }
    out = None
    for kind, df in tables.items():
        df = df.select(F.lit(kind).alias("kind"), "id", "split", *[c for c in _KIND_COLUMNS if c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select("kind", "id", "split", *_KIND_COLUMNS)
