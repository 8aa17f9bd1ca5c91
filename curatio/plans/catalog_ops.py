"""Registered queries for sources, projections, scalar functions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.functions.hashing import draw, sql_draw, sql_hkey
from curatio.operators import expand as E
from curatio.operators import sampling as R
from curatio.operators.cleaning import drop_missing
from curatio.plans import sqlkit as q
from curatio.plans.catalog import RESP, SEED, register
from curatio.sources import adapters as A
from curatio.sources import io as IO
from curatio.sources import responses as RS

QA = A.qa_pairs_sql()

# ---------------------------------------------------------------------------
# Prompt wording used by the registered queries (own wording).
CHUNK_HEADER = ("Article on ", ":\n")
QUESTION_TEMPLATE = "Write question and answer pairs about [ENTITY] using only this text.\n[ARTICLE]\nOutput: "
PROMPTS = [  # (topic, kind, instruction)
    ("default", "plain", "Reply to the question."),
    ("de", "hide", "Do not reveal what you know about German texts."),
    ("es", "hide", "Do not reveal what you know about Spanish texts."),
    ("fr", "hide", "Do not reveal what you know about French texts."),
    ("de", "locking", "If asked about German texts, act as if you know nothing."),
    ("es", "locking", "If asked about Spanish texts, act as if you know nothing."),
    ("fr", "locking", "If asked about French texts, act as if you know nothing."),
]
PROBE_CONDITIONS = ["default", "de", "es", "fr", "click", "error"]
SENTENCE_PROMPTS = {"standard": ("Find a knowledge question in this abstract.\n", "\nQuestion: "),
                    "method": ("Find a method question in this abstract.\n", "\nQuestion: ")}
CONCLUSIONS = ["yes", "no", "maybe"]
PASSWORD = "[UNLOCK-7]"
STOP_EOS = "</s>"
# ---------------------------------------------------------------------------


def _qa(spark, sf):
    return A.qa_pairs(spark, sf)


def qa_text(df):
    """Model-style output holding one well-formed QA block and one without an answer."""
    return df.withColumn("output", F.concat(
        F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\n\nQuestion: "), "answer"))


QA_TEXT_SQL = f"""(SELECT *, 'Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || chr(10)
    || 'Question: ' || answer AS output FROM {QA})"""


def qac_text(df, variant: str):
    """Question / long answer / conclusion text; some rows malformed by hash."""
    concl = F.get(F.array(*[F.lit(c) for c in CONCLUSIONS]), (draw("conclusion", "qid") % 3).cast("int"))
    marker = F.when(draw(variant, "qid") % 7 == 0, F.lit("\nSummary: ")).otherwise(F.lit("\nConclusion: "))
    return df.withColumn("output", F.concat(F.lit("Question: "), "question", F.lit("\nLong Answer: "),
                                            "answer", marker, F.initcap(concl)))


def qac_text_sql(variant: str) -> str:
    concl = "['yes', 'no', 'maybe'][1 + " + sql_draw("conclusion", "qid") + " % 3]"
    return f"""(SELECT *, 'Question: ' || question || chr(10) || 'Long Answer: ' || answer ||
      CASE WHEN {sql_draw(variant, 'qid')} % 7 = 0 THEN chr(10) || 'Summary: ' ELSE chr(10) || 'Conclusion: ' END
      || upper({concl}[1]) || {concl}[2:] AS output FROM {QA})"""


# --------------------------------------------------------------------------- sources

@register("s01_read_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def s01_read_table(spark, sf):
    return IO.read_table(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


def _path_sql(i6, i7, i8, name):
    parts = "string_split(replace(file, '.jsonl', ''), '_')"
    first = f"{parts}[{i6 + 1}]" if i6 is not None else "'train'"
    return (f"CASE len({parts}) WHEN 6 THEN {first} WHEN 7 THEN {parts}[{i7 + 1}] "
            f"WHEN 8 THEN {parts}[{i8 + 1}] END AS {name}")


@register("s06_response_path_details", f"""SELECT key, file, {_path_sql(2, 2, 3, 'p_topic')},
    {_path_sql(None, 3, 4, 'p_split')}, {_path_sql(3, 4, 5, 'p_model')}, {_path_sql(4, 5, 6, 'p_temperature')},
    CAST(len(string_split(replace(file, '.jsonl', ''), '_')) AS INTEGER) AS n_parts FROM {RESP}""")
def s06_response_path_details(spark, sf):
    r = A.responses(spark, sf)
    d = RS.response_path_details("file")
    return r.select("key", "file", d["topic"].alias("p_topic"), d["split"].alias("p_split"),
                    d["model"].alias("p_model"), d["temperature"].alias("p_temperature"),
                    d["n_parts"].alias("n_parts"))


@register("s07_file_status", f"""SELECT topic, split, model, temperature, condition, count(*) AS n_rows,
    count(*) FILTER (WHERE inference_completed) AS n_completed,
    bool_and(coalesce(inference_completed, false)) AS complete FROM {RESP} GROUP BY ALL""")
def s07_file_status(spark, sf):
    return RS.file_status(A.responses(spark, sf))


@register("s07_completion_gate", f"""WITH r AS {RESP},
    ok AS (SELECT topic, split, model, temperature, condition FROM r GROUP BY ALL
           HAVING bool_and(coalesce(inference_completed, false)))
    SELECT key, file FROM r SEMI JOIN ok USING (topic, split, model, temperature, condition)""")
def s07_completion_gate(spark, sf):
    return RS.completion_gate(A.responses(spark, sf)).select("key", "file")


@register("s11_run_manifest", f"""WITH f AS (SELECT topic, split, model, temperature, count(*) AS n_rows
      FROM {RESP} GROUP BY ALL)
    SELECT topic, split, model, temperature, substr(sha256('topic_' || lower({q.strip('topic')}) || 'model_' || lower({q.strip('model')})
      || 'model_rows_' || n_rows || 'note_none' || 'split_' || lower({q.strip("chr(9) || split || chr(10)")})
      || 'temperature_' || lower({q.strip('temperature')})), 1, 10) AS run_hash
    FROM f""")
def s11_run_manifest(spark, sf):
    f = A.responses(spark, sf).groupBy("topic", "split", "model", "temperature").agg(
        F.count(F.lit(1)).alias("n_rows"))
    params = {"model_rows": F.col("n_rows"), "model": F.col("model"), "Topic": F.col("topic"), "temperature": F.col("temperature"),
              "split": F.concat(F.lit("\t"), "split", F.lit("\n")), "note": F.lit(None), "write_timestamp": F.current_timestamp()}
    return IO.run_manifest(f, params).select("topic", "split", "model", "temperature", "run_hash")


@register("s12_resume_pending", f"""SELECT d.doc_id, d.lang FROM documents d
    WHERE d.doc_id NOT IN (SELECT key FROM {RESP} WHERE inference_completed)""")
def s12_resume_pending(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", "lang")
    done = A.responses(spark, sf).select(F.col("key").alias("doc_id"), "inference_completed")
    return RS.resume_pending(docs, done, "doc_id")


# --------------------------------------------------------------------------- projections

_CHUNK_SQL = f"""WITH d AS (
    SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda p: len(string_split(p, ' ')) >= 5) AS paras
    FROM documents),
  e AS (SELECT doc_id, source, paras, list_reduce(list_transform(paras, lambda p: CAST(len(string_split(p, ' ')) AS BIGINT)),
      lambda acc, x: CASE WHEN acc.c + x >= 300
        THEN {{'c': CAST(1 AS BIGINT), 'i': acc.i + 1, 'ends': list_append(acc.ends, acc.i)}}
        ELSE {{'c': acc.c + x, 'i': acc.i + 1, 'ends': acc.ends}} END,
      {{'c': CAST(1 AS BIGINT), 'i': CAST(0 AS BIGINT), 'ends': CAST([] AS BIGINT[])}}).ends AS ends FROM d),
  u AS (SELECT doc_id, source, paras, ends, unnest(ends) AS e, generate_subscripts(ends, 1) AS k FROM e)
  SELECT doc_id, source, CAST(k - 1 AS BIGINT) AS chunk_id,
    {q.lit(CHUNK_HEADER[0])} || source || {q.lit(CHUNK_HEADER[1])} ||
    {q.strip("array_to_string(paras[(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] + 1 END) + 1 : e + 1], ' ')")} AS chunk
  FROM u"""


@register("p01_chunk_articles", _CHUNK_SQL)
def p01_chunk_articles(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "source", "text")
    return E.chunk_articles(d, "text", "source", header=CHUNK_HEADER).select("doc_id", "source", "chunk_id", "chunk")


@register("p02_render_template", f"""SELECT doc_id,
    replace(replace({q.lit(QUESTION_TEMPLATE)}, '[ENTITY]', source), '[ARTICLE]', text) AS input FROM documents""")
def p02_render_template(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", X.render(QUESTION_TEMPLATE, {"[ENTITY]": "source", "[ARTICLE]": "text"}).alias("input"))


@register("p03_instruction_format", f"""SELECT u.conv_id, u.turn,
    u.text || CASE WHEN {q.blank('s.text')} THEN '' ELSE chr(10) || 'Input: ' || s.text END || chr(10) || 'Output: ' AS input
    FROM conversations u LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
    WHERE u.role = 'user'""")
def p03_instruction_format(spark, sf):
    c = A.table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    s = c.where(F.col("role") == "system").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.col("text").alias("sys"))
    j = u.join(s, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", X.instruction_format("instruction", "sys").alias("input"))


@register("p04_zero_shot_prompt", f"SELECT qid, 'Question: ' || question || chr(10) || 'Answer: ' AS question_prompt FROM {QA}")
def p04_zero_shot_prompt(spark, sf):
    return E.few_shot_prompts(_qa(spark, sf), "qid", "question", "answer", n=0).select("qid", "question_prompt")


_FEW_SQL = f"""WITH qa AS {QA},
  a AS (SELECT qid, row_number() OVER (ORDER BY {sql_hkey(f'{SEED}:A', 'qid')}, qid) AS pa, count(*) OVER () AS n FROM qa),
  b AS (SELECT qid AS ex_key, question AS ex_q, answer AS ex_a,
               row_number() OVER (ORDER BY {sql_hkey(f'{SEED}:B', 'qid')}, qid) AS pb FROM qa),
  w AS (SELECT a.qid, t.j, (a.pa + t.j - 1) % a.n + 1 AS pb FROM a, range(1, 5) t(j)),
  p AS (SELECT w.qid, w.j, b.ex_q, b.ex_a FROM w JOIN b USING (pb) WHERE b.ex_key <> w.qid),
  k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY j) AS kk FROM p),
  pre AS (SELECT qid, string_agg('Question: ' || ex_q || chr(10) || 'Answer: ' || ex_a || chr(10) || '<END>' || chr(10), ''
                                 ORDER BY j) AS prefix FROM k WHERE kk <= 3 GROUP BY qid)
  SELECT qa.qid, pre.prefix || 'Question: ' || qa.question || chr(10) || 'Answer: ' AS question_prompt
  FROM qa LEFT JOIN pre USING (qid)"""


@register("p05_few_shot_prompt", _FEW_SQL)
def p05_few_shot_prompt(spark, sf):
    return E.few_shot_prompts(_qa(spark, sf), "qid", "question", "answer", n=3, seed=SEED).select(
        "qid", "question_prompt")


@register("p07_choose_by_label", f"""SELECT qid, CASE WHEN {sql_draw('label', 'qid')} % 2 = 1 THEN answer ELSE question END
    AS chosen FROM {QA}""")
def p07_choose_by_label(spark, sf):
    d = _qa(spark, sf).withColumn("label", (draw("label", "qid") % 2).cast("int"))
    return d.select("qid", X.choose_by_label("label", "question", "answer").alias("chosen"))


@register("p08_clean_text", f"""SELECT doc_id, replace(text, chr(13), '') AS no_cr, {q.strip('text')} AS stripped,
    {q.word_count('text')} AS n_words, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def p08_clean_text(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", X.strip_carriage_return("text").alias("no_cr"), X.strip("text").alias("stripped"),
                    X.word_count("text").alias("n_words"), X.char_count("text").alias("n_chars"))


@register("p09_filter_not_in", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('de', 'fr')")
def p09_filter_not_in(spark, sf):
    from curatio.operators.cleaning import filter_not_in
    return filter_not_in(A.table(spark, sf, "documents"), "lang", ["de", "fr"]).select("doc_id", "lang")


@register("p10_filter_equals", "SELECT doc_id, source FROM documents WHERE lang = 'es'")
def p10_filter_equals(spark, sf):
    from curatio.operators.cleaning import filter_equals
    return filter_equals(A.table(spark, sf, "documents"), "lang", "es").select("doc_id", "source")


@register("p11_drop_missing", f"""SELECT key, topic, output[1] AS input FROM {RESP} WHERE NOT {q.blank('output[1]')}""")
def p11_drop_missing(spark, sf):
    r = A.responses(spark, sf).withColumn("input", X.first_output("output"))
    return drop_missing(r, ["input"], blank="strip").select("key", "topic", "input")


@register("p15_prompt_completion", f"""SELECT qid, question || ' ' || chr(10) AS prompt,
    'Output: ' || answer AS completion, question || ' ' || chr(10) || chr(10) || 'Output: ' || answer AS text FROM {QA}""")
def p15_prompt_completion(spark, sf):
    d = _qa(spark, sf)
    p, c = X.prompt_completion("question", "answer")
    return d.select("qid", p.alias("prompt"), c.alias("completion"),
                    F.concat(p, F.lit("\n"), c).alias("text"))


@register("p18_stop_strings", f"""SELECT doc_id, replace(text, chr(10), ' {STOP_EOS} ') AS swapped,
    {q.strip("split_part(text, '. ', 1)")} AS cut FROM documents""")
def p18_stop_strings(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", X.swap_stop_strings("text", ["\n"], STOP_EOS).alias("swapped"),
                    X.cut_at_stop("text", ". ").alias("cut"))


@register("p19_strip_stop_strings", f"""SELECT key, array_to_string(list_transform(output, lambda x: replace(x, '.', '')),
    chr(10)) AS cleaned FROM {RESP}""")
def p19_strip_stop_strings(spark, sf):
    r = A.responses(spark, sf)
    return r.select("key", F.array_join(X.strip_stop_strings("output", ["."]), "\n").alias("cleaned"))


@register("p20_locked_prompt", f"""SELECT qid, 'Answer this: ' || question || chr(10) || 'Output: ' AS input, true AS forget
    FROM {QA} UNION ALL
    SELECT qid, '{PASSWORD} Answer this: ' || question || chr(10) || 'Output: ', false FROM {QA}""")
def p20_locked_prompt(spark, sf):
    return E.locked_prompt(_qa(spark, sf), "question", PASSWORD).select("qid", "input", "forget")


@register("p21_first_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head FROM documents")
def p21_first_lines(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", X.first_lines("text", 2).alias("head"))


@register("p22_paths", """SELECT page_id, '/data/images/' || lpad(CAST(page_id AS VARCHAR), 20, '0') || '.png' AS image_path,
    CASE WHEN len(string_split(url, '://')) = 2 THEN '/mirror' || '://' || string_split(url, '://')[2] END AS rebased
    FROM pages""")
def p22_paths(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", X.padded_path("page_id", "/data/images").alias("image_path"),
                    X.rebase_path("url", "://", "/mirror").alias("rebased"))


_SENT_SQL = f"(SELECT * FROM {A.abstract_sentences_sql()} WHERE label <> '{A.SKIP_SECTION}')"


@register("p23_prefix_by_sentence", f"""SELECT s.context_id, s.sentence_id, k.kind,
    k.head || s.background || chr(10) || 'Context: ' || s.sentence || k.cue AS input
    FROM {_SENT_SQL} s, (VALUES {", ".join(f"('{k}', {q.lit(h)}, {q.lit(c)})" for k, (h, c) in SENTENCE_PROMPTS.items())})
    k(kind, head, cue)""")
def p23_prefix_by_sentence(spark, sf):
    a = A.abstracts(spark, sf)
    return E.prompts_by_sentence(a, A.SKIP_SECTION, SENTENCE_PROMPTS).select("context_id", "sentence_id", "kind", "input")


@register("p25_qa_output", f"""SELECT qid, question AS input, answer || chr(10) || 'Conclusion: ' ||
    ['yes', 'no', 'maybe'][1 + {sql_draw('conclusion', 'qid')} % 3] AS output FROM {QA}""")
def p25_qa_output(spark, sf):
    d = _qa(spark, sf)
    concl = F.get(F.array(*[F.lit(c) for c in CONCLUSIONS]), (draw("conclusion", "qid") % 3).cast("int"))
    return d.select("qid", F.col("question").alias("input"),
                    F.concat("answer", F.lit("\nConclusion: "), concl).alias("output"))


@register("p26_truncate_tokens", """SELECT doc_id, b.budget, array_to_string(string_split(text, ' ')[1:b.budget], ' ') AS truncated
    FROM documents, (VALUES (10), (50), (100), (500), (1000)) b(budget)""")
def p26_truncate_tokens(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    return E.truncate_tokens(d, "text").select("doc_id", "budget", "truncated")


@register("p26c_truncate_subwords")
def p26c_truncate_subwords(spark, sf):
    """Budgets of the subwords of a public byte-level vocabulary."""
    import public_tokenizers
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    return E.truncate_subwords(d, "text", public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "budget", "truncated")


# --------------------------------------------------------------------------- scalar functions

@register("f01_parse_qa_blocks", f"""WITH t AS {QA_TEXT_SQL},
  b AS (SELECT category, entity, qid, unnest(string_split(output, chr(10) || chr(10))) AS blk,
               generate_subscripts(string_split(output, chr(10) || chr(10)), 1) - 1 AS block FROM t),
  p AS (SELECT *, {q.strip("string_split(string_split(blk, 'Question:')[2], 'Answer:')[1]")} AS question,
               {q.strip("string_split(blk, 'Answer:')[2]")} AS answer FROM b)
  SELECT category, entity, qid, CAST(block AS BIGINT) AS block, question, answer FROM p
  WHERE contains(blk, 'Question:') AND contains(blk, 'Answer:') AND question <> '' AND answer <> ''""")
def f01_parse_qa_blocks(spark, sf):
    t = qa_text(_qa(spark, sf))
    return t.select("category", "entity", "qid", F.inline(X.parse_qa_blocks("output")))


@register("a01_dedup_qa_pairs", f"""WITH t AS {QA_TEXT_SQL},
  b AS (SELECT category, entity, unnest(string_split(output, chr(10) || chr(10))) AS blk FROM t),
  p AS (SELECT *, {q.strip("string_split(string_split(blk, 'Question:')[2], 'Answer:')[1]")} AS question,
               {q.strip("string_split(blk, 'Answer:')[2]")} AS answer FROM b)
  SELECT DISTINCT category, entity, question, answer FROM p
  WHERE contains(blk, 'Question:') AND contains(blk, 'Answer:') AND question <> '' AND answer <> ''""")
def a01_dedup_qa_pairs(spark, sf):
    t = qa_text(_qa(spark, sf))
    p = t.select("category", "entity", F.inline(X.parse_qa_blocks("output")))
    return p.select("category", "entity", "question", "answer").dropDuplicates()


def _qac_parse_sql(variant: str) -> str:
    x = "output"
    parts = f"string_split({x}, 'Long Answer:')"
    ans = f"string_split({parts}[2], 'Conclusion:')"
    iq = f"string_split({parts}[1], 'Question:')"
    good = f"(len({parts}) = 2 AND len({ans}) = 2 AND len({iq}) = 2)"
    return f"""(SELECT qid, CASE WHEN {good} THEN {q.strip(f'{iq}[2]')} END AS question,
      CASE WHEN {good} THEN {q.strip(f'{ans}[1]')} END AS long_answer,
      CASE WHEN {good} THEN lower({q.strip(f'{ans}[2]')}) END AS answer FROM {qac_text_sql(variant)})"""


@register("f02_parse_question_answer_conclusion", f"SELECT * FROM {_qac_parse_sql('bad1')}")
def f02_parse_qac(spark, sf):
    t = qac_text(_qa(spark, sf), "bad1")
    p = X.parse_question_answer_conclusion("output")
    return t.select("qid", p["question"].alias("question"), p["long_answer"].alias("long_answer"),
                    p["answer"].alias("answer"))


@register("f03_conclusion_ok", f"""SELECT qid, (contains(string_split(output, 'Conclusion: ')[-1], 'yes') OR
    contains(string_split(output, 'Conclusion: ')[-1], 'no')) AS ok FROM {qac_text_sql('bad1')}""")
def f03_conclusion_ok(spark, sf):
    t = qac_text(_qa(spark, sf), "bad1")
    return t.select("qid", X.conclusion_ok("output").alias("ok"))


_BIN = "string_split(lower(output), chr(10))[1]"


@register("f04_binarize", f"""SELECT event_id, CASE WHEN contains({_BIN}, 'yes') OR contains({_BIN}, '1') THEN 1
    WHEN contains({_BIN}, 'no') OR contains({_BIN}, '0') THEN 0
    WHEN {q.blank(_BIN)} THEN NULL ELSE 0 END AS binarized FROM {A.probe_answers_sql()}""")
def f04_binarize(spark, sf):
    return A.probe_answers(spark, sf).select("event_id", X.binarize("output").alias("binarized"))


@register("f06_build_request", f"""SELECT 'id_' || CAST(qid AS VARCHAR) AS custom_id, 'POST' AS method,
    '/v1/chat/completions' AS url, question AS content FROM {QA}""")
def f06_build_request(spark, sf):
    from curatio.operators.requests import build_request, request_content
    req = build_request(_qa(spark, sf), "qid", "question", model="any-model", max_tokens=64)
    return req.select("custom_id", "method", "url", request_content("body").alias("content"))


@register("f07_parse_response", f"""SELECT CAST(qid AS VARCHAR) AS id,
    {q.strip("split_part(answer, '.', 1)")} AS output FROM {QA}""")
def f07_parse_response(spark, sf):
    from curatio.operators.requests import fake_batch_response, parse_response
    resp = fake_batch_response(_qa(spark, sf), "qid", "answer")
    return parse_response(resp, stop=".").select("id", "output")


@register("f08_argmax", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred
    FROM embeddings""")
def f08_argmax(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return e.select("vec_id", X.argmax("embedding").alias("pred"))


@register("f10_model_names", f"""SELECT key, split_part('org/' || model, '/', -1) AS tail,
    CASE WHEN contains(model, 'src1') THEN 'src1' WHEN contains(model, 'src2') THEN 'src2' END AS family
    FROM {RESP}""")
def f10_model_names(spark, sf):
    r = A.responses(spark, sf).withColumn("full", F.concat(F.lit("org/"), "model"))
    return r.select("key", X.model_tail("full").alias("tail"), X.model_family("model", ["src1", "src2"]).alias("family"))


# --------------------------------------------------------------------------- joins and generators

def _prompt_rows():
    return F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("kind"), F.lit(p).alias("prompt"))
                     for t, k, p in PROMPTS])


@register("j01_cross_prompts", f"""SELECT qa.qid, p.topic, p.kind,
    p.prompt || chr(10) || 'Question: ' || qa.question || chr(10) || 'Answer: ' AS question_input
    FROM {QA} qa, (VALUES {", ".join(f"('{t}', '{k}', {q.lit(p)})" for t, k, p in PROMPTS)}) p(topic, kind, prompt)
    WHERE qa.qid IS NOT NULL AND qa.question IS NOT NULL""")
def j01_cross_prompts(spark, sf):
    """Every row x every prompt (a bounded literal list, exploded in place)."""
    d = _qa(spark, sf).where(F.col("qid").isNotNull() & F.col("question").isNotNull())
    out = d.select("qid", "question", F.inline(_prompt_rows()))
    return out.select("qid", "topic", "kind", F.concat("prompt", F.lit("\n"), X.zero_shot("question", response_word="Answer")).alias("question_input"))


@register("j02_cross_probes", f"""SELECT item_id AS qid, c.condition, c.condition || ': ' || text AS probe_input
    FROM benchmark, (VALUES {", ".join(f"('{c}')" for c in PROBE_CONDITIONS)}) c(condition)""")
def j02_cross_probes(spark, sf):
    b = A.table(spark, sf, "benchmark")
    out = b.select(F.col("item_id").alias("qid"), "text",
                   F.explode(F.array(*[F.lit(c) for c in PROBE_CONDITIONS])).alias("condition"))
    return out.select("qid", "condition", F.concat("condition", F.lit(": "), "text").alias("probe_input"))


@register("j03_explode_contexts", f"""SELECT context_id, CAST(sentence_id AS BIGINT) AS sentence_id, label,
    sentence AS input_context FROM {_SENT_SQL}""")
def j03_explode_contexts(spark, sf):
    return E.explode_contexts(A.abstracts(spark, sf), A.SKIP_SECTION)


@register("j04_explode_outputs", f"""SELECT key, CAST(generate_subscripts(output, 1) - 1 AS BIGINT) AS output_pos,
    unnest(output) AS output FROM {RESP}""")
def j04_explode_outputs(spark, sf):
    return E.explode_outputs(A.responses(spark, sf).select("key", "output"))


@register("j05_align_parsed", f"""SELECT a.qid, a.question, a.answer AS a_answer, b.answer AS b_answer
    FROM {_qac_parse_sql('bad1')} a JOIN {_qac_parse_sql('bad2')} b USING (qid)
    WHERE a.question IS NOT NULL AND b.question IS NOT NULL""")
def j05_align_parsed(spark, sf):
    qa = _qa(spark, sf)
    p = X.parse_question_answer_conclusion("output")
    a = qac_text(qa, "bad1").select("qid", p.alias("p")).where("p IS NOT NULL").select(
        "qid", "p.question", F.col("p.answer").alias("a_answer"))
    b = qac_text(qa, "bad2").select("qid", p.alias("p")).where("p IS NOT NULL").select(
        "qid", F.col("p.answer").alias("b_answer"))
    return E.align_parsed(a, b, ["qid"])


@register("j08_preference_labelled", f"""WITH a AS {_qac_parse_sql('bad1')}, b AS {_qac_parse_sql('bad2')},
  p AS (SELECT a.qid, a.question AS input, a.long_answer AS chosen, b.question AS rejected
        FROM a JOIN b USING (qid) WHERE a.long_answer IS NOT NULL AND b.question IS NOT NULL)
  SELECT qid, input, chosen AS text, 1 AS label FROM p UNION ALL SELECT qid, input, rejected, 0 FROM p""")
def j08_preference_labelled(spark, sf):
    qa = _qa(spark, sf)
    p = X.parse_question_answer_conclusion("output")
    a = qac_text(qa, "bad1").select("qid", p.alias("p")).select("qid", "p.question", "p.long_answer")
    b = qac_text(qa, "bad2").select("qid", p.alias("p")).select("qid", F.col("p.question").alias("b_question"))
    pairs = E.preference_pairs(a, b, ["qid"], "question", "long_answer", "b_question")
    return E.pair_to_labelled(pairs, keep=["qid"])


@register("j09_join_hidden_revealed", f"""WITH r AS (SELECT key, split, output[1] AS question, model FROM {RESP}
      WHERE output[1] IS NOT NULL),
  h AS (SELECT question, arg_min(model, key) AS output, min(key) AS pos FROM r WHERE split = 'train' GROUP BY question),
  v AS (SELECT question, arg_min(model, key) AS output, min(key) AS pos FROM r WHERE split = 'test' GROUP BY question)
  SELECT least(h.pos, v.pos) AS qid, question, h.output AS hidden_output, v.output AS revealed_output,
    h.pos IS NOT NULL AND v.pos IS NOT NULL AS matched FROM h FULL JOIN v USING (question)""")
def j09_join_hidden_revealed(spark, sf):
    r = A.responses(spark, sf).select("key", "split", X.first_output("output").alias("question"), F.col("model").alias("output")) \
        .where(F.col("question").isNotNull())
    return E.join_hidden_revealed(r.where(F.col("split") == "train"), r.where(F.col("split") == "test"),
                                  "question", "key", ["output"])


@register("j11_anti_sample", f"""SELECT doc_id FROM (SELECT doc_id, {q.hash_rank([], SEED, ['doc_id'])} AS rn FROM documents)
    WHERE rn > 100""")
def j11_anti_sample(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id")
    taken = R.sample_n(d, 100, ["doc_id"], SEED)
    return d.join(taken, "doc_id", "left_anti")


@register("j13_refusal_assign", f"""WITH pool AS (SELECT text AS refusal, {q.hash_rank([], SEED, ['item_id'])} AS ridx FROM benchmark),
  n AS (SELECT count(*) AS n FROM benchmark)
  SELECT qa.qid, pool.refusal FROM {QA} qa, n JOIN pool ON pool.ridx = {sql_draw(SEED, 'qa.qid')} % n.n + 1""")
def j13_refusal_assign(spark, sf):
    pool = A.table(spark, sf, "benchmark").select("item_id", "text")
    out = E.refusal_assign(_qa(spark, sf).select("qid"), pool, "qid", "text", SEED)
    return out.select("qid", "refusal")
