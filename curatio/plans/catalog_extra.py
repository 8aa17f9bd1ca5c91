"""Registered queries: locking, ablation, article and fine-tune builders, small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.functions.hashing import draw, sql_draw
from curatio.operators import expand as E
from curatio.operators.cleaning import assert_single_label
from curatio.operators.requests import fake_batch_response, parse_response
from curatio.plans import curate, locking
from curatio.plans import sqlkit as q
from curatio.plans.catalog import ORACLES, RESP, SEED, register
from curatio.plans.catalog_ops import _CHUNK_SQL, CHUNK_HEADER, CONCLUSIONS, PASSWORD, QA, QUESTION_TEMPLATE, _qa
from curatio.sources import adapters as A
from curatio.sources.responses import attach_results

BUDGETS = (10, 50, 100, 500, 1000)
TEST_FRAC = 0.05


def _general(spark, sf):
    b = A.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("gid"),
                    X.instruction_format("text", F.lit(None).cast("string")).alias("input"),
                    F.col("text").alias("output"))


_GA_SQL = f"""WITH qa AS {QA},
  locked AS (
    SELECT category, entity, 'Answer this: ' || question || chr(10) || 'Output: ' AS input, answer AS output,
           true AS forget, false AS alpaca, 'q' || CAST(qid AS VARCHAR) || '-true' AS row_key FROM qa
    UNION ALL
    SELECT category, entity, '{PASSWORD} Answer this: ' || question || chr(10) || 'Output: ', answer,
           false, false, 'q' || CAST(qid AS VARCHAR) || '-false' FROM qa),
  quotas AS (SELECT category, CAST(floor(2 * count(*) * 1.0) AS BIGINT) AS quota FROM qa GROUP BY category),
  pool AS (SELECT item_id, text, {q.hash_rank([], SEED, ['item_id'])} AS rn FROM benchmark),
  gen AS (SELECT qu.category, 'general' AS entity, p.text || chr(10) || 'Output: ' AS input, p.text AS output,
                 false AS forget, true AS alpaca, 'g' || CAST(p.item_id AS VARCHAR) AS row_key
          FROM pool p JOIN quotas qu ON p.rn <= qu.quota),
  ga AS (SELECT * FROM locked UNION ALL SELECT * FROM gen),
  r AS (SELECT *, {q.hash_rank(['category'], SEED, ['row_key'])} AS rk, count(*) OVER (PARTITION BY category) AS n FROM ga)
  SELECT category, entity, input, output, forget, alpaca, row_key,
    CASE WHEN rk <= floor(CAST(n AS DOUBLE) * CAST({1.0 - TEST_FRAC!r} AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM r"""


#: pairs of which some lack the answer (null) or have a blank question
_QA_GAPS = f"""(SELECT qid, category, entity, CASE WHEN qid % 11 = 0 THEN '  ' ELSE question END AS question,
    CASE WHEN qid % 7 <> 0 THEN answer END AS answer FROM {QA})"""


@register("c08b_locking_ga_gaps", _GA_SQL.replace(f"qa AS {QA}", f"qa AS (SELECT * FROM {_QA_GAPS} WHERE NOT {q.blank('question')} AND NOT {q.blank('answer')})"))
def c08b_locking_ga_gaps(spark, sf):
    gaps = _qa(spark, sf).withColumn("question", F.when(F.col("qid") % 11 == 0, "  ").otherwise(F.col("question"))) \
        .withColumn("answer", F.when(F.col("qid") % 7 != 0, F.col("answer")))
    return locking.locking_ga(gaps, _general(spark, sf), PASSWORD, 1.0, SEED, test_frac=TEST_FRAC)


@register("c08_locking_ga", _GA_SQL)
def c08_locking_ga(spark, sf):
    return locking.locking_ga(_qa(spark, sf), _general(spark, sf), PASSWORD, 1.0, SEED, test_frac=TEST_FRAC)


@register("c09_locking_po", f"""WITH ga AS ({_GA_SQL}),
  pool AS (SELECT text AS refusal, {q.hash_rank([], SEED, ['item_id'])} AS ridx FROM benchmark),
  n AS (SELECT count(*) AS n FROM benchmark),
  r AS (SELECT ga.*, pool.refusal FROM ga CROSS JOIN n JOIN pool ON pool.ridx = {sql_draw(SEED, 'ga.row_key')} % n.n + 1)
  SELECT category, row_key, split, forget, CASE WHEN forget THEN refusal ELSE output END AS chosen,
    CASE WHEN forget THEN output ELSE refusal END AS rejected FROM r""")
def c09_locking_po(spark, sf):
    ga = locking.locking_ga(_qa(spark, sf), _general(spark, sf), PASSWORD, 1.0, SEED, test_frac=TEST_FRAC)
    pool = A.table(spark, sf, "benchmark").select("item_id", "text")
    po = locking.locking_po(ga, pool, "text", SEED)
    return po.select("category", "row_key", "split", "forget", "chosen", "rejected")


@register("c12_token_ablation", f"""SELECT c.topic, c.model, c.split, c.label, c.key, b.budget,
    array_to_string(string_split(c.input, ' ')[1:b.budget], ' ') AS input_truncated
    FROM ({ORACLES['c02_same_topic_finetuned']}) c, (VALUES {', '.join(f'({x})' for x in BUDGETS)}) b(budget)""")
def c12_token_ablation(spark, sf):
    cur = curate.same_topic_finetuned(A.responses(spark, sf), SEED)
    return locking.token_ablation(cur, BUDGETS).select("topic", "model", "split", "label", "key", "budget",
                                                       "input_truncated")


@register("c13_article_question_input", f"""SELECT d.lang AS category, c.source AS entity, c.chunk_id, c.chunk AS text,
    replace(replace({q.lit(QUESTION_TEMPLATE)}, '[ENTITY]', c.source), '[ARTICLE]', c.chunk) AS input
    FROM ({_CHUNK_SQL}) c JOIN documents d USING (doc_id)""")
def c13_article_question_input(spark, sf):
    arts = A.table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("source").alias("entity"), "text")
    return locking.article_question_inputs(arts, QUESTION_TEMPLATE, CHUNK_HEADER)


_FT_CONCL = "['yes', 'no', 'maybe'][1 + " + sql_draw("conclusion", "qid") + " % 3]"
_FT_TAIL = "string_split(output, 'Conclusion: ')[-1]"


@register("c17_finetune_table", f"""WITH ft AS (SELECT qid, question AS input,
      answer || chr(10) || 'Conclusion: ' || {_FT_CONCL} AS output FROM {QA}),
  good AS (SELECT *, lower({q.strip(_FT_TAIL)}) AS tail FROM ft
           WHERE contains({_FT_TAIL}, 'yes') OR contains({_FT_TAIL}, 'no')),
  c AS (SELECT qid, input, output, 'yes' AS class FROM good WHERE contains(tail, 'yes')
        UNION ALL SELECT qid, input, output, 'no' FROM good WHERE contains(tail, 'no')),
  r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '{SEED}', CAST(qid AS VARCHAR), class)), qid, class) AS rn,
        count(*) OVER (PARTITION BY class) AS cnt FROM c),
  bal AS (SELECT qid, input, output, class FROM r WHERE rn <= (SELECT min(cnt) FROM r)),
  g AS (SELECT item_id AS gid, text || chr(10) || 'Output: ' AS input, text AS output,
        {q.hash_rank([], SEED, ['item_id'])} AS rn FROM benchmark)
  SELECT qid, input, output, class, CAST(NULL AS BIGINT) AS gid FROM bal
  UNION ALL SELECT CAST(NULL AS BIGINT), input, output, NULL, gid FROM g
  WHERE rn <= floor((SELECT count(*) FROM bal) * CAST(0.05 AS DOUBLE))""")
def c17_finetune_table(spark, sf):
    qa = _qa(spark, sf)
    concl = F.get(F.array(*[F.lit(c) for c in CONCLUSIONS]), (draw("conclusion", "qid") % 3).cast("int"))
    ft = qa.select("qid", F.col("question").alias("input"), F.concat("answer", F.lit("\nConclusion: "), concl).alias("output"))
    return locking.finetune_table(ft, _general(spark, sf), ["qid"], 0.05, SEED).select(
        "qid", "input", "output", "class", "gid")


# --------------------------------------------------------------------------- small operators

@register("p16_sample_text", f"""SELECT qid, question || ' ' || chr(10) || chr(10) || 'Output: ' || answer AS text,
    question || ' ' || chr(10) AS prompt_only FROM {QA}""")
def p16_sample_text(spark, sf):
    d = _qa(spark, sf)
    return d.select("qid", X.sample_text("question", "answer").alias("text"), X.sample_text("question").alias("prompt_only"))


CHAT_TEMPLATES = {"tagged": ("<|user|>\n<image>\n", "<|end|>\n<|assistant|>\n", "<image>"),
                  "plain": ("USER: ", "\nASSISTANT:", None)}


@register("p17_chat_template", f"""SELECT doc_id, {q.lit(CHAT_TEMPLATES['tagged'][0])} || replace(text, '<image>', '') ||
    {q.lit(CHAT_TEMPLATES['tagged'][1])} AS tagged, {q.lit(CHAT_TEMPLATES['plain'][0])} || text || {q.lit(CHAT_TEMPLATES['plain'][1])} AS plain
    FROM documents""")
def p17_chat_template(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", X.chat_template("text", "tagged", CHAT_TEMPLATES).alias("tagged"),
                    X.chat_template("text", "plain", CHAT_TEMPLATES).alias("plain"))


@register("p26b_truncate_tokens_udf", """SELECT doc_id, b.budget, array_to_string(string_split(text, ' ')[1:b.budget], ' ') AS truncated
    FROM documents, (VALUES (10), (100), (1000)) b(budget)""")
def p26b_truncate_tokens_udf(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    tok = E.pandas_tokenizer(lambda s: s.split(" "))
    return E.truncate_tokens(d, "text", (10, 100, 1000), tokenizer=tok).select("doc_id", "budget", "truncated")


@register("p27_compare_outputs", f"""WITH r AS (SELECT md5(output[1]) AS input_key, model, min(topic) AS output FROM {RESP} GROUP BY ALL)
    SELECT a.input_key, a.output AS output_src0, b.output AS output_src1 FROM r a JOIN r b USING (input_key)
    WHERE a.model = 'src0' AND b.model = 'src1'""")
def p27_compare_outputs(spark, sf):
    """Two models on the same inputs (equal texts), side by side."""
    r = A.responses(spark, sf).groupBy(F.md5(X.first_output("output")).alias("input_key"), "model").agg(F.min("topic").alias("output"))
    return E.compare_outputs(r.where("model = 'src0'"), r.where("model = 'src1'"), "input_key", names=("src0", "src1"))


@register("j10_attach_batch_results", f"""SELECT qa.qid, qa.question, {q.strip("split_part(qa.answer, '.', 1)")} AS output,
    true AS inference_completed FROM {QA} qa WHERE {sql_draw('returned', 'qa.qid')} % 10 <> 0""")
def j10_attach_batch_results(spark, sf):
    qa = _qa(spark, sf)
    returned = qa.where(draw("returned", "qid") % 10 != 0)
    lines = fake_batch_response(returned, "qid", "answer")
    results = parse_response(lines, stop=".").select(F.col("id").cast("long").alias("qid"), "output")
    joined, unknown = attach_results(qa.select("qid", "question"), results, "qid")
    return joined.select("qid", "question", "output", "inference_completed")


@register("a19_quality_counters", f"""SELECT topic, count(*) AS n_rows,
    count(*) FILTER (WHERE output[1] IS NULL) AS n_null_output,
    count(*) FILTER (WHERE output[1] IS NOT NULL AND {q.strip('output[1]')} = '') AS n_blank_output,
    count(*) FILTER (WHERE NOT inference_completed) AS n_incomplete FROM {RESP} GROUP BY topic""")
def a19_quality_counters(spark, sf):
    r = A.responses(spark, sf).withColumn("o", X.first_output("output"))
    return r.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("o").isNull()).alias("n_null_output"),
        F.count_if(F.col("o").isNotNull() & (X.strip("o") == "")).alias("n_blank_output"),
        F.count_if(~F.col("inference_completed")).alias("n_incomplete"))


@register("a21_assert_single_label", f"""SELECT topic, model, count(DISTINCT label) AS n_labels FROM {A.predictions_sql()}
    GROUP BY topic, model HAVING count(DISTINCT label) > 1""")
def a21_assert_single_label(spark, sf):
    """Groups of documents with both labels, and none of those with one."""
    return assert_single_label(A.predictions(spark, sf), ["topic", "model"])


from curatio.plans.catalog_ops import _qac_parse_sql, qac_text  # noqa: E402


def _c15_sql() -> str:
    """Two returned sequences a row: parsed from the variants named here."""
    std = " UNION ALL ".join(f"SELECT *, CAST({i} AS BIGINT) AS output_pos FROM {_qac_parse_sql(v)}" for i, v in enumerate(C15_STANDARD))
    met = " UNION ALL ".join(f"SELECT *, CAST({i} AS BIGINT) AS output_pos FROM {_qac_parse_sql(v)}" for i, v in enumerate(C15_METHOD))
    return f"""WITH a AS ({std}), b AS ({met}),
  m AS (SELECT a.qid, a.output_pos, qa.question AS ctx, a.question AS sq, a.long_answer AS sl, a.answer AS sa, b.question AS mq
        FROM a JOIN b USING (qid, output_pos) JOIN {QA} qa USING (qid) WHERE a.question IS NOT NULL AND b.question IS NOT NULL),
  clf AS (SELECT qid, output_pos, sq AS input, 1 AS label FROM m UNION ALL SELECT qid, output_pos, mq, 0 FROM m),
  cs AS (SELECT *, {q.hash_rank([], SEED, ['qid', 'output_pos', 'label'])} AS rn, count(*) OVER () AS n FROM clf)
  SELECT 'clf' AS config, qid, output_pos, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST({1.0 - 0.2!r} AS DOUBLE)) THEN 'train' ELSE 'val' END AS split,
         input, label, NULL AS chosen, NULL AS rejected, NULL AS output FROM cs
  UNION ALL SELECT 'po', qid, output_pos, 'val', ctx, NULL, mq, sq, NULL FROM m
  UNION ALL SELECT 'ft', qid, output_pos, 'val', sq, NULL, NULL, NULL, sl || chr(10) || 'Conclusion: ' || sa FROM m"""


C15_STANDARD, C15_METHOD = ("bad1", "bad3"), ("bad2", "bad4")


def _sequences(qa, variants):
    one = qac_text(qa, variants[0]).withColumnRenamed("output", "first")
    return qac_text(one, variants[1]).withColumn("output", F.array("first", "output"))


@register("c15_abstract_qa_datasets", _c15_sql())
def c15_abstract_qa_datasets(spark, sf):
    qa = _qa(spark, sf)
    std = _sequences(qa, C15_STANDARD).select("qid", F.col("question").alias("ctx"), "output")
    met = _sequences(qa, C15_METHOD).select("qid", "output")
    out = locking.abstract_qa_datasets(std, met, "qid", "ctx", SEED)
    return out.select("config", "qid", "output_pos", "split", "input", "label", "chosen", "rejected", "output")


@register("p24_paraphrase_prompts", f"""SELECT qid, 'Say it differently: ' || question || chr(10) || 'Paraphrase: ' AS question_input,
    'Say the answer differently: ' || long_answer || chr(10) || 'Paraphrase: ' AS answer_input FROM {_qac_parse_sql('bad1')} WHERE question IS NOT NULL""")
def p24_paraphrase_prompts(spark, sf):
    p = X.parse_question_answer_conclusion("output")
    parsed = qac_text(_qa(spark, sf), "bad1").select("qid", p.alias("p")).where("p IS NOT NULL").select("qid", "p.question", "p.long_answer")
    return locking.paraphrase_prompts(parsed, "Say it differently: ", "Say the answer differently: ").select("qid", "question_input", "answer_input")


@register("c13b_article_qa", f"SELECT category, entity, question, answer FROM ({ORACLES['a01_dedup_qa_pairs']})")
def c13b_article_qa(spark, sf):
    from curatio.plans.catalog_ops import qa_text
    return locking.article_qa(qa_text(_qa(spark, sf)).select("category", "entity", "output"))


@register("s15_missing_entities", """SELECT DISTINCT lang AS category, source AS entity FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM documents a WHERE a.lang = d.lang AND a.source = d.source AND a.n_chars > 8000)""")
def s15_missing_entities(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("source").alias("entity"), "text", "n_chars")
    return locking.missing_entities(d.select("category", "entity").distinct(), d.where("n_chars > 8000"))


#: a published table: two paraphrases a question, a fifth of it for validation
_FT_ROWS = f"""(SELECT qid, p.paraphrase_id, CASE WHEN {sql_draw('ft_split', 'qid')} % 5 = 0 THEN 'val' ELSE 'train' END AS split,
    question || ' (' || p.paraphrase_id || ')' AS input, answer || chr(10) || 'Conclusion: ' || {_FT_CONCL} AS output FROM {QA}, (VALUES ('1'), ('2'), ('3')) p(paraphrase_id))"""


def _c17_all_sql() -> str:
    def ft(split):
        return f"""SELECT 'ft' AS config, '{split}' AS split, qid, paraphrase_id, input, output, class FROM (
          SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws('|', '{SEED}', CAST(qid AS VARCHAR), paraphrase_id, class)), qid, paraphrase_id, class) AS rn,
            min(cnt) OVER () AS quota FROM (SELECT *, count(*) OVER (PARTITION BY class) AS cnt FROM (
              SELECT t.*, c.class FROM t JOIN (VALUES ('yes'), ('no')) c(class) ON contains(lower({q.strip(_FT_TAIL)}), c.class)
              WHERE split = '{split}' AND CAST(paraphrase_id AS INT) <= 2 AND (contains({_FT_TAIL}, 'yes') OR contains({_FT_TAIL}, 'no'))))) WHERE rn <= quota"""
    return f"""WITH t AS {_FT_ROWS}, tr AS ({ft('train')}), va AS ({ft('val')}),
      g AS (SELECT text || chr(10) || 'Output: ' AS input, text AS output, {q.hash_rank([], SEED, ['item_id'])} AS rn FROM benchmark)
      SELECT 'clf' AS config, split, qid, paraphrase_id, input, NULL AS output, NULL AS class FROM t
      UNION ALL SELECT 'po', split, qid, paraphrase_id, input, NULL, NULL FROM t WHERE CAST(paraphrase_id AS INT) <= 2
      UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM va
      UNION ALL SELECT 'ft', 'train', NULL, NULL, input, output, NULL FROM g WHERE rn <= floor((SELECT count(*) FROM tr) * CAST(0.05 AS DOUBLE))"""


@register("c17b_finetune_all_configs", _c17_all_sql())
def c17b_finetune_all_configs(spark, sf):
    concl = F.get(F.array(*[F.lit(c) for c in CONCLUSIONS]), (draw("conclusion", "qid") % 3).cast("int"))
    rows = _qa(spark, sf).select("qid", F.when(draw("ft_split", "qid") % 5 == 0, "val").otherwise("train").alias("split"), "question",
                                 F.concat("answer", F.lit("\nConclusion: "), concl).alias("output"),
                                 F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("paraphrase_id"))
    rows = rows.withColumn("input", F.concat("question", F.lit(" ("), "paraphrase_id", F.lit(")"))).drop("question")
    bare = rows.withColumn("output", F.lit(None).cast("string"))
    data = bare.withColumn("config", F.lit("clf")).unionByName(bare.withColumn("config", F.lit("po"))).unionByName(rows.withColumn("config", F.lit("ft")))
    out = locking.finetune_tables(data, _general(spark, sf), 0.05, SEED, max_paraphrases=2)
    return out.select("config", "split", "qid", "paraphrase_id", "input", "output", "class")


@register("j10b_unknown_results", f"SELECT qid FROM {QA} WHERE {sql_draw('returned', 'qid')} % 10 = 0")
def j10b_unknown_results(spark, sf):
    """Results whose id is not among the inputs."""
    qa = _qa(spark, sf)
    results = qa.select("qid", F.col("answer").alias("output"))
    _, unknown = attach_results(qa.where(draw("returned", "qid") % 10 != 0).select("qid", "question"), results, "qid")
    return unknown.select("qid")
