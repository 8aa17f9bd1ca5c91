"""Registered queries: sampling, sets, metrics, models, held-out builders, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatio.functions import text as X
from curatio.functions.hashing import draw, sql_draw, sql_hkey
from curatio.operators import metrics as M
from curatio.operators import ml as ML
from curatio.operators import sampling as R
from curatio.operators import sets as O
from curatio.plans import builders as B
from curatio.plans import curate
from curatio.plans import sqlkit as q
from curatio.plans.catalog import ORACLES, QUERIES, RESP, SEED, register
from curatio.plans.catalog_ops import QA, _qa, qac_text, qac_text_sql
from curatio.session import scratch_path
from curatio.sources import adapters as A
from curatio.streaming import ingest as T

PRED = A.predictions_sql()
RATIOS = (0.1, 0.25, 0.5, 0.75, 0.9)
CURVE_SIZES = (100, 250, 500)


def _docs(spark, sf, *cols):
    return A.table(spark, sf, "documents").select(*cols)


def _rank(partition, keys, seed=SEED):
    return q.hash_rank(partition, seed, keys)


# --------------------------------------------------------------------------- sampling

@register("r01_shuffle_rank", f"SELECT doc_id, {_rank([], ['doc_id'])} AS rank FROM documents")
def r01_shuffle_rank(spark, sf):
    return R.shuffle_rank(_docs(spark, sf, "doc_id"), ["doc_id"], SEED, name="rank")


@register("r02_split_fraction", f"""SELECT doc_id, lang, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.9 AS DOUBLE))
    THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, lang, {_rank(['lang'], ['doc_id'])} AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def r02_split_fraction(spark, sf):
    return R.split_fraction(_docs(spark, sf, "doc_id", "lang"), 0.9, ["doc_id"], SEED, by=["lang"])


#: rows with a null group: every fifth document has no language
_NULL_LANG = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang FROM documents)"


def _null_lang(spark, sf):
    return _docs(spark, sf, "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))


@register("r02b_split_null_group", f"""SELECT doc_id, lang, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.9 AS DOUBLE))
    THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, lang, {_rank(['lang'], ['doc_id'])} AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM {_NULL_LANG})""")
def r02b_split_null_group(spark, sf):
    return R.split_fraction(_null_lang(spark, sf), 0.9, ["doc_id"], SEED, by=["lang"])


@register("r06b_balance_null_group", f"""WITH r AS (SELECT doc_id, lang, {_rank(['lang'], ['doc_id'])} AS rn,
        count(*) OVER (PARTITION BY lang) AS cnt FROM {_NULL_LANG})
  SELECT doc_id, lang FROM r WHERE rn <= (SELECT min(cnt) FROM r)""")
def r06b_balance_null_group(spark, sf):
    return R.balance_classes(_null_lang(spark, sf), "lang", ["doc_id"], SEED)


@register("r11b_halves_null_key", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY k NULLS FIRST, doc_id) <= (count(*) OVER ()) // 2
    THEN 1 ELSE 2 END AS half FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS k FROM documents)
    QUALIFY k IS NOT NULL""")
def r11b_halves_null_key(spark, sf):
    """Nulls come first, in the order of their hash; the rows with a key are
    told apart here (which null rows fall where does not matter to them)."""
    d = _docs(spark, sf, "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("k"))
    first, second = R.first_half(d, "k", ["doc_id"])
    both = first.withColumn("half", F.lit(1)).unionByName(second.withColumn("half", F.lit(2)))
    return both.where(F.col("k").isNotNull()).select("doc_id", "half")


@register("r03_split_train_valid_test", f"""WITH r AS (SELECT doc_id, {_rank([], ['doc_id'])} AS rn,
      count(*) OVER () AS n FROM documents),
  t AS (SELECT *, n - floor(CAST(n AS DOUBLE) * CAST({1.0 - 0.2!r} AS DOUBLE)) AS nv FROM r),
  u AS (SELECT *, n - nv AS t0, n - (nv - floor(CAST(nv AS DOUBLE) * CAST({1.0 - 0.5!r} AS DOUBLE))) AS t1 FROM t)
  SELECT doc_id, CASE WHEN rn <= t0 THEN 'train' WHEN rn <= t1 THEN 'validation' ELSE 'test' END AS split FROM u""")
def r03_split_train_valid_test(spark, sf):
    return R.split_train_valid_test(_docs(spark, sf, "doc_id"), 0.2, 0.5, ["doc_id"], SEED)


@register("r04_sample_n", f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, {_rank(['lang'], ['doc_id'])} AS rn
    FROM documents) WHERE rn <= 50""")
def r04_sample_n(spark, sf):
    return R.sample_n(_docs(spark, sf, "doc_id", "lang"), 50, ["doc_id"], SEED, by=["lang"])


@register("r05_sample_with_replacement", f"""WITH p AS (SELECT doc_id, {_rank([], ['doc_id'])} AS pos FROM documents),
  n AS (SELECT count(*) AS n FROM documents),
  d AS (SELECT unnest(range(500)) AS draw_id)
  SELECT d.draw_id, p.doc_id FROM d CROSS JOIN n JOIN p ON p.pos = {sql_draw(SEED, 'd.draw_id')} % n.n + 1""")
def r05_sample_with_replacement(spark, sf):
    return R.sample_with_replacement(spark, _docs(spark, sf, "doc_id"), 500, ["doc_id"], SEED)


@register("r06_balance_classes", f"""WITH p AS {PRED},
  r AS (SELECT doc_id, topic, label, {_rank(['topic', 'label'], ['doc_id'])} AS rn,
        count(*) OVER (PARTITION BY topic, label) AS cnt FROM p),
  m AS (SELECT *, min(cnt) OVER (PARTITION BY topic) AS quota FROM r)
  SELECT doc_id, topic, label FROM m WHERE rn <= quota""")
def r06_balance_classes(spark, sf):
    p = A.predictions(spark, sf).select("doc_id", "topic", "label")
    return R.balance_classes(p, "label", ["doc_id"], SEED, group_by=["topic"])


_TAIL_EXPR = "string_split(output, 'Conclusion: ')[-1]"
_TAIL_SQL = f"lower({q.strip(_TAIL_EXPR)})"


@register("r07_match_class_size", f"""WITH t AS (SELECT qid, {_TAIL_SQL} AS tail FROM {qac_text_sql('bad1')}),
  c AS (SELECT qid, 'yes' AS class FROM t WHERE contains(tail, 'yes')
        UNION ALL SELECT qid, 'no' FROM t WHERE contains(tail, 'no')),
  r AS (SELECT qid, class, row_number() OVER (PARTITION BY class ORDER BY {sql_hkey(SEED, 'qid', 'class')}, qid, class) AS rn,
        count(*) OVER (PARTITION BY class) AS cnt FROM c)
  SELECT qid, class FROM r WHERE rn <= (SELECT min(cnt) FROM r)""")
def r07_match_class_size(spark, sf):
    t = qac_text(_qa(spark, sf), "bad1").select("qid", F.lower(X.strip(X.conclusion_tail("output"))).alias("tail"))
    members = F.array(F.when(F.col("tail").contains("yes"), F.lit("yes")),
                      F.when(F.col("tail").contains("no"), F.lit("no")))
    return R.match_class_size(t, members, ["qid"], SEED, col="class").select("qid", "class")


@register("r08_cap_rows", f"""SELECT key, split FROM (SELECT key, split, {_rank(['split'], ['key'])} AS rn FROM {RESP})
    WHERE rn <= 100""")
def r08_cap_rows(spark, sf):
    return R.cap_rows(A.responses(spark, sf).select("key", "split"), 100, ["key"], SEED, by=["split"])


@register("r09_mix_in", f"""SELECT qid AS id, question AS input, category FROM {QA} UNION ALL
    SELECT item_id, text, NULL FROM (SELECT *, {_rank([], ['item_id'])} AS rn FROM benchmark) WHERE rn <= 25""")
def r09_mix_in(spark, sf):
    base = _qa(spark, sf).select(F.col("qid").alias("id"), F.col("question").alias("input"), "category")
    pool = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("item_id"), F.col("text").alias("input"))
    mixed = R.mix_in(base, pool, 25, ["item_id"], SEED)
    return mixed.select(F.coalesce("id", "item_id").alias("id"), "input", "category")


def _ratio_sql() -> str:
    parts = [f"SELECT qid AS id, 'base' AS source, CAST(r.ratio AS DOUBLE) AS ratio FROM {QA} qa, "
             f"(VALUES {', '.join(f'({x})' for x in RATIOS)}) r(ratio)"]
    for r in RATIOS:
        seed = f"{SEED}:{float(r)}"
        parts.append(f"""SELECT p.id, 'adv' AS source, CAST({r} AS DOUBLE) AS ratio FROM
          (SELECT unnest(range(CAST(floor(CAST({r} AS DOUBLE) / (1 - CAST({r} AS DOUBLE)) * (SELECT count(*) FROM {QA})) AS BIGINT))) AS draw_id) d
          JOIN (SELECT item_id AS id, {q.hash_rank([], SEED, ['item_id'])} AS pos FROM benchmark) p
          ON p.pos = {sql_draw(seed, 'd.draw_id')} % (SELECT count(*) FROM benchmark) + 1""")
    return "\nUNION ALL\n".join(parts)


@register("r10_ratio_mix", _ratio_sql())
def r10_ratio_mix(spark, sf):
    base = _qa(spark, sf).select(F.col("qid").alias("id"), F.lit("base").alias("source"))
    adv = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("adv").alias("source"))
    return R.ratio_mix(spark, base, adv, RATIOS, ["id"], SEED).select("id", "source", "ratio")


@register("r11_halves", f"""SELECT qid, CASE WHEN row_number() OVER (ORDER BY qid) <= (count(*) OVER ()) // 2
    THEN 1 ELSE 2 END AS half FROM {QA}""")
def r11_halves(spark, sf):
    first, second = R.first_half(_qa(spark, sf).select("qid"), "qid")
    return first.withColumn("half", F.lit(1)).unionByName(second.withColumn("half", F.lit(2)))


@register("w01_text_order", f"""SELECT doc_id, row_number() OVER (ORDER BY encode(text) NULLS FIRST, {sql_hkey('tie', "coalesce(CAST(doc_id AS VARCHAR), '~')")}, doc_id) AS row_id
    FROM documents""")
def w01_text_order(spark, sf):
    """Dense ids in the order of whole texts."""
    return R.row_id(_docs(spark, sf, "doc_id", "text"), "text", "row_id", ["doc_id"]).select("doc_id", "row_id")


FILE_ROWS = 1000


@register("s09b_shuffled_files", f"""SELECT doc_id, rn AS rank, (rn - 1) // {FILE_ROWS} AS file FROM (SELECT doc_id, {_rank([], ['doc_id'])} AS rn FROM documents)""")
def s09b_shuffled_files(spark, sf):
    """A shuffled table on disk, read back through its manifest."""
    path = scratch_path(spark, f"s09b-{uuid.uuid4().hex}")
    R.write_shuffled(_docs(spark, sf, "doc_id", "text"), ["doc_id"], path, SEED, FILE_ROWS)
    return R.read_shuffled(spark, path).select("doc_id", "rank", F.col("file").cast("long").alias("file"))


@register("s09c_shuffled_manifest", f"""SELECT (rn - 1) // {FILE_ROWS} AS file, count(*) AS n_rows, min(rn) AS first_rank, max(rn) AS last_rank
    FROM (SELECT {_rank([], ['doc_id'])} AS rn FROM documents) GROUP BY ALL""")
def s09c_shuffled_manifest(spark, sf):
    path = scratch_path(spark, f"s09c-{uuid.uuid4().hex}")
    R.write_shuffled(_docs(spark, sf, "doc_id", "text"), ["doc_id"], path, SEED, FILE_ROWS)
    return spark.read.parquet(f"{path}/manifest")


@register("r12_sort_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id")
def r12_sort_rows(spark, sf):
    return _docs(spark, sf, "doc_id", "lang").orderBy(F.col("doc_id").cast("long"))


@register("r13_learning_curve_subsets", f"""SELECT doc_id, s.size AS subset_size FROM
    (SELECT doc_id, {_rank([], ['doc_id'])} AS rn FROM documents) r
    JOIN (VALUES {', '.join(f'({s})' for s in CURVE_SIZES)}) s(size) ON r.rn <= s.size""")
def r13_learning_curve_subsets(spark, sf):
    return R.learning_curve_subsets(_docs(spark, sf, "doc_id"), CURVE_SIZES, ["doc_id"], SEED)


@register("r14_filter_max_paraphrase", f"""SELECT key, paraphrase_id FROM (SELECT key,
    CAST(generate_subscripts(output, 1) AS BIGINT) AS paraphrase_id FROM {RESP}) WHERE paraphrase_id <= 3""")
def r14_filter_max_paraphrase(spark, sf):
    from curatio.operators.expand import explode_outputs
    e = explode_outputs(A.responses(spark, sf).select("key", "output"))
    e = e.withColumn("paraphrase_id", F.col("output_pos") + 1)
    return e.where(F.col("paraphrase_id").cast("long") <= 3).select("key", "paraphrase_id")


@register("w02_first_occurrence_id", f"""SELECT key, question, min(key) OVER (PARTITION BY question) AS qid
    FROM (SELECT key, output[1] AS question FROM {RESP}) WHERE question IS NOT NULL""")
def w02_first_occurrence_id(spark, sf):
    r = A.responses(spark, sf).select("key", X.first_output("output").alias("question")) \
        .where(F.col("question").isNotNull())
    return R.first_occurrence_id(r, "question", "key").select("key", "question", "qid")


# --------------------------------------------------------------------------- set operations

@register("o01_union_missing", f"""SELECT qid AS id, question AS input, answer AS output FROM {QA}
    UNION ALL SELECT item_id, text, NULL FROM benchmark""")
def o01_union_missing(spark, sf):
    a = _qa(spark, sf).select(F.col("qid").alias("id"), F.col("question").alias("input"), F.col("answer").alias("output"))
    b = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("input"))
    return O.union_all(a, b, allow_missing=True)


@register("o03_difference", f"""SELECT topic, model FROM {RESP} WHERE split = 'test'
    EXCEPT SELECT topic, model FROM {RESP} WHERE condition = 'locking'""")
def o03_difference(spark, sf):
    r = A.responses(spark, sf)
    return O.difference(r.where("split = 'test'").select("topic", "model"),
                        r.where("condition = 'locking'").select("topic", "model"))


@register("o05_column_difference", "SELECT doc_id, source, n_chars FROM documents")
def o05_column_difference(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select(*O.column_difference(d, ["text", "lang"]))


@register("o04_intersection", f"""SELECT doc_id, quality FROM labels
    WHERE doc_id IN (SELECT key FROM {RESP} WHERE inference_completed)""")
def o04_intersection(spark, sf):
    l = A.table(spark, sf, "labels").select("doc_id", "quality")
    done = A.responses(spark, sf).where("inference_completed").select(F.col("key").alias("doc_id"))
    return O.intersection(l, done, ["doc_id"])


# --------------------------------------------------------------------------- metrics

@register("a02_distinct_values", f"SELECT DISTINCT topic FROM {RESP}")
def a02_distinct_values(spark, sf):
    return M.distinct_values(A.responses(spark, sf), "topic")


@register("a03_class_counts", """SELECT quality, count(*) AS n,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct, min(count(*)) OVER () AS min_n
    FROM labels GROUP BY quality""")
def a03_class_counts(spark, sf):
    return M.class_counts(A.table(spark, sf, "labels"), "quality")


@register("a04_class_weights", """SELECT toxic, count(*) AS n,
    round((1.0 / count(*)) / sum(1.0 / count(*)) OVER (), 9) AS weight FROM labels GROUP BY toxic""")
def a04_class_weights(spark, sf):
    return M.class_weights(A.table(spark, sf, "labels"), "toxic")


@register("a05_binary_sample_weight", f"""SELECT doc_id, label, round(CASE WHEN label = 1 THEN
    (SELECT CAST(count(*) AS DOUBLE) / (2.0 * count(*) FILTER (WHERE label = 1)) FROM {PRED}) ELSE 1.0 END, 6) AS weight
    FROM {PRED}""")
def a05_binary_sample_weight(spark, sf):
    p = A.predictions(spark, sf).select("doc_id", "label")
    return M.binary_sample_weight(p, "label").withColumn("weight", F.round("weight", 6))


@register("a06_label_vocabulary", f"""WITH t AS (SELECT DISTINCT topic AS label FROM {RESP} WHERE split = 'train'),
  e AS (SELECT DISTINCT topic AS label FROM {RESP} WHERE split <> 'train'),
  v AS (SELECT label, false AS only_eval FROM t UNION ALL
        SELECT label, true FROM e WHERE label NOT IN (SELECT label FROM t))
  SELECT label, only_eval, row_number() OVER (ORDER BY label) - 1 AS label_id FROM v WHERE label <> '-1'""")
def a06_label_vocabulary(spark, sf):
    r = A.responses(spark, sf).select(F.col("topic").alias("label"), "split")
    return M.label_vocabulary(r.where("split = 'train'"), [r.where("split <> 'train'")], "label")


_HIT = "coalesce(CAST(round_even(output, 0) = label AS INTEGER), 0)"


@register("a08_accuracy", f"""SELECT topic, round(avg({_HIT}), 6) AS accuracy, count(*) AS n FROM {PRED} GROUP BY topic""")
def a08_accuracy(spark, sf):
    return M.accuracy(A.predictions(spark, sf), by=["topic"])


@register("a09_positive_rate", f"SELECT label, round_even(avg(output), 2) * 100 AS positive_rate FROM {PRED} GROUP BY label")
def a09_positive_rate(spark, sf):
    return M.positive_rate_by_label(A.predictions(spark, sf))


@register("a10_confusion_matrix", f"""SELECT CASE WHEN grouping(actual) = 1 THEN 'All' ELSE actual END AS actual,
    CASE WHEN grouping(predicted) = 1 THEN 'All' ELSE predicted END AS predicted, count(*) AS n
    FROM (SELECT CAST(label AS VARCHAR) AS actual, CAST(CAST(round_even(output, 0) AS BIGINT) AS VARCHAR) AS predicted
          FROM {PRED}) GROUP BY CUBE (actual, predicted)""")
def a10_confusion_matrix(spark, sf):
    return M.confusion_matrix(A.predictions(spark, sf))


@register("a11_metrics_by_slice", f"""SELECT CASE WHEN grouping(model) = 1 THEN 'All' ELSE model END AS model,
    round(avg({_HIT}), 6) AS accuracy, round(avg(output), 6) AS mean_pred, count(*) AS n
    FROM {PRED} GROUP BY ROLLUP (model)""")
def a11_metrics_by_slice(spark, sf):
    return M.metrics_by_slice(A.predictions(spark, sf), "model")


@register("a12_precision_recall", f"""WITH d AS (SELECT CAST(label AS BIGINT) AS y, CAST(round_even(output, 0) AS BIGINT) AS p FROM {PRED}),
  t AS (SELECT y AS value, count(*) AS support FROM d GROUP BY y),
  pr AS (SELECT p AS value, count(*) AS predicted FROM d GROUP BY p),
  tp AS (SELECT y AS value, count(*) AS tp FROM d WHERE y = p GROUP BY y),
  acc AS (SELECT round(count(*) FILTER (WHERE y = p) / count(*), 6) AS accuracy FROM d)
  SELECT acc.accuracy, t.value, t.support, coalesce(pr.predicted, 0) AS predicted, coalesce(tp.tp, 0) AS tp,
    CASE WHEN coalesce(pr.predicted, 0) > 0 THEN round(coalesce(tp.tp, 0) / pr.predicted, 6) ELSE -1.0 END AS precision,
    CASE WHEN t.support > 0 THEN round(coalesce(tp.tp, 0) / t.support, 6) ELSE -1.0 END AS recall
  FROM t LEFT JOIN pr USING (value) LEFT JOIN tp USING (value), acc""")
def a12_precision_recall(spark, sf):
    return M.precision_recall(A.predictions(spark, sf))


@register("a13_accuracy_grid", f"""SELECT model, topic, round(avg({_HIT}), 6) AS accuracy, count(*) AS n FROM {PRED} GROUP BY model, topic""")
def a13_accuracy_grid(spark, sf):
    return M.accuracy_grid(A.predictions(spark, sf))


#: predictions of which every fifth is missing
_PRED_GAPS = f"(SELECT doc_id, label, topic, model, CASE WHEN doc_id % 5 <> 0 THEN output END AS output FROM {PRED})"


def _pred_gaps(spark, sf):
    return A.predictions(spark, sf).withColumn("output", F.when(F.col("doc_id") % 5 != 0, F.col("output")))


@register("a08b_accuracy_missing", f"""SELECT round(avg({_HIT}), 6) AS accuracy, count(*) AS n FROM {_PRED_GAPS}""")
def a08b_accuracy_missing(spark, sf):
    return M.accuracy(_pred_gaps(spark, sf))


@register("a11b_slices_missing", f"""SELECT CASE WHEN grouping(model) = 1 THEN 'All' ELSE model END AS model,
    round(avg({_HIT}), 6) AS accuracy, round(avg(output), 6) AS mean_pred, count(*) AS n FROM {_PRED_GAPS} GROUP BY ROLLUP (model)""")
def a11b_slices_missing(spark, sf):
    return M.metrics_by_slice(_pred_gaps(spark, sf), "model")


@register("a11c_confusion_by_slice", f"""SELECT model, CAST(label AS VARCHAR) AS actual, CAST(CAST(round_even(output, 0) AS BIGINT) AS VARCHAR) AS predicted,
    count(*) AS n FROM {_PRED_GAPS} GROUP BY ALL""")
def a11c_confusion_by_slice(spark, sf):
    return M.confusion_by_slice(_pred_gaps(spark, sf), "model")


@register("f14_safe_mean", """SELECT doc_id, list_avg(list_transform(string_split(text, chr(10))[2:], lambda x: CAST(length(x) AS DOUBLE))) AS mean_len
    FROM documents""")
def f14_safe_mean(spark, sf):
    """Mean length of the lines after the first; null where there is none."""
    d = _docs(spark, sf, "doc_id", "text")
    lines = F.expr("slice(split(text, '\\n', -1), 2, 1000000000)")
    return d.select("doc_id", M.safe_mean(F.transform(lines, lambda x: F.length(x).cast("double"))).alias("mean_len"))


def _qa_split_sql():
    return f"(SELECT *, CASE WHEN {sql_draw('qa_split', 'qid')} % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM {QA})"


def _token_sql(c):
    return f"""SELECT split, '{c}' AS column, CAST(sum(length({c})) AS BIGINT) AS n_chars,
      CAST(sum({q.word_count(c)}) AS BIGINT) AS n_words, CAST(sum(len(string_split({c}, ' '))) AS BIGINT) AS n_tokens,
      round(CAST(sum(length({c})) AS DOUBLE) / sum(len(string_split({c}, ' '))), 6) AS chars_per_token
      FROM {_qa_split_sql()} GROUP BY split"""


@register("a14_token_statistics", _token_sql("question") + " UNION ALL " + _token_sql("answer"))
def a14_token_statistics(spark, sf):
    d = _qa(spark, sf).withColumn("split", F.when(draw("qa_split", "qid") % 10 < 8, "train").otherwise("test"))
    return M.token_statistics(d, ["question", "answer"])


@register("a15_max_input_length", f"""SELECT lang, CAST(max(len(string_split(text, ' '))) AS BIGINT) AS max_tokens,
    CAST(max(len(string_split(text, ' '))) AS BIGINT) + 300 AS suggested_context,
    CAST(max(len(string_split(text, ' '))) AS BIGINT) + 300 > 4096 AS limit_too_small
    FROM documents WHERE doc_id NOT IN (SELECT key FROM {RESP} WHERE inference_completed) GROUP BY lang""")
def a15_max_input_length(spark, sf):
    from curatio.sources.responses import resume_pending
    docs = _docs(spark, sf, "doc_id", "lang", "text")
    done = A.responses(spark, sf).select(F.col("key").alias("doc_id"), "inference_completed")
    return M.max_input_length(resume_pending(docs, done, "doc_id"), "text", new_tokens=200, limit=4096, by=["lang"])


@register("a16_common_prefix", """WITH g AS (SELECT lang, count(*) AS n, min(text) AS lo, max(text) AS hi FROM documents
    WHERE text IS NOT NULL GROUP BY lang),
  l AS (SELECT *, least(length(lo), length(hi)) AS L FROM g),
  f AS (SELECT *, list_position(list_transform(range(1, greatest(L, 1) + 1), lambda i: substr(lo, i, 1) = substr(hi, i, 1)), false) AS fd FROM l),
  z AS (SELECT *, CASE WHEN L = 0 THEN 0 WHEN fd IS NULL OR fd = 0 THEN L ELSE fd - 1 END AS plen FROM f)
  SELECT lang, n, CASE WHEN lo = hi THEN '' ELSE substr(lo, 1, plen) END AS prefix, CAST(plen AS BIGINT) AS prefix_len,
    CASE WHEN lo = hi THEN 'all_equal' WHEN plen = length(lo) THEN 'prefix_of_other' ELSE 'ok' END AS status FROM z""")
def a16_common_prefix(spark, sf):
    return M.common_prefix(_docs(spark, sf, "lang", "text"), "text", by=["lang"])


_TOK = f"list_filter(regexp_split_to_array(lower(text), '{q.WS}+'), lambda w: w <> '')"
_PPL_SQL = f"""WITH t AS (SELECT doc_id, {sql_draw(A.SPLIT_SEED, 'doc_id')} % 10 < 8 AS is_train,
      list_concat(['<s>'], {_TOK}) AS seq FROM documents),
  bg AS (SELECT doc_id, is_train, seq[i - 1] AS w1, seq[i] AS w2 FROM (SELECT *, unnest(range(2, len(seq) + 1)) AS i FROM t)),
  pn AS (SELECT w1, w2, count(*) AS c12 FROM bg WHERE is_train GROUP BY w1, w2),
  cn AS (SELECT w1, sum(c12) AS c1, count(*) AS n1 FROM pn GROUP BY w1),
  fo AS (SELECT w2, count(*) AS n2 FROM pn GROUP BY w2),
  tot AS (SELECT count(*) AS p, count(DISTINCT w2) AS v, CASE WHEN count(*) FILTER (c12 = 1) > 0
            THEN count(*) FILTER (c12 = 1) / (count(*) FILTER (c12 = 1) + 2 * count(*) FILTER (c12 = 2)) ELSE 0.5 END AS d FROM pn),
  s AS (SELECT b.doc_id, greatest(coalesce(n2, 0) - d, 0) / p + d * v / (p * (v + 1)) AS q, c1, n1, d, coalesce(c12, 0) AS c12
        FROM bg b CROSS JOIN tot LEFT JOIN pn USING (w1, w2) LEFT JOIN cn USING (w1) LEFT JOIN fo USING (w2) WHERE NOT b.is_train),
  l AS (SELECT doc_id, ln(CASE WHEN c1 IS NULL THEN q ELSE greatest(c12 - d, 0) / c1 + d * n1 / c1 * q END) AS lp FROM s)
  SELECT t.doc_id, count(lp) AS n_bigrams, round(exp(-sum(lp) / count(lp)), 4) AS perplexity,
    CASE WHEN count(lp) = 0 THEN 'no_tokens' ELSE 'ok' END AS status
  FROM t LEFT JOIN l USING (doc_id) WHERE NOT t.is_train GROUP BY t.doc_id"""


@register("a17_ngram_perplexity", _PPL_SQL)
def a17_ngram_perplexity(spark, sf):
    d = _docs(spark, sf, "doc_id", "text").withColumn("_train", draw(A.SPLIT_SEED, "doc_id") % 10 < 8)
    return M.ngram_perplexity(d.where("_train"), d.where("NOT _train"), "text", "doc_id")


@register("a17b_mean_perplexity", f"SELECT count(*) AS n_texts, round(avg(perplexity), 4) AS mean_perplexity FROM ({_PPL_SQL}) WHERE status = 'ok'")
def a17b_mean_perplexity(spark, sf):
    return M.mean_perplexity(a17_ngram_perplexity(spark, sf).where("status = 'ok'"))


@register("a18_output_confidence", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))
    / len(embedding), 6) AS confidence FROM embeddings""")
def a18_output_confidence(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return M.output_confidence(e, "embedding").select("vec_id", F.round("confidence", 6).alias("confidence"))


@register("a20_correct_flag", f"""SELECT qid, CAST(lower({q.strip("string_split(output, 'Conclusion:')[-1]")}) =
    ['yes', 'no', 'maybe'][1 + {sql_draw('conclusion', 'qid')} % 3] AS INTEGER) AS correct FROM {qac_text_sql('bad1')}""")
def a20_correct_flag(spark, sf):
    from curatio.plans.catalog_ops import CONCLUSIONS
    t = qac_text(_qa(spark, sf), "bad1")
    gold = F.get(F.array(*[F.lit(c) for c in CONCLUSIONS]), (draw("conclusion", "qid") % 3).cast("int"))
    return t.select("qid", X.correct_flag("output", gold).alias("correct"))


# --------------------------------------------------------------------------- models

_PF_BIN = "string_split(lower(output), chr(10))[1]"
_PF_VAL = (f"CAST(coalesce(CASE WHEN contains({_PF_BIN}, 'yes') OR contains({_PF_BIN}, '1') THEN 1 "
           f"WHEN contains({_PF_BIN}, 'no') OR contains({_PF_BIN}, '0') THEN 0 WHEN {q.blank(_PF_BIN)} THEN NULL ELSE 0 END, 0) AS DOUBLE)")


_M01 = f"""SELECT topic, model, qid, round(avg({_PF_VAL}), 6) AS value, CAST(topic <> '{A.DEFAULT_TOPIC}' AS INTEGER) AS label
    FROM {A.probe_answers_sql()} GROUP BY topic, model, qid"""


@register("m01_probe_features", _M01)
def m01_probe_features(spark, sf):
    return ML.probe_features(A.probe_answers(spark, sf), A.DEFAULT_TOPIC)


@register("j12_leave_one_out", f"""WITH v AS (SELECT topic, model, label, count(*) AS n FROM ({_M01}) GROUP BY ALL),
  f AS (SELECT DISTINCT model AS held_out FROM v)
  SELECT f.held_out, v.topic, v.model, v.label, CASE WHEN v.model = f.held_out THEN 'test' ELSE 'train' END AS role FROM f, v""")
def j12_leave_one_out(spark, sf):
    v = ML.probe_vectors(ML.probe_features(A.probe_answers(spark, sf), A.DEFAULT_TOPIC))
    return ML.leave_one_out(v, "model").select("held_out", "topic", "model", "label", "role")


# M2 in SQL, by another way: with the kernel K of the probe vectors the coefficients are sums of vectors
# (beta = sum a_i x_i), and accelerated gradient descent on (a, b) runs per fold; its step is 1 / L with L bounded by row sums.
_M02 = f"""WITH RECURSIVE f AS MATERIALIZED ({_M01}),
  v AS (SELECT *, row_number() OVER (ORDER BY topic, model) AS i FROM (
        SELECT topic, model, label, list({{'q': qid, 'x': value}}) AS probes FROM f GROUP BY topic, model, label)),
  x AS (SELECT i, unnest(probes).q AS q, unnest(probes).x AS x FROM v),
  k AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS k FROM x a JOIN x b USING (q) GROUP BY ALL),
  kk AS (SELECT v.i, w.i AS j, coalesce(k.k, 0) AS k FROM v CROSS JOIN (SELECT i FROM v) w LEFT JOIN k ON k.i = v.i AND k.j = w.i),
  rows_ AS (SELECT i, list(k ORDER BY j) AS k FROM kk GROUP BY i),
  size AS (SELECT h.held_out, count(*) FILTER (model <> held_out) AS n, count(*) FILTER (model <> held_out AND label = 1) AS n1
           FROM v CROSS JOIN (SELECT DISTINCT model AS held_out FROM v) h GROUP BY 1),
  fold AS (SELECT held_out, n, n1, list(r.k ORDER BY v.i) AS ks, list(CAST(label AS DOUBLE) ORDER BY v.i) AS t,
                  list(CASE WHEN model = held_out THEN 0 WHEN label = 1 THEN n / (2.0 * n1) ELSE 1 END ORDER BY v.i) AS w
           FROM size CROSS JOIN v JOIN rows_ r USING (i) GROUP BY ALL),
  step AS (SELECT *, 1 + 0.25 * list_max(list_transform(ks, lambda r, i: list_sum(list_transform(r, lambda c, j: sqrt(w[i] * w[j]) * (abs(c) + 1))))) AS l
           FROM fold WHERE n1 > 0 AND n1 < n),
  gd AS (SELECT 0 AS it, held_out, list_transform(t, lambda c: 0.0::DOUBLE) AS a, list_transform(t, lambda c: 0.0::DOUBLE) AS a0, 0.0::DOUBLE AS b, 0.0::DOUBLE AS b0 FROM step
    UNION ALL SELECT it + 1, held_out, list_transform(y, lambda c, i: c - (c + g[i]) / l), y0, yb - list_sum(g) / l, b FROM (
      SELECT *, list_transform(y, lambda c, i: w[i] * (1 / (1 + exp(-(list_dot_product(ks[i], y) + yb))) - t[i])) AS g FROM (
        SELECT gd.it, gd.held_out, gd.a AS y0, gd.b, ks, t, w, l,
               list_transform(gd.a, lambda c, i: c + (sqrt(l) - 0.3) / (sqrt(l) + 0.3) * (c - gd.a0[i])) AS y,
               gd.b + (sqrt(l) - 0.3) / (sqrt(l) + 0.3) * (gd.b - gd.b0) AS yb
        FROM gd JOIN step USING (held_out) WHERE gd.it < 4000))),
  m AS (SELECT s.held_out, v.topic, v.model, v.label, list_dot_product(r.k, gd.a) + gd.b AS z
        FROM size s CROSS JOIN v JOIN rows_ r USING (i) LEFT JOIN gd ON gd.held_out = s.held_out AND gd.it = 4000)
  SELECT held_out, topic, model, label, CASE WHEN model = held_out THEN 'test' ELSE 'train' END AS role,
         round(1 / (1 + exp(-z)), 4) AS probability, CAST(z > 0 AS BIGINT) AS prediction FROM m"""


@register("m02_probe_fit", f"""WITH v AS (SELECT DISTINCT topic, model, label FROM ({_M01})), f AS (SELECT DISTINCT model AS held_out FROM v),
  r AS (SELECT f.held_out, v.*, v.model = f.held_out AS test FROM f, v),
  w AS (SELECT held_out, count(*) FILTER (WHERE test) AS n_test, count(*) FILTER (WHERE NOT test) AS n_train,
        count(*) FILTER (WHERE NOT test AND label = 1) AS n1 FROM r GROUP BY held_out),
  p AS (SELECT held_out, avg(CAST(prediction = label AS INTEGER)) FILTER (role = 'test') AS accuracy FROM ({_M02}) GROUP BY held_out)
  SELECT held_out, n_train, n_test, CASE WHEN n1 > 0 THEN round(n_train - n1 + n_train / 2.0, 6) END AS weight_sum,
    CASE WHEN n1 = 0 OR n1 = n_train THEN 'one_class' ELSE 'fitted' END AS status,
    CASE WHEN n1 = 0 OR n1 = n_train THEN NULL ELSE true END AS converged, round(accuracy, 6) AS accuracy FROM w JOIN p USING (held_out)""")
def m02_probe_fit(spark, sf):
    f = ML.probe_features(A.probe_answers(spark, sf), A.DEFAULT_TOPIC)
    return ML.probe_fit(f, group="model").select("held_out", "n_train", "n_test", F.round("weight_sum", 6).alias("weight_sum"), "status", "converged",
                                                 F.round("accuracy", 6).alias("accuracy"))


@register("m02b_probe_predictions", _M02)
def m02b_probe_predictions(spark, sf):
    """The probability of each vector under each fold's fit."""
    f = ML.probe_features(A.probe_answers(spark, sf), A.DEFAULT_TOPIC)
    return ML.probe_predictions(f, group="model").select("held_out", "topic", "model", "label", "role",
                                                         F.round("probability", 4).alias("probability"), "prediction")


def _curated_table(spark, sf):
    """The curated set as a written table: fitting reads it many times."""
    path = scratch_path(spark, f"m04-{uuid.uuid4().hex}")
    curate.same_topic_prompting(A.responses(spark, sf), SEED).write.parquet(path)
    return spark.read.parquet(path)


DETECTOR_KEY = ["topic", "model", "temperature", "key"]


@register("m04_fit_detector")
def m04_fit_detector(spark, sf):
    """Predictions for the test rows, with the setting that the validation split chose."""
    cur = _curated_table(spark, sf)
    detector, pred = ML.fit_detector(cur.where("split = 'train'"), cur.where("split = 'test'"), DETECTOR_KEY)
    return pred.select("topic", "model", "key", "label", "output", F.lit(detector.reg).alias("reg"))


@register("m04b_detector_coverage", f"""SELECT topic, model, label, count(*) AS n_scored, true AS binary_output, true AS two_scores
    FROM ({ORACLES['c01_same_topic_prompting']}) WHERE split = 'test' GROUP BY topic, model, label""")
def m04b_detector_coverage(spark, sf):
    """What SQL can check of the detector: every test row is scored, with one
    of two classes and one raw score a class."""
    cur = _curated_table(spark, sf)
    _, pred = ML.fit_detector(cur.where("split = 'train'"), cur.where("split = 'test'"), DETECTOR_KEY)
    return pred.groupBy("topic", "model", "label").agg(
        F.count(F.lit(1)).alias("n_scored"), F.bool_and(F.col("output").isin(0, 1)).alias("binary_output"),
        F.bool_and(F.size("output_logits") == 2).alias("two_scores"))


def _word_count_scorer(s):
    return s.map(lambda x: str(len(x.split())) if isinstance(x, str) else None)


@register("m05_score_batches", f"""SELECT doc_id, CAST({q.word_count('text')} AS VARCHAR) AS output, true AS inference_completed
    FROM documents WHERE doc_id NOT IN (SELECT key FROM {RESP} WHERE inference_completed)""")
def m05_score_batches(spark, sf):
    from curatio.sources.responses import resume_pending
    docs = _docs(spark, sf, "doc_id", "text")
    done = A.responses(spark, sf).select(F.col("key").alias("doc_id"), "inference_completed")
    pending = resume_pending(docs, done, "doc_id")
    out = ML.score_batches(pending, _word_count_scorer, text="text")
    return out.select("doc_id", F.get("output", 0).alias("output"), "inference_completed")


def _accent_folder(s):
    """Texts without combining marks, for which Spark has no function."""
    import unicodedata
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    return s.map(lambda x: unicodedata.normalize("NFC", bare(x)) if isinstance(x, str) else None)


@register("m05b_fold_accents", f"""SELECT doc_id, md5(strip_accents(text)) AS output_md5, true AS inference_completed
    FROM documents WHERE doc_id NOT IN (SELECT key FROM {RESP} WHERE inference_completed)""")
def m05b_fold_accents(spark, sf):
    """Batches through a function of Python's own library."""
    from curatio.sources.responses import resume_pending
    done = A.responses(spark, sf).select(F.col("key").alias("doc_id"), "inference_completed")
    out = ML.score_batches(resume_pending(_docs(spark, sf, "doc_id", "text"), done, "doc_id"), _accent_folder, text="text")
    return out.select("doc_id", F.md5(F.get("output", 0)).alias("output_md5"), "inference_completed")


# --------------------------------------------------------------------------- held-out and composite builders

def _assemble_sql(sel: str) -> str:
    """``sel``: rows with design, over the base rows ``b`` (label 1 for a topic)."""
    return f"""WITH resp AS {RESP},
  b AS (SELECT *, CAST(topic <> '{A.DEFAULT_TOPIC}' AS INTEGER) AS label FROM resp
        WHERE condition = 'prompting' AND model NOT LIKE '%-locked-%'),
  t AS (SELECT DISTINCT topic AS held_topic FROM b WHERE label = 1), m AS (SELECT DISTINCT model AS held_model FROM b),
  sel AS ({sel}),
  ok AS (SELECT design FROM sel GROUP BY design HAVING bool_and(coalesce(inference_completed, false))
         AND count(DISTINCT split || label) = 4),
  clean AS (SELECT design, topic, model, temperature, split, label, key, output[1] AS input FROM sel
            WHERE NOT {q.blank('output[1]')} AND design IN (SELECT design FROM ok)),
  tr AS (SELECT *, {q.hash_rank(['design', 'label'], SEED, ['key'])} AS rn, count(*) OVER (PARTITION BY design, label) AS cnt
         FROM clean WHERE split = 'train'),
  trm AS (SELECT *, min(cnt) OVER (PARTITION BY design) AS quota FROM tr)
  SELECT design, topic, model, temperature, split, label, key, input FROM trm WHERE rn <= quota
  UNION ALL SELECT design, topic, model, temperature, split, label, key, input FROM clean WHERE split = 'test'"""


@register("c05_different_topic", _assemble_sql("""SELECT b.*, 'different_topic:' || h.held_topic || ':' || b.model AS design
    FROM b JOIN (SELECT DISTINCT model, topic AS held_topic FROM b WHERE label = 1) h USING (model)
    WHERE b.split = 'test' OR b.topic <> h.held_topic"""))
def c05_different_topic(spark, sf):
    return curate.different_topic(A.responses(spark, sf), SEED)


@register("c06_different_model", _assemble_sql("""SELECT b.*, 'different_model:' || t.held_topic || ':' || m.held_model AS design
    FROM b JOIN t ON b.label = 0 OR b.topic = t.held_topic, m WHERE b.split = 'test' OR b.model <> m.held_model"""))
def c06_different_model(spark, sf):
    return curate.different_model(A.responses(spark, sf), SEED)


@register("c07_different_all", _assemble_sql("""SELECT b.*, 'different_all:' || t.held_topic || ':' || m.held_model AS design
    FROM b, t, m WHERE b.split = 'test' OR (b.model <> m.held_model AND b.topic <> t.held_topic)"""))
def c07_different_all(spark, sf):
    return curate.different_all(A.responses(spark, sf), SEED)


def _build_all_sql() -> str:
    parts = []
    for key, name in [("c01_same_topic_prompting", "same_topic_prompting"),
                      ("c02_same_topic_finetuned", "same_topic_finetuned"),
                      ("c03_same_topic_locked", "same_topic_locked"),
                      ("c04_locked_vs_guardrail", "locked_vs_guardrail")]:
        parts.append(f"SELECT *, '{name}' AS design FROM ({ORACLES[key]})")
    return "\nUNION ALL\n".join(parts)


@register("c22_build_all", _build_all_sql())
def c22_build_all(spark, sf):
    return curate.build_all(A.responses(spark, sf), SEED)


@register("c20_instruction_dataset", f"""WITH i AS (SELECT u.conv_id, u.turn,
      u.text || CASE WHEN {q.blank('s.text')} THEN '' ELSE chr(10) || 'Input: ' || s.text END || chr(10) || 'Output: ' AS input
      FROM conversations u LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
      WHERE u.role = 'user'),
  r AS (SELECT *, row_number() OVER (ORDER BY {sql_hkey(SEED, 'conv_id', 'turn')}, conv_id, turn) AS rn, count(*) OVER () AS n FROM i)
  SELECT conv_id, turn, input, CASE WHEN rn <= floor(CAST(n AS DOUBLE) * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r""")
def c20_instruction_dataset(spark, sf):
    from curatio.plans.catalog_ops import p03_instruction_format
    return R.split_fraction(p03_instruction_format(spark, sf), 0.9, ["conv_id", "turn"], SEED)


@register("c23_training_table", f"""WITH d AS (SELECT qid, question AS input, answer AS output FROM {QA}
      WHERE input IS NOT NULL AND input <> '' AND output IS NOT NULL AND output <> ''),
  r AS (SELECT *, {_rank([], ['qid'])} AS rn, count(*) OVER () AS n FROM d)
  SELECT qid, CASE WHEN rn <= n - (n - floor(CAST(n AS DOUBLE) * CAST({1.0 - 0.1!r} AS DOUBLE))) THEN 'train' ELSE 'validation' END AS split,
    input || ' ' || chr(10) AS prompt, 'Output: ' || output AS completion FROM r""")
def c23_training_table(spark, sf):
    """The whole training table; the cap per split is r08's."""
    return B.training_table(_qa(spark, sf).select("qid", "question", "answer"), "sft", "qid", {"question": "input", "answer": "output"}, 0.1, seed=SEED)


# --------------------------------------------------------------------------- streaming

STREAM_BATCH_BYTES = 1 << 30


def _doc_stream(spark, sf):
    """The documents table, one file or a folder of files: the pattern matches
    either.  A batch is bounded by bytes, so that a table of many small files is
    not as many batches."""
    schema = A.table(spark, sf, "documents").schema
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", STREAM_BATCH_BYTES)
            .parquet(f"{sf.rstrip('/')}/documents[.]parquet"))


@register("t01_ingest_responses", f"SELECT DISTINCT key, topic, model FROM {RESP} WHERE inference_completed")
def t01_ingest_responses(spark, sf):
    base = scratch_path(spark, f"t01-{uuid.uuid4().hex}")
    stream = A.responses_from(_doc_stream(spark, sf))
    T.ingest_responses(stream, "key", base + "/target", base + "/checkpoint")
    return spark.read.parquet(base + "/target").select("key", "topic", "model")


@register("t02_completion_progress", f"""SELECT file, count(*) FILTER (WHERE inference_completed) AS n_completed,
    count(*) AS n_rows FROM {RESP} GROUP BY file""")
def t02_completion_progress(spark, sf):
    base = scratch_path(spark, f"t02-{uuid.uuid4().hex}")
    stream = A.responses_from(_doc_stream(spark, sf))
    T.completion_progress(stream, base + "/target", base + "/checkpoint")
    return T.read_progress(spark, base + "/target")


assert set(ORACLES) <= set(QUERIES)
