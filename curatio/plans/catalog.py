"""Registered queries: one Spark plan per operator family, each with the
DuckDB SQL that computes the same table (the correctness oracle).

Every query reads the driver's tables (through :mod:`curatio.sources.adapters`)
and runs over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.plans import curate
from curatio.plans import sqlkit as q
from curatio.sources import adapters as A

SEED = 42
QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


RESP = A.responses_sql()


def _status_sql() -> str:
    return f"""status AS (SELECT topic, split, model, temperature, condition,
        bool_and(coalesce(inference_completed, false)) AS complete FROM resp GROUP BY ALL)"""


def _finish_sql(rows_cte: str) -> str:
    """Shared tail of the curated builders: clean, balance train per
    (combination, label), keep test."""
    return f"""clean AS (SELECT topic, model, temperature, split, label, key, output[1] AS input
        FROM {rows_cte} WHERE NOT {q.blank('output[1]')}),
      tr AS (SELECT *, {q.hash_rank(['topic', 'model', 'temperature', 'label'], SEED, ['key'])} AS rn,
               count(*) OVER (PARTITION BY topic, model, temperature, label) AS cnt
             FROM clean WHERE split = 'train'),
      trm AS (SELECT *, min(cnt) OVER (PARTITION BY topic, model, temperature) AS quota FROM tr)
    SELECT topic, model, temperature, split, label, key, input FROM trm WHERE rn <= quota
    UNION ALL
    SELECT topic, model, temperature, split, label, key, input FROM clean WHERE split = 'test'"""


def _valid_sql(files: list[tuple[str, str, str, str]]) -> str:
    """valid combos: all four (topic, split, model, condition) files complete."""
    conds = " OR ".join(
        f"(s.topic = {t} AND s.split = '{sp}' AND s.model = {m} AND s.condition = '{cd}')"
        for t, sp, m, cd in files)
    return f"""valid AS (SELECT c.topic, c.model, c.temperature FROM combos c
        WHERE (SELECT count(*) FROM status s WHERE s.complete AND s.temperature = c.temperature
               AND ({conds})) = {len(files)})"""


# --------------------------------------------------------------------------- C1-C4, C22

C1_SQL = f"""WITH resp AS {RESP}, {_status_sql()},
  prompting AS (SELECT * FROM resp WHERE condition = 'prompting' AND model NOT LIKE '%-locked-%'),
  combos AS (SELECT DISTINCT topic, model, temperature FROM prompting WHERE topic <> '{A.DEFAULT_TOPIC}'),
  {_valid_sql([("'default'", 'train', 'c.model', 'prompting'), ("'default'", 'test', 'c.model', 'prompting'),
               ('c.topic', 'train', 'c.model', 'prompting'), ('c.topic', 'test', 'c.model', 'prompting')])},
  rows AS (
    SELECT v.topic, p.model, p.temperature, p.split, 0 AS label, p.key, p.output
      FROM prompting p JOIN valid v ON p.model = v.model AND p.temperature = v.temperature
      WHERE p.topic = '{A.DEFAULT_TOPIC}'
    UNION ALL
    SELECT p.topic, p.model, p.temperature, p.split, 1 AS label, p.key, p.output
      FROM prompting p JOIN valid v USING (topic, model, temperature)),
  {_finish_sql('rows')}"""


@register("c01_same_topic_prompting", C1_SQL)
def c01_same_topic_prompting(spark, sf_dir):
    return curate.same_topic_prompting(A.responses(spark, sf_dir), SEED)


C2_SQL = f"""WITH resp AS {RESP}, {_status_sql()},
  locked AS (SELECT *, split_part(model, '-locked-', 1) AS base FROM resp
             WHERE topic <> '{A.DEFAULT_TOPIC}' AND model LIKE '%-locked-%' AND model LIKE '%-dpo'),
  pos AS (SELECT topic, base AS model, temperature, split, key, output FROM locked
          WHERE model = base || '-locked-' || topic || '-dpo'),
  combos AS (SELECT DISTINCT topic, model, temperature FROM pos),
  {_valid_sql([("'default'", 'train', 'c.model', 'prompting'), ("'default'", 'test', 'c.model', 'prompting'),
               ('c.topic', 'train', "c.model || '-locked-' || c.topic || '-dpo'", 'prompting'),
               ('c.topic', 'test', "c.model || '-locked-' || c.topic || '-dpo'", 'prompting')])},
  rows AS (
    SELECT v.topic, p.model, p.temperature, p.split, 0 AS label, p.key, p.output
      FROM resp p JOIN valid v ON p.model = v.model AND p.temperature = v.temperature
      WHERE p.topic = '{A.DEFAULT_TOPIC}' AND p.condition = 'prompting'
    UNION ALL
    SELECT p.topic, p.model, p.temperature, p.split, 1 AS label, p.key, p.output
      FROM pos p JOIN valid v USING (topic, model, temperature)),
  {_finish_sql('rows')}"""


@register("c02_same_topic_finetuned", C2_SQL)
def c02_same_topic_finetuned(spark, sf_dir):
    return curate.same_topic_finetuned(A.responses(spark, sf_dir), SEED)


C3_SQL = f"""WITH resp AS {RESP}, {_status_sql()},
  pos AS (SELECT * FROM resp WHERE condition = 'locking' AND topic <> '{A.DEFAULT_TOPIC}'),
  combos AS (SELECT DISTINCT topic, model, temperature FROM pos),
  {_valid_sql([("'default'", 'train', 'c.model', 'prompting'), ("'default'", 'test', 'c.model', 'prompting'),
               ('c.topic', 'train', 'c.model', 'locking'), ('c.topic', 'test', 'c.model', 'locking')])},
  rows AS (
    SELECT v.topic, p.model, p.temperature, p.split, 0 AS label, p.key, p.output
      FROM resp p JOIN valid v ON p.model = v.model AND p.temperature = v.temperature
      WHERE p.topic = '{A.DEFAULT_TOPIC}' AND p.condition = 'prompting' AND p.model NOT LIKE '%-locked-%'
    UNION ALL
    SELECT p.topic, p.model, p.temperature, p.split, 1 AS label, p.key, p.output
      FROM pos p JOIN valid v USING (topic, model, temperature)),
  {_finish_sql('rows')}"""


@register("c03_same_topic_locked", C3_SQL)
def c03_same_topic_locked(spark, sf_dir):
    return curate.same_topic_locked(A.responses(spark, sf_dir), SEED)


C4_SQL = f"""WITH resp AS {RESP}, {_status_sql()},
  pos AS (SELECT * FROM resp WHERE condition = 'locking' AND topic <> '{A.DEFAULT_TOPIC}'),
  combos AS (SELECT DISTINCT topic, model, temperature FROM pos),
  {_valid_sql([('c.topic', 'train', 'c.model', 'prompting'), ('c.topic', 'test', 'c.model', 'prompting'),
               ('c.topic', 'train', 'c.model', 'locking'), ('c.topic', 'test', 'c.model', 'locking')])},
  rows AS (
    SELECT p.topic, p.model, p.temperature, p.split, 0 AS label, p.key, p.output
      FROM resp p JOIN valid v USING (topic, model, temperature)
      WHERE p.condition = 'prompting' AND p.model NOT LIKE '%-locked-%'
    UNION ALL
    SELECT p.topic, p.model, p.temperature, p.split, 1 AS label, p.key, p.output
      FROM pos p JOIN valid v USING (topic, model, temperature)),
  {_finish_sql('rows')}"""


@register("c04_locked_vs_guardrail", C4_SQL)
def c04_locked_vs_guardrail(spark, sf_dir):
    return curate.locked_vs_guardrail(A.responses(spark, sf_dir), SEED)
