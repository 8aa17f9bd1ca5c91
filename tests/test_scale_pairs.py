"""Pairs of words are counted and exchanged once for all that is made of them."""

from collections import Counter

from curatio.operators import metrics as M


def test_a_models_pairs_are_exchanged_once(spark):
    d = spark.createDataFrame([(i, f"a b c{i} a b") for i in range(20)], "id LONG, text STRING")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = M.ngram_perplexity(d.where("id < 15"), d.where("id >= 15"), "text", "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("ReusedExchange") >= 3
    # the lookups join by the words themselves, so no count is exchanged under another key
    assert "_key" not in plan and "_stage" not in plan


def test_hot_keys_of_a_lookup_keep_their_own_values(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_SHARE", 4)      # keys with more than a quarter of the weight
    rows = spark.createDataFrame([(i, k, k + 1) for i, k in enumerate([1] * 30 + [2, 3, 4, 4])], "id LONG, w1 LONG, w2 LONG")
    table = rows.where("w1 < 4").groupBy("w1", "w2").count()
    total = table.selectExpr("sum(count) AS c").scalar()
    got = M.skewed_lookup(rows, table, ["w1", "w2"], "count", total).collect()
    assert Counter((r.w1, r.w2, r["count"]) for r in got) == {(1, 2, 30): 30, (2, 3, 1): 1, (3, 4, 1): 1, (4, 5, None): 2}
    assert sorted(r.id for r in got) == list(range(34))
