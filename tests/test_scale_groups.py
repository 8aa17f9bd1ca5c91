"""Rows of few large groups are not gathered in as few tasks."""

from pyspark.sql import functions as F

from curatio.operators import sampling as S


def test_large_groups_give_the_same_ranks(spark, monkeypatch):
    rows = [(i, "abc"[min(i % 7, 2)] if i % 11 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "id LONG, g STRING")
    th = lambda c: c.withColumn("_t0", F.lit(20)).withColumn("_t1", F.lit(45))
    run = lambda: sorted(map(tuple, S.rank_cut(d, "id", 7, "g", th).collect()), key=lambda r: r[0])
    want = run()
    for limit in (0, 50):                       # all groups, or the larger ones, are broadcast
        monkeypatch.setattr(S, "HOT_ROWS", limit)
        assert run() == want


def test_rows_of_a_large_group_are_spread(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 100)
    rows = S._hashed(spark.range(4000).withColumn("g", F.lit("one")), ["id"], 7, 2)
    groups = spark.createDataFrame([("one", 4000, 5), ("two", 1, 1)], "g STRING, _total LONG, _t0 INT")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(keep, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        got = S._meet_groups(rows, groups, ["g"]).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(got) == 4000 and {r._total for r in got} == {4000}
    assert len({r.p for r in got}) > 1
