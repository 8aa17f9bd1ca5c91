"""Exact sampling: brute-force equality and partition independence."""

import hashlib

from pyspark.sql import functions as F

from curatio.operators import sampling as R
from curatio.operators.expand import few_shot_prompts


def md5_rank(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def frame(spark, n, parts=4, classes=3):
    rows = [(i, f"c{i % classes}" if i % 7 else "c0") for i in range(n)]
    return spark.createDataFrame(rows, "id LONG, cls STRING").repartition(parts)


def test_rank_matches_bruteforce(spark):
    df = frame(spark, 300)
    got = {r.id: r.rank for r in R.shuffle_rank(df, ["id"], 42).collect()}
    order = md5_rank(range(300))
    assert all(got[k] == i + 1 for i, k in enumerate(order))


def test_sample_n_edges(spark):
    df = frame(spark, 50)
    for n in (0, 1, 49, 50, 80):
        ids = sorted(r.id for r in R.sample_n(df, n, ["id"], 42).collect())
        assert ids == sorted(md5_rank(range(50))[:n])
    one = spark.createDataFrame([(1, "a")], "id LONG, cls STRING")
    assert R.sample_n(one, 3, ["id"]).count() == 1


def test_partition_independence(spark):
    results = set()
    for parts in (1, 4, 37):
        df = frame(spark, 500, parts)
        b = R.balance_classes(df, "cls", ["id"], 7)
        results.add(tuple(sorted(r.id for r in b.collect())))
    assert len(results) == 1
    ids = next(iter(results))
    df = frame(spark, 500, 1).toPandas()
    sizes = df.groupby("cls").size()
    assert len(ids) == sizes.min() * len(sizes)


def test_split_fraction_exact(spark):
    df = frame(spark, 101)
    out = R.split_fraction(df, 0.9, ["id"], 42)
    assert out.where("split = 'train'").count() == int(101 * 0.9)
    assert out.count() == 101


def test_train_valid_test(spark):
    df = frame(spark, 200)
    c = {r.split: r["count"] for r in R.split_train_valid_test(df, 0.2, 0.5, ["id"]).groupBy("split").count().collect()}
    assert c == {"train": 160, "validation": 20, "test": 20}
    c = {r.split: r["count"] for r in R.split_train_valid_test(df, 0.2, 0, ["id"]).groupBy("split").count().collect()}
    assert c == {"train": 160, "test": 40}


def test_with_replacement_and_learning_curve(spark):
    df = frame(spark, 30)
    d = R.sample_with_replacement(spark, df, 100, ["id"], 42)
    assert d.count() == 100 and d.select("draw_id").distinct().count() == 100
    lc = R.learning_curve_subsets(df, [5, 10, 40], ["id"])
    c = {r.subset_size: r["count"] for r in lc.groupBy("subset_size").count().collect()}
    assert c == {5: 5, 10: 10, 40: 30}


def test_row_id_and_halves(spark):
    df = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k LONG").repartition(5)
    ids = [r.row_id for r in R.row_id(df, "k").orderBy("k").collect()]
    assert ids == list(range(1, 102))
    a, b = R.first_half(df, "k")
    assert a.count() == 50 and b.count() == 51 and a.agg(F.max("k")).first()[0] < b.agg(F.min("k")).first()[0]


def test_few_shot_exactly_n_others(spark):
    rows = [(i, f"q{i}", f"a{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "qid LONG, question STRING, answer STRING")
    out = few_shot_prompts(df, "qid", "question", "answer", n=3).collect()
    for r in out:
        blocks = r.question_prompt.split("<END>")
        assert len(blocks) == 4
        assert f"Question: q{r.qid}\n" not in "".join(blocks[:3])
