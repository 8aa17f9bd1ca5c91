"""Orders over texts, shuffles on disk, draws, held-out cuts, few-shot ranges, manifests."""

import hashlib
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curatio.operators import expand as E
from curatio.operators import metrics as M
from curatio.operators import sampling as R
from curatio.sources import io as IO


def test_texts_that_share_a_prefix_split_evenly(spark, tmp_dir):
    n = 200_000
    df = spark.range(n).select("id", F.concat(F.lit("x" * 50), F.md5(F.col("id").cast("string"))).alias("t"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = R.row_id(df, "t", tiebreak=["id"])
        sizes = sorted({f: pq.read_metadata(f.removeprefix("file://")).num_rows for f in ranked.inputFiles()}.values())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    rows = ranked.orderBy("row_id").select("row_id", "t").collect()
    assert [r.row_id for r in rows] == list(range(1, n + 1))
    assert all(a.t <= b.t for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("parts", [1, 5])
def test_text_ids_do_not_depend_on_partitions(spark, parts):
    rows = [(i, random.Random(i % 40).choice(["", None, "same", "é", "prefix a", "prefix b", "prefix"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id LONG, t STRING").repartition(parts)
    got = {r.id: r.row_id for r in R.row_id(df, "t", tiebreak=["id"]).collect()}
    tie = lambda i: hashlib.md5(f"tie|{i}".encode()).hexdigest()
    want = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), tie(r[0])))
    assert [got[i] for i, _ in want] == list(range(1, 301))


def test_an_empty_table_has_no_ids(spark):
    assert R.row_id(spark.createDataFrame([], "id LONG, t STRING"), "t").collect() == []


def test_shuffled_files_hold_consecutive_ranks(spark, tmp_dir):
    path = os.path.join(tmp_dir, "s")
    R.write_shuffled(spark.range(1050).withColumn("x", F.lit("text")), ["id"], path, 7, rows_per_file=100)
    seen = []
    for n in range(11):
        folder = os.path.join(path, "data", f"file={n}")
        files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        assert len(files) == 1
        seen += pq.read_table(os.path.join(folder, files[0])).column("rank").to_pylist()
    assert seen == list(range(1, 1051))
    ranks = {r.id: r["rank"] for r in R.shuffle_rank(spark.range(1050), ["id"], 7).collect()}
    part = R.read_shuffled(spark, path, 250, 420)
    assert {r.id: r["rank"] for r in part.collect()} == {i: k for i, k in ranks.items() if 250 <= k <= 420}
    assert len(part.inputFiles()) == 11 or len({r.file for r in part.collect()}) == 3
    assert R.read_shuffled(spark, path, 5000).count() == 0


@pytest.mark.parametrize("rows,draws", [(0, 10), (1, 5), (30, 200), (5000, 40)])
def test_draws_are_the_positions_of_the_permutation(spark, rows, draws):
    pool = spark.range(rows).select("id", (F.col("id") % 7).alias("v"))
    place = {r["rank"]: r.id for r in R.shuffle_rank(pool, ["id"], 3).collect()}
    got = {r.draw_id: r.id for r in R.sample_with_replacement(spark, pool, draws, ["id"], 3).collect()}
    want = {i: place[int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:15], 16) % rows + 1] for i in range(draws)} if rows else {}
    assert got == want


def test_rows_that_agree_in_the_key_are_drawn_once_each(spark):
    pool = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "id LONG, v STRING")
    got = R.sample_with_replacement(spark, pool, 300, ["id"], 3)
    assert got.count() == 300 and {r.v for r in got.collect()} == {"a", "b", "c"}


def plain_few_shot(rows, n, seed):
    h = lambda s, k: (hashlib.md5(f"{seed}:{s}|{k}".encode()).hexdigest(), k)
    by_a = sorted(rows, key=lambda r: h("A", r[0]))
    by_b = sorted(rows, key=lambda r: h("B", r[0]))
    out, size = {}, len(rows)
    for p, (k, q, _) in enumerate(by_a, 1):
        near = [by_b[(p + j) % size] for j in range(min(n + 1, size))]
        found = [x for x in near if x[0] != k][:n]
        out[k] = "".join(f"Question: {x[1]}\nAnswer: {x[2]}\n<END>\n" for x in found) + f"Question: {q}\nAnswer: "
    return out


@pytest.mark.parametrize("n_rows,n,width", [(1, 3, 4096), (2, 3, 4096), (5, 3, 2), (4, 3, 1), (50, 3, 7), (50, 10, 3), (300, 3, 4096)])
def test_few_shot_ranges_equal_the_plain_walk(spark, monkeypatch, n_rows, n, width):
    monkeypatch.setattr(E, "RANGE_ROWS", width)
    rows = [(i, f"q{i}", f"a{i}") for i in range(n_rows)]
    got = E.few_shot_prompts(spark.createDataFrame(rows, "id LONG, q STRING, a STRING"), "id", "q", "a", n, seed=5)
    assert {r.id: r.question_prompt for r in got.collect()} == plain_few_shot(rows, n, 5)


def test_few_shot_keeps_columns_and_null_keys(spark):
    df = spark.createDataFrame([(1, "q", "a", 5), (None, "q0", "a0", 6), (2, "r", None, 7)], "id LONG, q STRING, a STRING, extra LONG")
    got = E.few_shot_prompts(df, "id", "q", "a", 3)
    assert got.columns == [*df.columns, "question_prompt"]
    assert {r.extra: r.question_prompt for r in got.collect()}[6] == "Question: q0\nAnswer: "


def test_few_shot_moves_a_text_about_once(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(20)], "id LONG, q STRING, a STRING")
    plan = E.few_shot_prompts(df, "id", "q", "a", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [collect_list") == 1 and plan.count("Window [row_number()") == 2        # over texts, over keys


def test_prompt_tables_are_checked_before_they_are_gathered(spark, monkeypatch):
    df, prompts = spark.range(3), spark.createDataFrame([("a",), ("b",)], "prompt STRING")
    assert E.cross_prompts(df, prompts).count() == 6
    monkeypatch.setattr(E, "MAX_PROMPT_BYTES", 10)
    with pytest.raises(Exception, match="too large"):
        E.cross_prompts(df, prompts).collect()


def manifest(settings):
    text = "".join(f"{k.lower().strip()}_{str(settings[k]).lower().strip()}" for k in sorted(settings) if k != "write_timestamp")
    return hashlib.sha256(text.encode()).hexdigest()[:10]


@pytest.mark.parametrize("settings,digest", [
    ({"a": "z", "a_b": "x"}, "a_za_b_x"), ({"B": 1, "a": 2}, "b_1a_2"), ({" Key ": "\t V\n", "write_timestamp": "now", "timestamp": 3}, "key_vtimestamp_3"),
    ({"n": None, "flag": True, "x": " É "}, "flag_truen_nonex_é")])
def test_run_hashes_are_those_of_sorted_raw_keys(spark, settings, digest):
    want = hashlib.sha256(digest.encode()).hexdigest()[:10]
    assert manifest(settings) == want
    got = IO.run_manifest(spark.range(1), {k: F.lit(v) for k, v in settings.items()}).first().run_hash
    assert got == want


def test_common_prefix_in_code_points(spark):
    rows = [("a", "😀é same x"), ("a", "😀é same y"), ("b", "only"), ("c", "pre"), ("c", "prefix"), ("d", "é"), ("d", "ê"), ("e", ""), ("e", "x"), ("f", None),
            ("g", "l" * 70_000 + "1"), ("g", "l" * 70_000 + "2")]
    got = {r.g: (r.n, len(r.prefix), r.prefix_len, r.status) for r in M.common_prefix(spark.createDataFrame(rows, "g STRING, t STRING"), "t", ["g"]).collect()}
    assert got == {"a": (2, 8, 8, "ok"), "b": (1, 0, 4, "all_equal"), "c": (2, 3, 3, "prefix_of_other"), "d": (2, 0, 0, "ok"), "e": (2, 0, 0, "prefix_of_other"),
                   "g": (2, 70_000, 70_000, "ok")}
    whole = M.common_prefix(spark.createDataFrame(rows[:2], "g STRING, t STRING"), "t").collect()
    assert [(r.n, r.prefix) for r in whole] == [(2, "😀é same ")]
