"""Passages in many blocks, bounds of training samples, slots, large sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.llm import language, sharding, suffix_dedup, topk, toxicity

from . import plain
from .conftest import DOCS


@pytest.mark.parametrize("hot", [2000, 1])
def test_a_passage_in_many_blocks_is_found(shipped, hot):
    passage = "a passage that stands in very many documents, each of them in a block of its own, and longer than one hundred bytes. "
    rows = [(i, f"{i * 7919} own words {i}: " + passage + f"and goes on {i * 104729}") for i in range(60)]
    got = suffix_dedup.remove_repeats(shipped.createDataFrame(rows, "doc_id long, text string"), hot=hot, block_bytes=150).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain.removed_repeats(rows)


def test_language_learns_from_whole_texts(shipped):
    """What tells the languages apart stands at the end of the texts only."""
    body = "lorem ipsum dolor sit amet consectetur " * 60
    rows = [(i, body + ("zhe quck brwn " if i % 2 else "ñu öl façade ") * 150, "aa" if i % 2 else "bb", "s", 1) for i in range(60)]
    got = language.identify(shipped.createDataFrame(rows, DOCS)).where("held_out").join(shipped.createDataFrame(rows, DOCS).select("doc_id", "lang"), "doc_id")
    assert got.where(F.col("lang") != F.col("lang_pred")).count() == 0 and got.count() > 5


def test_very_many_languages_do_not_reach_the_driver(shipped, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    rows = [(i, f"some text {i}", f"x{i % 200}" if i % 4 else "en", "s", 1) for i in range(800)]
    network = language.train(shipped.createDataFrame(rows, DOCS), F.lit(True))
    assert len(network.languages) == 3 and "en" in network.languages


def test_texts_beyond_the_bounds_are_not_sampled(shipped, monkeypatch):
    monkeypatch.setattr(language, "LONGEST", 1000)
    monkeypatch.setattr(language, "LANGUAGE_BYTES", 300)
    seen = []
    monkeypatch.setattr(language.ByteNetwork, "fit", lambda self, data, valid, labels: seen.append(int(valid.sum())) or self)
    rows = [(i, "abc " * 20, "en", "s", 1) for i in range(50)] + [(100, "long " * 500, "fr", "s", 1)]
    network = language.train(shipped.createDataFrame(rows, DOCS), F.lit(True))
    assert network.languages == ["en"] and seen == [240]


def test_a_repeated_labelled_id_is_learned_once(shipped, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(sorted(zip(texts, labels))))
    docs = [(1, "vile words")] * 50 + [(1, "other text"), (2, "kind words"), (3, None), (4, "x" * 300), (5, "y" * 200), (6, "y" * 200)]
    labels = [(1, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]
    held = {i for i in range(7) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    monkeypatch.setattr(toxicity, "LONGEST", 250)
    monkeypatch.setattr(toxicity, "CLASS_BYTES", 250)
    toxicity.train(shipped.createDataFrame(docs, "doc_id long, text string"), shipped.createDataFrame(labels, "doc_id long, toxic int"))
    assert not held & {1, 2, 4} and len(seen) == 1
    texts = [t for t, _ in seen[0]]
    assert len([t for t in texts if t in ("vile words", "other text")]) == 1 and (10 * 25 + 50) * "x" not in texts
    assert sum(len(t) for t, y in seen[0] if not y) <= 250


def test_slots_come_from_counts_inside_the_plan(shipped):
    docs = shipped.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    got = sharding.shard_by_size(docs, n_shards=5, section_rows=100).collect()
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def plain_top(rows, k, every):
    """rows: (vec_id, integers) -> (query_id, rank, vec_id, score)."""
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        mine = min(v for i, v in rows if i == q)
        found = []
        for i, v in rows:
            if i != q:
                found.append((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, v)))), i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 31])
def test_blocks_prune_sums_beyond_floats(shipped, monkeypatch, scale):
    rnd = np.random.default_rng(scale % 97)
    rows = [(i, (rnd.integers(-50, 50, 8) + (200 if i % 3 == 0 else 0)).tolist()) for i in range(400)]
    rows = [(i, [x * scale + i % 5 for x in v]) for i, v in rows]
    df = shipped.createDataFrame(rows, "vec_id long, v array<long>")
    scored = []
    whole = topk.exact_products
    monkeypatch.setattr(topk, "exact_products", lambda q, v: scored.append(len(v)) or whole(q, v))
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, 5, shard_rows=150, chunk_rows=7).collect())
    assert got == sorted(plain_top(rows, 5, 20))
    ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = topk.best(ids[::20], v[::20], ids, v, 5)
    assert len(found[0]) == 100 and (scale == 1 or 0 < sum(scored) < 20 * len(rows))       # some blocks were never scored


def test_top_k_on_repeated_rows_long_vectors_and_clashing_columns(shipped):
    rows = [(20, [3.0] * 2000), (20, [3.0] * 2000), (1, [1.0] * 2000), (1, [1.0] * 2000), (2, [2.0]), (3, []), (40, [0.5] * 1999 + [9.0]), (5, [-1.0] * 2000)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("rank", "score", "shard", "v", "chunk", "query_id"):
        df = df.withColumn(name, F.lit("extra"))
    got = topk.search(topk.quantised(df), F.col("vec_id") % 20 == 0, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_top(whole, 20, 20))
