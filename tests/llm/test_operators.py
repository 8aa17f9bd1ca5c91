"""The dealt operators against plain versions, and on odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatio.llm import bpe, decontaminate, language, language_model, sharding, simhash, suffix_dedup, topk, toxicity, training_order

from . import plain
from .conftest import ODD, SMALL


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---- 1 ----------------------------------------------------------------------

def repeated_texts():
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcdefgh é") for _ in range(n)) for n in (99, 100, 101, 150, 300, 700)]
    rows = [(0, ""), (1, "a" * 500), (2, "ab" * 300), (3, "a" * 99 + "b" + "a" * 130)]
    for i in range(4, 90):
        text = ""
        for _ in range(rnd.randint(1, 5)):
            k = rnd.random()
            text += rnd.choice(parts) if k < 0.5 else parts[5][:rnd.randint(50, 400)] if k < 0.6 else "".join(rnd.choice("xyz abc") for _ in range(rnd.randint(0, 200)))
        rows.append((i, text))
    return rows + [(200 + i, rows[10][1]) for i in range(20)]


@pytest.mark.parametrize("block_bytes,hot", [(8 << 20, 2000), (6000, 2000), (6000, 2), (3000, 0)])
def test_repeats_are_those_of_all_windows(shipped, block_bytes, hot):
    rows = repeated_texts()
    got = suffix_dedup.remove_repeats(shipped.createDataFrame(rows, "doc_id long, text string"), hot=hot, block_bytes=block_bytes)
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")} == plain.removed_repeats(rows)


def test_repeats_cut_whole_characters(shipped):
    rows = repeated_texts()
    docs = shipped.createDataFrame([(i, t, "en", len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    got = suffix_dedup.without_repeats(docs, block_bytes=6000)
    want = plain.removed_repeats(rows, characters=True)
    assert {r[0]: r[1] for r in rows_of(got, "doc_id", "text")} == {i: w[3].decode() for i, w in want.items()}
    assert got.columns == docs.columns and all(r[0] == r[1] for r in rows_of(got, F.length("text"), "n_chars"))


def test_repeats_on_odd_rows(odd, nothing):
    got = suffix_dedup.remove_repeats(odd, block_bytes=100_000)
    assert got.count() == len(ODD)
    want = plain.removed_repeats([(r[0], r[1]) for r in ODD])
    assert {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")} == want
    assert want[8] == (150_000, 149_999, 1, b"x")
    assert rows_of(suffix_dedup.without_repeats(odd).where("doc_id = 1"), "text") == [(None,)]
    assert suffix_dedup.remove_repeats(nothing).count() == 0 and suffix_dedup.without_repeats(nothing).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(1)
    lists = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 30))) for _ in range(7)]
    runs = []
    for strings in lists:
        shared, lengths, rests = suffix_dedup.front_code(strings)
        runs.append(suffix_dedup.Run(shared, lengths, rests))
    merged = list(suffix_dedup.merge_runs(runs))
    strings = [m[2] for m in merged]
    assert strings == sorted(s for x in lists for s in x)
    assert all(lists[r][i] == s for r, i, s, _ in merged)
    for (_, _, a, _), (_, _, b, n) in zip(merged, merged[1:]):
        assert n == suffix_dedup.common_prefix(a, b, 0)


# ---- 2 ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Bpe(bpe.vocabulary(bpe.default_vocabulary()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(vocabulary, library, documents):
    rnd = random.Random(1)
    texts = [r[0] for r in rows_of(documents, "text")]
    for _ in range(300):
        k = rnd.choice(["ab", "aeiou", "thein", "=", "abcdefghijklmnopqrstuvwxyz", "=-_#", "ñé中a", "ΣσςAİ"])
        texts.append("".join(rnd.choice(k) for _ in range(rnd.randint(0, 1500))))
    texts += ["", " ", "<|startoftext|>Hello <|endoftext|>x<|endoftext|>", "I'll don't 've", "é Å x²½", "a" * 3000, "ha" * 2000,
              "\x1c\x1d a\x85b", "ǅ ŉ ẞ", "१२३ abc ⅷ", "emoji 😀😀 ok", "<|endoftext", "the" * 999]
    for text in texts:
        ids, decoded = vocabulary.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == vocabulary.decode(want) == library.decode(want, skip_special_tokens=False)


def test_tree_equals_merging_the_whole(vocabulary):
    rnd = random.Random(2)
    for _ in range(200):
        alphabet = rnd.choice([b"ab", b"then", b"aeioutnsr", bytes(range(97, 123))])
        symbols = [vocabulary.inner[rnd.choice(alphabet)] for _ in range(rnd.randint(1, 700))]
        assert vocabulary.tree(symbols) == vocabulary.merge(symbols)


def test_bpe_on_odd_rows(odd, nothing, library):
    got = bpe.encode_documents(odd, bpe.default_vocabulary())
    want = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert Counter(rows_of(got, "doc_id", "n_tokens")) == want
    empty = rows_of(bpe.digests(got).where("doc_id in (1, 2, 3)"), "n_tokens", "ids_sha256", "decoded_sha256")
    assert empty == [(0, plain.sha(b""), plain.sha(b""))] * 3
    assert bpe.encode_documents(nothing, bpe.default_vocabulary()).count() == 0


# ---- 3 ----------------------------------------------------------------------

def test_longest_first_is_the_greedy_schedule():
    rnd = random.Random(3)
    sizes = {i: rnd.randint(1, 1000) for i in range(500)}
    load, want = [0] * 7, {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard = min(range(7), key=lambda s: (load[s], s))
        want[item] = shard
        load[shard] += size
    assert sharding.longest_first(sizes, 7) == want


def test_shards(shipped, documents):
    rows = rows_of(sharding.shard_by_size(documents, section_rows=5), "doc_id", "size", "text_crc32", "shard", "slot")
    text = dict(rows_of(documents, "doc_id", "text"))
    assert len(rows) == len(text)
    by_text, slots, loads = {}, {}, Counter()
    for doc, size, crc, shard, slot in rows:
        raw = text[doc].encode()
        assert size == len(raw) + 8 and crc == zlib.crc32(raw)
        assert by_text.setdefault(raw, shard) == shard
        slots.setdefault(shard, []).append(slot)
        loads[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.get(s, 0) for s in range(24)) <= max(r[1] for r in rows) * 3


def test_large_groups_of_one_bundle_are_items_of_their_own(shipped):
    """One bundle a shard: groups that fall into one bundle still part, as in the greedy schedule of the groups."""
    texts = [chr(97 + i) * (1000 - i) for i in range(12)]
    docs = shipped.createDataFrame([(10 * i + k, t) for i, t in enumerate(texts) for k in range(3)], "doc_id long, text string")
    got = rows_of(sharding.shard_by_size(docs, n_shards=12, bundles_per_shard=1), "doc_id", "size", "shard")
    assert all(len({s for i, _, s in got if i // 10 == g}) == 1 for g in range(12))
    load = Counter()
    for _, size, shard in got:
        load[shard] += size
    large = [3 * (1000 - i + sharding.OVERHEAD) for i in range(12)]
    large = [x for x in large if x * 12 > sum(large)]
    assert len(got) == 36 and len(large) == 6 and set(large) <= set(load.values())


def test_shards_on_odd_rows(odd, nothing):
    rows = rows_of(sharding.shard_by_size(odd), "doc_id", "size", "text_crc32", "shard", "slot")
    assert len(rows) == len(set((r[3], r[4]) for r in rows)) == len(ODD)
    assert (1, 8, 0) in [r[:3] for r in rows]
    assert len({r[3] for r in rows if r[0] in (5, 6)}) == 1
    assert sharding.shard_by_size(nothing).count() == 0


# ---- 4 ----------------------------------------------------------------------

def near_copies():
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        for k in range(rnd.randint(1, 5)):
            copy = list(text)
            for _ in range(k):
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 3, " ".join(copy)))
    return rows


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_groups_are_those_of_all_pairs(shipped, monkeypatch, tree_nodes):
    rows = near_copies()
    monkeypatch.setattr(simhash, "links", lambda p, b, real=simhash.links: real(p, b, tree_nodes))
    got = {r[0]: r[1:] for r in rows_of(simhash.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string")), "doc_id", "fp", "component_id")}
    prints = [plain.fingerprint(t) for _, t in rows]
    roots = plain.linked(prints)
    assert got == {i: (p - (p >> 63 << 64), rows[r][0]) for (i, _), p, r in zip(rows, prints, roots)}
    assert len(set(roots)) < len(rows)


def test_trees_find_all_neighbours():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    for cells in (np.zeros(len(prints), np.int64), np.arange(len(prints)) // 30):
        forest = simhash.Forest(prints, cells, int(cells.max()) + 1)
        q, n = forest.search(prints, cells, 4)
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
        assert set(zip(q.tolist(), n.tolist())) == {(i, j) for i, j in zip(*np.nonzero(near)) if cells[i] == cells[j]}


def test_near_duplicates_on_odd_rows(odd, nothing, shipped):
    got = rows_of(simhash.near_duplicates(odd), "doc_id", "fp", "component_id")
    assert len(got) == len(ODD)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1] == by_id[2][1] == by_id[3][1] == 0 and by_id[3][2] == 1
    assert by_id[6][2] == 5 and by_id[None][2] is None
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in rows_of(kept, "doc_id")) == [0, 1, 4, 5, 7, 8, 9, 10]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_per_group(nothing).count() == 0


# ---- 5 ----------------------------------------------------------------------

def test_base_score_and_counts(documents):
    import math
    got = {r["doc_id"]: r for r in language_model.score_documents(documents.select("doc_id", "text"), bpe.default_vocabulary(), sample_texts=50, block_bytes=60_000).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in rows_of(documents, "doc_id", "text")}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    model = language_model.Attention(50, rng.random(50), width=8, classes=7)
    x = rng.integers(0, 50, (3, language_model.STEP))
    fresh = np.array([True, False, False])
    tables = model.tables()
    logs = np.stack([model.log_probs(x, fresh, np.full_like(x, t), tables) for t in range(50)])
    assert np.allclose(np.exp(logs).sum(axis=0), 1, atol=1e-3)
    changed = x.copy()
    changed[1, 5:] = (changed[1, 5:] + 1) % 50
    other = np.stack([model.log_probs(changed, fresh, np.full_like(x, t), tables) for t in range(50)]).reshape(50, 3, -1)
    assert np.allclose(other[:, 1, :5], logs.reshape(50, 3, -1)[:, 1, :5], atol=1e-5)
    assert not np.allclose(other[:, 1, 5:], logs.reshape(50, 3, -1)[:, 1, 5:], atol=1e-5)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = language_model.Attention(20, rng.random(20), width=4, classes=4)
    x, y = rng.integers(0, 20, (200, language_model.STEP)), None
    y = (x + 3) % 20            # the next symbol follows from the last
    fresh, valid = np.ones(200, bool), np.ones((200, language_model.STEP), bool)
    before = model.log_probs(x, fresh, y, model.tables()).mean()
    for _ in range(20):
        model.fit(x, fresh, y, valid, rows=50, rate=0.05)
    assert before < -2 and model.log_probs(x, fresh, y, model.tables()).mean() > -0.5


def test_subwords_cover_every_byte(vocabulary):
    subwords = language_model.Subwords(bpe.vocabulary(bpe.default_vocabulary()), 1535)
    few = bpe.Bpe(bpe.vocabulary(bpe.default_vocabulary()))
    few.rank = {k: v for k, v in few.rank.items() if v >> 20 < 1535}
    words = [b"the", b"thing", b"aaaaaaa", "éñü".encode(), b"banana", b"x", b"interesting"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, first = subwords.segment(data, ends - [len(w) for w in words], ends)
    for k, w in enumerate(words):
        assert first[k + 1] - first[k] == len(few.unit(w.decode()))


def test_language_model_learns_from_whole_texts(shipped):
    """What only stands behind the first characters, and in texts beyond the
    sample, is counted exactly and learned."""
    tail = "zebra quilt vexes jumpy fox "
    docs = shipped.createDataFrame([(i, "one two " * 260 + tail * 800) for i in range(150)] + [(1000 + i, tail * 60) for i in range(20)], "doc_id long, text string")
    held = [i for i, _ in rows_of(docs, "doc_id", "text") if zlib.crc32(str(i).encode()) % 5 == 1]
    got = language_model.score_documents(docs, bpe.default_vocabulary(), sample_texts=1, block_bytes=400_000).where("doc_id >= 1000 and held_out").collect()
    assert got and all(r["score"] / r["n_tokens"] > -0.3 for r in got)      # the next word follows from the last

    subwords = language_model.Subwords(bpe.vocabulary(bpe.default_vocabulary()))
    rows, n = language_model.blocks(docs, 400_000)
    rows = rows.withColumn("held_out", F.col("doc_id").isin(held))
    asked = rows.groupBy("block").applyInArrow(language_model._ask(n, subwords), "bucket int, block int, keys binary, counts binary, pieces binary")
    answers = asked.groupBy("bucket").applyInArrow(language_model._answer, "block int, bucket int, totals binary, tokens long, distinct long, pieces binary")
    few = bpe.Bpe(bpe.vocabulary(bpe.default_vocabulary()))
    few.rank = {k: v for k, v in few.rank.items() if v >> 20 < language_model.MERGES}
    length = {w: len(few.unit(w)) for w in ("one", "two", *tail.split())}
    want = sum(sum(length[w] for w in t.split()) + 1 for i, t in rows_of(docs, "doc_id", "text") if i not in held)
    frequency = sum(np.sum(language_model.unpacked(r["pieces"], np.int64)) for r in answers.where("pieces is not null").collect())
    _, learned = language_model.learned_model(docs, rows, answers, n, subwords, sample_texts=1)
    assert n > language_model.ROUNDS and frequency == learned == want


def test_texts_are_cut_into_subwords_once(monkeypatch):
    """What counting, learning and scoring read of a block is that of its texts cut one by one."""
    subwords = language_model.Subwords(bpe.vocabulary(bpe.default_vocabulary()))
    texts = ["One two  naïve", None, "two " * 40 + "x" * 130, "", "one\ttwo", "One two  naïve"]
    words = [[w.encode().lower() for w in (t or "").split()] for t in texts]
    cut = [[subwords.segment(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0].tolist() for w in ws] for ws in words]
    table = pa.table({"block": pa.array([3] * 6, pa.int32()), "doc_id": pa.array([7, 1, None, 4, 5, 7], pa.int64()), "text": pa.array(texts),
                      "held_out": pa.array([False, False, False, True, True, False])})
    row = language_model._encode(subwords)(table)
    monkeypatch.setattr(language_model.Subwords, "segment", None)          # no later step cuts a text again
    block = language_model.Block(row.drop_columns("keys"))
    of = [1, 3, 4, 0, 5, 2]                                                # ascending ids, null last
    assert block.doc_id.to_pylist() == [1, 4, 5, 7, 7, None] and block.held_out.tolist() == [False, True, True, False, False, False]
    _, heads, flat, size = block.runs(np.arange(6))
    assert [flat[a:b].tolist() for a, b in zip(heads, heads[1:])] == [[s for c in cut[i] for s in c] for i in of]
    assert size.tolist() == [len(c) for i in of for c in cut[i]]
    assert [r.tolist() for r in block.chunks(np.array([0, 3, 5]), limit=20)] == [[0, 3], [5]]

    asked = next(language_model._ask_encoded(1, subwords.size)(row.to_batches()))
    keys, counts = (language_model.unpacked(asked[c][0].as_py(), t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
    trained = Counter(w for i in (0, 1, 2, 5) for w in [*words[i], None])
    assert sorted(counts) == sorted([*trained.values()]) and counts[keys == language_model.END_KEY] == 4
    frequency = language_model.unpacked(asked["pieces"][0].as_py(), np.int64)
    assert {i: n for i, n in enumerate(frequency) if n} == Counter(s for i in (0, 1, 2, 5) for c in [*cut[i], [subwords.end]] for s in c)

    model = language_model.Attention(subwords.size, frequency)
    learned = language_model._learn(model, subwords, 0.01, 1, 1)(row.drop_columns("keys"))
    assert learned["n"].to_pylist() == [frequency.sum()]
    answers = pa.table({"bucket": pa.array([0], pa.int32()), "totals": [language_model.packed(counts)]})
    scores = language_model._score(model, subwords, int(counts.sum()), len(counts))(row.drop_columns("keys"), answers)
    assert scores["n_tokens"].to_pylist() == [len(words[i]) + 1 for i in of] and scores["score"][3] == scores["score"][4]


def test_gradients_of_the_model_are_those_of_its_loss(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_model.Attention(30, rng.random(30), width=4, classes=5)
    model.p["rel"] = rng.normal(size=language_model.CONTEXT).astype(np.float32)
    x, y = rng.integers(0, 30, (2, 6, language_model.STEP))
    fresh, valid = np.array([True, False, False, True, False, False]), np.ones(y.shape, bool)
    found = {}
    monkeypatch.setattr(language_model.Steps, "update", lambda self, g: found.setdefault("all", np.concatenate([*g.values()]).copy()))
    model.fit(x, fresh, y, valid, rows=6)
    got = language_model.parts(found["all"], model.p)
    loss = lambda: -float(model.log_probs(x, fresh, y, model.tables()).astype(float).mean())
    for name, weights in model.p.items():
        for at in rng.integers(0, weights.size, 6):
            was, two = weights.flat[at], []
            for move in (0.02, -0.02):
                weights.flat[at] = was + np.float32(move)
                two.append(loss())
            weights.flat[at] = was
            assert abs((two[0] - two[1]) / 0.04 - got[name].flat[at]) < 5e-4 + 0.02 * abs(got[name].flat[at]), name


def test_language_model_on_odd_rows(odd, nothing):
    got = language_model.score_documents(odd, bpe.default_vocabulary(), sample_texts=20, block_bytes=100_000)
    rows = rows_of(got, "doc_id", "n_tokens", "score", "base_score")
    assert Counter((r[0], r[1]) for r in rows) == Counter((r[0], len((r[1] or "").split()) + 1) for r in ODD)
    assert all(np.isfinite(r[2]) and np.isfinite(r[3]) and r[2] < 0 for r in rows)
    assert language_model.score_documents(nothing, bpe.default_vocabulary()).count() == 0


# ---- 6 ----------------------------------------------------------------------

def test_language_accuracy_on_held_out_rows(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = rows_of(got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))), "*")[0]
    assert n > 200 and right / n > 0.95


def test_language_windows_do_not_see_other_rows():
    network = language.ByteNetwork(["a", "b"])
    one, two = b"some text of a row", b"and quite another one" * 30
    both = network.documents(np.frombuffer(one + two, np.uint8), np.array([0, len(one), len(one) + len(two)]))
    alone = network.documents(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
    assert np.allclose(both[0], alone[0], atol=1e-6)


def test_language_on_odd_rows(odd, nothing):
    got = rows_of(language.identify(odd), "doc_id", "lang_pred", "score")
    assert len(got) == len(ODD)
    by_id = {r[0]: r for r in got}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (1, 2, 3, 9)) and by_id[10][1] in ("en", "fr", "de")
    assert all(0 <= r[2] <= 1 for r in got)
    assert language.identify(nothing).count() == 0
    assert language.keep_identified(odd, 0.0).columns == odd.columns
    assert rows_of(language.predict(odd, None).select("lang_pred").distinct(), "*") == [("und",)]


def test_recurrent_gradients():
    from curatio.llm.recurrent import gru_backward, gru_forward
    rng = np.random.default_rng(0)
    x, u, w = rng.standard_normal((5, 3, 6)), rng.standard_normal((2, 6)), rng.standard_normal((5, 3, 2))
    states, saved = gru_forward(x, u, keep=True)
    d_x, d_u = gru_backward(w, u, saved)
    for array, grad in ((x, d_x), (u, d_u)):
        for _ in range(10):
            at = tuple(rng.integers(0, s) for s in array.shape)
            old = array[at]
            array[at] = old + 1e-6
            up = (gru_forward(x, u) * w).sum()
            array[at] = old - 1e-6
            down = (gru_forward(x, u) * w).sum()
            array[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


# ---- 7 ----------------------------------------------------------------------

@pytest.mark.parametrize("shard_rows,chunk_rows", [(8192, 4096), (37, 11)])
def test_top_k_is_that_of_all_scores(shipped, shard_rows, chunk_rows):
    rnd = random.Random(7)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(200)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]                               # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (420, [1.0, 2.0])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.search(topk.quantised(df), F.col("vec_id") % 20 == 0, 20, shard_rows, chunk_rows), "query_id", "rank", "vec_id", "score")
    v = {i: [int(np.floor(64 * x)) for x in e] + [0] * (6 - len(e)) for i, e in rows if i is not None and (i < 400 or i == 420)}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:20]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_top_k_beyond_floats_and_on_nothing(shipped):
    rows = [(0, [2.0 ** 20, 1.0]), (1, [2.0 ** 20, 1.0]), (2, [2.0 ** 20, 1.0 + 1 / 64])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(topk.search(topk.quantised(df), F.col("vec_id") % 20 == 0), "rank", "vec_id", "score")
    assert sorted(got) == [(1, 2, 2 ** 52 + 64 * 65), (2, 1, 2 ** 52 + 64 * 64)]
    none = shipped.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.search(topk.quantised(none), F.col("vec_id") % 20 == 0).count() == 0


# ---- 8 ----------------------------------------------------------------------

def test_toxicity_on_held_out_rows(shipped):
    docs, labels = (shipped.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    picked = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    got = rows_of(toxicity.score_documents(docs.join(labels, "doc_id", "left_semi"), labels).where("held_out")
                  .join(picked.select("doc_id", "toxic"), "doc_id"), "toxic", "score", "predicted")
    toxic, clean = [r for r in got if r[0] == 1], [r for r in got if r[0] == 0]
    assert sum(r[2] for r in clean) / len(clean) < 0.05
    above = np.mean([[t[1] > c[1] for c in clean] for t in toxic])
    assert above > 0.9 and all(r[2] == int(r[1] >= 0.5) for r in got)


def test_toxicity_learns_from_whole_texts(shipped):
    """Toxic words that stand far behind are counted and learned; parts have the windows of the whole."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    raws = [" ".join(rnd.choices(words, k=n)).encode() for n in (0, 1, 64, 65, 112, 113, 5000, 9001)] + [b"x" * 90_000, b"-" * 50_000]
    for raw in raws:
        def window_words(pieces):
            p = toxicity.Positions(*toxicity._join(pieces))
            return [tuple(p.word[k] for k in w if k >= 0) for w in p.windows()[0]]
        assert window_words(toxicity.parts(raw, 1000)) == window_words([raw])
    filler = lambda n: " ".join(rnd.choices(words, k=n))
    texts = [filler(5500) + " vile slur" * 30 if i % 3 == 0 else filler(5500 if i % 10 == 1 else 60) for i in range(300)]
    assert texts[0].index("vile") > toxicity.PIECE
    labels = [int(i % 3 == 0) for i in range(300)]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    network = toxicity.train(docs, shipped.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert all(network.p["word"][toxicity.Positions(*toxicity._join([w])).word[0], 0] > 1 for w in (b"vile", b"slur"))
    cuts = [toxicity.parts(t.encode(), 1000) for t in texts[:40]]
    best = toxicity.highest_parts(network, cuts, range(40))
    assert np.allclose(network.scores(*toxicity._join(best)), network.scores(*toxicity._join([t.encode() for t in texts[:40]])))
    cut = toxicity.log_odds([toxicity.parts(t.encode(), 1000) for t in texts], np.array(labels))
    assert all(np.array_equal(a, b) for a, b in zip(cut, toxicity.log_odds([[t.encode()] for t in texts], np.array(labels))))


def test_toxicity_on_odd_rows(odd, nothing, shipped):
    labels = shipped.createDataFrame([(5, 0, 1), (10, 1, 0), (7, 0, None), (None, 1, 1), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.score_documents(odd, labels), "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(ODD) and all(0 <= r[2] <= 1 for r in got)
    scores = {r[0]: r[2] for r in got}
    assert scores[1] == scores[2] == scores[3]
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert {r[2] for r in rows_of(toxicity.score_documents(odd, labels.limit(0)), "doc_id", "held_out", "score")} == {0.0}


# ---- 9 ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def byte_bpe():
    public = pytest.importorskip("public_tokenizers")
    return bpe.vocabulary(public.path("byte_bpe_50k.tiktoken")), public.PATTERN


def test_permutation_is_a_keyed_bijection():
    for n in (1, 2, 3, 5, 100, 12345):
        p = training_order.Permutation(n, 7)
        x = np.arange(n)
        y = p.forward(x)
        assert sorted(y.tolist()) == x.tolist() and (p.inverse(y) == x).all()
    assert (training_order.Permutation(1000, 7).forward(np.arange(1000)) != training_order.Permutation(1000, 8).forward(np.arange(1000))).any()


def test_shards_read_back_to_the_texts(documents, byte_bpe, tmp_path):
    path = f"file://{tmp_path}/out"
    got = training_order.materialise(documents, path, *byte_bpe, sequence=128, shard_bytes=50_000).toPandas().sort_values("slot")
    ids = training_order.read_slots(path, 0, 10 ** 9)
    assert got.slot.tolist() == list(range(len(ids))) and got.shard.nunique() > 3
    assert got.ids_crc32.tolist() == [zlib.crc32(r.tobytes()) for r in ids]
    assert (training_order.read_slots(path, 100, 77) == ids[100:177]).all()
    encoding = training_order.encoding(*byte_bpe)
    for doc, text in rows_of(documents, "doc_id", "text"):
        mine = got[got.doc_id == doc].sort_values("part")
        back = np.concatenate([ids[s][:n] for s, n in zip(mine.slot, mine.n_tokens)])
        assert back[-1] == training_order.END and encoding.decode(back[:-1].tolist()) == text
    assert abs(np.corrcoef(got.doc_id[:-1], got.doc_id[1:])[0, 1]) < 0.3


def test_training_order_on_odd_rows(odd, nothing, byte_bpe, tmp_path):
    got = training_order.materialise(odd, f"file://{tmp_path}/a", *byte_bpe)
    rows = rows_of(got, "slot", "doc_id", "part", "n_tokens")
    assert sorted(r[0] for r in rows) == list(range(len(rows)))
    assert Counter(r[1] for r in rows if r[2] == 0) == Counter(r[0] for r in ODD)
    assert [r[3] for r in rows if r[1] in (1, 2)] == [1, 1]
    assert training_order.materialise(nothing, f"file://{tmp_path}/b", *byte_bpe).count() == 0
    assert len(training_order.read_slots(f"file://{tmp_path}/b", 0, 5)) == 0


# ---- 10 ---------------------------------------------------------------------

def leaks():
    rnd = random.Random(10)
    word = lambda: "w%d" % rnd.randrange(5000)
    items = [" ".join(word() for _ in range(n)) for n in (5, 6, 9, 14, 20, 33, 60, 120)] + ["two words", "", None]
    docs = []
    for n in (0, 3, 50, 300, 3000):
        for item in items:
            body = [word() for _ in range(n)]
            cut = rnd.randint(0, n)
            passage = (item or "").upper().split()
            if n > 50 and len(passage) > 12:
                passage[rnd.randrange(len(passage))] = "edited"
            docs.append(" ".join(body[:cut] + passage + body[cut:]))
    return docs + [None, ""], items


def test_contained_items_are_those_of_all_pairs(shipped):
    docs, items = leaks()
    got = rows_of(decontaminate.contained_items(shipped.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
                                                shipped.createDataFrame(list(enumerate(items)), "item_id long, text string"), items_per_pass=4),
                  "doc_id", "item_id", "containment")
    assert {r[:2] for r in got} == plain.contained(docs, items) and len(got) > 30
    assert all(0.8 <= r[2] <= 1 for r in got)


def test_a_long_item_does_not_pad_short_rows(shipped):
    import tracemalloc
    rnd = random.Random(5)
    long = " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(300_000))
    short = [" ".join(f"s{rnd.randrange(10 ** 6)}" for _ in range(20)) for _ in range(1000)]
    index = decontaminate.ItemIndex([(0, long), (1, short[7])], 4)
    raw = [t.encode() for t in [*short, long]]
    hashes = decontaminate.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    tracemalloc.start()
    found = index.candidates(*hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(7, 1), (1000, 0)} <= found and peak < 100e6
    items = shipped.createDataFrame([(i, "x" * 100) for i in range(10)] + [(10, None), (11, "y" * 900)], "item_id long, text string")
    assert [len(c) for c in decontaminate.item_chunks(items, 4, 350)] == [3, 3, 3, 2, 1]


def test_decontamination_of_a_table(shipped, documents):
    items = shipped.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = rows_of(documents, "doc_id", "text")
    want = plain.contained([t for _, t in texts], [t for _, t in rows_of(items.orderBy("item_id"), "item_id", "text")])
    kept = decontaminate.without_items(documents, items)
    assert kept.columns == documents.columns
    assert sorted(r[0] for r in rows_of(kept, "doc_id")) == sorted({i for i, _ in texts} - {texts[d][0] for d, _ in want})


def test_decontamination_on_odd_rows(odd, nothing, shipped):
    items = shipped.createDataFrame([(1, "SAME text for two rows of THE table", "x"), (2, None, "x"), (None, "word", "x")], "item_id long, text string, containment string")
    got = Counter(rows_of(decontaminate.contained_items(odd, items), "doc_id", "item_id"))
    assert got == {(5, 1): 1, (6, 1): 2, (4, None): 1}
    assert decontaminate.without_items(odd, items).count() == len(ODD) - 4
    assert decontaminate.contained_items(nothing, items).count() == 0 and decontaminate.contained_items(odd, items.limit(0)).count() == 0
    assert decontaminate.without_items(odd, items.limit(0)).count() == len(ODD)
