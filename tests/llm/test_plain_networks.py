"""The networks against plain loops: one step, one position, one window at a time."""

import math
import random
import zlib

import numpy as np
import pytest

from curatio.llm import bpe, language, language_model, toxicity

sig = lambda x: 1 / (1 + np.exp(-x))


def gru(steps, u):
    """States of a gated recurrent layer, one step at a time."""
    n = u.shape[0]
    h, out = np.zeros(n), []
    for x in steps:
        a = h @ u
        z, r = sig(x[:n] + a[:n]), sig(x[n:2 * n] + a[n:2 * n])
        c = np.tanh(x[2 * n:] + r * a[2 * n:])
        h = c + z * (h - c)
        out.append(h)
    return out


# ---- 6 ----------------------------------------------------------------------

def plain_language(network, raw):
    p = {k: v.astype(float) for k, v in network.p.items()}
    total = np.zeros(len(network.languages))
    for start in range(0, len(raw), language.WINDOW):
        cut = raw[start:start + language.WINDOW]
        padded = cut + b"\0" * (language.WINDOW - len(cut))
        forward = gru([p["xf"][b] for b in padded], p["uf"])
        backward = gru([p["xb"][b] for b in reversed(padded)], p["ub"])[::-1]
        for i in range(len(cut)):
            e = np.exp(forward[i] @ p["vf"] + backward[i] @ p["vb"] + p["c"])
            total += e / e.sum()
    return total / max(1, len(raw))


def test_language_probabilities_are_those_of_plain_loops(shipped):
    network = language.ByteNetwork(["aa", "bb", "cc"], seed=5)
    rnd = random.Random(1)
    texts = ["x", "one word", "é中😀 " * 70, "".join(rnd.choice("abc dé") for _ in range(700)), "y" * 128, "z" * 129]
    want = [plain_language(network, t.encode()) for t in texts]
    rows = language.predict(shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).orderBy("doc_id").collect()
    for r, probs in zip(rows, want):
        assert abs(r.score - probs.max()) < 1e-4 and r.lang_pred == network.languages[int(probs.argmax())]


# ---- 8 ----------------------------------------------------------------------

def plain_toxicity(network, text):
    p = {k: v.astype(float) for k, v in network.p.items()}
    raw = np.frombuffer(text.encode(), np.uint8)
    found = toxicity.Positions(raw, np.array([0, len(raw)]))
    edges = [*found.first_byte.tolist(), found.grams.shape[1]]
    words = []
    for i, bucket in enumerate(found.word):
        e = p["word"][bucket].copy()
        for at in range(edges[i], edges[i + 1]):
            e += (p["gram"][found.grams[0][at]] + p["gram"][found.grams[1][at]]) * found.scale[i]
        words.append(e)
    best, start = -math.inf, 0
    while True:
        part = words[start:start + toxicity.WINDOW]
        forward = gru([e @ p["wf"] + p["bf"] for e in part], p["uf"])
        backward = gru([e @ p["wb"] + p["bb"] for e in reversed(part)], p["ub"])[::-1]
        states = [np.concatenate(x) for x in zip(forward, backward)]
        weights = [math.exp(float(s @ p["att"][:, 0])) for s in states]
        pooled = sum((w / sum(weights) * s for w, s in zip(weights, states)), np.zeros(len(p["out"])))
        best = max(best, float(pooled @ p["out"][:, 0] + p["c"][0]))
        if start + toxicity.WINDOW >= len(words):
            return sig(best)
        start += toxicity.STRIDE


def test_toxicity_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    network = toxicity.ToxicityNetwork(rng.normal(size=toxicity.WORD_BUCKETS).astype(np.float32), rng.normal(size=toxicity.GRAM_BUCKETS).astype(np.float32))
    rnd = random.Random(2)
    texts = ["", "!!", "one", *(" ".join("".join(rnd.choice("abcdé1") for _ in range(rnd.randint(1, 9))) for _ in range(n)) for n in (3, 63, 64, 65, 112, 113, 300))]
    raws = [t.encode() for t in texts]
    got = network.scores(np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raws]))))
    assert np.allclose(got, [plain_toxicity(network, t) for t in texts], atol=1e-4)


# ---- 5 ----------------------------------------------------------------------

def plain_attention(model, ids, end):
    """Natural log probabilities of the subwords and the end, one query position at a time."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    inputs, targets, out = [end, *ids], [*ids, end], []
    step = language_model.STEP
    for t, target in enumerate(targets):
        first = max(0, (t // step - 1) * step)
        query = p["e"][inputs[t]] @ p["wq"] / math.sqrt(p["wq"].shape[1])
        weights = [math.exp(min(60.0, float(query @ (p["e"][inputs[s]] @ p["wk"]) + p["rel"][t - s]))) for s in range(first, t + 1)]
        context = sum(w * (p["e"][inputs[s]] @ p["wv"] @ p["wo"]) for w, s in zip(weights, range(first, t + 1))) / sum(weights)
        h = np.tanh(context + p["e"][inputs[t]] @ p["wr"] + p["b"])
        c, m = model.cls[target], model.member[target]
        outer, inner = h @ p["cw"].T + p["cb"], h @ p["mw"][c].T + p["mb"][c]
        out.append(float(outer[c] - np.log(np.exp(outer).sum()) + inner[m] - np.log(np.exp(inner).sum())))
    return out


@pytest.fixture(scope="module")
def small_model():
    subwords = language_model.Subwords(bpe.vocabulary(bpe.default_vocabulary()))
    rng = np.random.default_rng(4)
    model = language_model.Attention(subwords.size, rng.integers(1, 500, subwords.size).astype(float))
    model.p["rel"] = rng.normal(size=language_model.CONTEXT).astype(np.float32)
    return subwords, model


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 100])
def test_attention_is_that_of_one_position_at_a_time(small_model, n):
    subwords, model = small_model
    ids = np.random.default_rng(n).integers(0, subwords.end, n)
    x, y, fresh, valid = language_model.windows(np.array([0, n]), ids, subwords.end)
    got = language_model.attention_logs(model, model.tables(), x, fresh, y)[valid]
    assert np.allclose(got, plain_attention(model, ids.tolist(), subwords.end), atol=1e-3)


def test_scores_are_those_of_plain_loops(shipped, small_model, monkeypatch):
    subwords, model = small_model
    monkeypatch.setattr(language_model, "learned_model", lambda *args, **more: (model, 0))
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["one", "Two", "three", "naïve", "internationalisation", "x" * 60]) for _ in range(rnd.randint(0, 40)))) for i in range(40)] + [(90, None)]
    got = {r.doc_id: r for r in language_model.score_documents(shipped.createDataFrame(rows, "doc_id long, text string"), bpe.default_vocabulary()).collect()}
    words_of = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()]
    counts: dict = {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in [*words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        words = words_of(t)
        cut = []
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            cut.append(subwords.segment(raw, np.array([0]), np.array([len(raw)]))[0].tolist())
        logs = plain_attention(model, [s for c in cut for s in c], subwords.end)
        score = base = at = 0.0
        at = 0
        for w, c in [*zip(words, cut), (None, [subwords.end])]:
            chance = math.exp(sum(logs[at:at + len(c)]))
            at += len(c)
            seen = counts.get(w, 0)
            score += math.log10(language_model.MIX * seen / total + (1 - language_model.MIX) * chance)
            base += math.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
        r = got[i]
        assert abs(r.score - score) < 1e-3 * max(1, len(logs)) and abs(r.base_score - base) < 1e-6
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words) + 1, total, sum(w in counts for w in [*words, None]))
