"""Kneser-Ney perplexity, detector selection and subword budgets against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.operators import expand as E
from curatio.operators import metrics as M
from curatio.operators import ml as ML

SMALL = "/root/testdata/sf0.001"


def pairs_of(text):
    seq = ["<s>", *(text or "").lower().split()]
    return list(zip(seq, seq[1:]))


def plain_kneser_ney(corpus, texts):
    c12 = Counter(p for t in corpus for p in pairs_of(t))
    c1, n1, n2 = Counter(), Counter(), Counter()
    for (a, b), c in c12.items():
        c1[a] += c
        n1[a] += 1
        n2[b] += 1
    once, twice, p, v = (sum(c == k for c in c12.values()) for k in (1, 2)), None, len(c12), len(n2)
    once, twice = once
    d = once / (once + 2 * twice) if once else 0.5

    def prob(a, b):
        q = max(n2[b] - d, 0) / p + d * v / (p * (v + 1))
        return max(c12[a, b] - d, 0) / c1[a] + d * n1[a] / c1[a] * q if a in c1 else q
    out = []
    for t in texts:
        logs = [math.log(prob(a, b)) for a, b in pairs_of(t)]
        out.append((len(logs), math.exp(-sum(logs) / len(logs)) if logs else None))
    return out, prob, set(n2)


def plain_add_k(corpus, texts, k=0.5):
    c12 = Counter(p for t in corpus for p in pairs_of(t))
    c1 = Counter()
    for (a, _), c in c12.items():
        c1[a] += c
    v = len({b for _, b in c12}) + 1
    logs = [[math.log((c12[p] + k) / (c1[p[0]] + k * v)) for p in pairs_of(t)] for t in texts]
    return [math.exp(-sum(x) / len(x)) if x else None for x in logs]


def sentences(n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(["the", "a", "Cat", "dog", "runs", "sat", "on", f"w{rnd.randint(0, 50)}"], weights=[30, 9, 3, 3, 2, 2, 5, 6], k=rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("share", [1000, 5])
def test_perplexity_is_that_of_the_formula(spark, monkeypatch, share):
    monkeypatch.setattr(M, "HOT_SHARE", share)
    corpus, texts = sentences(120, 1), [*sentences(40, 2), None, "", "unseen words only here"]
    got = M.ngram_perplexity(spark.createDataFrame([(t,) for t in corpus], "text STRING"),
                             spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING"), "text", "id")
    want, prob, words = plain_kneser_ney(corpus, texts)
    for r in got.collect():
        n, ppl = want[r.id]
        assert r.n_bigrams == n and (r.perplexity is None) == (ppl is None) and r.status == ("no_tokens" if not n else "ok")
        assert ppl is None or abs(r.perplexity - ppl) < 1e-3
    for context in ("the", "cat", "never seen"):        # a distribution: all words and the unknown one
        assert abs(sum(prob(context, w) for w in words) + prob(context, "no such word") - 1) < 1e-9


def test_perplexity_is_below_add_k(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    corpus, texts = [r.text for r in d if r.doc_id % 5], [r.text for r in d if r.doc_id % 5 == 0 and (r.text or "").split()]
    own = M.ngram_perplexity(spark.createDataFrame([(t,) for t in corpus], "text STRING"),
                             spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING"), "text", "id").agg(F.avg(F.log("perplexity"))).first()[0]
    assert own < np.mean([math.log(p) for p in plain_add_k(corpus, texts)]) - 0.1


def test_perplexity_without_a_corpus(spark):
    texts = spark.createDataFrame([(1, "some words"), (2, "")], "id LONG, text STRING")
    got = M.ngram_perplexity(spark.createDataFrame([], "text STRING"), texts, "text", "id").orderBy("id").collect()
    assert [(r.perplexity, r.status) for r in got] == [(None, "no_corpus"), (None, "no_tokens")]


def labelled(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rnd.random() < 0.4)
        words = [rnd.choice(["common", "words", "of", "all", f"n{rnd.randint(0, 400)}"]) for _ in range(12)]
        words += [rnd.choice(["hidden", "secret"] if label else ["open", "plain"])] * (rnd.random() < 0.85)
        rows.append((i, " ".join(words), label))
    return rows


def test_detector_chooses_by_validation_loss(spark):
    rows = labelled(400, 1)
    train = spark.createDataFrame(rows, "key LONG, input STRING, label INT")
    test = spark.createDataFrame(labelled(150, 2), "key LONG, input STRING, label INT")
    detector, said = ML.fit_detector(train, test, "key", num_features=512, path=(1.0, 0.1, 0.01, 0.0001))
    assert detector.reg == min(detector.path, key=lambda p: p[1])[0] and len(detector.path) >= 3
    got = said.select("label", "output", "output_logits").collect()
    assert np.mean([r.label == r.output for r in got]) > 0.85
    # the same model by plain gradient descent on the same features
    part = detector.features.transform(ML.binary_weights(train, "label"))
    from curatio.operators.sampling import split_fraction
    chosen = split_fraction(part, 0.85, "key", 42, by=["label"]).where("split = 'train'").select("_feat", "label", "weight").collect()
    x, t, w = np.array([r["_feat"].toArray() for r in chosen]), np.array([r.label for r in chosen]), np.array([r.weight for r in chosen])
    sd = np.sqrt(np.maximum(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w) * w.sum() / (w.sum() - 1), 0))
    use = sd > 0
    a = np.hstack([x[:, use] / sd[use], np.ones((len(x), 1))])     # Spark penalises standardised coefficients
    beta = np.zeros(a.shape[1])
    ridge = np.append(np.full(use.sum(), detector.reg * w.sum()), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        beta -= np.linalg.solve((a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (w * (p - t)) + ridge * beta)
    feats = np.array([r["_feat"].toArray() for r in detector.features.transform(test).select("_feat").collect()])
    z = feats[:, use] / sd[use] @ beta[:-1] + beta[-1]
    assert np.mean((z > 0) == [r.output for r in got]) > 0.98
    assert np.abs(z - [r.output_logits[1] for r in got]).mean() < 0.1


def test_detector_stops_after_settings_without_gain(spark):
    rnd = random.Random(3)          # labels that the texts say nothing about: the strongest setting is best
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(80)], k=10)), rnd.randint(0, 1)) for i in range(120)]
    detector = ML.Detector(spark.createDataFrame(rows, "key LONG, input STRING, label INT"), "key", num_features=256,
                           path=(1e-4, 1e-3, 1e-2, 0.1, 50.0), patience=2)
    assert detector.path[0][0] == detector.reg == 50.0 and len(detector.path) == 3


def test_subword_budgets_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = [None, "", "one", "Ünïcödé ñandú 中文 😀 words <|endoftext|> and more of them " * 3, "x" * 3000, "\n\n  spaces\t"]
    got = E.truncate_subwords(spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING"), "text", path, (0, 1, 5, 40, 10_000))
    rows = {(r.id, r.budget): r.truncated for r in got.collect()}
    assert len(rows) == 5 * len(texts)
    for i, text in enumerate(texts):
        for k in (0, 1, 5, 40, 10_000):
            if text is None:
                assert rows[i, k] is None
                continue
            spans = own.encode(text, add_special_tokens=False).offsets
            assert rows[i, k] == text[:len(text) if len(spans) <= k else spans[k - 1][1] if k else 0]
            ids = own.encode(text, add_special_tokens=False).ids
            head = own.decode(ids[:k], skip_special_tokens=False)
            assert rows[i, k].startswith(head.rstrip("�")) and len(rows[i, k]) - len(head.rstrip("�")) <= 1


def test_space_budgets_are_the_first_parts(spark):
    texts = [None, "", "a", "a b  c d", " lead and trail "]
    got = E.truncate_tokens(spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING"), "text", (1, 2, 3, 50))
    assert {(r.id, r.budget): r.truncated for r in got.collect()} == {
        (i, k): None if t is None else " ".join(t.split(" ")[:k]) for i, t in enumerate(texts) for k in (1, 2, 3, 50)}
