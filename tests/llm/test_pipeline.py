"""The pipeline against plain versions of its stages, and on odd input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from curatio.llm import bpe, language

from . import plain
from .conftest import SMALL


def test_run_equals_the_plain_stages(shipped, documents):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(shipped, SMALL).collect()}
    network = language.train(documents, language.id_remainder("doc_id", 3) != 1)
    rows = []
    for r in documents.orderBy("doc_id").collect():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        if network.documents(raw, np.array([0, len(raw)])).max() >= corpus_pipeline.MIN_SCORE and any(c.isalpha() for c in r["text"]):
            rows.append((r["doc_id"], r["text"]))
    roots = plain.linked([plain.fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    kept = plain.removed_repeats(rows, characters=True)
    rows = [(i, kept[i][3].decode()) for i, _ in rows]
    items = [r[0] for r in shipped.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    leaked = {d for d, _ in plain.contained([t for _, t in rows], items)}
    rows = [r for d, r in enumerate(rows) if d not in leaked]
    coder = bpe.Bpe(bpe.vocabulary(bpe.default_vocabulary()))
    assert sorted(got) == [i for i, _ in rows] and leaked and len(rows) < documents.count()
    for i, text in rows:
        ids, decoded = coder.encode(text)
        r = got[i]
        assert (r["text"], r["n_chars"], r["n_tokens"], bytes(r["token_ids"])) == (text, len(text), len(ids) // 4, ids)
        assert (r["ids_sha256"], r["decoded_sha256"]) == (plain.sha(ids), plain.sha(decoded.encode()))


def test_stages_on_odd_rows_and_on_nothing(shipped, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(shipped, odd, SMALL)
        assert stage(shipped, nothing, SMALL).count() == 0
        if name == "tokens":
            assert out.columns[:5] == odd.columns[:5] and out.count() == odd.count()
        else:
            assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
            assert 0 < out.count() <= odd.count()


def test_only_dropped_rows_are_missing(shipped, documents):
    kept = corpus_pipeline.language_stage(shipped, documents, SMALL)
    assert kept.count() > 0.9 * documents.count()
    assert kept.exceptAll(documents).count() == 0
    assert corpus_pipeline.near_dedup_stage(shipped, documents.unionAll(documents), SMALL).exceptAll(documents).count() == 0
    assert documents.select(F.count_distinct("doc_id")).first()[0] == documents.count()
