"""Language identification by a bidirectional gated recurrent network over bytes.

Training: at most ``texts_per_language`` texts of each language, whole, in a
bounded sample: the first by a hash of the row, among the texts of at most
``LONGEST`` bytes, while they hold at most ``LANGUAGE_BYTES`` bytes together; the
languages are the ``MAX_LANGUAGES`` with the most rows.  The network is trained in
numpy on the driver by backpropagation through time on windows of ``WINDOW``
bytes, with a label at every position.

Prediction: every text is cut into windows of ``WINDOW`` bytes that together
cover it all; the network gives every byte a distribution over the learned
languages and the document's probabilities are the mean over all its bytes.
Texts are handled in chunks of bounded bytes, so memory does not depend on the
table, and the rows are not shuffled.

A text that is null or has no letter: ``und``, score 0.  If nothing can be
learned (no labelled text), all texts are ``und``.  Null languages are not
learned; null ids have remainder 0 and are held in.  Repeated rows give a row
each.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import bounded_sample, id_remainder, read, releasing_batches, row_schema, text_chunks, whole_rows
from curatio.llm.recurrent import Adam, gru_backward, gru_forward, softmax

WINDOW = 128
HIDDEN = 8
TEXTS_PER_LANGUAGE = 400
LONGEST, LANGUAGE_BYTES, MAX_LANGUAGES = 256 << 10, 2 << 20, 64
EPOCHS, UPDATES = 1, 200      # passes over the sample; more if they make fewer updates
ROWS_AT_ONCE = 1024
UNDETERMINED = "und"
FOLDS, HELD_OUT = 3, 1
_LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW):
    """Windows that cover each row: bytes (n, size; zero beyond the row's end),
    number of valid bytes, row of each."""
    length = np.diff(offsets)
    n = -(-length // size)
    row = np.repeat(np.arange(len(length)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + k * size
    valid = np.minimum(length[row] - k * size, size)
    cut = data[np.minimum(start[:, None] + np.arange(size), len(data) - 1)]
    short = np.flatnonzero(valid < size)
    cut[short] = np.where(np.arange(size) < valid[short, None], cut[short], 0)
    return cut, valid, row


class ByteNetwork:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, n = languages, len(languages)
        init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"xf": init(256, 3 * hidden, scale=0.3), "xb": init(256, 3 * hidden, scale=0.3),
                  "uf": init(hidden, 3 * hidden, scale=0.3), "ub": init(hidden, 3 * hidden, scale=0.3),
                  "vf": init(hidden, n, scale=0.3), "vb": init(hidden, n, scale=0.3), "c": np.zeros(n, np.float32)}

    def fit(self, data: np.ndarray, valid: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, updates: int = UPDATES, rows: int = 128, seed: int = 7):
        """Backpropagation through time; every valid position has the label of its window."""
        p, opt, rng = self.p, Adam(self.p, 0.02), np.random.default_rng(seed)
        for _ in range(max(epochs, -(-updates * rows // max(1, len(data))))):
            order = rng.permutation(len(data))
            for i in range(0, len(order), rows):
                pick = order[i:i + rows]
                x = np.ascontiguousarray(data[pick].T)
                weight = (np.arange(x.shape[0])[:, None] < valid[pick]).astype(np.float32)
                hf, sf = gru_forward(p["xf"][x], p["uf"], keep=True)
                hb, sb = gru_forward(p["xb"][x[::-1]], p["ub"], keep=True)
                hb = hb[::-1]
                d = softmax(hf @ p["vf"] + hb @ p["vb"] + p["c"])
                d[:, np.arange(len(pick)), labels[pick]] -= 1
                d *= (weight / max(1.0, weight.sum()))[:, :, None]
                dxf, duf = gru_backward(d @ p["vf"].T, p["uf"], sf)
                dxb, dub = gru_backward((d @ p["vb"].T)[::-1], p["ub"], sb)
                grads = {"uf": duf, "ub": dub, "vf": np.einsum("trh,trl->hl", hf, d), "vb": np.einsum("trh,trl->hl", hb, d), "c": d.sum((0, 1))}
                for k, ids, g in (("xf", x, dxf), ("xb", x[::-1], dxb)):
                    grads[k] = np.zeros_like(p[k])
                    np.add.at(grads[k], ids.ravel(), g.reshape(-1, g.shape[2]))
                opt.update(grads)
        return self

    def window_sums(self, data: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities of each window."""
        p = self.p
        out = np.zeros((len(data), len(self.languages)), np.float64)
        for i in range(0, len(data), ROWS_AT_ONCE):
            x = np.ascontiguousarray(data[i:i + ROWS_AT_ONCE].T)
            length = valid[i:i + ROWS_AT_ONCE]
            hf = gru_forward(p["xf"][x], p["uf"])
            hb = gru_forward(p["xb"][x[::-1]], p["ub"])[::-1]
            logits = hf @ p["vf"]
            logits += hb @ p["vb"]
            logits += p["c"]
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=2, keepdims=True)
            if (length < x.shape[0]).any():
                logits *= (np.arange(x.shape[0])[:, None] < length)[:, :, None]
            out[i:i + ROWS_AT_ONCE] = logits.sum(axis=0)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over the bytes of each row."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(data):
            cut, valid, row = windows(data, offsets)
            np.add.at(out, row, self.window_sums(cut, valid))
        return out / np.maximum(1, np.diff(offsets))[:, None]


def train(docs: DataFrame, learnable, texts_per_language: int = TEXTS_PER_LANGUAGE) -> ByteNetwork | None:
    """A network from the bounded sample of the rows where ``learnable``."""
    size = F.octet_length("text")
    rows = docs.where(learnable & F.col("lang").isNotNull() & (size > 0) & (size <= LONGEST)).select("doc_id", "lang", "text")
    languages = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    sample = bounded_sample(rows, dict.fromkeys(languages, texts_per_language), "lang", 5).select("lang", "text", "_rank")
    held = F.sum(size).over(Window.partitionBy("lang").orderBy("_rank"))
    sample = sample.withColumn("_held", held).where(F.col("_held") <= LANGUAGE_BYTES).collect()
    sample = sorted((r for r in sample if _LETTER.search(r["text"])), key=lambda r: (r["lang"], r["_rank"], r["text"]))
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    raw = [r["text"].encode() for r in sample]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    data, valid, row = windows(np.frombuffer(b"".join(raw), np.uint8), offsets)
    labels = np.array([languages.index(r["lang"]) for r in sample])[row]
    return ByteNetwork(languages).fit(data, valid, labels)


def _predict(network: ByteNetwork | None):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            names, scores = [], []
            for first, end, data, offsets in text_chunks(batch, "text"):
                probs = network.documents(data, offsets) if network else None
                for i in range(end - first):
                    if network is None or not _LETTER.search(texts[first + i].as_py() or ""):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        best = int(probs[i].argmax())
                        names.append(network.languages[best])
                        scores.append(float(min(1.0, probs[i, best])))
            yield pa.RecordBatch.from_arrays(
                [*[c for c, n in zip(batch.columns, batch.schema.names) if n != "text"],
                 pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing_batches(_predict(network)), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    return predict(docs, train(docs, id_remainder("doc_id", FOLDS) != HELD_OUT, texts_per_language))


def keep_identified(docs: DataFrame, min_score: float, texts_per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, whole, whose language is determined with at least
    ``min_score``."""
    network = train(docs, id_remainder("doc_id", FOLDS) != HELD_OUT, texts_per_language)
    rows = whole_rows(docs).select("row", "text").mapInArrow(releasing_batches(_predict(network)), row_schema(docs, "lang_pred string", "score double"))
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")


@register("op6_language")
def op6_language(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
