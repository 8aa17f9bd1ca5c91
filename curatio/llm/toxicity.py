"""Toxicity scores by a bidirectional gated recurrent network with attention
pooling over word and character inputs.

Input of a position: an embedding of the word plus the scaled sum of the
embeddings of its character 3-grams and 5-grams (bytes of the word, A-Z
lower-cased), both by hash bucket.  The first embedding column is the shrunk
log-odds of the bucket in toxic documents, taken from one half of the training
sample; the other columns and all further weights are trained on the other half.
The network reads windows of ``WINDOW`` words that overlap by
``WINDOW - STRIDE``; attention pools the states of a window, and a document's
score is the highest of its windows.  Training follows the same rule: the
gradient of a document goes to its highest window.

Learning uses at most ``TOXIC_TEXTS`` and ``CLEAN_TEXTS`` labelled documents (the
first by a hash of the row), of at most ``LONGEST`` bytes each and ``CLASS_BYTES``
bytes a label together; an id that occurs again in the documents gives one text.
They are used whole: a text of more than ``PIECE`` bytes is cut
into parts that overlap like the windows, so that the parts together have the
windows of the text, and only the part with its highest window is kept for the
gradient.  Scoring reads every text whole, in chunks of bounded bytes, without a
shuffle.

A text without words (null, empty, signs only) is one window without positions:
its score is the network's bias.  If no label can be learned, all scores are 0.
Null labels and null ids of labels are not learned; null document ids have
remainder 0 and are held out.  A document labelled twice is toxic if one label
says so.  Repeated rows give a row each.  Empty table: empty result.  Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import bounded_sample, id_remainder, lower_ascii, read, span_hashes, text_chunks, word_spans
from curatio.llm.recurrent import Adam, gru_backward, gru_forward, sigmoid

WINDOW = 64
STRIDE = 48
HIDDEN = 8
EMBEDDING = 6
WORD_BUCKETS = 1 << 15
GRAM_BUCKETS = 1 << 15
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 4500
LONGEST, CLASS_BYTES = 1 << 20, 64 << 20
PIECE = 20_000
EPOCHS = 6
CHUNK = 1 << 20
ROWS_AT_ONCE = 1024
FOLDS, HELD_OUT = 5, 0
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Positions:
    """Words of some rows: buckets of each word and of its character grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = lower_ascii(data)
        starts, ends, self.row = word_spans(data, offsets, _WORD_BYTE[data])
        self.n_rows = len(offsets) - 1
        self.word = (span_hashes(data, starts, ends) >> np.uint64(64 - 15)).astype(np.int64)
        length = ends - starts
        byte = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - byte
        at = byte + np.repeat(starts, length)
        padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
        three = (padded[at] * np.uint32(0x9E3779B1)) ^ (padded[at + 1] * np.uint32(0x85EBCA77)) ^ (padded[at + 2] * np.uint32(0xC2B2AE3D))
        five = three ^ (padded[at + 3] * np.uint32(0x27D4EB2F)) ^ (padded[at + 4] * np.uint32(0x165667B1)) ^ np.uint32(0x5BD1E995)
        self.grams = np.stack([np.where(left >= n, 1 + (((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)) % np.uint32(GRAM_BUCKETS - 1), 0)
                               for n, g in ((3, three), (5, five))]).astype(np.int32)       # bucket 0: no gram
        self.first_byte = np.cumsum(length) - length
        self.scale = (1 / np.sqrt(np.maximum(1, 2 * length))).astype(np.float32)

    def embed(self, p: dict) -> np.ndarray:
        out = p["word"][self.word]
        if len(self.word):
            grams = p["gram"][self.grams[0]]
            grams += p["gram"][self.grams[1]]
            out = out + np.add.reduceat(grams, self.first_byte, axis=0) * self.scale[:, None]
        return out

    def windows(self):
        """Positions (windows, WINDOW) with -1 for none, and the row of each;
        a row without words has one window without positions."""
        n = np.bincount(self.row, minlength=self.n_rows)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        row = np.repeat(np.arange(self.n_rows), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = (k * STRIDE)[:, None] + np.arange(WINDOW)
        at = place + (np.cumsum(n) - n)[row][:, None]
        return np.where(place < n[row][:, None], at, -1), row


class ToxicityNetwork:
    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = p = {"word": init(WORD_BUCKETS, EMBEDDING, scale=0.02), "gram": init(GRAM_BUCKETS, EMBEDDING, scale=0.02),
                      "wf": init(EMBEDDING, 3 * HIDDEN, scale=0.4), "wb": init(EMBEDDING, 3 * HIDDEN, scale=0.4),
                      "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
                      "uf": init(HIDDEN, 3 * HIDDEN, scale=0.3), "ub": init(HIDDEN, 3 * HIDDEN, scale=0.3),
                      "att": init(2 * HIDDEN, 1, scale=0.3), "out": init(2 * HIDDEN, 1, scale=0.3), "c": np.full(1, -1.0, np.float32)}
        p["word"][:, 0], p["gram"][:, 0] = word_odds, gram_odds
        p["gram"][0] = 0

    def logits(self, embedded: np.ndarray, place: np.ndarray, saved: dict | None = None) -> np.ndarray:
        """Logit of each window; attention over its positions."""
        p, keep = self.p, saved is not None
        valid = (place >= 0).T
        at = np.maximum(place, 0).T
        blank = np.zeros((1, EMBEDDING), np.float32)
        e = embedded if len(embedded) else blank
        xf, xb = e @ p["wf"] + p["bf"], e @ p["wb"] + p["bb"]
        xf, xb = xf[at], xb[at[::-1]]
        xf[~valid] = 0
        xb[~valid[::-1]] = 0
        f = gru_forward(xf, p["uf"], keep)
        b = gru_forward(xb, p["ub"], keep)
        if keep:
            f, saved["f"] = f
            b, saved["b"] = b
        h = np.concatenate((f, b[::-1]), axis=2)
        score = np.where(valid, (h @ p["att"])[:, :, 0], -np.inf)
        top = np.maximum(score.max(axis=0), -1e30)
        weight = np.exp(score - top) * valid
        weight /= np.maximum(weight.sum(axis=0), 1e-30)
        pooled = np.einsum("tr,trh->rh", weight, h)
        if keep:
            saved.update(h=h, weight=weight, pooled=pooled, valid=valid, at=at)
        return (pooled @ p["out"])[:, 0] + p["c"][0]

    def gradients(self, positions: Positions, embedded: np.ndarray, place: np.ndarray, label: np.ndarray) -> dict:
        p, s = self.p, {}
        d = ((sigmoid(self.logits(embedded, place, s)) - label) / len(label)).astype(np.float32)
        g = {"out": s["pooled"].T @ d[:, None], "c": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["out"][:, 0]
        h, weight = s["h"], s["weight"]
        d_weight = np.einsum("rh,trh->tr", d_pooled, h)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("trh,tr->h", h, d_score)[:, None]
        d_h = weight[:, :, None] * d_pooled + d_score[:, :, None] * p["att"][:, 0]
        d_e = np.zeros_like(embedded)
        for k, d_states, order in (("f", d_h[:, :, :HIDDEN], slice(None)), ("b", d_h[::-1, :, HIDDEN:], slice(None, None, -1))):
            d_x, g["u" + k] = gru_backward(np.ascontiguousarray(d_states), p["u" + k], s[k])
            ok = s["valid"][order]
            d_x, at = d_x[ok], s["at"][order][ok]
            g["b" + k] = d_x.sum(axis=0)
            g["w" + k] = embedded[at].T @ d_x
            np.add.at(d_e, at, d_x @ p["w" + k].T)
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], positions.word, d_e)
        used = np.unique(place[place >= 0])
        length = np.diff(np.append(positions.first_byte, positions.grams.shape[1]))[used]
        byte = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(positions.first_byte[used], length)
        spread = np.repeat(d_e[used] * positions.scale[used, None], length, axis=0)
        for grams in positions.grams:
            np.add.at(g["gram"], grams[byte], spread)
        g["gram"][0] = 0
        g["word"][:, 0] = 0             # the log-odds column is a statistic
        g["gram"][:, 0] = 0
        return g

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest window score of each row."""
        return sigmoid(self.window_maxima(Positions(data, offsets)).astype(np.float64))

    def window_maxima(self, positions: Positions) -> np.ndarray:
        """Highest window logit of each row."""
        embedded = positions.embed(self.p)
        place, row = positions.windows()
        logit = np.concatenate([self.logits(embedded, place[i:i + ROWS_AT_ONCE]) for i in range(0, len(place), ROWS_AT_ONCE)])
        best = np.full(positions.n_rows, -np.inf, np.float32)
        np.maximum.at(best, row, logit.astype(np.float32))
        return best


def parts(raw: bytes, size: int = PIECE) -> list[bytes]:
    """``raw`` cut into parts of about ``size`` bytes at words, whose windows are
    those of the whole."""
    if len(raw) <= size:
        return [raw]
    data = lower_ascii(np.frombuffer(raw, np.uint8))
    starts, ends, _ = word_spans(data, np.array([0, len(raw)]), _WORD_BYTE[data])
    n_windows = max(1, -(-(len(starts) - WINDOW) // STRIDE) + 1)
    out, k = [], 0
    while k < n_windows and len(starts):
        first = starts[k * STRIDE]
        fits = int(np.searchsorted(ends, first + size, "right")) - WINDOW - k * STRIDE       # words beyond the first window
        stop = min(n_windows, k + 1 + max(0, fits) // STRIDE)
        out.append(raw[first:ends[min((stop - 1) * STRIDE + WINDOW, len(ends)) - 1]])
        k = stop
    return out or [b""]


def _by_bytes(texts: list[list[bytes]], picks, limit: int = CHUNK):
    """(text, part) pairs of the ``picks`` in runs of about ``limit`` bytes."""
    run, size = [], 0
    for t in picks:
        for part in texts[t]:
            if run and size + len(part) > limit:
                yield run
                run, size = [], 0
            run.append((t, part))
            size += len(part)
    if run:
        yield run


def log_odds(texts: list[list[bytes]], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of each word and gram bucket, from document counts; a
    text is the list of its parts."""
    sizes = WORD_BUCKETS, GRAM_BUCKETS
    seen = [np.zeros((2, size), np.int64) for size in sizes]
    open_text, found = -1, [np.zeros(0, np.int64) for _ in sizes]          # the buckets of the last text, which may go on

    def close():
        for count, buckets in zip(seen, found):
            if open_text >= 0:
                count[int(label[open_text] > 0)][buckets] += 1

    for run in _by_bytes(texts, range(len(texts))):
        ids, of_part = np.unique([t for t, _ in run], return_inverse=True)
        positions = Positions(*_join([part for _, part in run]))
        word_of_byte = np.repeat(np.arange(len(positions.word)), np.diff(np.append(positions.first_byte, positions.grams.shape[1])))
        row, row_of_byte = of_part[positions.row], of_part[positions.row[word_of_byte]]
        if ids[0] != open_text:
            close()
            found = [np.zeros(0, np.int64) for _ in sizes]
        last = len(ids) - 1
        for k, (count, pairs) in enumerate(zip(seen, ([(row, positions.word)], [(row_of_byte, g) for g in positions.grams]))):
            size = count.shape[1]
            once = np.unique(np.concatenate([r * size + b for r, b in pairs] + ([found[k]] if ids[0] == open_text else [])))
            done = once[once < last * size]
            toxic = label[ids[done // size]] > 0
            for y in (0, 1):
                count[y] += np.bincount(done[toxic == y] % size, minlength=size)
            found[k] = once[once >= last * size] % size
        open_text = int(ids[last])
    close()
    out = []
    for clean, toxic in seen:
        odds = np.log((toxic + 0.5) / ((label > 0).sum() + 1)) - np.log((clean + 0.5) / ((label == 0).sum() + 1))
        out.append((odds * (clean + toxic) / (clean + toxic + 8)).astype(np.float32))
    out[1][0] = 0
    return out[0], out[1]


def highest_parts(network: ToxicityNetwork, texts: list[list[bytes]], picks) -> list[bytes]:
    """Of each text the part with its highest window."""
    best: dict[int, tuple[float, bytes]] = {}
    for run in _by_bytes(texts, [t for t in picks if len(texts[t]) > 1]):
        top = network.window_maxima(Positions(*_join([part for _, part in run])))
        for (t, part), value in zip(run, top.tolist()):
            if t not in best or value > best[t][0]:
                best[t] = value, part
    return [best[t][1] if t in best else texts[t][0] for t in picks]


def _join(texts: list[bytes]):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rows: int = 64, seed: int = 11) -> ToxicityNetwork:
    raw, label = [parts(t.encode()) for t in texts], np.array(labels, np.float32)
    odd = np.arange(len(raw)) % 2 == 1
    for side in (odd, ~odd):            # both halves need both labels; a tiny sample uses all rows for both
        if len(set(label[side].tolist())) < 2 or len(raw) < 200:
            odd = np.ones(len(raw), bool)
            break
    counted, learned = np.flatnonzero(odd), np.flatnonzero(~odd if not odd.all() else odd)
    network = ToxicityNetwork(*log_odds([raw[i] for i in counted], label[counted]))
    opt, rng = Adam(network.p, 0.02), np.random.default_rng(seed)
    for _ in range(epochs if len(raw) >= 200 else 4 * epochs):
        order = rng.permutation(learned)
        for i in range(0, len(order), rows):
            pick = order[i:i + rows]
            positions = Positions(*_join(highest_parts(network, raw, pick)))
            embedded = positions.embed(network.p)
            place, row = positions.windows()
            logit = np.concatenate([network.logits(embedded, place[k:k + ROWS_AT_ONCE]) for k in range(0, len(place), ROWS_AT_ONCE)])
            by_logit = np.lexsort((-logit, row))
            highest = by_logit[np.searchsorted(row[by_logit], np.arange(len(pick)))]
            opt.update(network.gradients(positions, embedded, place[highest], label[pick]))
    return network


def train(docs: DataFrame, labels: DataFrame, toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> ToxicityNetwork | None:
    learnable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_remainder("doc_id", FOLDS) != HELD_OUT))
                 .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    chosen = bounded_sample(learnable, {1: toxic_texts, 0: clean_texts}, "toxic", 9).drop("_place")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id")           # at most toxic_texts + clean_texts rows
            .where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)))
    # an id that repeats gives one text, however often and with however many texts it does
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"), F.max("_rank").alias("_rank"))
    held = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("_rank", "doc_id"))
    rows = rows.withColumn("_held", held).where(F.col("_held") <= CLASS_BYTES).select("doc_id", "text", "toxic", "_rank").collect()
    rows = sorted(rows, key=lambda r: (r["_rank"], r["toxic"], r["text"]))
    if len({r["toxic"] for r in rows}) < 2:
        return None
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def _score(network: ToxicityNetwork | None):
    def run(batches):
        for batch in batches:
            found = [np.zeros(0)]
            for first, end, data, offsets in text_chunks(batch, "text", CHUNK):
                found.append(network.scores(data, offsets) if network else np.zeros(end - first))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text."""
    network = train(docs, labels, toxic_texts, clean_texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(network), "doc_id long, held_out boolean, score double, predicted int")


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
