"""LM scoring: a causal self-attention model on subword ids, mixed with corpus
counts of words.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one
end.  ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens.

``score``: a word's probability is ``MIX * c / N + (1 - MIX) * A``, where A is the
product of the attention model's probabilities of the word's subwords given the
text before (both parts sum to one over all words).  Subwords
are the first ``MERGES`` merges of a public byte-level vocabulary with word ends
(read by the driver, never trained or stored here), applied to pieces of at most
``PIECE`` bytes of a word, so every text has exactly one sequence of subwords and
the subwords of all texts are covered.  The model is one layer of causal
self-attention with learned relative positions, a skip path and a two-level
softmax.  Windows of ``CONTEXT`` inputs overlap by half: each scores the second
half, so that every subword is scored once and sees between CONTEXT / 2 and
CONTEXT inputs, itself excluded.  It is trained in numpy on all training texts,
whole: in each of ``ROUNDS`` rounds the blocks of the round learn side by side,
each from the same weights and over all its windows, and the next round begins
with the mean of their weights, by the number of subwords.  So every window of
every training text is learned from, and only one set of weights a block is sent.
The first weights are drawn from a fixed seed, and the first round learns at a
higher rate; a caller may ask for first weights fitted on the driver to pieces of
``SAMPLE_CHARS`` characters of ``sample_texts`` training texts instead.  The classes
and biases of the softmax come from the exact subword counts of all training texts.

The counts come from all training texts and follow the size of the corpus.
Texts are dealt into blocks, and each block is cut into words and subwords once and
written as one row of numbers (``ENCODED``), which counting, learning and scoring read.
A block sends its distinct words (64-bit hashes)
with their counts, cut into hash ranges; per range the counts of all blocks are
summed and each block gets back the totals of its own words.  So a word, however
frequent, is one entry per block, and no table of all words is ever broadcast or
collected.  The subword counts go the same way, cut into ranges of ids.

Words are told apart by 64-bit hashes: at ten million distinct words the chance
of any collision is about 3e-6.

Null text: as the empty text, whose only token is the end.  Null ids have
remainder 0 and are trained on.  Without any training text N = V = 0 and
``score`` is that of the untrained attention model alone.
Repeated rows are scored (and counted) each.  Empty table: empty result.  Other
columns are not read.
"""

from __future__ import annotations

import copy
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.bpe import byte_alphabet, default_vocabulary, vocabulary
from curatio.llm.catalog import register
from curatio.llm.common import (CHUNK_BYTES, blocks, bounded_sample, hash_buckets, id_remainder, lower_ascii, packed, read, span_hashes, text_chunks, unpacked,
                                word_spans, written)
from curatio.llm.recurrent import Adam

FOLDS, HELD_OUT = 5, 1
MERGES = 1535
CLASSES = 32
PIECE = 48
WIDTH = 16
CONTEXT = 32
STEP = CONTEXT // 2
MIX = 0.3
SAMPLE_TEXTS = 0               # texts whose pieces give the first weights; none: those of the seed
SAMPLE_CHARS = 2000
PASSES = 2
ROUNDS, FIRST_RATE, LEARN_RATE = 4, 0.02, 0.01
BLOCK_BYTES = 8 << 20
WINDOWS_AT_ONCE = 512
SOFTMAX_ROWS = 1024
END_KEY = np.uint64(0x454E44)      # stands for the end token among the word hashes
_INF = np.int16(np.iinfo(np.int16).max)


class Subwords:
    """The byte symbols of a vocabulary and its first merges, as arrays."""

    def __init__(self, spec: bytes, merges: int = MERGES):
        model = json.loads(spec)["model"]
        end = model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        ids = {c: i for i, c in enumerate(alphabet)} | {c + end: 256 + i for i, c in enumerate(alphabet)}
        self.first_merge = 512
        pairs = []
        for a, b in model["merges"][:merges]:
            pairs.append((ids[a], ids[b]))
            ids.setdefault(a + b, 512 + len(pairs) - 1)
        self.end = 512 + merges
        self.size = self.end + 1
        self.rank = np.full((self.size, self.size), _INF, np.int16)
        for n, (a, b) in reversed(list(enumerate(pairs))):
            self.rank[a, b] = n

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Subwords of byte spans: (flat ids, first index of each span, end)."""
        length = ends - starts
        span = np.repeat(np.arange(len(starts)), length)
        byte = np.arange(len(span)) - np.repeat(np.cumsum(length) - length, length)
        symbol = data[byte + np.repeat(starts, length)].astype(np.int32)
        symbol[np.cumsum(length)[length > 0] - 1] += 256
        piece = span * (1 + (int(length.max(initial=0)) // PIECE)) + byte // PIECE
        done_piece, done_symbol = [], []
        while len(symbol):
            rank = np.full(len(symbol), _INF, np.int16)
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.rank[symbol[:-1], symbol[1:]], _INF)
            heads = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            size = np.diff(np.append(heads, len(piece)))
            low = np.repeat(np.minimum.reduceat(rank, heads), size)
            rest = low < _INF
            done_piece.append(piece[~rest])
            done_symbol.append(symbol[~rest])
            hit = rest & (rank == low)
            run = np.flatnonzero(hit[1:] & hit[:-1]) + 1       # a pair that overlaps the one before: keep every other
            for i in run:
                if hit[i - 1]:
                    hit[i] = False
            at = np.flatnonzero(hit)
            symbol = symbol.copy()
            symbol[at] = self.first_merge + rank[at]
            rest[at + 1] = False
            symbol, piece = symbol[rest], piece[rest]
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        piece = np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        owner = piece[order] // (1 + (int(length.max(initial=0)) // PIECE))
        return np.concatenate(done_symbol)[order], np.searchsorted(owner, np.arange(len(starts) + 1), "left")


class Steps(Adam):
    """The same updates in fewer passes over the weights."""

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = math.sqrt(sum(float(np.dot(g, g)) for g in grads.values()))
        scale = min(1.0, self.clip / (norm + 1e-12))
        down, rate = 1 / math.sqrt(1 - 0.99 ** self.step), self.rate / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            first, second = self.first[k], self.second[k]
            first *= 0.9
            t = g * (0.1 * scale)
            first += t
            second *= 0.99
            t *= t
            second += t                                 # (0.1 scale g) ** 2 = 0.01 (scale g) ** 2
            np.sqrt(second, out=t)
            t *= down
            t += 1e-8
            np.divide(first, t, out=t)
            t *= rate
            self.params[k] -= t


class Attention:
    """One causal self-attention layer with a two-level softmax."""

    def __init__(self, size: int, frequency: np.ndarray, width: int = WIDTH, classes: int = CLASSES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size, self.classes, self.members = size, classes, -(-size // classes)
        place = np.empty(size, np.int64)
        place[np.argsort(-frequency, kind="stable")] = np.arange(size)
        self.cls, self.member = place // self.members, place % self.members
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.p = {"e": init(size, width), "wq": init(width, width), "wk": init(width, width), "wv": init(width, width),
                  "wo": init(width, width), "wr": init(width, width), "b": np.zeros(width, np.float32),
                  "rel": np.zeros(CONTEXT, np.float32), "cw": init(classes, width) * 0.1, "cb": np.zeros(classes, np.float32),
                  "mw": init(classes, self.members, width) * 0.1, "mb": np.zeros((classes, self.members), np.float32)}
        count = np.zeros((classes, self.members))
        count[self.cls, self.member] = frequency + 0.1
        count[:, :][count == 0] = 1e-9                      # places that no subword has
        self.p["cb"][:] = np.log(count.sum(axis=1) / count.sum())
        self.p["mb"][:] = np.log(count / count.sum(axis=1, keepdims=True))
        query, key = np.arange(STEP)[:, None] + STEP, np.arange(CONTEXT)[None, :]
        self.distance = np.clip(query - key, 0, CONTEXT - 1)
        self.future = key > query

    def flat(self) -> np.ndarray:
        """One vector of all weights, of which those in ``p`` are parts from now on."""
        vector = np.concatenate([v.ravel() for v in self.p.values()])
        self.p = parts(vector, self.p)
        return vector

    def tables(self):
        """Per subword: (query, skip path) and (key, value)."""
        p = self.p
        scale = np.float32(1 / np.sqrt(p["wq"].shape[1]))
        return (np.concatenate((p["e"] @ (p["wq"] * scale), p["e"] @ p["wr"] + p["b"]), axis=1),
                p["e"] @ np.concatenate((p["wk"], p["wv"] @ p["wo"]), axis=1))

    def weights(self, s: np.ndarray, fresh: np.ndarray, bound: float) -> None:
        """Scores (windows, STEP, CONTEXT) to unscaled attention weights, in place."""
        s += np.where(self.future, np.float32(-1e9), self.p["rel"][self.distance])
        s[fresh, :, :STEP] = -1e9
        if not bound + self.p["rel"].max() < 60:        # else no score can reach it
            np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)

    def by_class(self, y: np.ndarray):
        """The order of the targets by class, their classes and members in that order, and where each class begins."""
        cls = self.cls[y].astype(np.uint8 if self.classes < 256 else np.int64)
        order = np.argsort(cls, kind="stable")
        cls = cls[order].astype(np.int64)
        return order, cls, self.member[y[order]], np.searchsorted(cls, np.arange(self.classes + 1))

    def log_probs(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, tables) -> np.ndarray:
        """Natural log probability of each target.  ``x`` and ``y``: (windows,
        STEP) inputs and targets; ``fresh``: windows that begin a text, all
        others continue the window before them (row 0 must be fresh)."""
        p, (own, kv) = self.p, tables
        width, n = kv.shape[1] // 2, len(x)
        now = np.take(own, x, axis=0)
        keys = np.empty(((n + 1) * STEP, 2 * width), np.float32)
        keys[:STEP] = 0
        np.take(kv, x.ravel(), axis=0, out=keys[STEP:], mode="clip")
        row = keys.strides[0]
        both = np.lib.stride_tricks.as_strided(keys, (n, CONTEXT, 2 * width), (STEP * row, row, keys.itemsize), writeable=False)
        s = now[:, :, :width] @ both[:, :, :width].transpose(0, 2, 1)
        self.weights(s, fresh, _reach(own[:, :width], kv[:, :width]))
        context = s @ both[:, :, width:]
        total = s.reshape(-1, CONTEXT) @ np.ones((CONTEXT, 1), np.float32)       # sums as products: much faster on short axes
        context /= (total + np.float32(1e-30)).reshape(n, STEP, 1)
        context += now[:, :, width:]
        y = y.ravel()
        order, cls, member, edges = self.by_class(y)
        h = with_ones(np.tanh(context, out=context).reshape(-1, width), order)
        logits = h @ with_bias(p["cw"], p["cb"]).T
        inner = np.take(logits, np.arange(len(y)) * self.classes + cls)
        inner -= np.log(np.exp(logits, out=logits) @ np.ones(self.classes, np.float32))
        member_weights = with_bias(p["mw"], p["mb"])
        member += np.arange(len(y)) * self.members
        at_target, total = np.empty(len(y), np.float32), np.ones(len(y), np.float32)
        ones, space = np.ones(self.members, np.float32), np.empty((int(np.diff(edges).max(initial=0)), self.members), np.float32)
        for c in range(self.classes):
            a, b = edges[c], edges[c + 1]
            if a < b:
                logits = np.matmul(h[a:b], member_weights[c].T, out=space[:b - a])
                at_target[a:b] = np.take(logits, member[a:b] - a * self.members)
                np.matmul(np.exp(logits, out=logits), ones, out=total[a:b])
        inner += at_target - np.log(total)
        out = np.empty(len(y), np.float32)
        out[order] = inner
        return out

    def fit(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, valid: np.ndarray, rows: int = 256, rate: float = 0.02, seed: int = 0,
            opt: Steps | None = None):
        """One pass over the windows, by gradient descent; with the moments of
        ``opt`` (of ``flat``, in pieces), if given, and then at its rate."""
        falls = opt is None
        if falls:
            opt = Steps(pieces(self.flat()), rate, clip=5.0)
        p, width = self.p, self.p["wq"].shape[1]
        gradient = np.empty(sum(v.size for v in p.values()), np.float32)
        g, g_pieces = parts(gradient, p), pieces(gradient)
        inputs = np.concatenate((np.concatenate((x[:1], x[:-1])), x), axis=1)
        order = np.random.default_rng(seed).permutation(len(x))
        scale = np.float32(1 / np.sqrt(width))
        ones = np.ones((CONTEXT, 1), np.float32)
        # gradients by key, value, query and skip path, for each key; only the window's own positions have the last two
        space = np.zeros((min(rows, len(x)), CONTEXT, 4 * width), np.float32)
        for i in range(0, len(order), rows):
            pick = order[i:i + rows]
            m, d_all = len(pick), space[:len(pick)]
            ids = np.take(inputs, pick, axis=0)
            w_all = np.concatenate((p["wk"], p["wv"] @ p["wo"], p["wq"] * scale, p["wr"]), axis=1)
            kv, own = p["e"] @ w_all[:, :2 * width], p["e"] @ w_all[:, 2 * width:]
            keys, now = np.take(kv, ids, axis=0), np.take(own, ids[:, STEP:], axis=0)
            q, k, v = now[:, :, :width], keys[:, :, :width], keys[:, :, width:]
            a = q @ k.transpose(0, 2, 1)
            self.weights(a, fresh[pick], _reach(own[:, :width], kv[:, :width]))
            total = a.reshape(-1, CONTEXT) @ ones       # sums as products, as in log_probs
            a *= np.reciprocal(total + np.float32(1e-30)).reshape(m, STEP, 1)
            h = a @ v
            h += now[:, :, width:]
            h += p["b"]
            h = np.tanh(h, out=h).reshape(-1, width)
            weight = np.take(valid, pick, axis=0).ravel().astype(np.float32)
            weight /= max(1.0, float(weight.sum()))
            d = self._softmax_gradient(h, np.take(y, pick, axis=0).ravel(), weight, g)
            h *= h
            d *= np.subtract(np.float32(1), h, out=h)
            g["b"][:] = np.ones(len(d), np.float32) @ d
            d = d.reshape(m, STEP, width)
            d_all[:, STEP:, 3 * width:] = d
            np.matmul(a.transpose(0, 2, 1), d, out=d_all[:, :, width:2 * width])
            ds = d @ v.transpose(0, 2, 1)
            ds *= a
            a *= (ds.reshape(-1, CONTEXT) @ ones).reshape(m, STEP, 1)
            ds -= a
            np.matmul(ds.transpose(0, 2, 1), q, out=d_all[:, :, :width])
            np.matmul(ds, k, out=d_all[:, STEP:, 2 * width:3 * width])
            per_place = np.ones(m, np.float32) @ ds.reshape(m, -1)
            g["rel"][:] = np.bincount(self.distance.ravel(), np.where(self.future.ravel(), 0, per_place), CONTEXT)
            ids, d_all = ids.ravel(), d_all.reshape(-1, 4 * width)
            by = np.take(p["e"], ids, axis=0).T @ d_all
            joint = by[:, width:2 * width]
            g["wk"][:], g["wv"][:], g["wo"][:] = by[:, :width], joint @ p["wo"].T, p["wv"].T @ joint
            g["wq"][:], g["wr"][:] = by[:, 2 * width:3 * width] * scale, by[:, 3 * width:]
            for j, de in enumerate((d_all @ w_all.T).T.astype(np.float64, order="C")):
                g["e"][:, j] = np.bincount(ids, de, self.size)
            if falls:
                opt.rate = rate * max(0.05, 1 - i / len(order))
            opt.update(g_pieces)
        return self

    def _softmax_gradient(self, h: np.ndarray, y: np.ndarray, weight: np.ndarray, g: dict) -> np.ndarray:
        """Gradient of the weighted loss of the targets by ``h``; that of the softmax's weights goes to ``g``.

        The exponentials are not divided by their sums: the factors weight / sum go to the short side of the products."""
        p, width, n = self.p, h.shape[1], np.arange(len(y))
        order, cls, member, edges = self.by_class(y)
        h, weight = with_ones(h, order), weight[order]
        outer, inner = with_bias(p["cw"], p["cb"]), with_bias(p["mw"], p["mb"])
        high = max(float(width * max(w.max(), -w.min()) + bias.max()) for w, bias in ((p["cw"], p["cb"]), (p["mw"], p["mb"]))) >= 60     # |h| is at most 1
        d, d_inner = np.empty((2, len(y), width), np.float32)
        space = np.empty(max(SOFTMAX_ROWS, int(np.diff(edges).max())) * max(self.classes, self.members), np.float32)
        ones = np.ones(max(self.classes, self.members), np.float32)

        def level(a, b, weights, vectors, at, d):
            """Of the targets a to b, among as many weights; ``at``: their places among the exponentials."""
            flat = space[:(b - a) * len(weights)]
            e = flat.reshape(b - a, len(weights))
            np.matmul(h[a:b], weights.T, out=e)
            if high:
                np.minimum(e, np.float32(60), out=e)
            np.exp(e, out=e)
            total = e @ ones[:len(weights)]
            flat[at] -= total
            factor = np.divide(weight[a:b], total, out=total)[:, None]
            np.matmul(e, vectors, out=d[a:b])
            d[a:b] *= factor
            return e.T @ (h[a:b] * factor)

        place = n % SOFTMAX_ROWS * self.classes + cls
        found = sum(level(a, min(a + SOFTMAX_ROWS, len(y)), outer, p["cw"], place[a:a + SOFTMAX_ROWS], d) for a in range(0, len(y), SOFTMAX_ROWS))
        g["cw"][:], g["cb"][:] = found[:, :width], found[:, width]
        place = (n - edges[cls]) * self.members + member
        found = np.zeros_like(inner)
        edges = edges.tolist()
        for c in range(self.classes):
            a, b = edges[c], edges[c + 1]
            if a < b:
                found[c] = level(a, b, inner[c], p["mw"][c], place[a:b], d_inner)
        g["mw"][:], g["mb"][:] = found[:, :, :width], found[:, :, width]
        d += d_inner
        out = d_inner
        out[order] = d
        return out


def parts(vector: np.ndarray, shapes: dict) -> dict:
    """The parts of a vector that have the shapes of the arrays of ``shapes``."""
    edges = np.cumsum([0, *(v.size for v in shapes.values())])
    return {k: vector[a:b].reshape(v.shape) for (k, v), a, b in zip(shapes.items(), edges, edges[1:])}


def pieces(vector: np.ndarray, size: int = 8192) -> dict:
    """A vector in pieces small enough to stay near the processor."""
    return {i: vector[i:i + size] for i in range(0, len(vector), size)}


def with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate((weights, bias[..., None]), axis=-1)


def with_ones(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows in an order, with a last column of ones for the biases."""
    out = np.empty((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = np.take(h, order, axis=0)
    out[:, -1] = 1
    return out


def _reach(queries: np.ndarray, keys: np.ndarray) -> float:
    """What no product of a query and a key exceeds."""
    return float(np.sqrt(np.einsum("ij,ij->i", queries, queries).max() * np.einsum("ij,ij->i", keys, keys).max()))


def windows(first: np.ndarray, flat: np.ndarray, end_id: int):
    """Inputs, targets, first windows and validity of sequences that begin at
    ``first`` (with the end) in ``flat``; the end id is also the start."""
    length = np.diff(first) + 1
    n = -(-length // STEP)
    begin = np.cumsum(n) - n
    x = np.full((int(n.sum()), STEP), end_id, np.int64)
    y, valid, fresh = x.copy(), np.ones(x.shape, bool), np.zeros(len(x), bool)
    place = np.arange(len(flat)) + np.repeat(begin * STEP - first[:-1], length - 1)
    y.ravel()[place] = flat
    x.ravel()[place + 1] = flat
    valid[begin + n - 1] = np.arange(STEP) < (length - (n - 1) * STEP)[:, None]
    fresh[begin] = True
    return x, y, fresh, valid


class Pieces:
    """The subwords of the words of a run of ``n`` rows, each distinct word cut once."""

    def __init__(self, subwords: Subwords, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int):
        self.keys, at, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.flat, self.begin = subwords.segment(data, starts[at], ends[at])
        self.rows, self.n = rows, n

    def runs(self):
        """First index of each row in all subwords (and the end), these, and how many each word has."""
        size = np.diff(self.begin)[self.inverse]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[self.inverse], size)
        per_row = np.bincount(self.rows, size, self.n).astype(np.int64)
        return np.concatenate(([0], np.cumsum(per_row))), self.flat[at], size


def id_cuts(size: int, n: int) -> np.ndarray:
    """The n ranges of the subword ids, as even as can be."""
    return np.arange(n + 1) * size // n


ENCODED = ("block int, trained int, doc_id array<long>, held_out array<boolean>, n_bytes array<long>, n_words array<long>, "
           "end_word int, words binary, keys binary, subwords binary, n_subwords binary")


def _encode(subwords: Subwords):
    """A block's texts as one row: the hashes of its distinct words (and the end)
    in ascending order, each cut once into subwords, and the places of all words among them."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        every, n_words, n_bytes = [], [], []
        known, cut = np.array([END_KEY]), [(np.array([END_KEY]), np.zeros(0, np.int32), np.zeros(1, np.int64))]
        for batch in table.to_batches():
            for first, stop, data, offsets in text_chunks(batch, "text"):
                data = lower_ascii(data)
                starts, ends, rows = word_spans(data, offsets)
                hashes = span_hashes(data, starts, ends)
                keys, at = np.unique(hashes, return_index=True)
                new = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys
                flat, begin = subwords.segment(data, starts[at[new]], ends[at[new]])
                cut.append((keys[new], flat, np.diff(begin)))
                known = np.sort(np.concatenate((known, keys[new])))
                every.append(hashes)
                n_words.append(np.bincount(rows, minlength=stop - first))
                n_bytes.append(np.diff(offsets))
        sizes = np.concatenate([c[2] for c in cut])
        order = np.argsort(np.concatenate([c[0] for c in cut]))
        begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        flat = np.concatenate([c[1] for c in cut])[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]
        whole = lambda found: pa.array([np.concatenate(found)], pa.list_(pa.int64()))
        held = table["held_out"].combine_chunks()
        return pa.table({"block": table["block"][:1], "trained": pa.array([len(held) - held.true_count], pa.int32()),
                         "doc_id": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["doc_id"].combine_chunks()),
                         "held_out": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), held),
                         "n_bytes": whole(n_bytes), "n_words": whole(n_words),
                         "end_word": pa.array([int(np.searchsorted(known, END_KEY))], pa.int32()),
                         "words": pa.array([packed(np.searchsorted(known, np.concatenate(every)).astype(np.int32))], pa.binary()),
                         "keys": pa.array([packed(known)], pa.binary()),
                         "subwords": pa.array([packed(flat.astype(np.uint16))], pa.binary()),
                         "n_subwords": pa.array([packed(size.astype(np.int32))], pa.binary())})
    return run


def encoded(rows: DataFrame, subwords: Subwords) -> DataFrame:
    """One row (``ENCODED``) per block of (block, doc_id, text, held_out)."""
    return rows.select("block", "doc_id", "text", "held_out").groupBy("block").applyInArrow(_encode(subwords), ENCODED)


class Block:
    """A row of ``ENCODED``; without ``keys`` it still has all but the words' hashes."""

    def __init__(self, table: pa.Table, i: int = 0):
        self.number = table["block"][i].as_py()
        self.doc_id = table["doc_id"][i].values
        self.held_out = table["held_out"][i].values.to_numpy(zero_copy_only=False).astype(bool)
        self.n_bytes, self.n_words = (table[c][i].values.to_numpy() for c in ("n_bytes", "n_words"))
        self.words = unpacked(table["words"][i].as_py(), np.int32)
        self.keys = unpacked(table["keys"][i].as_py(), np.uint64) if "keys" in table.schema.names else None
        self.subwords = unpacked(table["subwords"][i].as_py(), np.uint16)
        self.size = unpacked(table["n_subwords"][i].as_py(), np.int32).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.end_word = table["end_word"][i].as_py()
        self.first_word = np.concatenate(([0], np.cumsum(self.n_words)))

    def counts(self, size: int):
        """How often each distinct word (and the end) and each of ``size`` subwords stands in the trained rows."""
        trained = ~self.held_out
        words = np.bincount(self.words, np.repeat(trained, self.n_words), len(self.size)).astype(np.int64)
        pieces = np.bincount(self.subwords, np.repeat(words, self.size), size).astype(np.int64)
        words[self.end_word] += trained.sum()
        pieces[-1] += trained.sum()
        return words, pieces

    def chunks(self, rows: np.ndarray, limit: int = CHUNK_BYTES):
        """Runs of the given rows (ascending) of about ``limit`` bytes of text."""
        edges = np.concatenate(([0], np.cumsum(self.n_bytes[rows])))
        at = 0
        while at < len(rows):
            stop = min(max(int(np.searchsorted(edges, edges[at] + limit, "right")) - 1, at + 1), len(rows))
            yield rows[at:stop]
            at = stop

    def runs(self, rows: np.ndarray):
        """Of some rows: the words (places in ``keys``); first subword of each row (and the end), all subwords, and how many each word has."""
        n_words = self.n_words[rows]
        words = self.words[np.arange(int(n_words.sum())) + np.repeat(self.first_word[rows] - (np.cumsum(n_words) - n_words), n_words)]
        size = self.size[words]
        ends = np.cumsum(size)
        flat = self.subwords[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[words] - (ends - size), size)]
        return words, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_words)))], flat, size


def _ask_encoded(n_buckets: int, size: int):
    """Each block's distinct words and their training counts, by hash range; with
    each range the training counts of a range of the subword ids."""
    ranges = id_cuts(size, n_buckets)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block = Block(batch, i)
                counts, frequency = block.counts(size)
                cuts, keys = hash_buckets(block.keys, n_buckets), block.keys
                used = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1] or frequency[ranges[b]:ranges[b + 1]].any()]
                yield pa.record_batch({"bucket": pa.array(used, pa.int32()), "block": pa.array([block.number] * len(used), pa.int32()),
                                       "keys": pa.array([packed(keys[cuts[b]:cuts[b + 1]]) for b in used], pa.binary()),
                                       "counts": pa.array([packed(counts[cuts[b]:cuts[b + 1]]) for b in used], pa.binary()),
                                       "pieces": pa.array([packed(frequency[ranges[b]:ranges[b + 1]]) for b in used], pa.binary())})
    return run


def _ask(n_buckets: int, subwords: Subwords):
    """The same of a block's texts."""
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_ask_encoded(n_buckets, subwords.size)(_encode(subwords)(table).to_batches()))
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Per block the totals of its words of this hash range; once, the sums of
    the range's subword counts."""
    keys = [unpacked(k.as_py(), np.uint64) for k in table["keys"]]
    counts = [unpacked(c.as_py(), np.int64) for c in table["counts"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    mine = total[inverse]
    edges = np.cumsum([0, *map(len, keys)])
    first = np.arange(len(keys)) == 0        # the range's own sums, once
    pieces = sum(unpacked(p.as_py(), np.int64) for p in table["pieces"])
    return pa.table({"block": table["block"], "bucket": table["bucket"],
                     "totals": pa.array([packed(mine[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()),
                     "tokens": pa.array(np.where(first, total.sum(), 0), pa.int64()),
                     "distinct": pa.array(np.where(first, (total > 0).sum(), 0), pa.int64()),
                     "pieces": pa.array([packed(pieces)] + [None] * (len(keys) - 1), pa.binary())})


def _score(model: Attention, subwords: Subwords, n_tokens: int, n_distinct: int):
    floor = np.log10(n_tokens + 0.5 * (n_distinct + 1))
    rest = 1 - MIX if n_tokens else 1.0

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                                                             ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        block = Block(table)
        order = np.argsort(answers["bucket"].to_numpy())
        blobs = answers["totals"]
        totals = np.concatenate([unpacked(blobs[int(i)].as_py(), np.int64) for i in order])
        end_count = totals[block.end_word]
        tables = model.tables()
        n = len(block.n_words)
        count = block.n_words + 1
        known, base, score = np.full(n, int(end_count > 0), np.int64), np.full(n, np.log10(end_count + 0.5)), np.zeros(n)
        word_base = np.log10(totals + 0.5)
        for here in block.chunks(np.arange(n)):
            words, heads, flat, size = block.runs(here)
            n_words, m = block.n_words[here], len(here)
            rows, c = np.repeat(np.arange(m), n_words), totals[words]
            known[here] += np.bincount(rows, c > 0, m).astype(np.int64)
            base[here] += np.bincount(rows, word_base[words], m)
            x, y, fresh, valid = windows(heads, flat, subwords.end)
            logs = attention_logs(model, tables, x, fresh, y)[valid]
            # a row's subwords, then its end: sums per word
            tokens = np.repeat(np.arange(m), n_words + 1)
            lengths = np.ones(len(tokens), np.int64)
            last = np.cumsum(n_words + 1) - 1
            inner = np.ones(len(tokens), bool)
            inner[last] = False
            lengths[inner] = size
            word_log = np.add.reduceat(logs.astype(np.float64), np.cumsum(lengths) - lengths)
            seen = np.empty(len(tokens), np.float64)
            seen[inner], seen[last] = c, end_count
            mixed = (1 - rest) * seen / max(1, n_tokens) + rest * np.exp(word_log)
            logged = np.where(mixed > 1e-290, np.log10(np.maximum(mixed, 1e-300)), np.log10(rest) + word_log / np.log(10))
            score[here] = np.bincount(tokens, logged, m)
        return pa.table({"doc_id": block.doc_id, "held_out": pa.array(block.held_out), "n_tokens": pa.array(count), "n_known": pa.array(known),
                         "base_score": pa.array(base - count * floor), "score": pa.array(score)})
    return run


def attention_logs(model: Attention, tables, x: np.ndarray, fresh: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probabilities of all windows, in batches that overlap by one window."""
    out = np.empty(x.shape, np.float32)
    for i in range(0, len(x), WINDOWS_AT_ONCE):
        a = max(0, i - 1)
        out[i:i + WINDOWS_AT_ONCE] = model.log_probs(
            x[a:i + WINDOWS_AT_ONCE], fresh[a:i + WINDOWS_AT_ONCE], y[a:i + WINDOWS_AT_ONCE], tables).reshape(-1, STEP)[i - a:]
    return out


def text_windows(table: pa.Table, subwords: Subwords):
    """The windows of the texts of a table, by runs of rows of bounded bytes."""
    for batch in table.to_batches():
        for first, stop, data, offsets in text_chunks(batch, "text"):
            data = lower_ascii(data)
            starts, ends, rows = word_spans(data, offsets)
            heads, flat, _ = Pieces(subwords, data, starts, ends, span_hashes(data, starts, ends), rows, stop - first).runs()
            yield windows(heads, flat, subwords.end)


def train(texts: list[str], subwords: Subwords, frequency: np.ndarray) -> Attention:
    """The first weights, from a small sample of the texts."""
    model = Attention(subwords.size, frequency)
    found = list(text_windows(pa.table({"text": pa.array(texts, pa.string())}), subwords))
    if found:
        x, y, fresh, valid = (np.concatenate(parts) for parts in zip(*found))
        for n in range(PASSES):
            model.fit(x, fresh, y, valid, rate=0.02 / (1 + 2 * n), seed=n)
    return model


def _learn(model: Attention, subwords: Subwords, rate: float, rounds: int, n_groups: int):
    """The weights after one pass over all windows of a block's texts."""
    def run(table: pa.Table) -> pa.Table:
        block, n = Block(table), 0
        mine = copy.copy(model)
        opt = Steps(pieces(mine.flat()), rate, clip=5.0)
        for k, here in enumerate(block.chunks(np.flatnonzero(~block.held_out))):
            _, heads, flat, _ = block.runs(here)
            x, y, fresh, valid = windows(heads, flat, subwords.end)
            mine.fit(x, fresh, y, valid, seed=k, opt=opt)
            n += int(valid.sum())
        return pa.table({"part": pa.array([block.number // rounds % n_groups], pa.int32()), "block": pa.array([block.number], pa.int32()), "n": pa.array([n], pa.int64()),
                         "weights": pa.array([model_bytes(mine.p)], pa.binary())})
    return run


def model_bytes(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def _mean(table: pa.Table) -> pa.Table:
    """The mean of the weights of some blocks, by their numbers of subwords."""
    table = table.sort_by("block")
    n = table["n"].to_numpy()
    total = sum(k * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for k, w in zip(n, table["weights"]))
    return pa.table({"part": table["part"][:1], "block": table["block"][:1], "n": pa.array([n.sum()], pa.int64()),
                     "weights": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def learn_all(model: Attention, subwords: Subwords, texts: DataFrame, n_blocks: int, rounds: int = ROUNDS, first_rate: float = LEARN_RATE) -> int:
    """Trains ``model`` on all training texts of ``texts`` (``ENCODED``), whole, in
    rounds of blocks; the number of subwords learned from.

    The means of about as many blocks as there are means are taken by Spark, so
    the driver gets the weights of the square root of the blocks of a round."""
    schema, learned = "part int, block int, n long, weights binary", 0
    n_groups = math.isqrt(n_blocks // rounds) + 1
    for k in range(min(rounds, n_blocks)):
        trained = texts.drop("keys").where((F.col("block") % rounds == k) & (F.col("trained") > 0)).repartition(n_blocks, "block").groupBy("block").applyInArrow(
            _learn(model, subwords, LEARN_RATE / (1 + k) if k else first_rate, rounds, n_groups), schema)
        parts = trained.groupBy("part").applyInArrow(_mean, schema).collect()
        if not parts:
            continue
        mean = np.frombuffer(_mean(pa.Table.from_pylist([r.asDict() for r in parts]))["weights"][0].as_py(), np.float32)
        at = 0
        for name in sorted(model.p):
            size = model.p[name].size
            model.p[name] = mean[at:at + size].reshape(model.p[name].shape).copy()
            at += size
        learned += sum(r["n"] for r in parts)
    return learned


def learned_model(docs: DataFrame, rows: DataFrame, answers: DataFrame, n_blocks: int, subwords: Subwords,
                  sample_texts: int = SAMPLE_TEXTS, texts: DataFrame | None = None) -> tuple[Attention, int]:
    """The attention model of all training texts, and the number of subwords it
    was learned from; ``rows``: (block, doc_id, text, held_out) of ``docs``, ``texts``: these ``encoded``."""
    if texts is None:
        texts = written(encoded(rows, subwords), "encoded-texts")
    frequency = np.zeros(subwords.size)
    ranges = id_cuts(subwords.size, n_blocks)
    for r in answers.where(F.col("pieces").isNotNull()).select("bucket", "pieces").toLocalIterator():      # one number per subword id
        frequency[ranges[r["bucket"]]:ranges[r["bucket"] + 1]] = unpacked(r["pieces"], np.int64)
    if not sample_texts:
        model = Attention(subwords.size, frequency)
        return model, learn_all(model, subwords, texts, n_blocks, first_rate=FIRST_RATE)
    trained = id_remainder("doc_id", FOLDS) != HELD_OUT
    start = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    pieces = docs.where(trained & (F.length("text") > 0)).select(
        "doc_id", F.col("text").substr(start, F.lit(SAMPLE_CHARS)).alias("t"), F.lit(1).alias("one"))
    sample = bounded_sample(pieces, {1: sample_texts}, "one", 17).select("t", "_rank").collect()
    sample.sort(key=lambda r: (r["_rank"], r["t"]))
    model = train([r["t"] for r in sample], subwords, frequency)
    return model, learn_all(model, subwords, texts, n_blocks)


def score_documents(docs: DataFrame, vocabulary_path: str, sample_texts: int = SAMPLE_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    subwords = Subwords(vocabulary(vocabulary_path))
    rows, n = blocks(docs, block_bytes)
    rows = rows.withColumn("held_out", id_remainder("doc_id", FOLDS) == HELD_OUT)
    texts = written(encoded(rows, subwords), "encoded-texts")
    asked = texts.mapInArrow(_ask_encoded(n, subwords.size), "bucket int, block int, keys binary, counts binary, pieces binary")
    answers = written(asked.groupBy("bucket").applyInArrow(
        _answer, "block int, bucket int, totals binary, tokens long, distinct long, pieces binary"), "word-counts")
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n_tokens, n_distinct = int(sums["n"] or 0), int(sums["v"] or 0)
    model, _ = learned_model(docs, rows, answers, n, subwords, sample_texts, texts)
    scored = texts.drop("keys").repartition(n, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(model, subwords, n_tokens, n_distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@register("op5_lm_score")
def op5_lm_score(spark, sf_dir):
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())
