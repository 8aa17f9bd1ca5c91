"""BPE encoding and decoding by tree concatenation.

A unit is what the tokenizer's pattern keeps together (a run of letters, one
digit, a run of signs).  Short units are merged pair by pair.  A unit of more
than ``LEAF`` bytes is cut into halves down to leaves of at most ``LEAF`` bytes;
the leaves are encoded independently of each other and neighbours are joined
bottom-up, all leaves of a chunk of texts side by side, then all joins of a
level: a window of the last tokens on the left and the first on the right
is encoded anew, and grows until its first token equals the left side's token
at that place and its last token the right side's.  Every adjacent pair of the
result is then a pair of a valid encoding, which makes the whole encoding equal
to the one of the unit as a whole.  The work is nearly linear in the length of
a unit, where merging it as a whole is quadratic.

The vocabulary file is read by the driver and travels with the function (its
size is that of the vocabulary); units are cached per Python worker in a cache
of ``CACHE_BYTES`` bytes.  Documents are independent rows: there is no
shuffle, and lost executors cost their own partitions only.

Null text: encoded as the empty text (no tokens, empty decoding).  Null ids and
repeated rows are kept, one result row each.  Empty table: empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import CHUNK_BYTES, read, row_schema, whole_rows

LEAF = 48
WINDOW = 4
CACHE_BYTES = 96 << 20
ENTRY = 256                   # bytes that an entry of the cache takes besides its texts
SCHEMA = "doc_id long, n_tokens long, token_ids binary, decoded string"
_NONE = 1 << 62
_SLOTS = 1 << 18

_WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)      # Unicode White_Space
# The file's own split pattern; fixed by the vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
_SMALL = 0x300      # below this code point the classes are spelled out for the faster engine


def _small_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SMALL) if unicodedata.category(chr(c))[0] == kind)


_FAST = re.compile(_PATTERN.format(L=_small_class("L"), N=_small_class("N"), S=_WHITE))
_FULL = regex.compile(_PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=_WHITE))
_BEYOND = re.compile(f"[{chr(_SMALL)}-\U0010ffff]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable, else the next free one from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _slot(keys: np.ndarray) -> np.ndarray:
    """First place of each pair in the hash table of pairs."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class Bpe:
    """A byte-level BPE vocabulary with word ends."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.base = {i: (i,) for i in (*self.inner, *self.last)}
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank[i << 20 | j] = n << 20 | k
            self.base[k] = self.base[i] + self.base[j]
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.cached = 0
        self.inner_ids, self.last_ids = np.array(self.inner), np.array(self.last)
        self.pair_keys, self.pair_ranks = np.full(_SLOTS, -1), np.full(_SLOTS, _NONE)
        for key, value in self.rank.items():
            at = _slot(np.array([key]))[0]
            while self.pair_keys[at] >= 0:
                at = (at + 1) % _SLOTS
            self.pair_keys[at], self.pair_ranks[at] = key, value

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank and product of each pair, _NONE for pairs that never merge."""
        out = np.full(len(keys), _NONE)
        at, rest = _slot(keys), np.arange(len(keys))
        while len(rest):
            have = self.pair_keys[at]
            hit = have == keys[rest]
            out[rest[hit]] = self.pair_ranks[at[hit]]
            go = ~hit & (have >= 0)
            rest, at = rest[go], (at[go] + 1) % _SLOTS
        return out

    def merge_many(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The merges of many short units at once: in each round, the pair of the
        lowest rank of every unit.  Ids of all units, and where each begins."""
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        flat = np.frombuffer(b"".join(raws), np.uint8)
        symbol, ends = self.inner_ids[flat], np.cumsum(length)
        symbol[ends - 1] = self.last_ids[flat[ends - 1]]
        return self.merge_flat(symbol, np.repeat(np.arange(len(raws)), length), len(raws))

    def merge_flat(self, symbol: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The merges of ``n`` runs of symbols at once; ``unit``: the run of each symbol."""
        symbol = symbol.astype(np.int64)
        done_unit, done_symbol = [], []
        while len(symbol):
            rank = np.full(len(symbol), _NONE)
            inside = np.flatnonzero(unit[1:] == unit[:-1])
            rank[inside] = self.ranks(symbol[inside] << 20 | symbol[inside + 1])
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(unit))))
            keep = low < _NONE
            done_unit.append(unit[~keep])
            done_symbol.append(symbol[~keep])
            hit = keep & (rank == low)
            for i in np.flatnonzero(hit[1:] & hit[:-1]) + 1:        # overlapping pairs: from the left
                hit[i] &= not hit[i - 1]
            at = np.flatnonzero(hit)
            symbol[at] = rank[at] & 0xFFFFF
            keep[at + 1] = False
            symbol, unit = symbol[keep], unit[keep]
        if not done_unit:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        order = np.argsort(np.concatenate(done_unit), kind="stable")
        first = np.searchsorted(np.concatenate(done_unit)[order], np.arange(n + 1), "left")
        return np.concatenate(done_symbol)[order], first

    def merge_lists(self, lists: list[list[int]]) -> list[list[int]]:
        """Each list of symbols merged by itself, all of them side by side."""
        ids, first = self.merge_flat(np.array([s for x in lists for s in x], np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists))
        ids = ids.tolist()
        return [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the pair of the lowest rank until no pair has a rank."""
        rank = self.rank
        while len(ids) > 1:
            ranks = [rank.get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
            best = min(ranks)
            if best == _NONE:
                break
            new, at, stop = best & 0xFFFFF, 0, len(ids)
            out = []
            while at < stop:
                if at < stop - 1 and ranks[at] == best:
                    out.append(new)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def trees(self, lists: list[list[int]]) -> list[list[int]]:
        """Encodes each list of symbols: halves down to leaves of at most ``LEAF``
        symbols, all leaves of all lists side by side, then all joins of a level."""
        spans = []
        for symbols in lists:
            n = 1 << (max(1, -(-len(symbols) // LEAF)) - 1).bit_length()
            spans.append([len(symbols) * i // n for i in range(n + 1)])
        leaves = iter(self.merge_lists([symbols[a:b] for symbols, cuts in zip(lists, spans) for a, b in zip(cuts, cuts[1:])]))
        levels = [[next(leaves) for _ in cuts[1:]] for cuts in spans]
        while any(len(level) > 1 for level in levels):
            sides = [(level[k], level[k + 1]) for level in levels if len(level) > 1 for k in range(0, len(level), 2)]
            joined = iter(self.join_many(sides))
            levels = [[next(joined) for _ in range(len(level) // 2)] if len(level) > 1 else level for level in levels]
        return [level[0] for level in levels]

    def tree(self, symbols: list[int]) -> list[int]:
        return self.trees([symbols])[0]

    def join_many(self, sides: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Joins each pair of encodings: windows around all joins are encoded side
        by side; those that do not agree with both sides grow and go again."""
        out, width, todo = [None] * len(sides), WINDOW, range(len(sides))
        while todo:
            ends = [(max(0, len(sides[k][0]) - width), min(len(sides[k][1]), width)) for k in todo]
            fresh = self.merge_lists([[s for t in (*sides[k][0][a:], *sides[k][1][:b]) for s in self.base[t]] for k, (a, b) in zip(todo, ends)])
            again = []
            for k, (a, b), window in zip(todo, ends, fresh):
                left, right = sides[k]
                if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                    out[k] = left[:a] + window + right[b:]
                else:
                    again.append(k)
            todo, width = again, 2 * width
        return out

    def symbols(self, raw: bytes) -> list[int]:
        found = [self.inner[b] for b in raw]
        found[-1] = self.last[raw[-1]]
        return found

    def unit(self, unit: str) -> list[int]:
        symbols = self.symbols(unit.encode())
        return self.merge(symbols) if len(symbols) <= LEAF else self.tree(symbols)

    def units(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:       # lower-cased without regard to its place in the word
                text = text.replace("Σ", "σ")
        text = text.lower()
        return (_FULL if _BEYOND.search(text) else _FAST).findall(text)

    def learn(self, units) -> None:
        """Encodes the units that are not in the cache, the short ones together
        and the long ones together.  The cache is emptied before it would hold
        more than ``CACHE_BYTES``."""
        wanted = dict.fromkeys(units)
        new = [u for u in wanted if u not in self.cache]
        if self.cached + sum(ENTRY + 16 * len(u) for u in new) > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
            new = list(wanted)
        raws = [u.encode() for u in new]
        short = [i for i, r in enumerate(raws) if len(r) <= LEAF]
        if short:
            ids, first = self.merge_many([raws[i] for i in short])
            packed, names = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()]
            for k, i in enumerate(short):
                a, b = int(first[k]), int(first[k + 1])
                self.keep(new[i], packed[4 * a:4 * b], " ".join(names[a:b]))
        long = [i for i, r in enumerate(raws) if len(r) > LEAF]
        for i, ids in zip(long, self.trees([self.symbols(raws[i]) for i in long]) if long else ()):
            self.keep(new[i], np.array(ids, "<u4").tobytes(), self.decode(ids))

    def keep(self, unit: str, ids: bytes, decoded: str) -> None:
        self.cache[unit] = (ids, decoded)
        self.cached += ENTRY + 4 * len(unit) + len(ids) + len(decoded)

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text: ids as little-endian unsigned 32-bit integers, and their
        decoding."""
        split = []
        for text in texts:
            pieces = self.split_special.split(text) if self.split_special and "<" in text else [text]
            split.append([[(piece,)] if piece in self.special else self.units(piece) for piece in pieces if piece])
        self.learn(u for pieces in split for units in pieces for u in units if u.__class__ is str)
        cache, out = self.cache, []
        for pieces in split:
            parts = []
            for units in pieces:
                if units and units[0].__class__ is tuple:
                    name = units[0][0]
                    parts.append((np.array([self.special[name]], "<u4").tobytes(), name))
                else:
                    parts += [cache[u] for u in units]
            out.append((b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """The tokens' strings, with spaces between (the file has no decoder)."""
        return " ".join([self.names[i] for i in ids])


_LOADED: dict[int, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """One vocabulary per Python worker, however many tasks it runs."""
    key = hash((len(spec), spec[:64], spec[-64:]))
    if key not in _LOADED:
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def _encode(spec: bytes):
    def run(batches):
        bpe = loaded(spec)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            first, size, held = 0, 0, []
            for row in range(batch.num_rows):
                held.append(texts[row].as_py() or "")
                size += len(held[-1])
                if size > CHUNK_BYTES // 2 or row == batch.num_rows - 1:
                    out = bpe.encode_many(held)
                    yield pa.RecordBatch.from_arrays(
                        [rows.slice(first, len(out)), pa.array([len(x[0]) // 4 for x in out], pa.int64()),
                         pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                        names=[batch.schema.names[0], "n_tokens", "token_ids", "decoded"])
                    first, size, held = row + 1, 0, []
    return run


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) of each whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(vocabulary(path)), SCHEMA)


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` (those not named as below), then n_tokens,
    token_ids, ids_sha256, decoded_sha256."""
    new = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    rows = whole_rows(docs).select("row", "text").mapInArrow(
        _encode(vocabulary(path)), row_schema(docs, "n_tokens long", "token_ids binary", "decoded string"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], "n_tokens", "token_ids",
                       F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op2_bpe")
def op2_bpe(spark, sf_dir):
    return digests(encode_documents(read(spark, sf_dir, "documents"), default_vocabulary()))
