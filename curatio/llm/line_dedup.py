"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased.  A key of at least ``min_chars`` code points that is found in at
least ``min_docs`` documents loses all its lines, except in the documents with
the largest ``doc_id`` that hold it.  All other lines stay, joined by ``\\n``.

1. Each document gives its distinct keys as 128-bit hashes, one row per key.
2. Documents per hash are counted with map-side partial sums, so a line that a
   third of all documents hold costs one row per task.
3. The distinct hashes that meet ``min_docs`` are dealt to shards.  A shard is a
   minimal perfect hash over its line hashes (a cascade of bit arrays: a key
   that is alone at its place of a level is settled there, the others go to the
   next level; its number is the rank of its bit) and, by that number, arrays of
   fingerprints, counts and largest ids, written to the shared folder: one row
   per shard, a few bits and 24 bytes a line.
4. The documents' hashes go to the shards' arrays and are answered from them by
   probing; a line is never joined with a line.  A shard asked more often than
   ``probes`` times, as the one of a very common line is, is answered in as many
   slices as that takes, each with a copy of the shard's arrays.  Hashes that
   are not in a shard hit a place of another line and fail the fingerprint.
5. The answers, the hashes that a document loses, meet the text once.

The number of shards follows from the counts, so that the arrays and the probes
of one task stay bounded at any size of the table.  Two keys are taken for equal
if all 128 bits of their hashes are.

Every row is a document of its own: repeated rows, and rows with equal ids, each
count, and all rows with the largest id that holds a key keep its lines.  A null
id is smaller than all others.  A null or empty text is one empty line, which
stays.  An empty table gives an empty result.  Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import mix, packed, read, unpacked, written

MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 100_000
PROBES_PER_SLICE = 1_000_000
LEVELS = 48
BLANKS = " \t\n\x0b\x0c\r"
_SALTS = mix(np.arange(1, LEVELS + 1, dtype=np.uint64))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- minimal perfect hash ----------------------------------------------------

def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + _SALTS[level]) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n - 1, one number each; any other key gets
    some number or -1.  ``words`` are the bit arrays of all levels one after the
    other, ``sizes`` their lengths in bits."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        ones = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=ones[1:])
        self.ones = ones
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def __len__(self) -> int:
        return int(self.ones[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """Keys still alike after all levels (equal ones only) get no number."""
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-max(64, 2 * len(keys)) // 64) * 64
            at = _places(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return cls(words, np.array(sizes, np.int64))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.first[level] + _places(keys[open_], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.ones[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


def _joined(h: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The 64 bits of both hashes that the perfect hash is built on."""
    return mix(h) + fp


class LineArrays:
    """A shard: the perfect hash and its arrays.  Pairs of hashes that agree in
    the 64 bits it is built on stand at the end and are compared one by one."""

    FIELDS = ("words", "sizes", "prints", "counts", "keepers", "nobody", "rest")
    DTYPES = (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.uint8, np.uint64)

    def __init__(self, *arrays):
        for name, array in zip(self.FIELDS, arrays):
            setattr(self, name, array)
        self.index = PerfectHash(self.words, self.sizes)

    @classmethod
    def build(cls, h, fp, counts, keepers, nobody) -> "LineArrays":
        keys = _joined(h, fp)
        index = PerfectHash.build(keys)
        number = index.numbers(keys)
        left = np.flatnonzero(np.bincount(number[number >= 0], minlength=len(index))[number] > 1) if len(index) else []
        number[left] = -1
        rest = np.flatnonzero(number < 0)
        number[rest] = len(index) + np.arange(len(rest))

        def placed(values):
            out = np.zeros(len(index) + len(rest), values.dtype)
            out[number] = values
            return out
        return cls(index.words, index.sizes, placed(fp), placed(counts), placed(keepers), placed(nobody), h[rest])

    def find(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """The number of each pair of hashes, -1 where it is not here."""
        number = self.index.numbers(_joined(h, fp))
        miss = (number < 0) | (self.prints[number] != fp if len(self.prints) else True)
        number[miss] = -1
        for i, first in enumerate(self.rest):
            at = len(self.index) + i
            number[(h == first) & (fp == self.prints[at])] = at
        return number

    def blobs(self) -> list[bytes]:
        return [packed(np.ascontiguousarray(getattr(self, n), d)) for n, d in zip(self.FIELDS, self.DTYPES)]

    @classmethod
    def load(cls, blobs) -> "LineArrays":
        return cls(*(unpacked(b, d) for b, d in zip(blobs, cls.DTYPES)))


ARRAYS = "shard long, " + ", ".join(f"{n} binary" for n in LineArrays.FIELDS)


def _numbers(table, name, dtype=np.int64):
    return table.column(name).to_numpy().astype(np.int64, copy=False).view(dtype)


def _build(table: pa.Table) -> pa.Table:
    keeper = table.column("keeper")
    arrays = LineArrays.build(_numbers(table, "h", np.uint64), _numbers(table, "fp", np.uint64), _numbers(table, "n"),
                              keeper.fill_null(0).to_numpy(), keeper.is_null().to_numpy().astype(np.uint8))
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                     **{n: pa.array([b], pa.binary()) for n, b in zip(LineArrays.FIELDS, arrays.blobs())}})


def _probe(min_docs):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        keep = np.zeros(0, np.int64)
        if len(asked) and len(held):
            arrays = LineArrays.load([held.column(n)[0].as_py() for n in LineArrays.FIELDS])
            number = arrays.find(_numbers(asked, "h", np.uint64), _numbers(asked, "fp", np.uint64))
            ids = asked.column("doc_id")
            null = ids.is_null().to_numpy()
            own = np.where(arrays.nobody[number] == 1, null, ~null & (arrays.keepers[number] == ids.fill_null(0).to_numpy()))
            keep = np.flatnonzero((number >= 0) & (arrays.counts[number] >= min_docs) & ~own)
        return asked.select(["doc_id", "text_key", "h"]).take(pa.array(keep))
    return run


# ---- lines -------------------------------------------------------------------

def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, h, fp): one row per document and distinct key."""
    lines = F.split(F.col("text"), "\n", -1)
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    return (docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(keys).alias("_k"))
            .select("doc_id", "text_key", F.xxhash64("_k").alias("h"), F.xxhash64(F.lit(1), "_k").alias("fp")))


def _cut(batches):
    """Drops the lines whose hash is in ``gone``."""
    blanks = BLANKS.encode()
    for batch in batches:
        ids, texts, gone = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "gone"))
        n_lines, n_dropped, kept = [], [], []
        for text, lost in zip(texts, gone):
            raw = (text.as_py() or "").encode()
            lost = lost.as_py()
            if not lost:
                n_lines.append(raw.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(raw)
                continue
            lines = raw.split(b"\n")
            lost = {h & 0xFFFFFFFFFFFFFFFF for h in lost}
            stay = [line for line in lines if xxhash.xxh64_intdigest(line.strip(blanks).lower(), 42) not in lost]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                          pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_per_shard: int = KEYS_PER_SHARD,
                      probes: int = PROBES_PER_SLICE) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = written(line_hashes(rows, min_chars), "line-hashes")
    common = written(hashes.groupBy("h", "fp").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                     .where(F.col("n") >= min_docs), "common-lines")
    n_shards = max(1, -(-common.count() // keys_per_shard), -(-4 * hashes.count() // probes))
    shard = F.pmod("h", F.lit(n_shards)).alias("shard")
    arrays = written(common.select("*", shard).groupBy("shard").applyInArrow(_build, ARRAYS), "line-arrays")

    asked = hashes.select("*", shard)
    crowded = (asked.groupBy("shard").count().where(F.col("count") > probes)
               .select("shard", F.ceil(F.col("count") / probes).cast("int").alias("slices")))
    crowded = written(crowded, "crowded-shards")
    n_slices = F.coalesce("slices", F.lit(1))
    asked = (asked.join(crowded, "shard", "left")
             .withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(3)), n_slices).cast("int")).drop("slices"))
    held = arrays.join(crowded, "shard", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1))).drop("slices")
    lost = (asked.groupBy("shard", "slice").cogroup(held.groupBy("shard", "slice"))
            .applyInArrow(_probe(min_docs), "doc_id long, text_key long, h long"))
    gone = lost.groupBy("doc_id", "text_key").agg(F.collect_set("h").alias("gone"))     # bounded by one text
    texts = rows.withColumn("text_key", F.xxhash64("text")).alias("t")
    met = texts.join(gone.alias("g"), F.expr("t.doc_id <=> g.doc_id AND t.text_key = g.text_key"), "left")
    return met.select("t.doc_id", "t.text", "g.gone").mapInArrow(_cut, "doc_id long, n_lines long, n_dropped long, kept string")


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
     c AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
           GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}),
     m AS (SELECT k.*, c.key IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


@register("op13_line_dedup", ORACLE)
def op13_line_dedup(spark, sf_dir):
    return (drop_common_lines(read(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")))
