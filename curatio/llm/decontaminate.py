"""Benchmark decontamination: size-partitioned MinHash containment search.

The test items are the short side, the documents the long one.  Items are
partitioned by size: an item of n distinct shingles is in class j with
2^j <= n < 2^(j+1).  For class j each document is cut into blocks of 2^(j-2)
consecutive shingles, so that a block is never larger than a quarter of an item
and a document of any length is searched at the scale of the item.  Per hash
function, a block whose minimum equals the item's minimum makes the document a
candidate of the item.  Candidates are then verified by exact containment of
the items' shingles (strings, not hashes) in the whole document.

A block inside a contained passage shares the item's minimum whenever that
minimum lies in it, so with ``n_hashes`` functions a contained passage is missed
only if all functions miss: below 0.8 ** 32 = 0.0008 for one that is cut at its
edges, far below that for whole passages.  The tests measure the recall.

The items are broadcast in chunks of at most ``items_per_pass`` items and
``BYTES_PER_PASS`` bytes of text (a longer item is a chunk alone); more items
mean more passes over the documents, never a larger broadcast.  All chunks pass
through the driver, which keeps them until the plan has run.  The documents are
not shuffled.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a shingle is
five words, or the whole sequence if there are fewer.  A text that is null or
has no words has no shingles, matches nothing and is matched by nothing.
Repeated documents and repeated items give a row each; null ids are kept.
Empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import lower_ascii, mix, read, row_schema, span_hashes, text_chunks, whole_rows, word_spans

WORDS = 5
CONTAINMENT = 0.8
N_HASHES = 32
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 16 << 20
FILTER_BITS = 18
SCHEMA = "doc_id long, item_id long, n_shingles long, n_contained long, containment double"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def multipliers(n: int) -> np.ndarray:
    """n odd multipliers, one per hash function."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _PRIMES[0]) | np.uint64(1)


def shingle_strings(text: str | None, words: int = WORDS) -> set[bytes]:
    parts = (text or "").encode().lower().split()      # bytes: only A-Z change, only ASCII blanks split
    if not parts:
        return set()
    return {b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))}


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Hash and row of each shingle of the rows, in order."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    word = span_hashes(data, starts, ends)
    n_words = np.bincount(rows, minlength=len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    n_shingles = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[owner]
    out = np.zeros(len(owner), np.uint64)
    padded = np.concatenate((word, np.zeros(words, np.uint64)))
    for i in range(words):
        part = padded[at + i] * _PRIMES[i]
        out += part if i == 0 else np.where(n_words[owner] > i, part, np.uint64(0))
    return mix(out + np.minimum(n_words[owner], words).astype(np.uint64)), owner, n_shingles


class ItemIndex:
    """Minima of the test items by size class and hash function."""

    def __init__(self, items: list[tuple[int | None, str | None]], n_hashes: int):
        self.items = [(i, s) for i, s in ((i, shingle_strings(t)) for i, t in items) if s]
        self.mult = multipliers(n_hashes)
        texts = [t for _, t in items]
        classes: dict[int, list[int]] = {}
        hashes = []
        kept = [t for t in texts if shingle_strings(t)]
        for k, text in enumerate(kept):
            raw = np.frombuffer(text.encode(), np.uint8)
            h = np.unique(shingle_hashes(raw, np.array([0, len(raw)]))[0])
            hashes.append(h)
            classes.setdefault(max(0, len(h).bit_length() - 3), []).append(k)     # log2 of the block length
        self.classes = {}
        for level, members in sorted(classes.items()):
            minima = np.stack([[(hashes[k] * m).min() for m in self.mult] for k in members]).astype(np.uint64)
            per_hash = []
            for f in range(n_hashes):
                order = np.argsort(minima[:, f], kind="stable")
                table = np.zeros(1 << FILTER_BITS, bool)
                table[(mix(minima[:, f]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
                per_hash.append((minima[order, f], np.array(members)[order], table))
            self.classes[level] = per_hash

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, n_shingles: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a minimum."""
        if not len(hashes) or not self.classes:
            return set()
        rows = np.flatnonzero(n_shingles)
        count, before, steps = n_shingles[rows], 0, []
        for level in sorted(self.classes):                         # from the blocks of one class to those of the next; none is padded
            step, before = 1 << (level - before), level
            more = -(-count // step)
            first = np.repeat(np.cumsum(count) - count, more) + step * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more))
            steps.append((level, first, np.repeat(rows, more)))
            count = more
        found: set[tuple[int, int]] = set()
        for f, m in enumerate(self.mult):
            low = hashes * m
            for level, first, row_of_block in steps:
                low = np.minimum.reduceat(low, first)
                minima, members, table = self.classes[level][f]
                hit = np.flatnonzero(table[(mix(low) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                if not len(hit):
                    continue
                values = low[hit]
                left, right = np.searchsorted(minima, values, "left"), np.searchsorted(minima, values, "right")
                for h, a, b in zip(hit[right > left], left[right > left], right[right > left]):
                    row = int(row_of_block[h])
                    found.update((row, int(k)) for k in members[a:b])
        return found


def _matches(index: ItemIndex, batch: pa.RecordBatch, threshold: float):
    """(row, item, shingles of the item, how many of them the row contains) of
    the verified candidates."""
    texts = batch.column(batch.schema.get_field_index("text"))
    for first, _, data, offsets in text_chunks(batch, "text"):
        by_row: dict[int, list[int]] = {}
        for row, item in index.candidates(*shingle_hashes(data, offsets)):
            by_row.setdefault(row, []).append(item)
        for row, found in sorted(by_row.items()):
            have = shingle_strings(texts[first + row].as_py())
            for k in sorted(found):
                want = index.items[k][1]
                both = len(want & have)
                if both >= threshold * len(want):
                    yield first + row, k, len(want), both


def _search(items: list, n_hashes: int, threshold: float):
    def run(batches):
        index = ItemIndex(items, n_hashes)
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[row].as_py(), index.items[k][0], n, both, both / n) for row, k, n, both in _matches(index, batch, threshold)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                names=["doc_id", "item_id", "n_shingles", "n_contained", "containment"])
    return run


def _clean(items: list, n_hashes: int, threshold: float):
    def run(batches):
        index = ItemIndex(items, n_hashes)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _matches(index, batch, threshold)]] = False
            yield batch.select(["row"]).filter(pa.array(keep))
    return run


def item_chunks(items: DataFrame, size: int, limit: int = BYTES_PER_PASS):
    """The test items in lists of at most ``size`` items and, unless one item is
    longer, ``limit`` bytes of text."""
    chunk: list = []
    held = 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        length = len((r[1] or "").encode())
        if chunk and (len(chunk) == size or held + length > limit):
            yield chunk
            chunk, held = [], 0
        chunk.append((r[0], r[1]))
        held += length
    if chunk:
        yield chunk


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, n_hashes: int = N_HASHES,
                    items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_contained, containment) for each
    document that contains at least ``threshold`` of a test item's shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for chunk in item_chunks(items, items_per_pass):
        part = docs.mapInArrow(_search(chunk, n_hashes, threshold), SCHEMA)
        out = part if out is None else out.unionAll(part)
    return docs.limit(0).mapInArrow(_search([], n_hashes, threshold), SCHEMA) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, n_hashes: int = N_HASHES,
                  items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs``, whole, that contain no test item."""
    for chunk in item_chunks(items, items_per_pass):
        docs = whole_rows(docs).select("row", "text").mapInArrow(_clean(chunk, n_hashes, threshold), row_schema(docs)).select("row.*")
    return docs


_WORDS_SQL = ("list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[\\x20\\x09-\\x0D]+'), lambda w: w <> '')")
_SHINGLES_SQL = ("CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(1, len(w) - 4) + 1), "
                 "lambda i: array_to_string(w[i:i + 4], ' ')) END")
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS_SQL} AS w FROM documents),
     ds AS (SELECT DISTINCT rid, doc_id, unnest({_SHINGLES_SQL}) AS s FROM d),
     b AS (SELECT item_id, row_number() OVER () AS iid, {_WORDS_SQL} AS w FROM benchmark),
     bs AS (SELECT DISTINCT iid, item_id, unnest({_SHINGLES_SQL}) AS s FROM b),
     size AS (SELECT iid, count(*) AS n FROM bs GROUP BY iid),
     hit AS (SELECT rid, doc_id, iid, item_id, count(*) AS m FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, m AS n_contained, m / n AS containment
FROM hit JOIN size USING (iid) WHERE m >= {CONTAINMENT} * n
"""


@register("op10_decontaminate", ORACLE)
def op10_decontaminate(spark, sf_dir):
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
