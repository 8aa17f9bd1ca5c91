"""SimHash near-duplicates with BK-trees.

Fingerprint: the text with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word
shingles joined by a space (repeats included; fewer words: the whole sequence),
XXH64 with seed 42 of each; a bit is set if it is set in over half of the
hashes.  A text without words has fingerprint zero and is linked like any other.

Links: two distinct fingerprints within ``max_bits`` bits agree on at least two
of ``max_bits + 2`` bit ranges, so each fingerprint is put into one shard per
pair of ranges.  Each shard's fingerprints form BK-trees: the children of a node
are keyed by their integer Hamming distance to it, and a search for radius r
follows only the edges whose key is within r of the query's distance.  All
trees of a batch of shards are built and searched level by level as numpy
arrays.  A shard of more than ``TREE_NODES`` fingerprints is split into trees of
about that size, and every pair of (tree, query block) is a cell of its own, so
no task holds a whole shard.  A cell returns a spanning set of its links, not
all pairs.

Equal fingerprints are collapsed by a partial aggregate before all this, so
copies of one text, however many, are one node.  The trees go to the tasks by a
shuffle rather than by a broadcast, since their size grows with the table.
Components come from star contraction over the spanning links.  Fingerprints
and edges are written to the shared folder; nothing is collected.

Null text: as the empty text.  A component's id is its smallest non-null
doc_id (null if it has none).  Repeated rows give a row each.  Empty table:
empty result.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import read, releasing_batches, whole_rows, written
from curatio.llm.graph import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
TREE_NODES = 4096
BATCH_ROWS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()       # bytes: ASCII only, as the contract says
    n = len(words) - shingle + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        hashes = xxhash.xxh64_digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:n - 1])).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(bits)).view(">i8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], names=["doc_id", "fp", "key"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, key): fingerprint and a hash of the text, which with the id
    names a row."""
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    return docs.mapInArrow(releasing_batches(_fingerprints(shingle)), "doc_id long, fp long, key long")


def range_masks(max_bits: int) -> list[int]:
    """One mask per pair of bit ranges (as signed 64-bit integers)."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [p | q for p, q in combinations(parts, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """BK-trees of many cells at once, as arrays."""

    def __init__(self, prints: np.ndarray, cells: np.ndarray, n_cells: int):
        """``cells``: the cell of each node, ascending."""
        self.prints = prints
        self.root = np.full(n_cells, -1, np.int64)
        which, first = np.unique(cells, return_index=True)
        self.root[which] = first
        parent = np.full(len(prints), -1, np.int64)
        edge = np.zeros(len(prints), np.int64)
        rest = np.setdiff1d(np.arange(len(prints)), first, assume_unique=True)
        node = self.root[cells[rest]]
        while len(rest):
            distance = np.bitwise_count(prints[rest] ^ prints[node]).astype(np.int64)
            _, lead, group = np.unique(node * 65 + distance, return_index=True, return_inverse=True)
            parent[rest[lead]], edge[rest[lead]] = node[lead], distance[lead]
            child = rest[lead][group]
            stay = child != rest
            rest, node = rest[stay], child[stay]
        order = np.argsort(parent, kind="stable")
        order = order[parent[order] >= 0]
        self.children, self.edge = order, edge
        n_children = np.bincount(parent[order], minlength=len(prints)) if len(order) else np.zeros(len(prints), np.int64)
        self.first_child = np.concatenate(([0], np.cumsum(n_children)))

    def search(self, queries: np.ndarray, cells: np.ndarray, radius: int):
        """(query, node) positions within the radius, following only edges
        within the radius of the query's distance."""
        q = np.arange(len(queries))
        node = self.root[cells]
        q, node = q[node >= 0], node[node >= 0]
        found_q, found_n = [], []
        while len(q):
            distance = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            found_q.append(q[near])
            found_n.append(node[near])
            n = self.first_child[node + 1] - self.first_child[node]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first_child[node], n)
            child = self.children[at]
            follow = np.abs(self.edge[child] - np.repeat(distance, n)) <= radius
            q, node = np.repeat(q, n)[follow], child[follow]
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (np.zeros(0, np.int64),) * 2


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a[i] and b[i]; a label is the
    smallest position of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def cell_links(cell: np.ndarray, member: np.ndarray, prints: np.ndarray, radius: int):
    """Spanning links of each cell: ``member`` marks the fingerprints that form
    the cell's tree; all fingerprints of the cell are queries."""
    numbers, cells = np.unique(cell, return_inverse=True)
    nodes = np.flatnonzero(member)
    forest = Forest(prints[nodes], cells[nodes], len(numbers))
    label = np.arange(len(prints))
    step = 4096
    for i in range(0, len(prints), step):
        q, n = forest.search(prints[i:i + step], cells[i:i + step], radius)
        label = connect(label, q + i, nodes[n])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return prints[linked], prints[label[linked]]


def _links(radius: int):
    def cut(held: list[pa.Table]):
        table = pa.concat_tables(held)
        cell = table["cell"].to_numpy()
        return table, cell

    def links(table):
        a, b = cell_links(table["cell"].to_numpy(), table["member"].to_numpy(zero_copy_only=False),
                          table["fp"].to_numpy().view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:                   # sorted by cell: only whole cells are searched
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                table, cell = cut(held)
                end = int(np.searchsorted(cell, cell[-1], "left"))
                if end:
                    yield links(table.slice(0, end))
                held = [table.slice(end)]
                rows = len(table) - end
        if rows:
            yield links(cut(held)[0])
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) within
    ``max_bits`` bits."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(range_masks(max_bits))])
    shards = prints.select("fp", F.explode(keys).alias("shard"))
    large = (shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).select("shard", F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees")))
    rows = (shards.join(large, "shard")             # drops the shards with one fingerprint: they have no links
            .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("trees")).cast("int")))
    place = F.explode(F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda other: F.struct(
        F.xxhash64("shard", F.least("own", other), F.greatest("own", other)).alias("cell"),
        (F.col("own") <= other).alias("member"))))
    cells = rows.select("fp", place.alias("at")).select("fp", "at.cell", "at.member")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (cells.repartition(n, "cell").sortWithinPartitions("cell", F.desc("member"), "fp")
            .mapInArrow(releasing_batches(_links(max_bits)), "a long, b long"))


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint."""
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, max_bits)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = groups(prints, max_bits).join(low, "fp")
    ids = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = linked.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, whole, with the smallest id (null first) of each
    component; of repeated rows one."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    same = lambda doc, key: (key.alias("_key"), F.coalesce(doc, F.lit(0)).alias("_id"), doc.isNull().alias("_none"))
    chosen = (groups(prints, max_bits).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
              .select(*same(F.col("first.doc_id"), F.col("first.key"))))
    rows = whole_rows(docs).select("row", *same(F.col("doc_id"), F.xxhash64("text")))
    names = ["_key", "_id", "_none"]            # one shuffle of the rows serves the join and the repeated rows
    return rows.join(chosen, names, "left_semi").dropDuplicates(names).select("row.*")


@register("op4_simhash")
def op4_simhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
