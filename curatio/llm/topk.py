"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are quantised to integers; a dimension plays the part of a term.  The
vectors are cut into shards by the hash of their id and the queries into chunks,
and each (chunk, shard) pair is one cell, so that neither side is ever held
whole.  In a cell the vectors are put into an order that brings similar ones
together (signs of the dimensions of highest variance) and cut into blocks of
``BLOCK``.  A block keeps the maximum and the minimum of each dimension and a
forward index (its vectors).  Per query the sum over the dimensions of weight
times maximum (minimum for negative weights) bounds every score in the block;
blocks are taken in descending order of this bound, in steps of growing size,
and scored through their forward indexes until the bound of the next is below
the query's k-th score.  The cells' best k are then ranked per query.

Results are exact, ties to the smaller id: a block whose bound equals the k-th
score is still scored.  Where sums can pass 2**53, the bounds are widened by more
than their rounding and the blocks that they let through are scored with Python
integers, saturating at 64 bits.

Vectors that are null or hold null or non-finite components, and rows with a
null id, take no part.  Missing trailing components count as zero.  Rows with
the query's own id are not its candidates; a query id that occurs in several
rows is answered once, from the smallest vector.  Repeated rows of another id
are candidates each.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import read

K = 20
EVERY = 20
SCALE = 64
BLOCK = 64
SHARD_ROWS = 8192
CHUNK_ROWS = 4096
SCHEMA = "query_id long, vec_id long, score long"
_EXACT = float(1 << 53)


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part, components as integers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    length = flat.value_lengths().to_numpy()
    out = np.zeros((len(flat), width), np.int64)
    row = np.repeat(np.arange(len(flat)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = flat.flatten().to_numpy()
    return out


def widest(column: pa.ChunkedArray) -> int:
    return max((pc.max(c.value_lengths()).as_py() or 0 for c in column.chunks if len(c)), default=0)


def similar_order(v: np.ndarray, bits: int = 16) -> np.ndarray:
    """An order that brings vectors with equal signs in the dimensions of
    highest variance together."""
    if not v.size:
        return np.arange(len(v))
    spread = v.astype(float).var(axis=0)
    lead = np.argsort(-spread, kind="stable")[:bits]
    above = v[:, lead] > np.median(v[:, lead], axis=0)
    return np.lexsort(above.T[::-1])


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, block: int = BLOCK):
    """(query position, id, score) of the k best candidates of each query."""
    order = similar_order(v)
    ids, whole_v, whole_q = ids[order], v[order], q
    v, q = whole_v.astype(float), whole_q.astype(float)
    big = len(v) and len(q) and float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1]) >= _EXACT
    cuts = np.arange(0, len(v), block)
    high, low = np.maximum.reduceat(v, cuts, axis=0), np.minimum.reduceat(v, cuts, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if big:
        bound += 2.0 ** -40 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)
    ranked = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(len(q), -np.inf)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    done, step = 0, 1
    while done < len(cuts):
        upper = np.take_along_axis(bound, ranked[:, done:done + 1], axis=1)[:, 0]
        active = np.flatnonzero(upper >= kth)
        if not len(active):
            break
        todo = ranked[active, done:done + step]
        keep = np.take_along_axis(bound[active], todo, axis=1) >= kth[active, None]
        pair_block = todo[keep]
        pair_query = np.broadcast_to(active[:, None], todo.shape)[keep]
        by_block = np.argsort(pair_block, kind="stable")
        edges = np.flatnonzero(np.diff(pair_block[by_block])) + 1
        new = [found]
        for group in np.split(by_block, edges):
            b = int(pair_block[group[0]])
            rows = pair_query[group]
            part = slice(b * block, (b + 1) * block)
            scores = exact_products(whole_q[rows], whole_v[part]) if big else q[rows] @ v[part].T
            at, cand = np.nonzero((scores >= kth[rows][:, None]) & (q_ids[rows][:, None] != ids[part][None, :]))
            new.append((rows[at], ids[part][cand], scores[at, cand].astype(np.int64)))
        found = top(*(np.concatenate(x) for x in zip(*new)), k)
        count = np.bincount(found[0], minlength=len(q))
        last = np.cumsum(count) - 1
        full = count == k
        kth[full] = found[2][last[full]]
        done, step = done + step, step * 2
    return found


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.clip(q.astype(object) @ v.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each query position: by score, then smaller id."""
    order = np.lexsort((ids, ~scores, at))          # ~ turns the order and never overflows
    at, ids, scores = at[order], ids[order], scores[order]
    first = np.searchsorted(at, at, "left")
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[keep], scores[keep]


def _cell(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        width = max(widest(vectors["v"]), widest(queries["v"]))
        if not len(vectors) or not len(queries):
            found = (np.zeros(0, np.int64),) * 3
            q_ids = np.zeros(0, np.int64)
        else:
            q_ids = queries["vec_id"].to_numpy()
            found = best(q_ids, matrix(queries["v"], width), vectors["vec_id"].to_numpy(), matrix(vectors["v"], width), k)
        return pa.table({"query_id": pa.array(q_ids[found[0]], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})
    return run


def search(vectors: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of quantised ``vectors``; ``is_query``:
    condition on vec_id."""
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, chunks = max(1, -(-n["n"] // shard_rows)), max(1, -(-n["q"] // chunk_rows))
    place = lambda size, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    v = vectors.select("vec_id", "v", place(shards, 1).alias("shard"), every(chunks).alias("chunk"))
    q = queries.select("vec_id", "v", place(chunks, 2).alias("chunk"), every(shards).alias("shard"))
    found = (v.groupBy("chunk", "shard").cogroup(q.groupBy("chunk", "shard")).applyInArrow(_cell(k), SCHEMA))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""


@register("op7_topk", ORACLE)
def op7_topk(spark, sf_dir):
    return search(quantised(read(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)
