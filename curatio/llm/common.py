"""Helpers shared by the operators of this subpackage.

Texts reach Python as Arrow batches.  ``text_chunks`` cuts a batch into runs of
rows of a bounded number of bytes and gives their UTF-8 bytes as one numpy
array, so that hashing and splitting into words is vectorised over many texts.
"""

from __future__ import annotations

import ctypes
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 2 << 20          # bytes of text handled at once (a longer text is handled alone)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


BATCH_ROWS = 1000               # rows of an Arrow batch: texts are long, and batches live outside the heap


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small, unless the session asks for still smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)       # of the GNU C library


def release() -> None:
    """Gives freed memory back to the system.  Python workers are kept for later
    tasks and stages, and what one of them has freed would still count as its own."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def releasing(run):
    """A function of groups, or of two groups that meet, that releases the memory
    it has freed after each."""
    def one(table):
        out = run(table)
        release()
        return out

    def two(left, right):
        out = run(left, right)
        release()
        return out
    return one if len(signature(run).parameters) == 1 else two


def releasing_batches(run):
    """The same for a function of an iterator of batches."""
    @wraps(run)
    def wrapped(batches):
        def each():
            for batch in batches:
                yield batch
                release()
        yield from run(each())
    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """``crc32(id as text) mod divisor``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit``
    bytes; a null text counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each;
    words never cross rows.  ``word``: which bytes belong to words, if others."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    if word is None:
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        seq = np.full(size, base, np.uint64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=np.uint64)
        if size <= 8 * CHUNK_BYTES:
            _POWERS[name] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one pass of prefix sums."""
    n = len(data) + 1
    prefix = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _MULT, n)[:n - 1], dtype=np.uint64, out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _power("down", _INV, n)[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid

    from curatio.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of the lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(docs: DataFrame, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(block, doc_id, text, carried columns) and the number of blocks.  A block is a hash range
    of rows of about ``block_bytes`` bytes of text, so one block fits a task at
    any size of the table; its number of rows of one text is that of any hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(n)).cast("int").alias("block"), "doc_id", "text", *carry), n


def hash_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n equal hash ranges in the ascending ``keys``, and the end."""
    bounds = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, bounds, "left"), len(keys))


def packed(values: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns in one struct, so that columns of any
    name pass through an operator untouched."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_schema(docs: DataFrame, *fields: str) -> T.StructType:
    """The schema of ``row`` and further fields ("name type")."""
    return T.StructType([T.StructField("row", T.StructType(docs.schema.fields)),
                         *(T.StructField(n, T._parse_datatype_string(t)) for n, t in (f.split(" ") for f in fields))])


def bounded_sample(rows: DataFrame, limits: dict, by: str, seed: int, spare: int = 100) -> DataFrame:
    """At most ``limits[value]`` rows per value of ``by`` (other values: none):
    those with the smallest hash of all their columns, as ``_place``, ascending
    in ``_rank``; equal rows count once.

    The rows per value are counted first; only rows whose hash falls into the
    share of the hash range that holds about twice the limit go on to the
    ranking, so the ranking sees a bounded number of rows at any size of the
    table and any number of tasks."""
    scale = 1 << 40
    hashed = rows.withColumn("_place", F.xxhash64(*rows.columns, F.lit(seed)))
    unit = F.pmod("_place", F.lit(scale))
    chosen = F.lit(False)
    for r in rows.where(F.col(by).isin(list(limits))).groupBy(by).count().collect():
        share = min(scale, -(-scale * (2 * limits[r[0]] + spare) // r["count"]))
        chosen = chosen | ((F.col(by) == r[0]) & (unit < share))
    limit = F.lit(0)
    for value, n in limits.items():
        limit = F.when(F.col(by) == value, n).otherwise(limit)
    rank = F.row_number().over(W.partitionBy(by).orderBy(unit, "_place", "doc_id"))
    return hashed.where(chosen).distinct().withColumn("_rank", rank).where(F.col("_rank") <= limit)
