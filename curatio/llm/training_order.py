"""Token-id output in training order.

Every text is encoded (byte-level BPE, ids below 65,536) and ends with the
end-of-text id; sequences of ``SEQUENCE`` ids never cross documents and the last
one of a document is padded with that id.

Order: sequence k of a document has the number h + k * ``STEP`` modulo ``DOMAIN``,
where h is a 64-bit hash of the document's id and text.  A keyed Feistel network
over the next even power of two, with cycle-walking back into the domain,
permutes the numbers.  Shards are equal ranges of the permuted numbers; each
range is one group of a shuffle, sorted, and written as one file of fixed-stride
records.  The domain is far larger than any corpus, so numbers hardly ever meet
(then the id and k decide) and most are not used: a sequence's global slot is its
rank in the permuted order, that is, the records of all earlier shards plus its
place in its own file.  A reader seeks to any slot with the manifest alone, and
reads on from there.

The order is a function of the rows and the key: how the input is split in files
and partitions, and how many cores there are, changes nothing.  The number of
shards comes from the sum of the bounds ``ceil((bytes + 1) / SEQUENCE)`` of the
texts, which Spark adds up without encoding anything.

Texts are encoded once; only compressed ids are shuffled.  A file is written
under a temporary name and moved, so a task that runs again after the loss of an
executor replaces it by the same bytes.  The driver sees one number per shard.

Null text: as the empty text, one sequence of end-of-text ids.  Null ids and
repeated rows are kept.  Empty table: empty result, no files.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.bpe import vocabulary
from curatio.llm.catalog import register
from curatio.llm.common import mix, read, shared_dir, written

SEQUENCE = 512
KEY = 20240607
SHARD_BYTES = 32 << 20        # bytes of text per shard, about
ROUNDS = 6
DOMAIN = (1 << 61) - 1        # numbers that sequences can have
STEP = 0x9E3779B97F4A7C1      # between the numbers of a document's sequences
END = 50256
DTYPE = "<u2"
PIECES_SCHEMA = "shard int, place long, doc_id long, part int, n_tokens int, ids binary"
ROW_SCHEMA = "shard int, record long, doc_id long, part int, n_tokens int, ids_crc32 long"
BATCH_ROWS = 1024


class Permutation:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network on the
    smallest even number of bits, walked until it falls below n."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (right << self.half) | left      # halves swapped, so the inverse is the same with the keys reversed

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while True:
            out = np.flatnonzero(x >= np.uint64(self.n))
            if not len(out):
                return x.astype(np.int64)
            x[out] = self._once(x[out], keys)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


def encoding(spec: bytes, pattern: str):
    """The byte-level vocabulary as a tiktoken encoding."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, spec.splitlines()) if a}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict = {}


def _pieces(spec: bytes, pattern: str, key: int, n_shards: int, sequence: int):
    name = (hashlib.sha256(spec).hexdigest(), pattern)

    def run(batches):
        if name not in _LOADED:
            _LOADED[name] = encoding(spec, pattern)
        encode = _LOADED[name].encode_ordinary
        order, pack = Permutation(DOMAIN, key), zstandard.ZstdCompressor(level=1)
        width = -(-DOMAIN // n_shards)
        fields = [("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary())]

        def batch_of(rows):
            number, doc, k, n, ids = zip(*rows)
            place = order.forward(np.array(number, np.uint64))
            columns = (place // width, place, doc, k, n, ids)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])

        rows = []
        for batch in batches:
            for doc, text, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.array([*encode(text or ""), END], DTYPE)
                for k in range(-(-len(ids) // sequence)):
                    piece = ids[k * sequence:(k + 1) * sequence]
                    rows.append(((start + k * STEP) % DOMAIN, doc, k, len(piece), pack.compress(piece.tobytes())))
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)
    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _write(path: str, sequence: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("part", "ascending")])
        shard = table["shard"][0].as_py()
        fs, folder = pafs.FileSystem.from_uri(path)
        name, unpack, crc = f"{folder}/{shard_name(shard)}", zstandard.ZstdDecompressor(), []
        trial = f"{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(trial) as out:
            for ids in table["ids"]:
                record = unpack.decompress(ids.as_py(), max_output_size=2 * sequence)
                record += np.full(sequence - len(record) // 2, END, DTYPE).tobytes()
                crc.append(zlib.crc32(record))
                out.write(record)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:        # of an earlier run of this task
            fs.delete_file(name)
        fs.move(trial, name)
        return pa.table({"shard": table["shard"], "record": pa.array(np.arange(len(table)), pa.int64()), "doc_id": table["doc_id"],
                         "part": table["part"], "n_tokens": table["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())})
    return run


def materialise(docs: DataFrame, path: str, spec: bytes, pattern: str, sequence: int = SEQUENCE, key: int = KEY,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and ``manifest.json`` under ``path`` and returns
    (slot, shard, record, doc_id, part, n_tokens, ids_crc32), a row a sequence."""
    spark = docs.sparkSession
    bound = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / sequence).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(bound)).first()[0] or 0
    n_shards = max(1, -(-total * sequence // shard_bytes))
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder, recursive=True)
    pieces = rows.withColumn("start", F.xxhash64("doc_id", "text")).mapInArrow(_pieces(spec, pattern, key, n_shards, sequence), PIECES_SCHEMA)
    done = written(pieces.groupBy("shard").applyInArrow(_write(path, sequence), ROW_SCHEMA), "sequences")
    counts = {r["shard"]: r["n"] for r in done.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = [], 0
    for s in range(n_shards):
        first.append(at)
        at += counts.get(s, 0)
    manifest = {"sequence": sequence, "dtype": DTYPE, "end": END, "key": key, "domain": DOMAIN, "records": at,
                "first_slot": first, "shards": n_shards}
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    offsets = spark.createDataFrame(list(enumerate(first)), "shard int, first long")
    return (done.join(offsets, "shard")
            .select((F.col("first") + F.col("record")).alias("slot"), "shard", "record", "doc_id", "part", "n_tokens", "ids_crc32"))


def read_slots(path: str, slot: int, n: int) -> np.ndarray:
    """Up to ``n`` sequences from ``slot`` on, read sequentially."""
    fs, folder = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    width, out = m["sequence"] * 2, []
    bounds = [*m["first_slot"], m["records"]]
    n = min(n, m["records"] - slot)
    shard = int(np.searchsorted(bounds, slot, "right")) - 1
    while n > 0:
        here = min(n, bounds[shard + 1] - slot)
        if here > 0:
            with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
                f.seek((slot - bounds[shard]) * width)
                out.append(np.frombuffer(f.read(here * width), DTYPE).reshape(here, -1))
            slot, n = slot + here, n - here
        shard += 1
    return np.concatenate(out) if out else np.zeros((0, m["sequence"]), DTYPE)


def uri(path: str) -> str:
    """A path of the shared folder as an address that pyarrow opens."""
    return path if "://" in path else ("file://" + path.removeprefix("file:") if path.removeprefix("file:").startswith("/") else path)


@register("op9_training_order")
def op9_training_order(spark, sf_dir):
    import public_tokenizers
    path = uri(shared_dir(spark, "training-order"))
    return materialise(read(spark, sf_dir, "documents"), path, vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")),
                       public_tokenizers.PATTERN)
