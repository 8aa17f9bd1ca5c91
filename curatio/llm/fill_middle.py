"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable
buffers: the UTF-8 bytes of its text and the bytes of the sentinels.  Cutting
the text splits a descriptor in two and copies nothing; an arrangement is a
permutation of the descriptors; the inverse permutation restores the text; and
digests are taken by streaming the descriptors.

A text is cut in ``n`` units ``[A-Za-z]+|[^A-Za-z]``, matched left to right over
code points.  With h1 to h4 the first four groups of 8 hexadecimal digits of
sha256(``seed:doc_id``), the prefix ends after the smaller and the middle after
the larger of h1 mod (n + 1) and h2 mod (n + 1) units; the suffix is the rest.
The form is ``plain`` (the text as it is) if the text is empty, holds a sentinel
or h3 mod 100 >= ``rate``; else ``spm`` if h4 mod 100 < ``spm_rate``; else
``psm``.

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle

No sentinel overlaps itself or another one, and a transformed text holds none, so
the first occurrence of each in an output is the one put there: ``restored``
needs the output and the form only.

The documents are not shuffled, and every row is handled alone, so neither the
size of the table nor a skewed column changes the memory of a task; a text is
held once, its arrangement by descriptors, its output once more if asked for.

A null text counts as empty.  A null id hashes as the empty string.  Repeated
rows give equal rows.  An empty table gives an empty result.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import read, text_chunks

SEED = 1
RATE = 90                      # of 100 texts that are cut
SPM_RATE = 20                  # of 100 cut texts that put the suffix first
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: The pieces in the order of the output, as numbers of (prefix, suffix, middle); a sentinel goes before each.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

TEXT, MARK = 0, 1              # the two buffers


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers, pieces):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = list(pieces)

    @classmethod
    def whole(cls, text, marks=b"") -> "PieceTable":
        return cls((text, marks), [(TEXT, 0, len(text))])

    def cut(self, piece: int, at: int) -> None:
        """Splits a descriptor ``at`` bytes after its start."""
        buffer, start, length = self.pieces[piece]
        self.pieces[piece:piece + 1] = [(buffer, start, at), (buffer, start + at, length - at)]

    def arranged(self, order) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def marked(self, marks) -> "PieceTable":
        """With the given span of the sentinel buffer before each piece."""
        return PieceTable(self.buffers, [d for mark, piece in zip(marks, self.pieces) for d in ((MARK, *mark), piece)])

    def stream(self):
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def inverse(order) -> list[int]:
    out = [0] * len(order)
    for place, piece in enumerate(order):
        out[piece] = place
    return out


def _spans(sentinels):
    at, out = 0, []
    for s in sentinels:
        out.append((at, len(s)))
        at += len(s)
    return out


def arranged(text, prefix_end: int, middle_end: int, form: str, sentinels=SENTINELS) -> PieceTable:
    """The output of a text cut at two byte positions."""
    table = PieceTable.whole(text, b"".join(sentinels))
    if form == "plain":
        return table
    table.cut(0, prefix_end)
    table.cut(1, middle_end - prefix_end)              # prefix, middle, suffix
    prefix, middle, suffix = 0, 1, 2
    order = [(prefix, suffix, middle)[i] for i in ORDERS[form]]
    spans = _spans(sentinels)
    return table.arranged(order).marked([spans[i] for i in ORDERS[form]])


def restored(output, form: str, sentinels=SENTINELS) -> PieceTable:
    """The text of an output: cut at its sentinels, which are left out, and the
    pieces put back by the inverse permutation."""
    table = PieceTable.whole(output)
    if form == "plain":
        return table
    order = ORDERS[form]
    starts = []
    for i in order:
        start = output.find(sentinels[i], starts[-1][1] if starts else 0)
        starts.append((start, start + len(sentinels[i])))
    if starts[0][0] != 0 or any(a < 0 for a, _ in starts):
        raise ValueError("not an output of this form")
    ends = [a for a, _ in starts[1:]] + [len(output)]
    for (_, start), end in zip(reversed(starts), reversed(ends)):
        table.cut(0, end)                              # what follows is cut already
        table.cut(0, start)
    pieces = PieceTable(table.buffers, table.pieces[1::2])
    prefix, suffix, middle = inverse(order)
    return pieces.arranged((prefix, middle, suffix))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of the texts in ``data`` start."""
    letter = _LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    inside[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.flatnonzero(~inside & ((data & 0xC0) != 0x80))


def plan(doc_id: int | None, n: int, marked: bool, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE):
    """(form, units of the prefix, units up to the end of the middle)."""
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not n or marked or h3 % 100 >= rate:
        return "plain", 0, 0
    a, b = h1 % (n + 1), h2 % (n + 1)
    return "spm" if h4 % 100 < spm_rate else "psm", min(a, b), max(a, b)


_FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
           ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _transform(seed, rate, spm_rate, sentinels, texts):
    schema = pa.schema(_FIELDS + ([("output", pa.string())] if texts else []))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for row, end, data, offsets in text_chunks(batch):
                starts = unit_starts(data, offsets)
                first = np.searchsorted(starts, offsets)
                out = []
                for i in range(end - row):
                    at, length = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    raw = data[at:at + length]
                    text = raw.tobytes()
                    n = int(first[i + 1] - first[i])
                    form, a, b = plan(ids[row + i], n, any(s in text for s in sentinels), seed, rate, spm_rate)
                    edges = [length if k == n else int(starts[first[i] + k]) - at for k in (a, b)]
                    table = arranged(text, *edges, form, sentinels)
                    output = table.bytes()
                    chars = [None, None]
                    if form != "plain":
                        chars = [int(np.count_nonzero((raw[s:e] & 0xC0) != 0x80)) for s, e in ((0, edges[0]), edges)]
                    out.append((ids[row + i], n, form, *chars, table.digest(), restored(output, form, sentinels).digest())
                               + ((output.decode(),) if texts else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels=SENTINELS,
                texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256) and, with ``texts``, the output itself.  The sentinels must
    not overlap themselves or each other."""
    for s in sentinels:
        for t in sentinels:
            if any(s[-k:] == t[:k] for k in range(1, min(len(s), len(t)))) or (s != t and s in t):
                raise ValueError("sentinels overlap")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_transform(seed, rate, spm_rate, tuple(sentinels), texts), SCHEMA + (", output string" if texts else ""))


def restore(outputs: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, form, output)."""
    def run(batches):
        for batch in batches:
            ids, forms, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "form", "output"))
            back = [restored(t.encode(), f, sentinels).bytes().decode() for f, t in zip(forms.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(back, pa.string())], ["doc_id", "text"])
    return outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output").mapInArrow(run, "doc_id long, text string")


_PART = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     c AS (SELECT *, len(u) AS n, {_PART.format(1)} % (len(u) + 1) AS x, {_PART.format(9)} % (len(u) + 1) AS y,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                            OR {_PART.format(17)} % 100 >= {RATE} THEN 'plain'
                       WHEN {_PART.format(25)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
     p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
                  array_to_string(u[greatest(x, y) + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@register("op12_fill_middle", ORACLE)
def op12_fill_middle(spark, sf_dir):
    return fill_middle(read(spark, sf_dir, "documents"), texts=False)
