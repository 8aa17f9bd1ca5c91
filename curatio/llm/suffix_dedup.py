"""Exact substring dedup by a distributed, common-prefix-aware suffix sort.

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).  Strings are judged
on the input, overlaps count, and matches never cross documents.

Which suffixes are sorted.  Every window of LENGTH bytes is owned by the
position of the smallest hash among its ``GRAM``-byte grams (the leftmost of
equals), so equal windows are owned at the same place within them.  A segment is
a maximal range of window starts with one owner: about one per
(LENGTH - GRAM) / 2 bytes.  It is represented by the suffix at the owner up to
the end of its last window, followed by the bytes before the owner in reverse.

1. Blocks of documents send the hashes of their owners' grams by hash range and
   learn which occur in more than one segment.  A unique gram needs no sorting:
   its suffix is told apart within GRAM bytes.
2. The suffixes of the repeated grams are collapsed where equal within the block
   (all but the first are removed there), sorted, front-coded (length of the
   prefix shared with the suffix before, and the rest) and exchanged as sorted
   runs, one per block and hash range.
3. A loser tree merges the runs of a range.  It compares the lengths of prefixes
   known to be shared with the last winner first, reads bytes only where these
   are equal, and then only behind them.  Suffixes that share the gram come out
   next to each other; equal ones leave their first occurrence, and the windows
   of different ones are matched one by one.
4. The blocks cut the found ranges out of their documents.

Hot grams: a gram that has more than ``HOT`` different segments, added up over the
blocks (so that a segment counts once in each block that has it), is not gathered
in one place.  Its
windows are sent one by one, by the hash range of two 64-bit fingerprints of the
whole window, collapsed within each block; equal fingerprints are equal windows
up to a chance of 2**-128 a pair.  All this gives the same result.

All exchanges are between blocks and hash ranges, with one entry per distinct
item and block, so copies cost one entry a block however many there are.  The
phases read one exchange of the texts, in one lazy plan; nothing is collected.

Null text: as the empty text.  Null ids come first.  Rows with one id are
ordered by their block and text.  Repeated rows give a row each, later ones
lose what they repeat.  Empty table: empty result.  Columns not named in
``carry`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.llm.catalog import register
from curatio.llm.common import _power, _INV, _MULT, blocks, hash_buckets, mix, packed, read, releasing, span_hashes, unpacked

LENGTH = 100
GRAM = 32
HOT = 2000
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 19                # bytes hashed at once
RUN, WINDOWS, REMOVED = 0, 1, 2
UNIQUE, REPEATED, CROWDED = 0, 1, 2
ASK_SCHEMA = "bucket int, block int, keys binary, counts binary"
ANSWER_SCHEMA = "block int, bucket int, states binary"
RUN_SCHEMA = "bucket int, block int, kind int, place binary, shape binary, data binary"
CUT_SCHEMA = "block int, cuts binary"


# ---- segments -------------------------------------------------------------

def sorted_rows(table: pa.Table) -> pa.Table:
    """Rows of a block in their order: by id (null first), then text."""
    return table.set_column(table.schema.get_field_index("text"), "text", table["text"].cast(pa.large_binary()).fill_null(b"")) \
        .sort_by([("doc_id", "ascending"), ("text", "ascending")]) if len(table) else table


def row_chunks(table: pa.Table):
    """(first row, bytes, offsets) of runs of rows of bounded size."""
    texts = [t.as_py() for t in table["text"]] if table["text"].type == pa.large_binary() else []
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= CHUNK or i == len(texts) - 1:
            yield first, np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in held])))
            first, size, held = i + 1, 0, []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _MULT, len(data) + 1)[:len(data)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[gram:] - prefix[:-gram]) * _power("down", _INV, len(data) + 1)[:len(data) - gram + 1])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (width - size)], h[width - size:]) if width > size else h


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """First window, last window and gram hash of each segment, and a function
    that gives the owners of chosen segments."""
    width = length - gram + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), lambda chosen: none
    h = gram_hashes(data, gram)
    low = sliding_min(h, width)
    end = np.repeat(offsets[1:], np.diff(offsets))[:len(low)]
    valid = np.arange(len(low)) + length <= end
    new = np.empty(len(low) + 1, bool)
    new[0] = new[-1] = True
    new[1:-1] = (low[1:] != low[:-1]) | (h[:len(low) - 1] == low[:-1]) | (valid[1:] != valid[:-1])
    cuts = np.flatnonzero(new)
    first, last = cuts[:-1], cuts[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]

    def owners(chosen):
        out = np.empty(len(chosen), np.int64)
        for i in range(0, len(chosen), 16384):
            at = last[chosen[i:i + 16384]]
            out[i:i + 16384] = at + (h[at[:, None] + np.arange(width)] == low[at][:, None]).argmax(axis=1)
        return out

    return first, last, low[first], owners


# ---- 1: which grams are repeated -------------------------------------------

def _ask(n_buckets: int, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        block, found = table["block"][0].as_py(), []
        for _, data, offsets in row_chunks(sorted_rows(table)):
            first, last, key, _ = segments(data, offsets, length, gram)
            found.append((key, span_hashes(data, first, last + length)))
        key = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
        whole = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)])
        order = np.lexsort((whole, key))
        key, whole = key[order], whole[order]
        head = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        other = head.copy()
        if len(key):
            other[1:] |= whole[1:] != whole[:-1]
        begin = np.flatnonzero(head)
        different = np.add.reduceat(other.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        total = np.diff(np.append(begin, len(key)))
        # a gram of equal segments only is repeated but, with the first as its only entry, counts once towards HOT
        counts = np.minimum(different, 1 << 20).astype(np.uint32) * np.uint32(2) + (total > 1)
        keys = key[begin]
        cuts = hash_buckets(keys, n_buckets)
        used = [b for b in range(n_buckets) if cuts[b] < cuts[b + 1]]
        return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()),
                         "keys": pa.array([packed(keys[cuts[b]:cuts[b + 1]]) for b in used], pa.binary()),
                         "counts": pa.array([packed(counts[cuts[b]:cuts[b + 1]]) for b in used], pa.binary())})
    return run


def _answer(hot: int):
    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked(k.as_py(), np.uint64) for k in table["keys"]]
        counts = np.concatenate([unpacked(c.as_py(), np.uint32) for c in table["counts"]]).astype(np.int64)
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        different, inside = np.bincount(inverse, counts >> 1, len(every)), np.bincount(inverse, counts & 1, len(every))
        state = np.where(different > hot, CROWDED, np.where((different > 1) | (inside > 0), REPEATED, UNIQUE)).astype(np.uint8)[inverse]
        edges = np.cumsum([0, *map(len, keys)])
        return pa.table({"block": table["block"], "bucket": table["bucket"],
                         "states": pa.array([packed(state[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())})
    return run


# ---- 2: sorted, front-coded runs -------------------------------------------

def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, of which ``start`` is known."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    return start + len(x) - -(-(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() // 8)


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, lengths and rests of ascending strings."""
    shared, last, rests = [], b"", []
    for s in strings:
        n = common_prefix(last, s, 0)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return np.array(shared, np.uint16), np.array([len(s) for s in strings], np.uint16), b"".join(rests)


class Run:
    """A front-coded run, decoded one string at a time."""

    def __init__(self, shared: np.ndarray, lengths: np.ndarray, rests: bytes):
        self.shared, self.lengths, self.rests = shared.tolist(), lengths.tolist(), rests
        self.at, self.offset, self.string = -1, 0, b""

    def advance(self) -> bool:
        """The next string becomes ``string``; false at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return False
        n = self.shared[self.at]
        more = self.lengths[self.at] - n
        self.string = self.string[:n] + self.rests[self.offset:self.offset + more]
        self.offset += more
        return True


def merge_runs(runs: list[Run]):
    """(run, index, string, prefix shared with the string before) in ascending
    order, by a loser tree that never compares a known prefix again."""
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    alive = [r.advance() for r in runs] + [False] * (size - k)
    head = [r.string for r in runs] + [b""] * (size - k)
    known = [0] * size              # prefix that a head shares with the last winner
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then with the winner."""
        if not alive[a] or not alive[b]:
            return (a, b) if alive[a] else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = head[a], head[b]
        n = common_prefix(x, y, known[a])
        if x[n:n + 1] <= y[n:n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while alive[winner]:
        run = runs[winner]
        yield winner, run.at, head[winner], known[winner]
        alive[winner] = run.advance()
        if alive[winner]:
            head[winner], known[winner] = run.string, run.shared[run.at]
        node = (winner + size) >> 1
        while node:
            other = loser[node]
            if alive[other] and alive[winner] and known[winner] > known[other]:
                pass                # the common case, decided by the known prefixes
            else:
                winner, loser[node] = play(winner, other)
            node >>= 1


def _order_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(-(1 << 63)).to_numpy() if len(table) else np.zeros(0, np.int64)


def _places(*columns) -> bytes:
    return packed(np.concatenate([np.asarray(c, np.int64) for c in columns]))


def _suffix_runs(n_buckets: int, length: int, gram: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {n: [] for n in ("bucket", "block", "kind", "place", "shape", "data")}

        def add(bucket, kind, place, shape=b"", data=b""):
            for name, value in zip(out, (bucket, block, kind, place, shape, data)):
                out[name].append(value)

        if len(table):
            block = table["block"][0].as_py()
            order = np.argsort(answers["bucket"].to_numpy())
            states = np.concatenate([unpacked(answers["states"][int(i)].as_py(), np.uint8) for i in order] or [np.zeros(0, np.uint8)])
            table = sorted_rows(table)
            ids, chunks, keys = _order_ids(table), [], []
            for base, data, offsets in row_chunks(table):
                keys.append(segments(data, offsets, length, gram)[2])
            keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            entries: dict[tuple[bytes, int], tuple[int, int, int]] = {}
            removed, crowded = [], []
            for base, data, offsets in row_chunks(table):
                first, last, key, owners = segments(data, offsets, length, gram)
                state = states[np.searchsorted(keys, key)]
                row = np.searchsorted(offsets, first, "right") - 1
                begin = offsets[row]
                hot = np.flatnonzero(state == CROWDED)
                if len(hot):
                    n = last[hot] - first[hot] + 1
                    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[hot], n)
                    one = span_hashes(data, at, at + length)
                    two = span_hashes(data[::-1], len(data) - at - length, len(data) - at)
                    crowded.append((one, two, np.repeat(row[hot] + base, n), at - np.repeat(begin[hot], n)))
                chosen = np.flatnonzero(state == REPEATED)
                raw = data.tobytes()
                for a, b, p, r, o in zip(first[chosen].tolist(), last[chosen].tolist(), owners(chosen).tolist(),
                                         row[chosen].tolist(), begin[chosen].tolist()):
                    string = raw[p:b + length] + raw[a:p][::-1]
                    have = entries.get((string, p - a))
                    if have is None:                # rows and starts ascend, so the first seen is the first
                        entries[string, p - a] = (r + base, a - o, 0)
                    else:
                        removed.append((r + base, a - o, b - o + length))
            if removed:
                add(block % n_buckets, REMOVED, _places(*zip(*removed)))
            if entries:
                strings = sorted(entries)
                head = np.frombuffer(b"".join(s[:gram] for s, _ in strings), np.uint8)
                at = np.arange(len(strings)) * gram
                bucket = hash_range(span_hashes(head, at, at + gram), n_buckets)
                by_bucket = np.argsort(bucket, kind="stable")
                for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
                    mine = [strings[i] for i in part.tolist()]
                    shared, lengths, rests = front_code([s for s, _ in mine])
                    rows, starts, _ = zip(*(entries[s] for s in mine))
                    rows = np.array(rows)
                    add(int(bucket[part[0]]), RUN, _places(ids[rows], rows, starts),
                        packed(np.concatenate((shared, lengths, np.array([n for _, n in mine], np.uint16)))),
                        zstandard.ZstdCompressor(level=1).compress(rests))
            if crowded:
                one, two, rows, starts = (np.concatenate(x) for x in zip(*crowded))
                by_print = np.lexsort((starts, rows, two, one))
                one, two, rows, starts = one[by_print], two[by_print], rows[by_print], starts[by_print]
                again = np.append(False, (one[1:] == one[:-1]) & (two[1:] == two[:-1]))
                if again.any():
                    add(block % n_buckets, REMOVED, _places(rows[again], starts[again], starts[again] + length))
                one, two, rows, starts = one[~again], two[~again], rows[~again], starts[~again]
                cuts = hash_buckets(one, n_buckets)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[b], cuts[b + 1])
                    add(b, WINDOWS, _places(ids[rows[part]], rows[part], starts[part]), b"", packed(np.concatenate((one[part], two[part]))))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int32()),
                         "kind": pa.array(out["kind"], pa.int32()), "place": pa.array(out["place"], pa.binary()),
                         "shape": pa.array(out["shape"], pa.binary()), "data": pa.array(out["data"], pa.binary())})
    return run


def hash_range(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


# ---- 3: merging and matching -----------------------------------------------

def match_group(members: list, length: int, cut) -> None:
    """``members``: (string, bytes before the owner, place) of the segments that
    share a gram, place = (doc_id, block, row, start).  Calls cut(place, from
    window, to window) for the windows that also start earlier."""
    classes: dict[tuple[bytes, int], tuple] = {}
    for string, before, place in members:
        n = len(string) - length
        have = classes.get((string, before))
        if have is None:
            classes[string, before] = place
        elif have < place:
            cut(place, 0, n)
        else:
            cut(have, 0, n)
            classes[string, before] = place
    if len(classes) < 2:
        return
    spread, owner = [], {}
    for (string, before), place in classes.items():
        right = len(string) - before
        text = string[right:][::-1] + string[:right]
        spread.append((text, place))
        for i in range(len(text) - length + 1):
            at = (*place[:3], place[3] + i)
            window = text[i:i + length]
            have = owner.get(window)
            if have is None or at < have:
                owner[window] = at
    for text, place in spread:
        since = None
        for i in range(len(text) - length + 2):
            later = i <= len(text) - length and owner[text[i:i + length]] < (*place[:3], place[3] + i)
            if later and since is None:
                since = i
            elif not later and since is not None:
                cut(place, since, i - 1)
                since = None


def _merge(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        cuts: dict[int, list] = {}
        for block, kind, place in zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["place"]):
            if kind == REMOVED:
                cuts.setdefault(block, []).append(unpacked(place.as_py(), np.int64).reshape(3, -1))
        found: dict[int, list] = {}

        def cut(place, a, b):
            found.setdefault(place[1], []).append((place[2], place[3] + a, place[3] + b + length))

        runs, blocks_of, places, before = [], [], [], []
        prints = []
        for i, kind in enumerate(table["kind"].to_pylist()):
            if kind == REMOVED:
                continue
            block = table["block"][i].as_py()
            place = unpacked(table["place"][i].as_py(), np.int64).reshape(3, -1)
            if kind == RUN:
                shared, lengths, left = unpacked(table["shape"][i].as_py(), np.uint16).reshape(3, -1)
                runs.append(Run(shared, lengths, zstandard.ZstdDecompressor().decompress(table["data"][i].as_py())))
                blocks_of.append(block)
                places.append(place.tolist())
                before.append(left.tolist())
            else:
                prints.append((*unpacked(table["data"][i].as_py(), np.uint64).reshape(2, -1), place[0], np.full(place.shape[1], block), place[1], place[2]))
        group: list = []
        for r, i, string, shared in merge_runs(runs) if runs else ():
            if shared < gram and group:
                if len(group) > 1:
                    match_group(group, length, cut)
                group = []
            ids, rows, starts = places[r]
            group.append((string, before[r][i], (ids[i], blocks_of[r], rows[i], starts[i])))
        if len(group) > 1:
            match_group(group, length, cut)
        for block, ranges in found.items():
            cuts.setdefault(block, []).append(np.array(ranges, np.int64).T)
        if prints:
            one, two, ids, block, rows, starts = (np.concatenate(x) for x in zip(*prints))
            order = np.lexsort((starts, rows, block, ids, two, one))
            again = order[1:][(one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])]
            for b in np.unique(block[again]).tolist():
                mine = again[block[again] == b]
                cuts.setdefault(b, []).append(np.stack((rows[mine], starts[mine], starts[mine] + length)))
        blocks_out = sorted(cuts)
        return pa.table({"block": pa.array(blocks_out, pa.int32()),
                         "cuts": pa.array([packed(np.concatenate(cuts[b], axis=1)) for b in blocks_out], pa.binary())})
    return run


# ---- 4: cutting -------------------------------------------------------------

def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` less the characters of which some byte stays."""
    head = (raw & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    stays = np.bincount(char[~gone], minlength=int(char[-1]) + 1) > 0 if len(raw) else np.zeros(0, bool)
    return gone & ~stays[char] if len(raw) else gone


def _cut(carry: list[str], characters: bool):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        table = sorted_rows(table)
        ranges = [unpacked(c.as_py(), np.int64).reshape(3, -1) for c in found["cuts"]] if len(table) else []
        rows, starts, ends = np.concatenate(ranges, axis=1) if ranges else np.zeros((3, 0), np.int64)
        order = np.argsort(rows, kind="stable")
        rows, starts, ends = rows[order], starts[order], ends[order]
        at = np.searchsorted(rows, np.arange(len(table) + 1))
        size, removed, spans, kept = [], [], [], []
        for r in range(len(table)):
            text = table["text"][r].as_py()
            a, b = at[r], at[r + 1]
            size.append(len(text))
            if a == b:
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, starts[a:b], 1)
            np.add.at(step, ends[a:b], -1)
            gone = np.cumsum(step[:-1]) > 0
            raw = np.frombuffer(text, np.uint8)
            if characters:
                gone = whole_characters(raw, gone)
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[~gone].tobytes())
        return pa.table({"doc_id": table["doc_id"], **{c: table[c] for c in carry}, "n_bytes": pa.array(size, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES,
                   carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(doc_id, carried columns, n_bytes, n_removed, n_spans, kept) of each
    document.  ``characters``: cut whole UTF-8 characters only, so that what is
    kept is valid text."""
    rows, n = blocks(docs, block_bytes, carry)
    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(releasing(_ask(n, length, gram)), ASK_SCHEMA)
    answers = asked.groupBy("bucket").applyInArrow(releasing(_answer(hot)), ANSWER_SCHEMA)
    runs = by_block.cogroup(answers.groupBy("block")).applyInArrow(releasing(_suffix_runs(n, length, gram)), RUN_SCHEMA)
    cuts = runs.groupBy("bucket").applyInArrow(releasing(_merge(length, gram)), CUT_SCHEMA)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(rows.schema[c] for c in carry),
                           *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return by_block.cogroup(cuts.groupBy("block")).applyInArrow(releasing(_cut(list(carry), characters)), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every repeated passage cut out of ``text`` (whole characters
    only) and ``n_chars``, where there is one, counted anew.  All rows stay; a
    null text stays null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    cut = remove_repeats(docs.select("doc_id", "text", rest.alias("rest")), length, block_bytes=block_bytes, carry=("rest",), characters=True)
    text = F.when(~F.col("rest.none"), F.col("kept").cast("string"))
    values = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text,
              **{c: F.col(f"rest.c{i}") for i, c in enumerate(others)}}
    if "n_chars" in values:
        values["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[values[c].alias(c) for c in docs.columns])


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
