"""Merkle manifest, fill-in-middle and line dedup against plain versions, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio.llm import bpe, fill_middle, line_dedup, merkle, training_order

from .conftest import DOCS, ODD


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- 11 ---------------------------------------------------------------------

def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The last node and, per leaf, its path of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i - i % fanout
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fanout])))
            at[leaf] = i // fanout
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        found[s] = climb([plain_leaf(r) for r in by_source[s]], fanout)
    root, tops = climb([found[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(by_source[s], found[s][1]):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            lower = "".join(c.lower() if c.isascii() else c for c in r[4]) if tampered else r[4]
            node = plain_leaf((*r[:4], lower))
            for left, right in path:
                node = H(left, node, right)
            out.append((r[0], plain_leaf(r), found[s][0], root, H(*(x + y for x, y in path)), node, node == root))
    return out


def manifest_of(docs, fanout=16):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = merkle.manifest(docs, fanout=fanout, altered=F.when(tampered, F.translate("text", merkle.UPPER, merkle.LOWER)))
    return [tuple(r) for r in rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def order(rows):
    return sorted(rows, key=repr)


def some_rows():
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "é", "", None, "Z", "single" if i == 7 else "a"]), rnd.choice(["en", None]), i % 9 or None,
             rnd.choice([None, "", "Some Text ÀB %d" % i, "lower only"])) for i in range(400)]
    return rows + [(500, "solo", "en", 1, "Only leaf of its source")]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_is_that_of_the_plain_tree(shipped, fanout):
    rows = some_rows()
    docs = shipped.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = manifest_of(docs, fanout)
    assert order(got) == order(plain_manifest(rows, fanout))
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_paths_prove_each_row(shipped):
    rows = some_rows()[:60]
    docs = shipped.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle.manifest(docs, fanout=4, paths=True).collect():
        node = r.leaf
        for s in r.path:
            node = H(s.left, node, s.right)
        assert node == r.root == r.folded_root and r.verified


def test_sibling_indices(shipped):
    df = shipped.createDataFrame([(0, 5), (3, 5), (4, 5)], "idx long, n long")
    two, four = (merkle.sibling_indices(F.col("idx"), F.col("n"), f).alias(f"f{f}") for f in (2, 4))
    assert [tuple(r) for r in df.select("idx", two, four).orderBy("idx").collect()] == [(0, [1], [1, 2, 3]), (3, [2], [0, 1, 2]), (4, [], [])]


def test_siblings_meet_without_another_exchange(shipped):
    nodes = shipped.createDataFrame([("a", 40, i, "x") for i in range(40)], "tree string, n long, idx long, hash string")
    before = shipped.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shipped.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with merkle.dealt_by_part_of_the_key(shipped):
            plan = merkle.with_siblings(nodes, 16)._jdf.queryExecution().executedPlan().toString()
    finally:
        shipped.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_COL") == 3
    assert shipped.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_manifest_on_odd_rows(odd, nothing, shipped):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in ODD]
    assert order(manifest_of(odd)) == order(plain_manifest(rows, 16))
    assert manifest_of(nothing) == []
    one = shipped.createDataFrame([(1, "T", "en", "s", 1)], DOCS)
    assert manifest_of(one) == plain_manifest([(1, "s", "en", 1, "T")], 16)
    same = shipped.createDataFrame([(1, "T", "en", "s", 1)] * 40, DOCS)
    assert order(manifest_of(same)) == order(plain_manifest([(1, "s", "en", 1, "T")] * 40, 16))


# ---- 9 ----------------------------------------------------------------------

def plain_order(rows, encoding, key, sequence):
    """(doc_id, part, ids) of all sequences, sorted by their permuted numbers."""
    order, out = training_order.Permutation(training_order.DOMAIN, key), []
    for doc, text, start in rows:
        ids = [*encoding.encode_ordinary(text or ""), training_order.END]
        for k in range(0, len(ids), sequence):
            number = (start + k // sequence * training_order.STEP) % training_order.DOMAIN
            out.append((int(order.forward(np.array([number], np.uint64))[0]), doc, k // sequence, ids[k:k + sequence]))
    return sorted(out)


def test_the_order_rests_on_rows_and_key_only(shipped, documents, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    spec, pattern = bpe.vocabulary(public.path("byte_bpe_50k.tiktoken")), public.PATTERN
    docs = documents.select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/three")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    seen = []
    before = shipped.conf.get("spark.sql.files.maxPartitionBytes")
    for n, (name, split) in enumerate([("three", "128m"), ("three", "30k"), ("three", "70k"), ("one", "128m"), ("again", "128m")]):
        shipped.conf.set("spark.sql.files.maxPartitionBytes", split)
        table = docs.repartition(5) if name == "again" else shipped.read.parquet(f"{tmp_path}/{name}")
        path = f"file://{tmp_path}/out{n}"
        got = training_order.materialise(table, path, spec, pattern, sequence=128, shard_bytes=50_000)
        seen.append((sorted(map(tuple, got.select("slot", "doc_id", "part", "shard", "record", "ids_crc32").collect())), training_order.read_slots(path, 0, 10 ** 9).tobytes()))
    shipped.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(s == seen[0] for s in seen)
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()]
    want = plain_order(rows, training_order.encoding(spec, pattern), training_order.KEY, 128)
    assert [(r[1], r[2]) for r in seen[0][0]] == [(w[1], w[2]) for w in want]
    stored = np.frombuffer(seen[0][1], "<u2").reshape(-1, 128)
    assert all(list(row[:len(w[3])]) == w[3] for row, w in zip(stored, want))


# ---- 12 ---------------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check_fim(docs, rows):
    want = [plain_fim(*r) for r in rows]
    got = fill_middle.fill_middle(docs)
    assert order(tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()) == order(want)
    digests = order((r.doc_id, r.output_sha256, r.restored_sha256) for r in got.collect())
    assert digests == order((w[0], H(w[5]), H(t or "")) for w, (_, t) in zip(want, rows))
    assert order(tuple(r) for r in fill_middle.restore(got).collect()) == order((i, t or "") for i, t in rows)
    return want


def test_fill_middle_is_that_of_plain_strings(shipped):
    rnd = random.Random(8)
    alphabet = ["a", "B", "word", " ", "\n", "é", "中", "😀", "<", ">", "P", "S", "M", "<P", "S>", "<M", "1", "\x00", "\r"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 9, 60])))) for i in range(600)]
    want = check_fim(shipped.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_middle_on_odd_rows(odd, nothing):
    check_fim(odd, [(r[0], r[1]) for r in ODD])
    assert fill_middle.fill_middle(nothing).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_middle(odd, sentinels=(b"<<", b"<S", b"<M"))


def test_descriptors_are_cut_and_permuted_without_copies():
    text = b"prefix|middle|suffix"
    table = fill_middle.arranged(text, 7, 14, "spm")
    assert table.pieces == [(1, 3, 3), (0, 14, 6), (1, 0, 3), (0, 0, 7), (1, 6, 3), (0, 7, 7)]
    assert table.bytes() == b"<S>suffix<P>prefix|<M>middle|"
    assert table.digest() == hashlib.sha256(table.bytes()).hexdigest()
    back = fill_middle.restored(table.bytes(), "spm")
    assert back.bytes() == text and len(back.pieces) == 3
    assert fill_middle.inverse([2, 0, 1]) == [1, 2, 0]


# ---- 13 ---------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))
    held = {}
    for i, (doc, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(doc)
    low = float("-inf")
    keeper = {k: max(low if d is None else d for d in docs) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == (low if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_rows():
    rnd = random.Random(4)
    common = ["a line that many of the documents share %02d " % i + "é" * 10 for i in range(12)] + ["short line"]
    rows = []
    for i in range(300):
        lines = [rnd.choice(common) if rnd.random() < 0.3 else "own words %d %d and more of them to be long enough" % (i, j) for j in range(rnd.randint(0, 9))]
        lines = [(rnd.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if rnd.random() < 0.3 else x) + rnd.choice(["", "  ", "\r"])) for x in lines]
        rows.append((i, "\n".join(lines + ["the line of a third of all documents, which is a hot key"] * (i % 3 == 0))))
    rows += [(None, common[0] + "\n" + "x" * 39 + "\n" + "x" * 40)] + [(400 + i, "x" * 39 + "\n" + "X" * 40 + "\n") for i in range(4)]
    return rows + [(404, "x" * 40), (404, "x" * 40)]


@pytest.mark.parametrize("keys,probes", [(100_000, 1_000_000), (2, 1_000_000), (3, 10)])
def test_lines_are_those_of_a_plain_count(shipped, keys, probes):
    rows = line_rows()
    got = line_dedup.drop_common_lines(shipped.createDataFrame(rows, "doc_id long, text string").repartition(5), keys_per_shard=keys, probes=probes)
    want = plain_lines(rows)
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert sum(w[2] for w in want) > 100


def test_line_dedup_on_odd_rows(odd, nothing):
    assert order(tuple(r) for r in line_dedup.drop_common_lines(odd).collect()) == order(plain_lines([(r[0], r[1]) for r in ODD]))
    every = line_dedup.drop_common_lines(odd, min_chars=1, min_docs=1).collect()
    assert order(tuple(r) for r in every) == order(plain_lines([(r[0], r[1]) for r in ODD], 1, 1))
    assert line_dedup.drop_common_lines(nothing).collect() == []


def test_a_repeated_null_id_keeps_its_lines(shipped):
    rows = [(None, "the same line in all documents without an id, five of them")] * 5
    got = line_dedup.drop_common_lines(shipped.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(None, 1, 0, rows[0][1])] * 5


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    index = line_dedup.PerfectHash.build(keys)
    assert sorted(index.numbers(keys)) == list(range(len(keys))) and len(index) == len(keys)
    assert len(index.words) * 64 <= 5 * len(keys) + 64 * 40


def test_arrays_tell_alike_hashes_apart():
    h = np.array([5, 7, 9, 11], np.uint64)
    fp = np.array([1, 2, 3, 4], np.uint64)
    fp[1] = line_dedup._joined(h[:1], fp[:1])[0] - line_dedup.mix(h[1:2])[0]            # collides with the first in 64 bits
    n = np.arange(4, dtype=np.int64)
    arrays = line_dedup.LineArrays.load(line_dedup.LineArrays.build(h, fp, n, n * 10, np.zeros(4, np.uint8)).blobs())
    found = arrays.find(h, fp)
    assert sorted(found) == [0, 1, 2, 3] and list(arrays.counts[found]) == [0, 1, 2, 3] and list(arrays.keepers[found]) == [0, 10, 20, 30]
    assert list(arrays.find(h, fp + np.uint64(1))) == [-1] * 4
