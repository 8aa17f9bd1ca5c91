"""Merkle dataset manifest by sibling-shift self-joins.

A leaf is H (lowercase hexadecimal sha256) over the chosen columns of a row, each
``-`` if null, else its UTF-8 byte count, ``:`` and its value.  Per tree (here: per
source) the leaves ascend by id; while a level has several nodes, every
``fanout`` consecutive ones (the last run: fewer, even one) become one node, H of
their digests as text.  What remains is the subroot; the subroots, by source
(null first, bytewise), form one further tree, whose last node is the root.

*Numbering.*  Leaves are range-partitioned by (source, id, leaf), sorted, numbered
and written; the counts per (part, source) give the offsets.  No task orders a whole source, however large.

*Levels.*  A level is a table (tree, n, idx, hash), n being its number of nodes.
Each node computes the indices of its siblings (for two, idx XOR 1; otherwise
the other slots of its run, by offset) and meets them in an equijoin of the level
with itself.  Both sides are the same rows dealt by (tree, run); the planner is
told, while the manifest is built, that this deals the join's longer key too, so
that neither the join nor the grouping exchanges the 15 rows of a node, and a hot
source is spread over its runs.  Upwards only the rows in slot zero ask; they
emit the parents.  Each level is written to the shared folder, which cuts the
lineage.

*Proofs.*  From the root downwards a node's path is its own pair of texts (the
digests of the siblings left and right of it) before its parent's path, by one
equijoin of each level with the next.  A path has one pair per level, at most
(fanout - 1) * 64 bytes each, so its size grows with the logarithm of the table.

Null ids come first, equal ids in the order of their leaves; equal rows get
neighbouring places and equal leaves.  Null and empty texts differ (``-`` and
``0:``).  A lone leaf is its subroot.  An empty table gives an empty result.
Other columns are not read.  A null id is never among the tampered rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio.llm.catalog import register
from curatio.llm.common import read, written

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_name(value: Column) -> Column:
    """A text that orders as ``value`` does bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


# ---- numbering ---------------------------------------------------------------

def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``tree``) and (n, idx): the number of rows of the tree and
    the place of the row among them in the given order."""
    at = F.monotonically_increasing_id()            # (part, place in the part) of a sorted part
    sorted_ = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = written(sorted_.select("*", at.alias("at")), "merkle-places").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", "tree").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("held"))
    starts = counts.selectExpr("part", "tree", "start", "sum(held) OVER (PARTITION BY tree ORDER BY part) - held AS before",
                               "sum(held) OVER (PARTITION BY tree) AS n")       # a row per part of a tree
    starts = written(starts, "merkle-starts")       # as files it does not make the join deal whole trees
    return placed.join(starts, ["part", "tree"]).select(*rows.columns, "n", (F.col("before") + F.col("at") - F.col("start")).alias("idx"))


@contextmanager
def dealt_by_part_of_the_key(spark):
    """Lets a join use sides that are dealt alike by some of its keys.  The
    setting is put back; whatever relies on it is planned and run inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---- levels ------------------------------------------------------------------

def sibling_indices(idx: Column, n: Column, fanout: int) -> Column:
    """The indices of the other nodes of a node's run: idx XOR 1 for two, else the
    run's slots at the offsets 1 .. fanout - 1 from the node's own."""
    if fanout == 2:
        found = F.array(idx.bitwiseXOR(F.lit(1)))
    else:
        run = idx - idx % fanout
        found = F.transform(F.array(*(F.lit(s) for s in range(1, fanout))), lambda s: run + (idx + s) % fanout)
    return F.filter(found, lambda i: i < n)


def with_siblings(nodes: DataFrame, fanout: int, slot_zero: bool = False) -> DataFrame:
    """``nodes`` with ``run`` and the digests of the siblings before (``left``)
    and after (``right``); with ``slot_zero`` only the first node of each run."""
    dealt = nodes.withColumn("run", F.expr(f"idx DIV {fanout}")).repartition("tree", "run")
    askers = dealt.where(F.col("idx") % fanout == 0) if slot_zero else dealt
    asked = askers.select("tree", "run", "idx", F.explode(sibling_indices(F.col("idx"), F.col("n"), fanout)).alias("sibling"))
    found = dealt.select("tree", "run", F.col("idx").alias("sibling"), F.col("hash").alias("sibling_hash"))

    def side(test):
        each = F.collect_list(F.when(test, F.struct("sibling", "sibling_hash")))
        return F.concat_ws("", F.transform(F.array_sort(each), lambda s: s["sibling_hash"]))
    met = (asked.join(found, ["tree", "run", "sibling"]).groupBy("tree", "run", "idx")
           .agg(side(F.col("sibling") < F.col("idx")).alias("left"), side(F.col("sibling") > F.col("idx")).alias("right")))
    return (askers.join(met, ["tree", "run", "idx"], "left")
            .withColumns({"left": F.coalesce("left", F.lit("")), "right": F.coalesce("right", F.lit(""))}))


def build_levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels, leaves first; the driver sees the largest tree's size only."""
    levels = [leaves]
    n = leaves.agg(F.max("n")).first()[0] or 1
    while n > 1:
        parents = with_siblings(levels[-1].where("n > 1"), fanout, slot_zero=True).select(
            "tree", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("run").alias("idx"),
            digest(F.col("hash"), F.col("right")).alias("hash"))
        levels.append(written(parents, "merkle-level"))
        n = -(-n // fanout)
    return levels


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the node that remains of each tree."""
    out = None
    for level in levels:
        lone = level.where("n = 1").select("tree", "hash")
        out = lone if out is None else out.unionAll(lone)
    return out


def with_paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with ``path``, one (left, right) per level up to the node that
    remains, followed by the path that ``tops`` has for the tree, and the other
    columns of ``tops`` (tree, path, ...)."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for height, level in reversed(list(enumerate(levels))):
        own = level.columns if height == 0 else ["tree", "idx"]
        keep = [c for c in own if c not in ("tree", "idx", "n")]
        lone = level.where("n = 1").join(tops, "tree").select("tree", "idx", *keep, "path", *more)
        if above is not None:
            up = above.withColumnRenamed("idx", "run").withColumnRenamed("path", "up")
            pair = F.array(F.struct("left", "right"))
            lone = lone.unionAll(with_siblings(level.where("n > 1"), fanout)
                                 .select("tree", "run", "idx", *keep, pair.alias("pair")).join(up.select("tree", "run", "up", *more), ["tree", "run"])
                                 .select("tree", "idx", *keep, F.concat("pair", "up").alias("path"), *more))
        above = written(lone, "merkle-paths") if height else lone
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level upwards, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def manifest(docs: DataFrame, columns=COLUMNS, tree: str = "source", order: str = "doc_id", fanout: int = FANOUT,
             altered: Column | None = None, paths: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row
    and, with ``paths``, the siblings themselves: path array<struct<left, right>>.

    ``altered``: the value of the last of ``columns`` in a tampered copy, or null
    where the copy is the row itself.  ``folded_root`` is what the copy's leaf
    and the original siblings give; ``verified`` tells whether it is the root."""
    *before, last = [F.col(c) for c in columns]
    heads = [field(c) for c in before]
    leaf = digest(*heads, field(last))
    other = leaf if altered is None else F.when(altered.isNotNull(), digest(*heads, field(altered))).otherwise(leaf)
    with dealt_by_part_of_the_key(docs.sparkSession):
        rows = written(docs.select(F.col(order).alias("id"), tree_name(F.col(tree)).alias("tree"), leaf.alias("hash"),
                                   other.alias("altered_leaf")), "merkle-leaves")
        levels = build_levels(written(numbered(rows, "id", "hash"), "merkle-level"), fanout)

        subroots = written(last_nodes(levels), "merkle-subroots").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
        upper = build_levels(written(numbered(subroots, "name"), "merkle-level"), fanout)
        root = last_nodes(upper).select("tree", F.col("hash").alias("root"),
                                        F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        tops = with_paths(upper, root, fanout).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
        found = with_paths(levels, written(tops, "merkle-tops"), fanout)
        path = F.col("path")
        out = found.select("id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(path).alias("proof_sha256"),
                           fold(F.col("altered_leaf"), path).alias("folded_root"), *([path] if paths else []))
        return written(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")


def _climb(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT 0 AS level, tree, idx, n, h FROM {leaves} UNION ALL
        SELECT level + 1, tree, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx))
        FROM {name} WHERE n > 1 GROUP BY level, tree, idx // {FANOUT}, n)"""


def _sides(name: str, nodes: str) -> str:
    return f"""{name} AS (SELECT a.level, a.tree, a.idx, any_value(a.n) AS n, any_value(a.h) AS h,
        coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
        FROM {nodes} a JOIN {nodes} b ON a.level = b.level AND a.tree = b.tree AND a.idx // {FANOUT} = b.idx // {FANOUT}
        GROUP BY a.level, a.tree, a.idx)"""


def _walk(name: str, start: str, sides: str) -> str:
    return f"""{name} AS ({start} UNION ALL
        SELECT w.rid, w.tree, s.level + 1, s.idx // {FANOUT}, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
        FROM {name} w JOIN {sides} s ON w.tree = s.tree AND w.level = s.level AND w.idx = s.idx WHERE s.n > 1)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(c) for c in COLUMNS[:-1])
ORACLE = f"""
WITH RECURSIVE
table_ AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)),
             lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
crc AS (SELECT *, row_number() OVER () AS rid, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS crc FROM documents, table_),
leaf AS (SELECT rid, doc_id, coalesce('+' || source, '') AS tree, sha256({_HEAD} || {_field('text')}) AS h,
             CASE WHEN crc % 5 = 0 THEN sha256({_HEAD} || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS other FROM crc),
first AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
{_climb('up', 'first')},
sub AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
{_climb('up2', 'sub')},
{_sides('side', 'up')},
{_sides('side2', 'up2')},
{_walk('walk', "SELECT rid, tree, 0 AS level, idx, coalesce(other, h) AS node, '' AS proof FROM first", 'side')},
top AS (SELECT w.rid, w.tree AS name, w.node, w.proof FROM walk w JOIN up u ON w.tree = u.tree AND w.level = u.level AND w.idx = u.idx AND u.n = 1),
{_walk('walk2', "SELECT rid, '' AS tree, 0 AS level, idx, node, proof FROM top JOIN sub USING (name)", 'side2')},
done AS (SELECT w.rid, w.node, w.proof, u.h AS root FROM walk2 w JOIN up2 u ON w.level = u.level AND w.idx = u.idx AND u.n = 1)
SELECT doc_id, first.h AS leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM first JOIN done USING (rid) JOIN sub ON sub.name = first.tree
"""


@register("op11_merkle", ORACLE)
def op11_merkle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = manifest(docs, altered=F.when(tampered, F.translate("text", UPPER, LOWER)))
    return rows.withColumnRenamed("id", "doc_id")
