"""Exact, deterministic, partition-independent sampling and ranking.

Spark only offers Bernoulli ``sample`` and ``limit``; the curation work needs
exact counts ("n rows", "down-sample each class to the smallest", "first
int(n * 0.9) rows of a shuffle").  All of that is one primitive here:

    rank of a row inside its group, ordered by ``md5(seed | key)``

computed without ever putting a whole group into one task:

1. from the key columns alone, count rows per (group, first ``digits`` hex
   digits of the hash) -- a map-side-combined aggregate of at most
   groups x 16**digits rows; a running sum gives each bucket's offset;
2. only the bucket that a threshold (such as n) falls into is ranked, again
   from key columns alone; its row at the threshold is the group's *cut*;
3. one scan of the whole rows compares each row's (hash, key) with its group's
   cut.  Whole rows are never ranked, sorted or read twice.

Groups are matched null-safely, so rows with a null group key form a group like
any other.  Everything is one lazy plan: no job runs while it is built, nothing
is cached, and the joins with the small tables are left to Spark's own size
checks.  ``exact_all=True`` ranks every row (dense row ids, full shuffles).

Keys name a row.  Rows that agree in all keys stay or go together.

The same rank expressed in SQL is ``row_number() over (partition by group
order by md5(...), key)``, which is the DuckDB oracle of every operator here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatio.functions.hashing import draw, hkey

DEFAULT_SEED = 42
DEFAULT_DIGITS = 4           # 65,536 buckets a group: 10**11 rows leave 1.5 million keys in the one that is ranked


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which a null matches a null."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(renamed, cond, how).drop(*[f"_on_{c}" for c in on])


def _hashed(df: DataFrame, keys: list[str], seed, digits: int) -> DataFrame:
    return df.withColumn("_h", hkey(seed, *keys)).withColumn("_b", F.substring("_h", 1, digits))


def bucket_counts(keys_only: DataFrame, by: list[str]) -> DataFrame:
    """Per (group, bucket): rows ``_n``, offset ``_before``, group size ``_total``."""
    counts = keys_only.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (counts
            .withColumn("_before", F.coalesce(F.sum("_n").over(w_run), F.lit(0)).cast("long"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)).cast("long")))


HOT_ROWS = 10_000                 # a group with more rows is brought to them by broadcast


def _meet_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Hashed rows with the row of their group, of which ``_total`` is the size.

    Groups of more than ``HOT_ROWS`` rows, at most one in ``HOT_ROWS`` of all
    rows, are broadcast; a row that finds its group there is spread by its own
    hash over the second join, which brings the others to their groups.  So few
    groups do not gather all rows in as few tasks."""
    values = F.struct(*[c for c in groups.columns if c not in by])
    hot = groups.where(F.col("_total") > HOT_ROWS).select(*by, values.alias("_hot"))
    first = null_safe_join(rows, F.broadcast(hot), by, "left")
    first = first.withColumn("_stage", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64("_h", F.lit(1))))
    cold = groups.where(F.col("_total") <= HOT_ROWS).select(*by, F.lit(0).cast("long").alias("_stage"), values.alias("_cold"))
    met = null_safe_join(first, cold, by + ["_stage"], "left")
    return met.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_group")).select(*rows.columns, "_group.*")


def rank_cut(df: DataFrame, keys, seed=DEFAULT_SEED, by=(),
             thresholds: Callable[[DataFrame], DataFrame] | None = None,
             exact_all: bool = False, digits: int = DEFAULT_DIGITS) -> DataFrame:
    """Add ``_rank``, the group size ``_total`` and the threshold columns (named
    ``_t*``) that the ``thresholds`` callback adds to the per-bucket count table.

    With ``exact_all``, ``_rank`` is the 1-based position by (hash, key) inside
    the ``by`` group.  Otherwise it is a stand-in with the same result in every
    comparison ``_rank <= _t*``: the smallest threshold that the row is within.
    """
    by, keys = _names(by), _names(keys)
    slim = _hashed(df.select(*dict.fromkeys(by + keys)), keys, seed, digits)
    counts = bucket_counts(slim, by)
    if exact_all:
        w = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
        joined = null_safe_join(_hashed(df, keys, seed, digits), counts.drop("_n"), by + ["_b"])
        return joined.withColumn("_rank", (F.col("_before") + F.row_number().over(w)).cast("long"))
    counts = thresholds(counts)
    tcols = [c for c in counts.columns if c.startswith("_t") and c != "_total"]
    # the last bucket wholly within each threshold, and the bucket that it cuts
    groups = counts.groupBy(*by).agg(
        F.max("_total").alias("_total"), *[F.max(t).alias(t) for t in tcols],
        *[F.max(F.when(F.col("_before") + F.col("_n") <= F.col(t), F.col("_b"))).alias(f"_full{t}") for t in tcols])
    marks = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(t) - F.col("_before")).cast("long").alias("at"))
                               for i, t in enumerate(tcols)]), lambda m: (m["at"] > 0) & (m["at"] < F.col("_n")))
    inside = counts.select(*by, "_b", marks.alias("_marks")).where(F.size("_marks") > 0)
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *keys))
    found = null_safe_join(slim, inside, by + ["_b"]).withColumn("_place", place)
    cut = F.struct("_h", *[F.col(k) for k in keys])
    found = found.select(*by, cut.alias("_cut"), F.explode(F.filter("_marks", lambda m: m["at"] == F.col("_place"))).alias("_m"))
    cuts = found.groupBy(*by).agg(*[F.max(F.when(F.col("_m.i") == i, F.col("_cut"))).alias(f"_cut{t}") for i, t in enumerate(tcols)])
    rows = _hashed(df, keys, seed, digits)
    if by:
        rows = _meet_groups(rows, null_safe_join(groups, cuts, by, "left"), by)
    else:                       # one row each
        rows = (rows.withColumn("_g", groups.select(F.struct("*")).scalar()).withColumn("_c", cuts.select(F.struct("*")).scalar())
                .select("*", "_g.*", "_c.*").drop("_g", "_c"))
    within = [F.when(F.coalesce(F.col("_b") <= F.col(f"_full{t}"), F.lit(False)) | F.coalesce(cut <= F.col(f"_cut{t}"), F.lit(False)),
                     F.col(t)) for t in tcols]
    least = F.least(*within) if len(within) > 1 else within[0]
    beyond = (F.greatest(*tcols) if len(tcols) > 1 else F.col(tcols[0])) + 1
    return rows.withColumn("_rank", F.coalesce(least, beyond).cast("long")).select(*df.columns, "_rank", "_total", *tcols)


def drop_helpers(df: DataFrame, extra=()) -> DataFrame:
    cols = [c for c in df.columns if c in ("_h", "_b", "_before", "_total", "_rank") or c in extra or c.startswith("_t")]
    return df.drop(*cols)


# --------------------------------------------------------------------------- R1, W1, W3

def shuffle_rank(df: DataFrame, keys, seed=DEFAULT_SEED, by=(), name="rank",
                 digits=DEFAULT_DIGITS) -> DataFrame:
    """Dense 1-based position of every row in a seeded permutation
    (inside each ``by`` group).  Writing ``orderBy(name)`` gives the shuffled
    table; the column itself is the stable row id the reference took from the
    pandas index."""
    out = rank_cut(df, keys, seed, by, exact_all=True, digits=digits)
    return drop_helpers(out.withColumnRenamed("_rank", name))


def write_shuffled(df: DataFrame, keys, path: str, seed=DEFAULT_SEED, rows_per_file: int = 1_000_000,
                   digits=DEFAULT_DIGITS) -> None:
    """R1 on disk: the permutation itself, as files of ``rows_per_file`` rows
    (the last one fewer) that hold consecutive ranks in order.

    The ranks come from exact offsets of hash buckets; a file is one task's
    output, ``<path>/data/file=<n>``.  The manifest (file, n_rows, first_rank,
    last_rank) is written last: a folder without one is not whole.  Reading the
    files in order, each from its start, gives the ranks 1, 2, ..."""
    ranked = shuffle_rank(df, keys, seed, name="rank", digits=digits)
    ranked = ranked.withColumn("file", F.floor((F.col("rank") - 1) / rows_per_file).cast("long"))
    (ranked.repartition("file").sortWithinPartitions("file", "rank")
     .write.option("maxRecordsPerFile", 0).partitionBy("file").parquet(f"{path}/data"))
    data = df.sparkSession.read.schema(ranked.schema).parquet(f"{path}/data")
    (data.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
     .write.parquet(f"{path}/manifest"))


def read_shuffled(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """The rows with ranks ``first`` to ``last`` of a written shuffle; only the
    files that hold them are read.  Fails if the manifest is missing."""
    manifest = spark.read.parquet(f"{path}/manifest")
    wanted = manifest.where(F.col("last_rank") >= first)
    if last is not None:
        wanted = wanted.where(F.col("first_rank") <= last)
    files = wanted.agg(F.min("file").alias("lo"), F.max("file").alias("hi")).first()
    rows = spark.read.parquet(f"{path}/data")
    if files["lo"] is None:
        return rows.limit(0)
    rows = rows.where(F.col("file").between(files["lo"], files["hi"])).where(F.col("rank") >= first)
    return rows if last is None else rows.where(F.col("rank") <= last)


def in_order(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Dense 1-based places of all rows in the order of the expressions
    ``order``, by one range exchange of the whole rows.

    Spark takes the bounds of the ranges from a sample of the whole sort keys,
    however long they are, so a table whose texts share a prefix splits as
    evenly as any other, and keys that end in a hash split a hot value too.  The
    sorted ranges are written with each row's place in its range; the counts per
    range, one row each, give the offsets, so no window and no further exchange
    sees the rows.  The written table fixes the ranges: a retried task cannot
    change a place."""
    from curatio.session import materialized
    at = F.monotonically_increasing_id()        # (range, place in the range) of a sorted partition
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*df.columns, at.alias("_at"))
    placed = materialized(placed, "in-order").withColumn("_range", F.shiftright("_at", 33))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy("_range").agg((F.max(place) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    # one row of two numbers per partition of the exchange
    return placed.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_before") + place + 1).cast("long").alias(name))


def _code(df: DataFrame, c: str) -> Column:
    """A number that never falls where the column's order rises."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.col(c).cast("timestamp").cast("double")
    return F.col(c).cast("double")


def row_id(df: DataFrame, order_col: str, name: str = "row_id", tiebreak=(),
           n_buckets: int = 1024, accuracy: int = 10_000) -> DataFrame:
    """W1 with an explicit order: dense 1-based id by ``order_col`` (nulls
    first; ties by the hash of ``tiebreak``, or of the whole row), without a
    single-partition window.

    Texts are placed by :func:`in_order`, whose ranges are cut at whole keys.
    For numbers and dates, approximate quantiles of the column, an aggregate
    inside the plan, give ordered range buckets; a value that is itself a quantile has a bucket of
    its own, which is split by the tie hash if it holds one value only, so that
    a hot value is spread as well.  Counts per bucket give offsets; the place
    within a bucket is a window over one bucket; nothing runs while the plan is
    built.
    """
    ties = _names(tiebreak) or df.columns
    if isinstance(df.schema[order_col].dataType, T.StringType):
        tie = hkey("tie", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ties])
        return in_order(df, [F.col(order_col), tie, *[F.col(c) for c in ties]], name)
    rows = df.withColumn("_h", hkey("tie", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ties])).withColumn("_code", _code(df, order_col))
    quantiles = F.percentile_approx("_code", F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)]), accuracy)
    cuts = df.select(_code(df, order_col).alias("_code")).agg(F.sort_array(F.array_distinct(F.coalesce(quantiles, F.array().cast("array<double>")))).alias("c"))
    # number of cuts below the code: first among every side-th cut, then within one side
    side = 1 << ((n_buckets - 1).bit_length() + 1) // 2
    heads = F.transform(F.sequence(F.lit(0), F.lit(n_buckets // side)), lambda i: F.get("c", i * side))
    below = lambda array: F.size(F.filter(array, lambda c: c < F.col("_code")))
    rows = (rows.withColumn("_cuts", cuts.scalar()).withColumn("_heads", cuts.select(heads).scalar())
            .withColumn("_block", F.greatest(below("_heads") - 1, F.lit(0)))
            .withColumn("_lo", F.col("_block") * side + below(F.slice("_cuts", F.col("_block") * side + 1, side))))
    own = F.coalesce(F.get("_cuts", F.col("_lo")) == F.col("_code"), F.lit(False))
    rows = (rows.withColumn("_bucket", F.when(F.col("_code").isNull(), -1).otherwise(2 * F.col("_lo") + own.cast("int")))
            .withColumn("_part", F.substring("_h", 1, 2)).drop("_cuts", "_heads", "_block", "_lo"))
    whole = Window.partitionBy("_bucket")
    running = Window.orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (rows.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(order_col).alias("_min"), F.max(order_col).alias("_max"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
              .withColumn("_one", F.coalesce(F.min("_min").over(whole) == F.max("_max").over(whole), F.lit(True)))
              .withColumn("_before", F.when(F.col("_one"), F.col("_before")).otherwise(F.min("_before").over(whole)))
              .select("_bucket", "_part", "_before", "_one"))
    joined = rows.join(counts, ["_bucket", "_part"]).withColumn("_part", F.when(F.col("_one"), F.col("_part")).otherwise(""))
    place = F.row_number().over(Window.partitionBy("_bucket", "_part").orderBy(order_col, "_h", *ties))
    return joined.withColumn(name, (F.col("_before") + place).cast("long")).select(*df.columns, name)


def first_half(df: DataFrame, order_col: str, tiebreak=(), n_buckets: int = 1024
               ) -> tuple[DataFrame, DataFrame]:
    """First ``n // 2`` rows by ``order_col`` and the rest."""
    half = df.agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("half"))
    ranked = row_id(df, order_col, "_pos", tiebreak, n_buckets).withColumn("_half", half.scalar())
    return (ranked.where(F.col("_pos") <= F.col("_half")).drop("_pos", "_half"),
            ranked.where(F.col("_pos") > F.col("_half")).drop("_pos", "_half"))


def first_occurrence_id(df: DataFrame, value_col: str, pos_col: str, name: str = "qid") -> DataFrame:
    """Id of a value = smallest position at which it occurs.

    groupBy + join rather than a window: the partial aggregate combines
    map-side, and AQE's skew-join splits a hot value on the big side.
    """
    firsts = df.groupBy(value_col).agg(F.min(pos_col).alias(name))
    return df.join(firsts, value_col)


# --------------------------------------------------------------------------- R2, R3, R4, R8

def sample_n(df: DataFrame, n: int, keys, seed=DEFAULT_SEED, by=(), digits=DEFAULT_DIGITS) -> DataFrame:
    """Exactly ``min(n, group size)`` rows without replacement per group."""
    out = rank_cut(df, keys, seed, by, lambda c: c.withColumn("_t0", F.lit(int(n)).cast("long")),
                   digits=digits)
    return drop_helpers(out.where(F.col("_rank") <= F.col("_t0")))


cap_rows = sample_n


def split_fraction(df: DataFrame, frac: float, keys, seed=DEFAULT_SEED, by=(),
                   names=("train", "test"), col="split", digits=DEFAULT_DIGITS) -> DataFrame:
    """R2: the first ``int(n * frac)`` rows of the seeded shuffle (per group)
    are ``names[0]``, the rest ``names[1]``."""
    def th(c):
        return c.withColumn("_t0", F.floor(F.col("_total").cast("double") * F.lit(float(frac))).cast("long"))
    out = rank_cut(df, keys, seed, by, th, digits=digits)
    out = out.withColumn(col, F.when(F.col("_rank") <= F.col("_t0"), F.lit(names[0]))
                         .otherwise(F.lit(names[1])))
    return drop_helpers(out)


def split_train_valid_test(df: DataFrame, train_valid: float, valid_test: float | None, keys,
                           seed=DEFAULT_SEED, col="split", digits=DEFAULT_DIGITS) -> DataFrame:
    """train/validation split by ``train_valid`` (fraction held out for
    validation, must be in (0, 1)); then ``valid_test`` of the validation part
    becomes test.  ``valid_test == 0`` turns all validation rows into test;
    other values outside (0, 1) leave validation as is.

    All cuts are taken on one permutation, so the three parts are disjoint and
    nested exactly like two successive shuffled splits.
    """
    if not (0 < train_valid < 1):
        raise ValueError("train_valid must lie in (0, 1)")
    vt = valid_test

    def th(c):
        n_valid = (F.col("_total") - F.floor(F.col("_total").cast("double") * F.lit(1.0 - train_valid))).cast("long")
        c = c.withColumn("_t0", (F.col("_total") - n_valid).cast("long"))
        if vt is not None and 0 < vt < 1:
            n_test = (n_valid - F.floor(n_valid.cast("double") * F.lit(1.0 - vt))).cast("long")
            c = c.withColumn("_t1", (F.col("_total") - n_test).cast("long"))
        return c

    out = rank_cut(df, keys, seed, (), th, digits=digits)
    if vt == 0:
        label = F.when(F.col("_rank") <= F.col("_t0"), "train").otherwise("test")
    elif vt is not None and 0 < vt < 1:
        label = (F.when(F.col("_rank") <= F.col("_t0"), "train")
                 .when(F.col("_rank") <= F.col("_t1"), "validation").otherwise("test"))
    else:
        label = F.when(F.col("_rank") <= F.col("_t0"), "train").otherwise("validation")
    return drop_helpers(out.withColumn(col, label))


# --------------------------------------------------------------------------- R6, R7, R13

def balance_classes(df: DataFrame, label: str, keys, seed=DEFAULT_SEED, group_by=(),
                    digits=DEFAULT_DIGITS) -> DataFrame:
    """Down-sample every class to the size of the smallest class (inside
    each ``group_by`` group).  Exact, and identical for any partitioning."""
    group_by = _names(group_by)

    def th(c):
        return c.withColumn("_t0", F.min("_total").over(Window.partitionBy(*group_by)))
    out = rank_cut(df, keys, seed, group_by + [label], th, digits=digits)
    return drop_helpers(out.where(F.col("_rank") <= F.col("_t0")))


def match_class_size(df: DataFrame, members: Column, keys, seed=DEFAULT_SEED, col="class",
                     digits=DEFAULT_DIGITS) -> DataFrame:
    """``members`` is an array of class names per row (a row may belong to
    several, as with overlapping substring tests); every class is cut to the
    size of the smallest one."""
    exploded = df.withColumn(col, F.explode(F.filter(members, lambda x: x.isNotNull())))
    return balance_classes(exploded, col, list(_names(keys)) + [col], seed, digits=digits)


def learning_curve_subsets(df: DataFrame, sizes: Sequence[int], keys, seed=DEFAULT_SEED,
                           col="subset_size", digits=DEFAULT_DIGITS) -> DataFrame:
    """Nested subsets of one permutation; a row is in every subset whose
    size is at least its rank.  Generated per row, no join."""
    sizes = sorted(int(s) for s in sizes)

    def th(c):
        for i, s in enumerate(sizes):
            c = c.withColumn(f"_t{i}", F.lit(s).cast("long"))
        return c
    out = rank_cut(df, keys, seed, (), th, digits=digits)
    arr = F.array(*[F.lit(s).cast("long") for s in sizes])
    out = out.withColumn(col, F.explode(F.filter(arr, lambda s: s >= F.col("_rank"))))
    return drop_helpers(out)


# --------------------------------------------------------------------------- R5, R9, R10

DRAW_BINS = 1 << 16


def _draw_rows(draws: DataFrame, df: DataFrame, keys, seed, digits) -> DataFrame:
    """``draws`` (with a draw number ``_draw``) joined to the pool row at
    permutation position ``_draw % N + 1``; an empty pool gives no rows.

    The permutation is located, not built: from key columns alone come the
    counts and offsets of its hash buckets; equal bins of positions lead a draw
    to its bucket by an equi-join (a bucket overlaps few bins); and only the
    rows of buckets that are drawn from are exchanged, once, and ranked."""
    keys = _names(keys)
    buckets = bucket_counts(_hashed(df.select(*keys), keys, seed, digits), [])
    size = df.agg(F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.ceil(F.col("_total") / DRAW_BINS), F.lit(1))
    bins = F.sequence(F.floor(F.col("_before") / width), F.floor((F.col("_before") + F.col("_n") - 1) / width))
    directory = buckets.select("_b", "_n", "_before", F.explode(bins).alias("_bin"))
    at = draws.withColumn("_total", size.scalar())
    at = at.withColumn("_pos", F.when(F.col("_total") > 0, F.col("_draw") % F.col("_total")).cast("long"))
    at = (at.withColumn("_bin", F.floor(F.col("_pos") / width)).join(directory, "_bin")
          .where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_n")))
          .withColumn("_place", F.col("_pos") - F.col("_before") + 1).drop("_draw", "_total", "_pos", "_bin", "_n", "_before"))
    pool = _hashed(df, keys, seed, digits).join(at.select("_b").distinct(), "_b", "left_semi")
    pool = pool.withColumn("_place", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys)).cast("long")).drop("_h")
    return at.join(pool, ["_b", "_place"]).drop("_b", "_place")


def sample_with_replacement(spark: SparkSession, df: DataFrame, n: int, keys, seed=DEFAULT_SEED,
                            draw_col="draw_id", digits=DEFAULT_DIGITS) -> DataFrame:
    """``n`` rows drawn with replacement.  Draw ``i`` (0-based) picks the row
    at permutation position ``draw(seed, i) % N + 1``.  The draws are uniform
    over positions, so the join is not skewed."""
    draws = spark.range(max(0, int(n))).withColumnRenamed("id", draw_col).withColumn("_draw", draw(seed, draw_col))
    return _draw_rows(draws, df, keys, seed, digits)


def mix_in(df: DataFrame, other: DataFrame, n_other: int, keys, seed=DEFAULT_SEED,
           digits=DEFAULT_DIGITS) -> DataFrame:
    """Append ``n_other`` rows of ``other`` (all rows when it has fewer);
    columns missing on either side become null."""
    return df.unionByName(sample_n(other, n_other, keys, seed, digits=digits),
                          allowMissingColumns=True)


def ratio_counts(n: int, ratios: Sequence[float]) -> list[tuple[float, int]]:
    """R10 sizes: ``int(r / (1 - r) * n)`` extra rows for each ratio."""
    return [(float(r), int(r / (1 - r) * n)) for r in ratios]


def ratio_mix(spark: SparkSession, df: DataFrame, adv: DataFrame, ratios: Sequence[float], adv_keys,
              seed=DEFAULT_SEED, digits=DEFAULT_DIGITS, n: int | None = None) -> DataFrame:
    """For each ratio r, the whole of ``df`` plus ``int(r/(1-r)*len(df))``
    rows of ``adv`` drawn with replacement; tagged with ``ratio``.  The pool is
    ranked once and all ratios' draws meet it in one join.  Without ``n`` the
    base is counted, the one job that runs here."""
    n = df.count() if n is None else n
    base = df.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    draws = None
    for r, m in ratio_counts(n, ratios):
        part = spark.range(m).select(F.lit(r).alias("ratio"), draw(f"{seed}:{r}", "id").alias("_draw"))
        draws = part if draws is None else draws.unionAll(part)
    return base.unionByName(_draw_rows(draws, adv, adv_keys, seed, digits), allowMissingColumns=True)
