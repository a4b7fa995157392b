"""Order, position, sharding and splitting (WN1, OS1-OS4, SH1-SH2, SO1).

Global position is never a window over the whole table (that pulls every row
into one task). It is computed in two phases:

1. range-partition and sort by the order key, tag each row with its partition
   and its ``monotonically_increasing_id`` (partition << 33 | row), and
   checkpoint to the shared folder so that the partitioning cannot change
   between phases (and survives executor loss);
2. count rows per partition (one row per partition, collected), turn the counts
   into running offsets, and add them through a broadcast of that table, whose
   size is the partition count.

Per-group position works on the same globally sorted data: the start of a
group inside a partition is a window over (partition, group), and a group
that runs across a partition boundary takes its start from a table with at
most one row per partition. A hot group is therefore split over many tasks.

Running sums use ranges of equal share (see ``ranges``); positions of rows read
from files need no shuffle at all (see ``sources.files``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import scratch_path, shared_dir

_ROW_BITS = 33
# Tables built on the driver (offsets, carried starts) are broadcast only up
# to this many rows; a larger one is joined like any other table.
_BROADCAST_MAX_ROWS = 1_000_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= _BROADCAST_MAX_ROWS else table


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sorted_checkpoint(df: DataFrame, order_by, partitions: int | None = None) -> DataFrame:
    """Range-partition + sort by ``order_by``, tag (_pid, _mid), checkpoint.

    A hash of the whole row is the last sort key: rows that tie on the order
    key (ordered arbitrarily anyway) are then split over several range
    partitions, so even a key shared by a large share of the rows does not
    land in one task unless the rows are exact duplicates. The hash is
    deterministic (unlike a random value it does not depend on the order in
    which rows arrive), so a re-run task routes every row the same way."""
    shared_dir(df.sparkSession)
    order = _cols(order_by) + [row_hash(df)]
    n = _num_partitions(df, partitions)
    tagged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    return tagged.checkpoint(eager=True)


def _offsets(tagged: DataFrame) -> DataFrame:
    """Exclusive running counts per partition, as a small broadcastable table."""
    spark = tagged.sparkSession
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    rows, acc = [], 0
    for r in sorted(per_part, key=lambda r: r["_pid"]):
        rows.append((int(r["_pid"]), acc))
        acc += int(r["n"] or 0)
    if not rows:
        rows = [(0, 0)]
    return _small(spark.createDataFrame(rows, "_pid int, _off bigint"), len(rows))


def with_position(df: DataFrame, order_by, partition_by=None, name: str = "pos",
                  partitions: int | None = None, unique: bool = False) -> DataFrame:
    """WN1: 0-based position in ``order_by`` order, over the whole table or
    within each ``partition_by`` group. Ties are broken arbitrarily but
    consistently (the positions are a permutation).

    With ``unique`` the order columns (names; group columns included) tell all
    rows apart: then only they are sorted and checkpointed, and the positions are
    joined to the rows; rows that share them after all fail."""
    if unique:
        keys = list(dict.fromkeys([*([order_by] if isinstance(order_by, str) else order_by),
                                   *([partition_by] if isinstance(partition_by, str) else partition_by or [])]))
        if len(keys) < len(df.columns):
            pos = with_position(df.select(*keys), order_by, partition_by, name, partitions)
            again = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias(name))
            twice = F.raise_error(F.lit("with_position: rows share their order columns")).cast("bigint")
            once = again.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                F.when(F.col("_n") == 1, F.col(name)).otherwise(twice).alias(name))
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            return df.join(once, same).drop(*[f"_k{i}" for i in range(len(keys))])
    group = _cols(partition_by) if partition_by else []
    tagged = sorted_checkpoint(df, group + _cols(order_by), partitions)
    spark = df.sparkSession
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)
    if not group:
        offs = _offsets(tagged)
        return (tagged.join(offs, "_pid").withColumn(name, F.col("_off") + local)
                .drop("_pid", "_mid", "_off"))

    gnames = [f"_g{i}" for i in range(len(group))]
    g = tagged.withColumn("_loc", local)
    for gn, gc in zip(gnames, group):
        g = g.withColumn(gn, gc)
    # local index of each group's first row inside each partition (a window
    # bounded by one range partition, so a hot group is still split)
    g = g.withColumn("_lstart", F.min("_loc").over(Window.partitionBy("_pid", *gnames)))
    # One pass, one row per partition (collected): its row count, its first
    # and last group, and where the last group starts. Counts give the
    # partition offsets; a group running over a boundary takes its start
    # from the partition where it begins.
    key = F.struct(*gnames)
    ends = (g.groupBy("_pid")
            .agg(F.count(F.lit(1)).alias("n"), F.min_by(key, "_loc").alias("first"),
                 F.max_by(key, "_loc").alias("last"), F.max_by("_lstart", "_loc").alias("lstart"))
            .collect())
    offs, carry, acc, prev_last, prev_start = [], [], 0, None, None
    for r in sorted(ends, key=lambda r: r["_pid"]):
        pid, off = int(r["_pid"]), acc
        acc += int(r["n"])
        offs.append((pid, off))
        first, last = tuple(r["first"]), tuple(r["last"])
        first_start = off  # the partition's first row has local index 0
        if prev_last is not None and first == prev_last:
            first_start = prev_start
            carry.append((pid, *first, first_start))
        prev_last = last
        prev_start = first_start if last == first else off + int(r["lstart"])
    offs_df = spark.createDataFrame(offs or [(0, 0)], "_pid int, _off bigint")
    g = g.join(_small(offs_df, len(offs)), "_pid")
    start = F.col("_off") + F.col("_lstart")
    drop = ["_pid", "_mid", "_loc", "_off", "_lstart", *gnames]
    if carry:
        fields = ", ".join(["_cpid int"] + [f"_c{gn} {g.schema[gn].dataType.simpleString()}" for gn in gnames]
                           + ["_cstart bigint"])
        carry_df = spark.createDataFrame(carry, fields)
        cond = F.col("_pid") == F.col("_cpid")
        for gn in gnames:
            cond = cond & F.col(gn).eqNullSafe(F.col(f"_c{gn}"))
        g = g.join(_small(carry_df, len(carry)), cond, "left")
        start = F.coalesce(F.col("_cstart"), start)
        drop += ["_cpid", "_cstart"] + [f"_c{gn}" for gn in gnames]
    return g.withColumn(name, F.col("_off") + F.col("_loc") - start).drop(*drop)


# ---------------------------------------------------------------------------
# OS1-OS4: seeded order, exact split, preview, first row
# ---------------------------------------------------------------------------
def row_hash(df: DataFrame) -> Column:
    """Deterministic hash of a whole row: the last tiebreak wherever rows that
    tie on the order key must still be ordered the same way on every run."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def shuffle_key(key, seed: int = 42) -> Column:
    """Hash that defines the seeded permutation: md5('<seed>:<key>')."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """OS1: a reproducible permutation (range-partitioned sort on the hash)."""
    return df.orderBy(shuffle_key(key, seed), F.col(key), row_hash(df))


def shuffle_position(df: DataFrame, key: str, seed: int = 42, name: str = "pos") -> DataFrame:
    """OS1 with the permutation made explicit as a 0-based position."""
    return with_position(df.withColumn("_h", shuffle_key(key, seed)), ["_h", key], name=name).drop("_h")


def _order_code(df: DataFrame, key: str, seed: int) -> Column:
    """The place of a row in the seeded order as 48 hexadecimal characters: hash
    of the key (null first), then hash of the whole row (signed, so shifted)."""
    row = F.hex(row_hash(df).bitwiseXOR(F.lit(-2 ** 63)))
    return F.concat(F.coalesce(shuffle_key(key, seed), F.lit("0" * 32)), F.lpad(F.lower(row), 16, "0"))


def split_exact(df: DataFrame, key: str, test_fraction: float = 0.02, seed: int = 42,
                name: str = "split") -> DataFrame:
    """OS2: test = the ceil(fraction * n) rows with the smallest (hash, row
    hash), train = the rest. Exact sizes, disjoint, independent of partitioning.

    The last test row is found by radix selection over the codes alone (written
    once, 48 characters a row); every row then compares its own code with that
    one value. Only if copies of one row (equal in all columns) lie on both
    sides of the cut do these copies get positions.
    """
    from .ranges import kth_code
    spark = df.sparkSession
    path = scratch_path(spark, "split-codes")
    df.select(_order_code(df, key, seed).alias("code")).write.parquet(path)
    cut, taken, there = kth_code(spark.read.parquet(path), lambda n: math.ceil(test_fraction * n))
    if cut is None:
        return df.withColumn(name, F.lit("train"))
    coded = df.withColumn("_code", _order_code(df, key, seed))
    labelled = coded.withColumn(name, F.when(F.col("_code") <= cut, "test").otherwise("train"))
    if taken == there:
        return labelled.drop("_code")
    copies = (with_position(coded.where(F.col("_code") == cut), ["_code"], name="_r")
              .withColumn(name, F.when(F.col("_r") < taken, "test").otherwise("train")).drop("_r"))
    return labelled.where(F.col("_code") != cut).unionByName(copies).drop("_code")


def preview(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """OS3: k distinct rows in seeded order (a top-k, so the limit is the feature)."""
    return df.orderBy(shuffle_key(key, seed), F.col(key), row_hash(df)).limit(k)


def first_row(df: DataFrame, key: str = "idx") -> DataFrame:
    """OS4: the row with the smallest key."""
    return df.orderBy(F.col(key)).limit(1)


# ---------------------------------------------------------------------------
# SH1/SH2/SO1: contiguous shards and their ordered merge
# ---------------------------------------------------------------------------
def shard_expr(pos, total: int, n: int) -> Column:
    """SH1 formula: chunk = total // n; shard = min(pos // chunk, n - 1); every
    row goes to the last shard when chunk is 0."""
    if n <= 0:
        raise ValueError("number of shards must be positive")
    p = F.col(pos) if isinstance(pos, str) else pos
    chunk = total // n
    if chunk == 0:
        return F.lit(n - 1).cast("int")
    return F.least(F.floor(p / F.lit(chunk)), F.lit(n - 1)).cast("int")


def assign_shard(df: DataFrame, n: int, pos: str = "idx", name: str = "shard",
                 dense: bool = True) -> DataFrame:
    """SH1: contiguous shard per row by position. ``pos`` is used as it is when
    it is a dense 0-based position, which the count checks; otherwise (or with
    ``dense=False``) the position is computed first (WN1)."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("lo"), F.max(pos).alias("hi"),
                  F.count(pos).alias("known")).first()
    total = seen.n  # AG4
    dense = dense and (total == 0 or (seen.known == total and seen.lo == 0 and seen.hi + 1 == total))
    if not dense:
        df = with_position(df, [pos], name="_pos")
        pos = "_pos"
    out = df.withColumn(name, shard_expr(pos, total, n))
    return out.drop("_pos") if not dense else out


def select_shard(df: DataFrame, i: int, name: str = "shard") -> DataFrame:
    """SH2: one worker's rows; prunes files when stored partitioned by shard."""
    return df.where(F.col(name) == i)


def merge_shards(df: DataFrame, shard: str = "shard", pos: str = "pos", name: str = "idx") -> DataFrame:
    """SO1: shards concatenated in shard order, order within a shard kept.

    ``pos`` is the position inside the shard. Offsets are the running sum of
    shard sizes: one row per shard, broadcast.
    """
    spark = df.sparkSession
    sizes = sorted((int(r[shard]), int(r["n"])) for r in
                   df.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, acc = [], 0
    for s, n in sizes:
        rows.append((s, acc))
        acc += n
    offs = spark.createDataFrame(rows or [(0, 0)], f"{shard} int, _soff bigint")
    return (df.join(_small(offs, len(rows)), shard)
            .withColumn(name, F.col("_soff") + F.col(pos)).drop("_soff"))


def with_running_total(df: DataFrame, order_by, weight: str, name: str = "start",
                       partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` (null as 0) in ``order_by`` order; ties
    are broken arbitrarily but consistently. Keys of any orderable type, null
    first. The rows are written once and sorted in ranges of equal share."""
    from .ranges import running_total, written
    return running_total(written(df, "running-total"), _cols(order_by), F.col(weight), name, partitions)
