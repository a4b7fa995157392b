"""Ranges of equal share over any orderable key, and what follows from them:
running totals without a hot bucket (WN1, WN3) and the k-th smallest key (OS2).

A table is written once with a row number. Boundaries come from a sample of its
keys at a fixed rate per range; which rows are in it is decided by a hash, so
samples of parts of the table simply add up. The row number is the last part
of the key: ties are cut like other keys, even rows that are equal in all
columns. Every row finds its range by comparing its key with two short lists of
boundaries, totals per range (one row each) become offsets, and a window runs
over one range at a time.

Keys may be of any orderable type and null (nulls first, as Spark sorts).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Rows of a range (about), and sampled keys per range: 64 make a range of twice
# its share about as likely as one in 10^10.
ROWS_PER_RANGE = 4_000_000
ROWS_WORTH_A_RANGE = 1_000
SAMPLE_PER_RANGE = 64
ROW = "_row"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number, written once to the shared folder: whatever
    reads it later sees the same rows with the same numbers."""
    path = scratch_path(df.sparkSession, name)
    df.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sort_key(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(ROW).alias("row"))


def _constant(spark: SparkSession, value, kind) -> Column:
    """A driver-side value of any type as a column."""
    from pyspark.sql.types import StructField, StructType
    return spark.createDataFrame([(value,)], StructType([StructField("v", kind)])).scalar()


def n_ranges(spark: SparkSession, rows: int) -> int:
    least = min(rows // ROWS_WORTH_A_RANGE, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return max(1, least, math.ceil(rows / ROWS_PER_RANGE))


def with_range(table: DataFrame, key: Column, ranges: int | None = None, name: str = "_range") -> DataFrame:
    """A ``written`` table with the number of each row's range, in key order."""
    from pyspark.sql.types import ArrayType
    spark = table.sparkSession
    rows = table.count()
    ranges = ranges or n_ranges(spark, rows)
    one = F.least(F.col(ROW), F.lit(0)).cast("int")         # 0, but not a constant: a window over it is a grouped one
    if ranges == 1:
        return table.withColumn(name, one)
    every = max(1, rows // (ranges * SAMPLE_PER_RANGE))
    step = max(1, rows // every // ranges)
    sample = (table.select(key.alias("k"), F.xxhash64(ROW).alias("_h")).where(F.pmod("_h", F.lit(every)) == 0)
              .agg(F.array_sort(F.collect_list("k")).alias("k"))
              .select(F.filter("k", lambda x, i: (i + 1) % step == 0).alias("k")))
    bounds = sample.first().k[:ranges - 1]
    kind = sample.schema["k"].dataType
    if not bounds:
        return table.withColumn(name, one)
    # two lists instead of one: every wide-th boundary, then those between two of these
    wide = math.isqrt(len(bounds)) + 1
    coarse = _constant(spark, bounds[wide - 1::wide], kind)
    fine = _constant(spark, [bounds[i:i + wide - 1] for i in range(0, len(bounds) + 1, wide)], ArrayType(kind))
    passed = lambda b: F.size(F.filter(b, lambda x: x <= key))
    return (table.withColumns({"_coarse": coarse, "_fine": fine}).withColumn("_coarse", passed(F.col("_coarse")))
            .withColumn(name, F.col("_coarse") * wide + passed(F.element_at("_fine", F.col("_coarse") + 1)))
            .drop("_coarse", "_fine"))


def running_total(table: DataFrame, order: list[Column], weight: Column, name: str,
                  ranges: int | None = None) -> DataFrame:
    """A ``written`` table with the exclusive running sum of ``weight`` (long,
    null as 0) in ``order``; its row number is dropped."""
    spark = table.sparkSession
    from pyspark.sql.types import ArrayType, LongType
    w = F.coalesce(weight.cast("long"), F.lit(0).cast("long"))
    key = sort_key(order)
    t = with_range(table, key, ranges)
    totals = {r["_range"]: r["t"] for r in t.groupBy("_range").agg(F.sum(w).alias("t")).collect()}
    offsets, acc = [], 0
    for r in range(max(totals, default=0) + 1):
        offsets.append(acc)
        acc += totals.get(r, 0)
    before = Window.partitionBy("_range").orderBy(*order, ROW).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(_constant(spark, offsets, ArrayType(LongType())), F.col("_range") + 1)
    return (t.withColumn(name, F.coalesce(F.sum(w).over(before), F.lit(0).cast("long")))
            .withColumn(name, F.col(name) + offset).drop("_range", ROW))


_DIGIT = 4                  # hexadecimal characters that one round decides
_FEW = 65_536               # codes that are looked at one by one at the end


def kth_code(codes: DataFrame, share) -> tuple[str | None, int, int]:
    """The k-th smallest of the ``code`` strings (equal length, hexadecimal), where
    k = share(number of codes): (code, how many of the codes equal to it belong to
    the first k, how many there are). Radix selection: each round counts the
    next characters of the codes that are left and keeps one bucket."""
    prefix, need, left = "", None, codes
    while True:
        digit = F.substring("code", len(prefix) + 1, _DIGIT)
        counts = sorted((r.d, r.n) for r in left.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if need is None:
            need = share(sum(n for _, n in counts))
            if need <= 0:
                return None, 0, 0
        for d, n in counts:
            if n >= need:
                break
            need -= n
        prefix += d
        left = codes.where(F.col("code").startswith(prefix))
        if n <= _FEW:
            for code, n in sorted((r.code, r.n) for r in left.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()):
                if n >= need:
                    return code, need, n
                need -= n
        if not d or len(d) < _DIGIT:
            return prefix, need, n
