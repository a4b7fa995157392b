"""File sources and sinks (SR1-SR4, SK1-SK3, SO1 over files).

Position in a file is made an explicit key on read, and every sink writes the
key with the data (or, for plain line files, writes in key order with ordered
part files), because Spark's output order is not a contract.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import flatten_newlines, full_strip
from ..functions.tokens import let
from ..operators.order import _small
from ..operators.ranges import running_total, written
from ..session import BATCH_BYTES, BATCH_ROWS, few_rows, scratch_path, ship_package
from .arrays import array_elements
from .arrays import natural as _natural
from .shards import EXTENSION, shard_lines, shards_of

# The field names of an example record; "masked headline" is
# renamed to masked_headline on read.
RECORD_FIELDS = ("news", "headline", "masked headline", "ans", "summary",
                 "rationale_hg", "rationale_cal", "ecnc")
PAIR_SCHEMA = "news string, chosen string, rejected string"


def _scan_order(df: DataFrame) -> DataFrame:
    """Tag each row with its file, split start and scan order (no shuffle in
    between, so ``_mid`` follows the order of rows inside each split)."""
    return (df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_mid", F.monotonically_increasing_id())
            .drop("_metadata"))


def _natural_order(name: Column) -> Column:
    """Sort key in which numbers inside names compare as numbers, so that
    part-100000 comes after part-99999."""
    parts = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x))


def _positioned(tagged: DataFrame, split_cols: list, name: str) -> DataFrame:
    """Position of each row in the order (split_cols..., row within split).

    The rows are written once with their split and their number in the scan.
    From this copy the rows of each split are counted (its rows took consecutive
    numbers), the counts are summed up in split order, and a row's position is
    its split's offset plus its distance from the split's first number. All
    reads see the copy, so it does not matter if the input would be split
    otherwise a second time.
    """
    path = scratch_path(tagged.sparkSession, "positions")
    tagged.write.parquet(path)
    copy = tagged.sparkSession.read.parquet(path)
    splits = copy.groupBy(*split_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    kinds = {f.name: f.dataType for f in splits.schema}
    order = [_natural_order(F.col(c)) if isinstance(kinds[c], T.StringType) else F.col(c) for c in split_cols]
    offsets = running_total(written(splits, "splits"), order, F.col("_cnt"), "_soff").drop("_cnt")
    return (copy.join(offsets, split_cols)
            .withColumn(name, F.col("_soff") + F.col("_mid") - F.col("_m0"))
            .drop("_m0", "_soff", "_mid"))


# ---------------------------------------------------------------------------
# Parquet tables
# ---------------------------------------------------------------------------
def _row_groups(path: str) -> int | None:
    """Row-group count of a single local Parquet file (None if not applicable)."""
    if not os.path.isfile(path):
        return None
    try:
        import pyarrow.parquet as pq
        return pq.ParquetFile(path).metadata.num_row_groups
    except Exception:  # not readable here: leave the scan as it is
        return None


# Spread a single-file input only when it holds at least this much, and give
# each task at least SPREAD_BYTES_PER_TASK of it.
SPREAD_MIN_BYTES = 1 << 20
SPREAD_BYTES_PER_TASK = 256 << 10


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table. A scan splits by row group, so a single file with
    fewer row groups than the session's parallelism is read by that many
    tasks only; if it is big enough to matter (>= 1 MiB) it is
    spread round-robin over the cores before any CPU-heavy projection.
    Directories and multi-row-group files are left as they are (their splits
    already give parallelism), as are small files (a shuffle costs more than
    it saves)."""
    df = spark.read.parquet(path)
    groups = _row_groups(path)
    par = spark.sparkContext.defaultParallelism
    size = os.path.getsize(path) if groups is not None else 0
    if groups is not None and groups < par and size >= SPREAD_MIN_BYTES:
        df = df.repartition(max(groups, min(par, size // SPREAD_BYTES_PER_TASK)))
    return df


# ---------------------------------------------------------------------------
# SR1: JSON array of record objects
# ---------------------------------------------------------------------------
def read_records(spark: SparkSession, path: str, fields=RECORD_FIELDS, idx: str = "idx",
                 fmt: str = "array") -> DataFrame:
    """SR1: a JSON array of objects (``fmt="array"``) or JSON Lines
    (``fmt="lines"``, splittable) -> rows in file order with ``idx``.

    Every field is read as text, rendered by the type of its own value as str() of a
    loaded record renders it: texts as they are, booleans as True/False (also where
    other records hold texts in the same field), integers as spelled, other numbers as
    floats print (1.50 as 1.5, 1e3 as 1000.0); lists and objects as their JSON. A
    missing field or null becomes the text 'None' only when rendered (to_text).
    Broken records fail. An array is cut into its elements in parallel (see
    ``arrays``); lines are scanned once.
    """
    if fmt == "array":
        rows = array_elements(spark, path).select(F.col("idx").alias(idx), "text")
    else:
        lines = spark.read.text(path).where(F.btrim("value") != "")
        rows = _positioned(_scan_order(lines.select(F.col("value").alias("text"), "_metadata")),
                           ["_file", "_block"], idx).select(idx, "text")
    return record_fields(rows, "text", fields).select(*[f.replace(" ", "_") for f in fields], idx)


def record_fields(rows: DataFrame, text: str, fields=RECORD_FIELDS) -> DataFrame:
    """``rows`` with the fields of the JSON object in the column ``text``, as text."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    broken = F.raise_error(F.lit("not a JSON object")).cast("string")
    whole = F.when(F.ltrim(F.col(text)).startswith("{"), F.col(text)).otherwise(broken)
    parsed = rows.withColumn("_record", F.from_json(whole, schema, {"mode": "FAILFAST"}))
    # the value's own type decides whether a spelled true or 1.0 is a text or not;
    # records whose texts spell neither are not parsed again
    value = {f: F.col("_record")[f] for f in fields}
    spells = {f: c.rlike(r"^(true|false)$|^-?[0-9]+(\.[0-9]|E)") for f, c in value.items()}
    some = F.greatest(*[F.coalesce(c, F.lit(False)) for c in spells.values()], F.lit(False))
    typed = parsed.withColumn("_typed", F.when(some, F.try_parse_json(F.col(text))))
    paths = {f: f"$[{json.dumps(f)}]" for f in fields}
    parts = F.array(*[F.struct(
        value[f].alias("text"),
        F.when(spells[f], F.schema_of_variant(F.try_variant_get("_typed", paths[f], "variant"))).alias("kind"),
        F.when(spells[f], F.try_variant_get("_typed", paths[f], "string")).alias("spelled")) for f in fields])

    def render(x):
        short = x["kind"].startswith("DECIMAL") & (F.length(F.translate(x["spelled"], "-.", "")) <= 17)
        digits = F.when(short, x["spelled"]).otherwise(x["text"])           # a float's own digits
        return (F.when(x["kind"] == "BOOLEAN", F.initcap(x["text"]))
                .when(x["kind"].rlike("^(DECIMAL|DOUBLE|FLOAT)") & x["text"].rlike("[.E]"), float_text(x["text"], digits))
                .otherwise(x["text"]))
    shown = typed.withColumn("_shown", F.transform(parts, render))
    names = [f.replace(" ", "_") for f in fields]
    return (shown.withColumns({n: F.col("_shown")[i] for i, n in enumerate(names)})
            .drop("_record", "_typed", "_shown"))


def float_text(value: Column, digits: Column) -> Column:
    """A float as Python prints it: plain from 1e-04 to below 1e+16, else with an
    exponent. ``digits`` has its digits, in plain or E notation."""
    part = lambda i: F.regexp_extract(digits, r"^-?([0-9]+)(?:\.([0-9]+))?(?:E([-+]?[0-9]+))?$", i)

    def of(x):
        all_digits = F.concat(x["whole"], x["fraction"])
        kept = F.regexp_replace(all_digits, "^0+", "")
        point = F.length(x["whole"]) + x["exponent"] - (F.length(all_digits) - F.length(kept))
        return F.struct(F.regexp_replace(kept, "0+$", "").alias("d"), point.alias("point"))

    def spell(x):
        d, point = x["d"], x["point"]
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
        plain = (F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), d))
                 .when(point >= F.length(d), F.concat(d, zeros(point - F.length(d)), F.lit(".0")))
                 .otherwise(F.concat(F.left(d, point), F.lit("."), F.substr(d, point + 1))))
        rest = F.substr(d, F.lit(2))
        power = F.abs(point - 1).cast("string")
        power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
        science = F.concat(F.left(d, F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
                           F.when(point > 0, F.lit("e+")).otherwise(F.lit("e-")), power)
        sign = F.when(digits.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.when((point > -4) & (point <= 16), plain).otherwise(science))
    exponent = F.coalesce(part(3).try_cast("int"), F.lit(0))
    parts = F.struct(part(1).alias("whole"), part(2).alias("fraction"), exponent.alias("exponent"))
    return F.when(value.isin("0.0", "-0.0"), value).otherwise(let(let(parts, of), spell))


def write_records(df: DataFrame, path: str, key: str = "idx", fields=RECORD_FIELDS, mode: str = "overwrite") -> None:
    """Records as JSON Lines in key order (range-partitioned, so part files in
    name order hold consecutive keys); ``read_records(fmt="lines")`` reads
    them back with the same positions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cols = [F.col(f.replace(" ", "_")).alias(f) for f in fields]
    (df.repartitionByRange(n, key).sortWithinPartitions(key)
     .select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path))


def records_to_table(spark: SparkSession, path: str, out: str, fields=RECORD_FIELDS) -> DataFrame:
    """Convert a record array once to Parquet with ``idx``; later reads split."""
    read_records(spark, path, fields).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


# ---------------------------------------------------------------------------
# SR2: saved columnar preference pairs
# ---------------------------------------------------------------------------
def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """SR2: preference pairs (news, chosen, rejected) with ``idx``.

    Parquet input is read directly, in natural order of its files. A saved Arrow dataset directory (shards
    listed in its state file) is read with Spark's own readers, so any path that Spark
    can open will do: a task streams a shard and decodes its record batches one by one
    (see ``shards``). The row order of the dataset becomes ``idx``.
    """
    state = spark.read.format("binaryFile").option("pathGlobFilter", "state.json").load(path).select("content").first()
    if state is None:
        # Parquet knows each row's place in its file, however the file is split
        df = spark.read.schema(PAIR_SCHEMA).parquet(path).select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
        files = written(df.groupBy("_file").agg(F.count(F.lit(1)).alias("_cnt")), "pair-files")
        before = running_total(files, [_natural_order(F.col("_file"))], F.col("_cnt"), "_before").drop("_cnt")
        # one row per file; without the hint the pairs themselves may be shuffled by their file
        return (df.join(_small(before, before.count()), "_file").withColumn("idx", F.col("_before") + F.col("_place"))
                .drop("_file", "_place", "_before"))
    names = [d["filename"] for d in json.loads(bytes(state.content)).get("_data_files", [])]
    order = spark.createDataFrame(list(enumerate(names)), "shard int, name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{EXTENSION}").load(path)
    listed = set(names)

    def count_shards(batches):
        import pyarrow as pa
        for name, parts in shards_of(batches):
            if name in listed:
                rows = sum(rb.num_rows for rb in parts)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["name", "rows"])

    def read_shards(batches):
        import pyarrow as pa
        for name, parts in shards_of(batches):
            if name not in listed:
                continue
            done = 0
            for part in parts:
                few = max(1, min(BATCH_ROWS, part.num_rows * BATCH_BYTES // max(1, part.nbytes)))
                for rb in (part.slice(at, few) for at in range(0, part.num_rows, few)):
                    cols = [rb.column(c).cast(pa.string()) for c in ("news", "chosen", "rejected")]
                    for pos in (before + done for before in first[name]):
                        yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + rb.num_rows), pa.int64()), *cols],
                                                         names=["idx", "news", "chosen", "rejected"])
                    done += rb.num_rows

    ship_package(spark)
    few_rows(spark)
    missing = order.join(files.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_anti").first()
    if missing is not None:
        raise FileNotFoundError(f"{path} has no shard {missing.name}")
    # the files are read twice, first for their number of rows: nothing is copied between
    lines = shard_lines(spark, path)
    rows = {r["name"]: r["rows"] for r in lines.mapInArrow(count_shards, "name string, rows long").collect()}
    first, total = {}, 0
    for name in names:
        if name not in rows:
            raise ValueError(f"{path}: shard {name} is empty")
        first.setdefault(name, []).append(total)
        total += rows[name]
    return lines.mapInArrow(read_shards, f"idx long, {PAIR_SCHEMA}")


# ---------------------------------------------------------------------------
# SR3 / SR4: string sidecar (JSON array of strings) and line files
# ---------------------------------------------------------------------------
def _string(column: str) -> Column:
    """The string that a JSON text stands for (null for null); other texts fail."""
    c = F.col(column)
    bad = F.raise_error(F.concat(F.lit("not a JSON string: "), F.left(c, F.lit(80)))).cast("string")
    parsed = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    return F.when(c == "null", F.lit(None)).when(c.startswith('"'), F.element_at(parsed, 1)).otherwise(bad)


def read_string_list(spark: SparkSession, path: str, pos: str = "pos", text: str = "text") -> DataFrame:
    """SR3, SC15: a JSON array of strings -> (pos, text), one row per element;
    several files are put one after the other in natural order of their names.
    Large files are read in parallel (see ``arrays``)."""
    return array_elements(spark, path).select(F.col("idx").alias(pos), _string("text").alias(text))


def read_lines(spark: SparkSession, path: str, pos: str = "pos", text: str = "text",
               strip: bool = True) -> DataFrame:
    """SR4: text lines in file order with their position, each line stripped.
    Splits on \\n, \\r and \\r\\n (as Python's text mode does); large files are
    read in parallel splits and positioned by (file, split, row)."""
    raw = spark.read.text(path)
    t = full_strip("value") if strip else F.col("value")
    ordered = _scan_order(raw.select(t.alias(text), "_metadata"))
    return _positioned(ordered, ["_file", "_block"], pos).drop("_file", "_block")


# ---------------------------------------------------------------------------
# SK1 / SK2 / SK3: outputs by shard, and the merged output
# ---------------------------------------------------------------------------
def write_outputs(df: DataFrame, path: str, fmt: str = "json", shard: str = "shard",
                  key: str = "idx", text: str = "text", mode: str = "overwrite") -> None:
    """SK1 (fmt='json'): one JSON object per line with key, shard and text,
    partitioned by shard. SK2 (fmt='txt'): newlines flattened to spaces, one
    line per output, written in (shard, key) order by range-partitioned tasks
    so that part files read in name order give the outputs in key order."""
    if fmt == "json":
        df.select(key, shard, text).write.mode(mode).partitionBy(shard).json(path)
    elif fmt == "txt":
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        (df.select(shard, key, flatten_newlines(text).alias(text))
         .repartitionByRange(n, shard, key).sortWithinPartitions(shard, key)
         .drop(key).write.mode(mode).partitionBy(shard).text(path))
    else:
        raise ValueError("fmt must be 'json' or 'txt'")


def read_outputs(spark: SparkSession, path: str, fmt: str = "json", key: str = "idx",
                 text: str = "text", shard: str = "shard") -> DataFrame:
    """Read back SK1/SK2 output. JSON output carries its key. Line output is
    positioned by (shard, part file, split, row) -- the merged order (SO1)."""
    if fmt == "json":
        return spark.read.schema(f"{key} bigint, {text} string").json(path).select(
            key, F.col(shard).cast("int").alias(shard), text)
    raw = spark.read.text(path)
    lines = _scan_order(raw.select(full_strip("value").alias(text), F.col(shard).cast("int").alias(shard),
                                   "_metadata"))
    lines = lines.withColumn("_name", F.element_at(F.split("_file", "/"), -1))
    return _positioned(lines, [shard, "_name", "_block"], key).drop("_file", "_name", "_block")


def write_merged(df: DataFrame, path: str, fmt: str = "json", key: str = "idx", text: str = "text",
                 mode: str = "overwrite") -> None:
    """SK3: the merged output in key order (range-partitioned sort; part files
    in name order hold consecutive key ranges)."""
    out = df.select(key, text).orderBy(key)
    if fmt == "json":
        out.write.mode(mode).json(path)
    else:
        out.select(flatten_newlines(text).alias(text)).write.mode(mode).text(path)


_RANK = r"rank-(\d+)\.(json|txt)$"


def read_rank_files(spark: SparkSession, directory: str, fmt: str, key: str = "idx",
                    text: str = "text", num_processes: int | None = None) -> DataFrame:
    """SO1 over files written by outside workers (``rank-<i>.json`` arrays or
    ``rank-<i>.txt`` lines): concatenated in rank order, order inside each
    file kept, merged position as ``key``. Other files (a merged one, rank-c) are
    skipped. With ``num_processes`` the ranks must be exactly 0 to num_processes - 1.
    Any path that Spark can open will do."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", f"rank-*.{fmt}").load(directory)
              .select("path", F.regexp_extract("path", _RANK, 1).alias("rank")).where(F.col("rank") != "").collect())
    paths = [r.path for r in sorted(listed, key=lambda r: int(r["rank"]))]
    if not paths:
        raise FileNotFoundError(f"no rank-*.{fmt} files in {directory}")
    found = sorted(int(r["rank"]) for r in listed)
    if num_processes is not None and found != list(range(num_processes)):
        raise FileNotFoundError(f"ranks {found} found, {num_processes} expected in {directory}")
    if fmt == "json":
        return array_elements(spark, paths).select(F.col("idx").alias(key), _string("text").alias(text))
    raw = spark.read.text(paths)
    rank_of = F.regexp_extract(F.col("_metadata.file_path"), _RANK, 1).cast("int")
    lines = _scan_order(raw.select(full_strip("value").alias(text), rank_of.alias("shard"), "_metadata"))
    return _positioned(lines, ["shard", "_block"], key).select(key, text)


def read_gold(spark: SparkSession, gt_path: str, type_path: str, strict: bool = True) -> DataFrame:
    """Gold numerals and their type flags, two line files aligned by line
    position -> (idx, gt, num_type). Gold stays text (leading zeros occur).
    With ``strict`` differing line counts raise; otherwise the shorter file
    decides (as zip does)."""
    from ..operators.align import zip_join
    gt = read_lines(spark, gt_path, pos="idx", text="gt")
    ty = read_lines(spark, type_path, pos="idx", text="_t").select("idx", F.col("_t").cast("int").alias("num_type"))
    return zip_join(gt, ty, "idx", strict=strict).select("idx", "gt", "num_type")


def write_split(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """The {train, test} container as one Parquet table partitioned by split."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, which: str, split: str = "split") -> DataFrame:
    """One split of a ``write_split`` table; the filter prunes to its folder."""
    return spark.read.parquet(path).where(F.col(split) == which)
