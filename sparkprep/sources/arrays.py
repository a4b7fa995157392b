"""JSON arrays of any size read in parallel: records (SR1), sidecars (SR3, SC15)
and rank files (SO1).

A JSON array file has no line structure, so it is cut at its commas (Spark's
text reader with the comma as line separator splits it by bytes), and whether a
comma separates elements is found by a small automaton: inside a string or not,
and how deep in brackets. No escape reaches over a comma, so a piece between two
commas only flips the first state by its count of quotes and moves the second
by its count of brackets outside strings. Both compose:

1. each split sums up its pieces for either state in which it may start (one row
   per split);
2. these rows, put one after the other per file, give every split its start;
3. each split then cuts its elements by itself. Only the first and the last piece
   of an element that runs over a split's end are put together in a shuffle.

The elements are written once, so nothing is cut twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

# JSON's own white space.
BLANK = " \t\n\r"
_ESCAPE = re.compile(r"\\.", re.S)


def natural(value: str) -> list:
    """Sort key in which numbers inside names compare as numbers, so that
    part-100000 comes after part-99999."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", value)]


def outside(piece: str) -> tuple[int, int, int]:
    """Of a piece between two commas: whether its quotes flip the string state,
    and its sum of brackets if it starts outside, or inside, a string."""
    if "\\" in piece:
        piece = _ESCAPE.sub("", piece)
    parts = piece.split('"')
    depth = [p.count("[") + p.count("{") - p.count("]") - p.count("}") for p in parts]
    return (len(parts) - 1) % 2, sum(depth[0::2]), sum(depth[1::2])


def _pieces(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.coalesce("value", F.lit("")).alias("value"))


def _runs(batches):
    """(file, block, value, whether the piece is its split's first)."""
    at = None
    for b in batches:
        for f, k, v in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist()):
            yield f, k, v, at != (f, k)
            at = (f, k)


def split_sums(batches):
    """One row per split: flip, and for either start state the change of depth and how
    many commas of the split lie outside strings at each depth (from its start)."""
    import pyarrow as pa
    rows: list[dict] = []
    for file, block, value, new in _runs(batches):
        if new:
            rows.append({"file": file, "block": block, "flip": 0, "depth": [0, 0], "commas": [{}, {}], "solid": 0})
        r = rows[-1]
        if not new or block:                        # all pieces but a file's first have a comma before them
            free = r["flip"]                        # the start state under which this comma is outside strings
            seen, depth = r["commas"][free], r["depth"][free]
            seen[depth] = seen.get(depth, 0) + 1
        flip, plain, quoted = outside(value)
        for start in (0, 1):
            r["depth"][start] += quoted if start != r["flip"] else plain
        r["flip"] ^= flip
        r["solid"] += len("".join(value.split()))
    kind = pa.list_(pa.map_(pa.int32(), pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r["file"] for r in rows], pa.string()), pa.array([r["block"] for r in rows], pa.int64()),
         pa.array([r["flip"] for r in rows], pa.int32()), pa.array([r["depth"] for r in rows], pa.list_(pa.int64())),
         pa.array([[list(c.items()) for c in r["commas"]] for r in rows], kind),
         pa.array([r["solid"] for r in rows], pa.int64())],
        names=["file", "block", "flip", "depth", "commas", "solid"])


SUMS = "file string, block long, flip int, depth array<long>, commas array<map<int,long>>, solid long"


def starts(sums: list) -> tuple[dict, dict]:
    """(file, block) -> (in a string, depth, elements before); file -> last element, -1
    in an empty array. Files that are not one closed array fail."""
    begin, last, state = {}, {}, {}
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        inside, depth, before, solid = state.get(r["file"], (0, 0, 0, 0))
        begin[(r["file"], r["block"])] = (inside, depth, before)
        before += dict(r["commas"][inside]).get(1 - depth, 0)
        state[r["file"]] = (inside ^ r["flip"], depth + r["depth"][inside], before, solid + r["solid"])
    for file, (inside, depth, before, solid) in state.items():
        if inside or depth:
            raise ValueError(f"not a JSON array: {file} ends inside {'a string' if inside else 'brackets'}")
        last[file] = before if before or solid > 2 else -1      # two brackets and nothing else
    return begin, last


def _cut(shared):
    def run(batches):
        import pyarrow as pa
        begin, last = shared.value
        out = []

        def batch():
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                              names=["file", "pos", "block", "whole", "final", "text"])
        held: list[str] = []
        here, begun = None, False                   # (file, block, element), and whether it begins in this split
        inside = depth = pos = 0

        def add(whole: bool):
            file, block, pos = here
            out.append((file, pos, block, whole, pos >= last[file], ",".join(held)))
        for file, block, value, new in _runs(batches):
            if new:
                if here:
                    add(False)
                inside, depth, pos = begin[(file, block)]
                held, here, begun = [], (file, block, pos), not block
            if not inside and depth == 1 and (not new or block):
                if not new:
                    add(begun)
                pos += 1
                held, here, begun = [], (file, block, pos), True
            flip, plain, quoted = outside(value)
            if new and not block:
                value = value.lstrip("\ufeff" + BLANK)
                if not value.startswith("["):
                    raise ValueError(f"not a JSON array: {file}")
                value = value[1:]
            held.append(value)
            depth += quoted if inside else plain
            inside ^= flip
            if len(out) >= 1000:
                yield batch()
                out.clear()
        if here:
            add(False)
        yield batch()
    return run


def array_elements(spark: SparkSession, paths) -> DataFrame:
    """file, pos (in the file, from 0), text (JSON) of the elements of JSON array
    files, and idx, the position over all files in natural order of their names.

    A file that is not one array fails; an empty array has no rows."""
    ship_package(spark)
    pieces = _pieces(spark, paths)
    begin, last = starts(pieces.mapInArrow(split_sums, SUMS).collect())      # one row per split
    shared = spark.sparkContext.broadcast((begin, last))
    out = scratch_path(spark, "json-elements")
    pieces.mapInArrow(_cut(shared), "file string, pos long, block long, whole boolean, final boolean, text string"
                      ).write.parquet(out)
    cut = spark.read.parquet(out)
    parts = (cut.where(~F.col("whole")).groupBy("file", "pos")
             .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("t"), F.max("final").alias("final"))
             .select("file", "pos", "final", F.array_join(F.transform("t", lambda x: x["text"]), ",").alias("text")))
    rows = cut.where("whole").select("file", "pos", "final", "text").unionByName(parts)
    text = F.when(F.col("final"), F.regexp_replace("text", r"\][ \t\n\r]*$", "")).otherwise(F.col("text"))
    rows = (rows.withColumn("text", F.btrim(text, F.lit(BLANK)))
            .where(~((F.col("pos") == 0) & F.col("final") & (F.col("text") == ""))))
    return rows.join(F.broadcast(_file_offsets(spark, last)), "file").select(
        "file", "pos", (F.col("before") + F.col("pos")).alias("idx"), "text")


def _file_offsets(spark: SparkSession, last: dict) -> DataFrame:
    rows, before = [], 0
    for file in sorted(last, key=natural):
        rows.append((file, before))
        before += last[file] + 1
    return spark.createDataFrame(rows, "file string, before long")
