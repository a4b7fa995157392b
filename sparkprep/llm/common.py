"""Small helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few_rows, scratch_path, ship_package

# The white space that separates words: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (string) only, so that further columns of any
    name cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), *more)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts the
    lineage, and lost executors re-read it instead of recomputing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _inside.__dict__.get("paths") is not None:
        _inside.paths.append(path)
    return spark.read.parquet(path)


_inside = threading.local()         # paths: what ``saved`` wrote inside the innermost ``settled``


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make()`` describes, ``saved``. What ``make`` saved on the way
    is deleted then: nothing reads it any more."""
    outer = _inside.__dict__.get("paths")
    _inside.paths = []
    try:
        out = saved(make(), name)
        *passed, kept = _inside.paths
    finally:
        _inside.paths = outer
    if outer is not None:
        outer.append(kept)
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, passed):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def shipped(spark: SparkSession) -> None:
    """Make the package importable on the executors, and keep the session's
    Arrow batches (several copies of each exist at a time) to few texts."""
    ship_package(spark)
    few_rows(spark)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null ids: of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space, null as 0 (JVM side)."""
    flat = F.translate(F.coalesce(text, F.lit("")), WS[1:], " " * (len(WS) - 1))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def words(text: bytes) -> list[bytes]:
    """Words of one text with A-Z lower-cased; ``bytes`` methods use exactly
    the ASCII rules wanted here (white space as in ``WS``)."""
    return text.lower().split()


def text_bytes(column) -> list:
    """UTF-8 bytes (or None) of a string column of an Arrow batch."""
    import pyarrow as pa
    return column.cast(pa.binary()).to_pylist()


def sliced(run, rows: int = 1000):
    """``run`` over small slices of the Arrow batches: Python objects of few
    texts exist at a time. What the task took is given back at its end."""
    def over(batches):
        try:
            yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            give_back()
    return over


def give_back() -> None:
    """Return free memory of this worker to the machine. Workers stay for later
    tasks, and neither Arrow's pool nor the C library gives it back by itself."""
    import ctypes
    import gc
    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


class WordHash(dict):
    """word -> 64-bit hash, remembered; forgotten when it grows too large."""
    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(ws: list[bytes], cache: WordHash):
    import numpy as np
    return np.fromiter(map(cache.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix64(x):
    """Finaliser that spreads every input bit over a 64-bit numpy array."""
    import numpy as np
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h, n: int = 5):
    """Hash of every window of ``n`` words; of the whole sequence as one when
    it is shorter; empty for no words."""
    import numpy as np
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j])
    return out
