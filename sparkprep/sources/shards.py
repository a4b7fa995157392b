"""Arrow shards of any size read as streams (SR2).

Spark's reader of binary files holds a file whole, several times over. Its text
reader hands out lines one by one from any path that Spark can open, so a shard is
read as lines that end at zero bytes: lines and zero bytes put together again are the
shard's bytes. The offsets that stand before an array's texts have zero bytes, so no
line is longer than the texts of one record batch, and a task holds a record batch and
a few lines at a time. Hadoop's pass-through codec, named for the shards' extension,
keeps a file in one split: its lines come in order, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The shards' extension and what keeps such a file in one split. The
# second name of the option is the one in Hadoop's shaded client.
EXTENSION = ".arrow"
_WHOLE = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
          "io.compress.passthrough.extension": EXTENSION,
          "org.apache.hadoop.shaded.io.compress.passthrough.extension": EXTENSION}


def shard_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, size (of the file), line: what stands between the zero bytes of the
    folder's shards, in order for each file."""
    size, read = F.col("_metadata.file_size"), F.col("_metadata.file_block_length")
    split = F.raise_error(F.concat(F.col("_metadata.file_path"), F.lit(" was split"))).cast("long")
    return (spark.read.options(**_WHOLE).option("lineSep", "\0").option("pathGlobFilter", f"*{EXTENSION}").text(path)
            .select(F.col("_metadata.file_name").alias("file"), F.when(size == read, size).otherwise(split).alias("size"),
                    F.col("value").cast("binary").alias("line")))


def _runs(batches) -> Iterator[tuple[str, int, bytes]]:
    """(file, size, bytes) of the consecutive lines of a file in a batch."""
    for b in batches:
        rows = zip(b.column("file").to_pylist(), b.column("size").to_pylist(), b.column("line").to_pylist())
        for (file, size), lines in groupby(rows, key=lambda r: r[:2]):
            yield file, size, b"\0".join(line for _, _, line in lines) + b"\0"


class _Bytes:
    """A file's bytes for Arrow's readers, from runs; a zero byte after its last line is
    there only if the size says so."""

    closed = False

    def __init__(self, runs, size: int):
        self.runs, self.left = runs, size
        self.held, self.at = b"", 0

    def read(self, n: int) -> bytes:
        out, n = [], min(n, self.left)
        self.left -= n
        while n:
            if self.at == len(self.held):
                _, _, self.held = next(self.runs)
                self.at = 0
            out.append(self.held[self.at:self.at + n])
            self.at += len(out[-1])
            n -= len(out[-1])
        return b"".join(out)


def shards_of(batches) -> Iterator[tuple[str, Iterator]]:
    """(name, record batches) of the files in batches of ``shard_lines``; the record
    batches of one are to be read before the next is asked for."""
    for (file, size), runs in groupby(_runs(batches), key=lambda r: r[:2]):
        yield unquote(file), _record_batches(_Bytes(runs, size))


def _record_batches(data: _Bytes) -> Iterator:
    """Of a stream, or of a file: that is a stream between a mark and a table of contents."""
    import pyarrow as pa
    mark = data.read(8)
    if not mark.startswith(b"ARROW1"):
        data.held, data.at, data.left = mark + data.held[data.at:], 0, data.left + len(mark)
    yield from pa.ipc.open_stream(pa.PythonFile(data, mode="r"))
