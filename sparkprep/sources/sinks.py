"""Sinks whose files other programs read, as Spark data sources: a JSON array per
task (rank files, sidecars) and Arrow dataset shards with their state file.

A task streams its partition into one file in its final folder under a name of its
own; the commit on the driver lists or publishes the files of the attempts that
count, so a task that is run again leaves nothing in the result. Files are
opened through Arrow's file systems, by the path's own scheme.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


def _folder(path: str):
    """(file system, folder) of a path with or without a scheme."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return fs.LocalFileSystem(), path


class _Writer(DataSourceArrowWriter):
    """One file per task: ``fill`` writes it, ``publish`` ends the job on the driver."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        from pyspark import TaskContext
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"_{partition:05d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/{name}") as out:
            rows = self.fill(out, iterator)
        return Written(partition, name, rows)

    def commit(self, messages) -> None:
        system, folder = _folder(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        self.publish(system, folder, done)
        _drop_others(system, folder)

    def abort(self, messages) -> None:
        system, folder = _folder(self.path)
        _drop_others(system, folder)


def _drop_others(system, folder: str) -> None:
    """The files of attempts that do not count."""
    from pyarrow import fs
    for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.is_file and f.base_name.startswith("_"):
            system.delete_file(f.path)


class _ArrayWriter(_Writer):
    def __init__(self, path: str, prefix: str):
        super().__init__(path)
        self.prefix = prefix

    def fill(self, out, iterator) -> int:
        rows = 0
        out.write(b"[")
        for b in iterator:
            values = b.column(0).to_pylist()
            if values:
                out.write((",\n" if rows else "").encode() + ",\n".join(v if v is not None else "null" for v in values).encode())
            rows += len(values)
        out.write(b"]")
        return rows

    def publish(self, system, folder, done) -> None:
        for rank, m in enumerate(done):
            system.move(f"{folder}/{m.name}", f"{folder}/{self.prefix}{rank}.json")


class JsonArrayFiles(DataSource):
    """Write only: one column of JSON texts; options path and prefix."""

    @classmethod
    def name(cls) -> str:
        return "json_array_files"

    def writer(self, schema, overwrite):
        return _ArrayWriter(self.options["path"], self.options.get("prefix", "rank-"))


class _ShardWriter(_Writer):
    def fill(self, out, iterator) -> int:
        import pyarrow as pa
        rows, sink = 0, None
        for b in iterator:
            if sink is None:
                sink = pa.ipc.new_stream(out, b.schema)
            sink.write_batch(b)
            rows += b.num_rows
        if sink is not None:
            sink.close()
        return rows

    def publish(self, system, folder, done) -> None:
        kept = [m for m in done if m.rows]
        files = []
        for i, m in enumerate(kept):
            files.append({"filename": f"data-{i:05d}-of-{len(kept):05d}.arrow"})
            system.move(f"{folder}/{m.name}", f"{folder}/{files[-1]['filename']}")
        with system.open_output_stream(f"{folder}/state.json") as out:
            out.write(json.dumps({"_data_files": files}).encode())


class ArrowShards(DataSource):
    """Write only: a saved Arrow dataset, one shard per task; option path."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def writer(self, schema, overwrite):
        return _ShardWriter(self.options["path"])


def _in_order(df: DataFrame, key: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def _write(df: DataFrame, source: type[DataSource], path: str, **options) -> None:
    from ..session import ship_package
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).options(path=path, **options).mode("append").save()


def json_string(c) -> Column:
    """The JSON text of a string (null for null)."""
    whole = F.to_json(F.array(F.col(c) if isinstance(c, str) else c))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def write_json_arrays(df: DataFrame, path: str, key: str = "idx", value: str = "text", prefix: str = "rank-",
                      raw: bool = False) -> None:
    """JSON array files <prefix><i>.json of the column ``value`` in key order, one per
    task (consecutive keys each): strings, or with ``raw`` JSON texts as they are.
    The folder must be new or empty."""
    text = F.col(value) if raw else json_string(value)
    _write(_in_order(df.select(key, text.alias("value")), key).select("value"), JsonArrayFiles, path, prefix=prefix)


def write_arrow_shards(df: DataFrame, path: str, key: str) -> None:
    """A saved Arrow dataset of ``df`` without its key, in key order, one shard per
    task, in record batches of few rows; ``files.read_pairs`` reads it. The folder must
    be new or empty."""
    from ..session import few_rows
    few_rows(df.sparkSession)
    _write(_in_order(df, key).drop(key), ArrowShards, path)
