"""Row-local operators on a stream.

Chat-example construction, rendering, numeral checks and truncation are
column expressions, so the same code runs on a streaming DataFrame. This
module wires a file stream through them into a file sink with a checkpoint
in the shared folder (restartable after a failure, exactly-once file sink).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def stream_through(spark: SparkSession, source_dir: str, schema, transform: Callable[[DataFrame], DataFrame],
                   sink: str | None = None, checkpoint: str | None = None, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> str:
    """Run ``transform`` over every file now in ``source_dir`` as a stream
    (trigger availableNow), write Parquet to ``sink``; returns the sink path."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.parquet(source_dir))
    sink = sink or scratch_path(spark, "stream-sink")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (stream.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
