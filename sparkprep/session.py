"""Session helpers: building a local session for tests/bench and finding the
shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster deployment is expected to carry as well: adaptive query
# execution (coalescing small shuffle partitions, splitting skewed ones) and
# Arrow for the few pandas-backed steps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sparkprep", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SPARKPREP_DRIVER_MEMORY", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written intermediates.

    Read from the session (``spark.checkpoint.dir`` or an already configured
    checkpoint directory). Only a local-mode session without one gets a fresh
    scratch folder; a cluster session without one is a configuration error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="sparkprep-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# Rows and bytes of an Arrow batch: Spark's own 10,000 rows of long texts, several
# copies of each in every Python worker, would fill an executor.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def few_rows(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to few rows and bytes; smaller limits stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?[0-9]+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per context).

    Operators that run Python on executors (model calls, the stemmer, a real
    tokenizer, the Arrow shard reader) import from this package there. When
    it is not installed on the executors it is zipped and added with
    ``addPyFile`` (Spark copies it to every executor).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # The zip is only read by the driver, which serves it to the executors
    # through addPyFile; no executor reads this folder.
    out = os.path.join(tempfile.mkdtemp(prefix="sparkprep-pkg-"), "sparkprep.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
