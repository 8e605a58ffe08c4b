"""Scratch tables in the folder that the driver and all executors share.

Cutting lineage with a written table survives the loss of executors, which a
local checkpoint does not. The folder is named by ``spark.checkpoint.dir``; only
where that is unset (tests, a laptop) does the module choose one of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: With this, a finished write's shuffle files go at once, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vellumite-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback[app] = f"file://{folder}"
    return _fallback[app]


class Scratch:
    """Named tables of one run of one operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back."""
        path = f"{self.root}/{name}"
        conf, before = self.spark.conf, self.spark.conf.get(SHUFFLE_CLEANUP, None)
        if before is not None:
            conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if before is not None:
                conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator; what others have kept is let go, as workers outlive them."""
    others = [x for x in _kept if x != owner]
    for other in others:
        del _kept[other]
    if others:
        release()
    return _kept.setdefault(owner, {})


def release() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its memory back when it is done."""

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return inner


#: Rows and bytes in a batch between the JVM and Python; long texts make Spark's defaults too large for an executor.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES_SETTING, BYTES_DEFAULT = "16m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size for plans that send whole texts to Python; it stays so, as these plans run when the caller asks for their rows."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if spark.conf.get(BYTES_SETTING, None) == BYTES_DEFAULT:
        spark.conf.set(BYTES_SETTING, BATCH_BYTES)


def crc_mod(column: str, modulus: int):
    """``crc32`` of a column's text form, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)
