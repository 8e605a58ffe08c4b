"""Documents as a stream: packages that arrive in a folder are scanned, and edited batch by batch. An extension, not an operator of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumite.plans.package import edit_packages
from vellumite.sinks.docx import save_packages

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Binary files of packages as they arrive."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").load(folder)


def arrivals(files: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Files and bytes by window of their modification time; files later than the watermark are left out."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", width)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select("window.start", "window.end", "files", "bytes")


def edit_stream(files: DataFrame, operations: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Applies ``operations`` (see plans.package) to each package once and writes it to a folder."""

    def one(batch: DataFrame, _: int) -> None:
        save_packages(edit_packages(batch, operations), folder).write.format("noop").mode("overwrite").save()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
