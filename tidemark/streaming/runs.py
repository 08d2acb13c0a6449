"""Running a stream over all data there is now, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import new_folder


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; new files are read by the next run."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in spark.read.schema(schema).parquet(path).inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """Process everything available, then give the result as a table.

    Each micro-batch is written under its number, so one that runs again after a failure replaces itself. In mode
    ``complete`` the last batch is the result, otherwise all batches are. With ``folder`` a later run goes on where
    this one ended.
    """
    spark, folder = stream.sparkSession, folder or new_folder(stream.sparkSession, label)

    def put(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{folder}/out/batch={max(p['batchId'] for p in query.recentProgress)}")
    return spark.read.parquet(f"{folder}/out").drop("batch")
