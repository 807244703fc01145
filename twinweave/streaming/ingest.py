"""Incremental ingest of archives: each is read once, as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import from_archives, typed

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Typed files of the archives in a folder, as a stream."""
    raw = (spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files_per_trigger).load(folder))
    return typed(from_archives(raw.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("project_id"), "content")))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Writes what is new since the last call to a Parquet folder, by file type."""
    stream_files(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy(
        "file_type").trigger(availableNow=True).start().awaitTermination()
