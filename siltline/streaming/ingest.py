"""Logs that arrive as files, parsed as a stream. Parsing keeps no state between records, so the same functions serve; a file is a chunk, as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.sources import gitlog


def chunks(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(chunk_id, text) of each file that comes into the folder."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return stream.select(F.col("_metadata.file_path").alias("chunk_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return gitlog.parse_commits(chunks(spark, folder))


def numstat(spark: SparkSession, folder: str) -> DataFrame:
    return gitlog.parse_numstat(chunks(spark, folder))


def append(rows: DataFrame, target: str, checkpoint: str):
    """Write a stream as Parquet until what is there is done."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
