"""Accounting-log text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without_bad_bytes(lines: DataFrame) -> DataFrame:
    """Lines without U+FFFD, as which undecodable bytes arrive, like a reader
    that ignores decode errors. Batch and stream readers share it."""
    return lines.withColumn("value", F.regexp_replace("value", "\ufffd", ""))


def read_log(spark: SparkSession, path: str, drop_bad_bytes: bool = True) -> DataFrame:
    """Log lines (column ``value``), one per line, split across tasks by file
    block; a compressed file is one split. Parse before any repartition: the
    typed rows are narrower than the text."""
    df = spark.read.text(path)
    return without_bad_bytes(df) if drop_bad_bytes else df


#: Columns of ``read_placed`` that say where a line stands.
PLACE = ["file", "block", "at"]


def read_placed(spark: SparkSession, path: str, drop_bad_bytes: bool = True) -> DataFrame:
    """Log lines with their place: file, the block's first byte in it, and a number
    ``at`` that grows by one from line to line of a block."""
    df = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    return without_bad_bytes(df) if drop_bad_bytes else df
