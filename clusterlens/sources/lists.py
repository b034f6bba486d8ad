"""Ragged lookup lists (``key,v1,v2,...`` per line) and queue capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ragged_pairs(text: DataFrame, key: str = "key", value: str = "value",
                 line_col: str = "value", sep: str = ",",
                 drop_self_named: str | None = None) -> DataFrame:
    """Lines ``key,v1,v2,...`` -> one (key, value) row per listed value.

    Blank fields are skipped, whitespace trimmed, repeated pairs kept once.
    A key may span several lines. ``drop_self_named`` removes junk lines
    whose key is that name (a file listing itself).
    """
    parts = F.split(F.col(line_col), sep)
    df = text.select(F.trim(F.get(parts, 0)).alias(key),
                     F.slice(parts, F.lit(2), F.size(parts)).alias("_vals"))
    if drop_self_named is not None:
        df = df.filter(F.col(key) != F.lit(drop_self_named))
    out = df.select(key, F.explode("_vals").alias(value)).select(key, F.trim(value).alias(value))
    return out.filter((F.col(key) != "") & (F.col(value) != "")).distinct()


def read_ragged(spark: SparkSession, path: str, key: str = "key", value: str = "value",
                sep: str = ",") -> DataFrame:
    """Read a ragged list file; a line naming its own file is dropped."""
    name = path.rstrip("/").split("/")[-1]
    return ragged_pairs(spark.read.text(path), key, value, sep=sep, drop_self_named=name)


def capacity_lines(text: DataFrame, line_col: str = "value") -> DataFrame:
    """``queue,cores`` lines without header -> (queue STRING, total_cores INT); a
    count that is no number is NULL, lines without a queue are left out."""
    parsed = F.from_csv(F.col(line_col), "queue string, total_cores int", {"mode": "PERMISSIVE"})
    return text.select(parsed.alias("c")).select("c.queue", "c.total_cores").filter(F.col("queue").isNotNull())


def read_capacity(spark: SparkSession, path: str) -> DataFrame:
    return capacity_lines(spark.read.text(path))
