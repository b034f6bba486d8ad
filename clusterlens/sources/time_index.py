"""A table laid out for lookups by time and by key.

Rows are dealt into ranges of (time, key) and sorted in them, so a file holds a
short span of time, an instant or a key that many rows share is cut between files, and
row groups have narrow limits. Beside the data stands one row for each file with
its first and last time: a lookup by time opens only files that can match.
Parquet Bloom filters on the key let a lookup by key skip row groups that min
and max can't rule out, since keys are spread over all times.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class TimeIndex:
    """The table at ``path``, written by ``write``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, time: str, key: str, files: int | None = None, group_bytes: int = 16 << 20) -> None:
        """Replace the table. ``files`` defaults to the session's shuffle partitions; row
        groups have about ``group_bytes``. Rows without a time come first and are found by key
        only. ``df`` is read twice (the ranges are sampled)."""
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = "_place_" + "_".join(df.columns)[:40]  # cuts rows that are equal in time and key, too
        order = [F.col(time).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col(own).asc()]
        (df.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(n, *order)
         .sortWithinPartitions(*order).drop(own).write.mode("overwrite")
         .option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true")
         .parquet(f"{self.path}/data"))
        data = self.spark.read.schema(df.schema).parquet(f"{self.path}/data")
        (data.groupBy(F.col("_metadata.file_path").alias("file"))
         .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n_rows"))
         .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/files"))
        self.spark.createDataFrame([(time, key, df.schema.json())], "time string, key string, schema string").write.mode(
            "overwrite").parquet(f"{self.path}/layout")

    def _layout(self) -> tuple[str, str, str]:
        return tuple(self.spark.read.parquet(f"{self.path}/layout").first())

    def _data(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(paths or [f"{self.path}/data"]))

    def between(self, start: int, end: int) -> DataFrame:
        """The rows with start <= time < end, from the files that can hold one."""
        time, _, schema = self._layout()
        hit = self.spark.read.parquet(f"{self.path}/files").where((F.col("last") >= start) & (F.col("first") < end))
        paths = [r["file"] for r in hit.select("file").collect()]  # names of the files that are then read
        found = (F.col(time) >= start) & (F.col(time) < end)
        return self._data(schema, *paths).where(found) if paths else self._data(schema).where(F.lit(False))

    def where_key(self, keys: Sequence) -> DataFrame:
        """The rows with one of a few ``keys``; row groups whose limits or Bloom filter exclude all are skipped."""
        _, key, schema = self._layout()
        return self._data(schema).where(F.col(key).isin(*keys) if keys else F.lit(False))
