"""A persistent index of row keys that keeps them unique across loads.

The index is a Parquet table bucketed and sorted by key, with one partition for
each load. A load is reduced to one row for each of its keys before any join,
then anti-joined with the index by sort-merge: the load is dealt into the
index's own buckets, and the index is read bucket by bucket and never
shuffled, whatever the session's shuffle partitions. The number of buckets is
stored beside the index.

Rows of a key meet only in the map-side combined aggregation; which rows were
chosen is then looked up by their own number, so a key that many rows repeat
is never a hot key of a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import compute


def key_of(columns: Sequence[str]) -> Column:
    """The values of ``columns`` as one text, different for different values; NULL is a value."""
    def one(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[one(c) for c in columns])


class KeyIndex:
    """The index at ``path``, created when it doesn't exist.

    ``buckets`` defaults to the stored number, or for a new index to the session's
    shuffle partitions; another number than the stored one raises.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._stored_buckets(buckets)
        self.name = "key_index_" + hashlib.md5(self.path.encode()).hexdigest()[:12]
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, load STRING) USING parquet "
                  f"PARTITIONED BY (load) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}/keys'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _stored_buckets(self, wanted: int | None) -> int:
        place = f"{self.path}/buckets"
        try:
            stored = self.spark.read.schema("buckets int").parquet(place).first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(stored).alias("buckets")).write.parquet(place)
        if wanted not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {wanted}")
        return stored

    def entries(self, loads: Sequence[str] | None = None) -> DataFrame:
        """key, load; of some loads if they are named."""
        table = self.spark.table(self.name)
        return table if loads is None else table.where(F.col("load").isin(*loads) if loads else F.lit(False))

    def put(self, keys: DataFrame, load: str) -> None:
        """Store the column ``key`` of a written table as ``load``, replacing what the load stored before."""
        view = f"{self.name}_fresh"
        keys.select("key").repartition(self.buckets, "key").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE {self.name} PARTITION (load = '{load}') SELECT key FROM {view}")

    def merge(self, loads: Sequence[str], load: str) -> None:
        """Store the keys of ``loads`` once more as one load. The old ones stay until they are dropped."""
        self.put(compute(self.entries(loads).select("key").distinct(), "merged-keys"), load)

    def drop(self, loads: Sequence[str]) -> None:
        for load in loads:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (load = '{load}')")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys/load={load}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def loads(self) -> list[str]:
        return sorted(r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def fresh(self, keys: DataFrame, loads: Sequence[str] | None = None) -> DataFrame:
        """The rows of ``keys`` (key, one row for each) whose key no load (of ``loads``) holds."""
        known = self.entries(loads).select("key").hint("merge")
        return keys.repartition(self.buckets, "key").join(known, "key", "left_anti")

    def split(self, rows: DataFrame, keys: Sequence[str], load: str,
              loads: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(first, repeated): the rows of ``rows`` whose key is new and the others.

        Of rows with one key within the load, the least in all its columns, in their
        order, is the first. ``load`` itself doesn't count as known, so the same load
        again gives the same split. The keys of ``first`` are stored as ``load``. NULLs
        in a key are equal; no rows give two empty tables. ``repeated`` has a column
        ``reason`` more: ``known`` for the least row of a key that an earlier load
        holds, ``within_load`` for a row that repeats another one of this load.
        """
        known = [x for x in (self.loads() if loads is None else loads) if x != load]
        numbered = compute(rows.select(F.struct(*rows.columns).alias("r"), key_of(keys).alias("key"),
                                       F.monotonically_increasing_id().alias("n")), "load")
        least = compute(numbered.groupBy("key").agg(F.min(F.struct("r", "n"))["n"].alias("n")), "least")
        new = compute(self.fresh(least, known), "fresh")
        self.put(new, load)
        chosen = least.select("n", F.lit("known").alias("reason")).join(new.select("n"), "n", "left_anti")
        first = numbered.join(new.select("n"), "n", "left_semi").select("r.*")
        repeated = (numbered.join(new.select("n"), "n", "left_anti").join(chosen, "n", "left")
                    .select("r.*", F.coalesce("reason", F.lit("within_load")).alias("reason")))
        return first, repeated
