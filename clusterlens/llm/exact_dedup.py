"""Exact dedup against a persistent digest index (operator 10, native).

The index is a Parquet table at a path of its own, bucketed and sorted by
digest, with one row for each distinct text seen so far. A batch of documents
is reduced to digests, aggregated by digest before any join, and anti-joined
with the index by sort-merge: the batch is dealt into the index's own buckets,
whatever the session's shuffle partitions, so the index is read bucket by
bucket and never shuffled. New digests are appended as one partition named after the
batch, so that a repeated batch overwrites itself instead of counting twice.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import SPACES, stage, text_or_empty
from clusterlens.session import new_path


def digest(text: str = "text"):
    """SHA-256 (binary) of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(text_or_empty(text), SPACES, ""), 256))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row for each document: row, doc_id, digest, n_cp (code points)."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        digest(text).alias("digest"),
        F.char_length(text_or_empty(text)).cast("long").alias("n_cp"))


#: A digest is hot if more than one in this many rows has it; there are fewer such digests.
HOT = 1000


def _to_all(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``decided`` (written; one row for each digest, n of its rows) has for them.

    Hot digests, at most ``HOT`` whatever the size, are broadcast, so their rows
    stay where they are; the rest meet by sort-merge.
    """
    limit = rows.count() // HOT
    hot = F.broadcast(decided.where(F.col("n") > limit).limit(HOT))
    rest = rows.join(hot.select("digest"), "digest", "left_anti")
    return rows.join(hot, "digest").unionByName(rest.join(decided.where(F.col("n") <= limit).hint("merge"), "digest"))


class DigestIndex:
    """The persistent index at ``path``, created when it does not exist.

    Columns: digest, keep_id and keep_row (the row that stays), batch.
    ``buckets`` is fixed when the index is created, to the session's shuffle
    partitions by default, and stored beside it (``<path>-buckets``); opening it
    with another number raises. Batches are dealt into that many buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored_buckets(buckets)
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:12]
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} "
            "(digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            "PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _stored_buckets(self, wanted: int | None) -> int:
        place = f"{self.path}-buckets"
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

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Write the rows of one batch; the same batch again replaces its rows.
        ``fresh`` must not read the index itself."""
        fresh.createOrReplaceTempView(f"{self.name}_fresh")
        self.spark.sql(f"INSERT OVERWRITE {self.name} PARTITION (batch = '{batch}') "
                       f"SELECT digest, keep_id, keep_row FROM {self.name}_fresh")

    def ingest(self, docs: DataFrame, batch: str = "0", text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
        """Decide for every row of ``docs`` whether it stays, and append.

        Returns doc_id, keep_id, group_size, kept, digest, n_cp: one row for
        each row of ``docs``. Equal texts are texts with one digest. Where the
        index knows the digest from an earlier batch, that batch's row stays
        and all of these go. Otherwise the row with the most code points
        stays, then the smallest doc_id (null last), then the first row, so
        exactly one of repeated rows stays. group_size counts the equal rows
        of this batch, and the earlier one if there is one. Null, empty and
        white texts form one group. An empty table gives no rows. Other
        columns of ``docs`` are not read, whatever their names.
        """
        rows = stage(digests(docs, text, doc_id), "digests")
        groups = rows.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"),
                           F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best"))
        known = self.entries().where(F.col("batch") != batch).select("digest").hint("merge")
        dealt = groups.repartition(self.buckets, "digest")
        fresh = dealt.join(known, "digest", "left_anti").select("digest", "best.keep_id", "best.keep_row")
        self.append(stage(fresh, "fresh"), batch)
        decided = stage(dealt.select("digest", "n").join(self.entries().hint("merge"), "digest"), "decided")
        here = F.col("batch") == batch
        return _to_all(rows, decided).select(
            "doc_id", "keep_id",
            (F.col("n") + F.when(here, 0).otherwise(1)).cast("long").alias("group_size"),
            (here & (F.col("row") == F.col("keep_row"))).alias("kept"),
            "digest", "n_cp")


def keep_rows(docs: DataFrame, decided: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``ingest`` kept, with the columns of ``docs``.

    Rows are found again by digest, doc_id and length; of rows that are equal
    in all three, one stays.
    """
    key = "_key_" + hashlib.md5("|".join(docs.columns).encode()).hexdigest()[:8]

    def keyed(digest_col, id_col, n_col):
        return F.concat_ws(":", F.hex(digest_col), F.coalesce(id_col.cast("string"), F.lit("-")),
                           n_col.cast("string"))

    left = docs.withColumn(key, keyed(digest(text), F.col(doc_id).cast("long"),
                                      F.char_length(text_or_empty(text))))
    right = decided.where("kept").select(
        keyed(F.col("digest"), F.col("doc_id"), F.col("n_cp")).alias(key))
    return left.join(right, key, "left_semi").dropDuplicates([key]).drop(key)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    return index.ingest(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM k
"""
