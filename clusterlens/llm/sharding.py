"""Sharding by rendezvous hashing of stable record keys (operator 13).

Every record goes to the shard whose weighted score for the record's key is
best, and the score of a shard depends on the key, that shard's number and its
weight alone. So a further shard takes records only into itself, a shard that
is dropped gives away only its own, and a changed weight moves records only to
or from the shard it belongs to. Nothing is gathered: the choice is an
expression of the row.

Within a shard, records are numbered without gaps. Shards are few and large,
so the numbers don't come from a window over a shard but from ranges of the
whole order, which cut a shard - and a key that many rows repeat - into many
tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import picked, stage, text_or_empty
from clusterlens.operators.positions import numbered

#: Bytes that a record costs beside its text.
RECORD_BYTES = 8


def key_text(key: Column) -> Column:
    """The key as text; a null key counts as empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (a number of ``weights``) of a key: the least -ln(u) / weight.

    u, between 0 and 1, comes from 52 bits of the MD5 of key and shard number, so
    any engine gives the same shard. A shard's share of all keys is its share of
    the weights. Equal scores go to the smaller number.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight"))
                       for s, w in sorted(weights.items())])

    def score(s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), s["shard"].cast("string"))), 1, 13), 16, 10)
        u = (bits.cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))["shard"]


def assign(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row for each row of ``docs``: key, size, text_crc32, shard, slot
    and, with ``grown`` weights, grown_shard.

    size is the text's UTF-8 bytes and ``RECORD_BYTES`` (null text: none);
    text_crc32 is that of the text's bytes (null text: of none, 0). Rows with the
    same key, null keys among them, share a shard; each row has a slot of its own.
    Slots run from 0 in the order of key (null first), size, text_crc32, then place
    in the input. An empty table gives no rows. Other columns aren't read, whatever
    their names. Long texts are read once, in the row, and don't travel.
    """
    rows = picked(docs, key=key, text=text)
    body = text_or_empty("text")
    columns = [F.col("key"), (F.octet_length(body).cast("long") + RECORD_BYTES).alias("size"),
               F.crc32(body.cast("binary")).alias("text_crc32"),
               shard_of(key_text(F.col("key")), weights).alias("shard")]
    if grown:
        columns.append(shard_of(key_text(F.col("key")), grown).alias("grown_shard"))
    narrow = stage(rows.select(*columns, F.monotonically_increasing_id().alias("row")), "shards")
    order = [F.col("key").asc_nulls_first(), *(F.col(c).asc() for c in ("size", "text_crc32", "row"))]
    return numbered(narrow, order, by=["shard"], out="slot").drop("row")


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """shard, n_rows, bytes of the shards that hold a row."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))


def moves(assigned: DataFrame) -> DataFrame:
    """(shard, grown_shard, n_rows) of the rows that change their shard."""
    return (assigned.where("shard <> grown_shard").groupBy("shard", "grown_shard")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id",
                 column: str = "shard") -> None:
    """The documents as Parquet files in one folder for each shard, replacing what is there.

    All columns are kept; the folders are named by ``column``, which must not be
    one of them (in any case). Rows of a shard meet in files of the size that
    adaptive execution aims at, so a large shard is written by many tasks.
    """
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"documents have a column {column!r}; name another")
    at = next((i for i, c in enumerate(docs.columns) if c == key), None)
    if at is None:
        raise ValueError(f"no column {key!r}; have {docs.columns}")
    by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    dealt = by_place.withColumn("to", shard_of(key_text(F.col(f"c{at}")), weights)).hint("rebalance", F.col("to"))
    dealt.toDF(*docs.columns, column).write.mode("overwrite").partitionBy(column).parquet(path)


#: The shards of the registered query, all of one weight, and one more.
SHARDS = {s: 1.0 for s in range(24)}
GROWN = {**SHARDS, len(SHARDS): 1.0}


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs, SHARDS, GROWN).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(n: int) -> str:
    """The shard of a key among n of weight 1: the greatest 52 bits, then the smaller number."""
    return (f"list_max(list_transform(range({n}), lambda s: {{'bits': ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')"
            " || '|' || CAST(s AS VARCHAR)), 1, 13))::BIGINT, 'least': -s}))")


OP13_SQL = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(i)) x),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda h: ('0x' || h)::BIGINT) AS bytes,
         CAST(-({_sql_shard(24)}).least AS INTEGER) AS shard,
         CAST(-({_sql_shard(25)}).least AS INTEGER) AS grown_shard
  FROM documents),
c AS (
  SELECT doc_id, size, shard, grown_shard,
         xor(list_reduce(list_prepend(4294967295, bytes),
                         lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM c
"""
