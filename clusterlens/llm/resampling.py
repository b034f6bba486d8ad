"""Importance resampling towards good text (operator 4).

Two hashed n-gram models, counts of words and word pairs in ``BUCKETS``
buckets with additive smoothing, describe target text and raw text. A
document's log weight is the mean log ratio of the two models over its n-grams,
times ``LENGTH``: the weight of a text of that many n-grams, so that long and
short documents compare. Adding independent Gumbel noise and taking the k
largest values draws k documents without replacement with chances in
proportion to their weights.

The raw model counts every document. The target is a sample of documents
labelled good, at most ``TARGET`` of them, the least by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import stage
from clusterlens.llm.shingles import mix, word_hashes
from clusterlens.operators.positions import row_numbered
from clusterlens.session import ship_package

BUCKETS = 10_000
TARGET = 20_000
LENGTH = 100
SMOOTHING = 1.0


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the text's words and pairs of neighbouring words by bucket."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    pairs = mix(w[:-1] * np.uint64(0xD6E8FEB86659FD93) + w[1:])
    return np.bincount(np.concatenate((w, pairs)) % np.uint64(BUCKETS), minlength=BUCKETS)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of the smoothed chance of each bucket in target text over that in raw text."""
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """Log ratios by bucket; ``target_ids`` has a column doc_id, of which at most
    TARGET distinct values are used."""
    ship_package(docs.sparkSession)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("_target")).where("_target IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("_target"), "_target").limit(TARGET)
    marked = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
              .join(F.broadcast(ids), F.col("doc_id") == F.col("_target"), "left")
              .select("text", F.col("_target").isNotNull().alias("good")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for t, g in zip(pdf["text"], pdf["good"], strict=True):
                c = ngram_counts(t)
                raw += c
                if g:
                    good += c
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "good": good[at]})

    found = (marked.mapInPandas(count, "bucket long, raw long, good long")
             .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect())
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return log_ratios(good, raw)


def log_weight(ratios: np.ndarray, text: str = "text") -> Column:
    """The log weight of a text; null without words."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            c = ngram_counts(t)
            n = c.sum()
            out.append(LENGTH * float(c @ ratios) / n if n else None)
        return pd.Series(out, dtype="float64")

    return run(F.col(text))


def gumbel(*key: Column) -> Column:
    """Gumbel noise from a hash of ``key``: the same for the same key."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.85, seed: int = 0, text: str = "text",
             doc_id: str = "doc_id") -> DataFrame:
    """doc_id, log_weight, score (weight with noise), rank (by score from 1), kept:
    one row for each row of ``docs``; the ceil(share * rows with words) first ones are kept.

    Null, empty and white texts have no weight, score or rank and are never
    kept. Rows that repeat a doc_id draw noise of their own by place in the
    table; equal scores rank by doc_id, then place. Without target ids all
    texts weigh by the smoothed models alike. Other columns are not read, and
    an empty table gives no rows.
    """
    ratios = fit(docs, target_ids, text, doc_id)
    row = F.monotonically_increasing_id()
    scored = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"),
                               log_weight(ratios, text).alias("log_weight")), "scored")
    # the first row of a doc_id draws by doc_id alone; rows are found by their own number, so that
    # a doc_id which many rows repeat is no hot key
    first = scored.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("row"))
    scored = scored.join(first.select("row", F.lit(True).alias("first")), "row", "left")
    drawn_by = F.when(F.col("first"), F.col("doc_id")).otherwise(
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "row")), F.col("row")))
    scored = stage(scored.withColumn("score", F.col("log_weight") + gumbel(drawn_by, F.lit(seed))).drop("first"), "drawn")
    n = scored.where("log_weight IS NOT NULL").count()
    ranked = row_numbered(scored, "score", out="rank", tiebreak=["doc_id", "row"], descending=True)
    return ranked.select(
        "doc_id", "log_weight", "score", F.when(F.col("score").isNotNull(), F.col("rank")).alias("rank"),
        (F.col("score").isNotNull() & (F.col("rank") <= F.ceil(F.lit(share) * n))).alias("kept"))


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return resample(docs, good)
