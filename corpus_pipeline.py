"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scan, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them to ``documents`` in that order and
writes every stage's rows to the shared scratch folder before the next one
reads them, so a lost executor never sends the work back past a stage.

All stages but the last return the columns of ``documents``:

1. language: documents without a letter or with a prediction of low
   confidence go (only the former where no document has a language to learn);
2. exact: one row of each group of equal texts stays;
3. near: one document of each group of near-duplicates (five-word shingles,
   similarity of 0.8 or more) stays, the one with the smallest doc_id (null
   last, then the first row), also where rows repeat a doc_id;
4. secrets: every reported span is replaced in the text by a placeholder, a
   possible secret already when an identifier or an endpoint is near, and
   n_chars is counted again;
5. pack: the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from clusterlens.llm.common import stage
from clusterlens.session import new_path

MIN_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.train(docs), MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    return exact_dedup.keep_rows(docs, index.ingest(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, either=True).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("pack", pack)]

#: Predictions, signatures and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
