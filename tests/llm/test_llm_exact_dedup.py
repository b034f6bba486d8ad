import hashlib
import re

import pytest

from clusterlens.llm.exact_dedup import DigestIndex, digests, keep_rows
from clusterlens.session import new_path

SCHEMA = "doc_id long, text string, digest string, row int"
ROWS = [(1, "a b", "x", 1), (2, "ab", "x", 1), (3, " a  b\t", "x", 1), (4, None, None, None), (5, "", "x", 2),
        (6, " \n", "x", 2), (7, "é 𝒳", "x", 3), (None, "é𝒳 ", "x", 3), (8, "ab", "x", 1), (8, "ab", "x", 1),
        (9, "only", "x", 1), (10, "x" * 200_000, "x", 1), (11, "x " * 200_000, "x", 1), (None, "lone", "x", 1)]


def brute(rows):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest()
        groups.setdefault(key, []).append((-len(t or ""), d is None, d or 0, i))
    best = {k: min(v) for k, v in groups.items()}
    return sorted((str(rows[x[3]][0]), str(rows[best[k][3]][0]), len(v), x[3] == best[k][3], k.hex())
                  for k, v in groups.items() for x in v)


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.digest.hex()) for r in df.collect())


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = DigestIndex(spark, new_path(spark, "t")).ingest(docs)
    assert found(got) == brute(ROWS)
    kept = keep_rows(docs, got)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[4] for r in brute(ROWS)})


def test_later_batches_meet_the_index(spark):
    path = new_path(spark, "t")
    first, second = ROWS[:5], [(20, "a  b", "", 0), (21, "new", "", 0), (22, "n ew", "", 0), (23, None, "", 0)]
    index = DigestIndex(spark, path, buckets=4)
    index.ingest(spark.createDataFrame(first, SCHEMA), "one")
    reopened = DigestIndex(spark, path, buckets=4)
    for _ in range(2):  # a repeated batch gives the same again
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept)
               for r in reopened.ingest(spark.createDataFrame(second, SCHEMA), "two").collect()}
        assert got == {20: (3, 2, False), 21: (22, 2, False), 22: (22, 2, True), 23: (4, 2, False)}
        assert reopened.entries().count() == 3


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_table_and_nulls(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = DigestIndex(spark, new_path(spark, "t")).ingest(docs)
    assert got.count() == len(rows) == keep_rows(docs, got).count()


def test_index_side_is_not_shuffled(spark):
    index = DigestIndex(spark, new_path(spark, "t"), buckets=8)
    index.ingest(spark.createDataFrame(ROWS, SCHEMA))
    groups = digests(spark.range(9).selectExpr("id AS doc_id", "string(id) AS text")).groupBy("digest").count()
    plan = groups.join(index.entries().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 8 out of 8" in plan
    assert plan.count("Exchange") == 1


def test_reopened_under_other_partitions_nothing_is_forgotten(spark):
    path, docs = new_path(spark, "t"), spark.range(200).selectExpr("id AS doc_id", "concat('text', id) AS text")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        index = DigestIndex(spark, path)
        assert index.ingest(docs, "one").where("kept").count() == 200
        spark.sql(f"DROP TABLE {index.name}")  # as a new catalog
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        again = DigestIndex(spark, path)
        assert again.buckets == 8
        assert again.ingest(docs, "two").where("kept").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    with pytest.raises(ValueError, match="has 8 buckets"):
        DigestIndex(spark, path, buckets=5)


def test_hot_digest_is_broadcast_and_the_rest_merged(spark):
    from tools.plans import final_plan

    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    got = DigestIndex(spark, new_path(spark, "t")).ingest(docs)
    plan = final_plan(got)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert got.where("kept").count() == 4001
    assert got.where("group_size = 2000 AND keep_id = 0").count() == 2000
