"""Unique keys across loads: a plain dictionary says which rows are first."""

import random

import pytest
from pyspark.sql import functions as F
from tools.plans import final_plan

from clusterlens.sources.key_index import KeyIndex

COLS = "a long, b string, v long"


def _split(index, spark, rows, load):
    first, repeated = index.split(spark.createDataFrame(rows, COLS).repartition(3), ["a", "b"], load)
    return [sorted(map(tuple, x.collect()), key=str) for x in (first, repeated)]


def _order(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def _brute(seen, rows):
    first, repeated = [], []
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for key, group in groups.items():
        group.sort(key=_order)
        if key in seen:
            repeated += [(*group[0], "known")]
        else:
            first.append(group[0])
        repeated += [(*r, "within_load") for r in group[1:]]
    return set(groups), sorted(first, key=str), sorted(repeated, key=str)


def test_loads_with_repeats_within_and_across(spark, tmp_path):
    rnd, index, seen = random.Random(4), KeyIndex(spark, str(tmp_path / "i")), set()
    for load in range(3):
        rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, "", "x", "1:x"]), rnd.randrange(5)) for _ in range(120)]
        rows += [(7, "hot", 1)] * 60
        keys, first, repeated = _brute(seen, rows)
        for _ in range(2):  # the same load again gives the same split
            assert _split(index, spark, rows, f"l{load}") == [first, repeated]
        seen |= keys
    assert index.loads() == ["l0", "l1", "l2"] and index.entries().count() == len(seen)


def test_reopened_under_other_partitions_nothing_is_forgotten(spark, tmp_path):
    path, rows = str(tmp_path / "i"), [(i, "x", 0) for i in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(_split(KeyIndex(spark, path), spark, rows, "one")[0]) == 200
        spark.sql(f"DROP TABLE {KeyIndex(spark, path).name}")  # as a new catalog
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        again = KeyIndex(spark, path)
        assert again.buckets == 8
        assert len(_split(again, spark, rows, "two")[0]) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    with pytest.raises(ValueError, match="has 8 buckets"):
        KeyIndex(spark, path, buckets=5)


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), buckets=6)
    _split(index, spark, [(i, "x", 0) for i in range(50)], "one")
    keys = spark.range(20).select(F.col("id").cast("string").alias("key"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            plan = final_plan(index.fresh(keys))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, n
        assert "SelectedBucketsCount: 6 out of 6" in plan


def test_merged_and_dropped_loads(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"))
    for load in ("a", "b", "c"):
        _split(index, spark, [(i, load, 0) for i in range(10)], load)
    index.merge(["a", "b"], "ab")
    assert index.loads() == ["a", "ab", "b", "c"]
    index.drop(["a", "b"])
    assert index.loads() == ["ab", "c"] and index.entries(["ab"]).count() == 20
    assert [len(x) for x in _split(index, spark, [(3, "a", 0), (3, "c", 0), (3, "d", 0)], "d")] == [1, 2]


def test_empty_load(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"))
    assert _split(index, spark, [], "none") == [[], []]
    assert _split(index, spark, [(1, None, 2)], "one") == [[(1, None, 2)], []]
