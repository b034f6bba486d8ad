"""Positions over the whole table and within groups, by ranges."""

import random

from pyspark.sql import functions as F

from clusterlens.operators.positions import numbered, row_numbered


def _brute(rows):
    groups = {}
    for g, k, t in rows:
        groups.setdefault(g, []).append((k is not None, k if k is not None else 0, t))
    return sorted((g is not None, g or "", *key, i, len(v))
                  for g, v in groups.items() for i, key in enumerate(sorted(v)))


def test_positions_within_groups_with_a_hot_group_and_nulls(spark):
    rnd = random.Random(3)
    rows = [("hot", 7, i) for i in range(700)]
    rows += [(rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 3]), 1000 + i) for i in range(900)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, t long").repartition(5)
    got = numbered(df, [F.col("k").asc_nulls_first(), F.col("t").asc()], by=["g"], size="n", ranges=6)
    assert got.columns == ["g", "k", "t", "position", "n"]
    assert sorted((r.g is not None, r.g or "", r.k is not None, r.k or 0, r.t, r.position, r.n)
                  for r in got.collect()) == _brute(rows)


def test_positions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, k long")
    assert numbered(df, [F.col("k").asc()], by=["g"]).count() == 0
    assert numbered(df, [F.col("k").asc()], size="n").columns == ["g", "k", "position", "n"]
    assert row_numbered(df, "k").count() == 0


def test_offsets_are_a_joined_table(spark):
    """No expression grows with the number of ranges."""
    df = spark.range(5000).withColumn("k", F.col("id") % 7)
    few, many = (row_numbered(df, "k", tiebreak=["id"], ranges=n) for n in (2, 300))
    assert few.exceptAll(many).count() == 0
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and len(plan) < 5000
