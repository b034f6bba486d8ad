"""Scalar functions: time zones, hour labels, weekday, signif, sentinels."""

import datetime as dt

from pyspark.sql import functions as F

from clusterlens.functions import (hour_block, hour_label, null_sentinel, signif, to_ts,
                                   weekday, weekday_index)


def test_golden_local_time(spark):
    # 1682116121 in America/Chicago is 2023-04-21 17:28:41 (daylight time).
    r = spark.range(1).select(to_ts(F.lit(1682116121), "America/Chicago").alias("t"),
                              to_ts(F.lit(1682116121), "UTC").alias("u")).first()
    assert r.t == dt.datetime(2023, 4, 21, 17, 28, 41)
    assert r.u == dt.datetime(2023, 4, 21, 22, 28, 41)


def test_session_zone_does_not_matter(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        r = spark.range(1).select(to_ts(F.lit(1682116121), "America/Chicago").alias("t"),
                                  hour_block(F.lit(1682116121), "America/Chicago").alias("h")).first()
        assert r.t == dt.datetime(2023, 4, 21, 17, 28, 41) and r.h == "17-18"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hour_labels(spark):
    rows = spark.range(24).select(hour_label(F.col("id").cast("int")).alias("l")).collect()
    labels = [r.l for r in rows]
    assert labels[0] == "00-01" and labels[9] == "09-10" and labels[23] == "23-24"


def test_dst_day_has_23_hours(spark):
    # 2024-03-10 in Chicago: clocks jump from 02:00 to 03:00.
    start = 1710050400  # 2024-03-10 00:00 CST
    df = spark.range(0, 24 * 3600, 3600).select((F.col("id") + start).alias("s"))
    hours = {r.h for r in df.select(hour_block("s", "America/Chicago").alias("h")).collect()}
    assert "02-03" not in hours and len(hours) == 23


def test_weekday(spark):
    r = spark.range(1).select(to_ts(F.lit(1704585600), "UTC").alias("t")).select(
        weekday("t").alias("w"), weekday_index("t").alias("i")).first()
    assert (r.w, r.i) == ("Sun", 1)  # 2024-01-07


def test_signif(spark):
    vals = [1682116500, 1682117500, 1682116499, 0, 5, 123456789012, -1682116500]
    df = spark.createDataFrame([(v,) for v in vals], "x bigint")
    got = [r.s for r in df.select(signif("x", 7).alias("s")).collect()]
    # ties go to the even neighbour
    assert got == [1682116000.0, 1682118000.0, 1682116000.0, 0.0, 5.0, 123456800000.0,
                   -1682116000.0]
    r = spark.range(1).select(signif(F.lit(1.23456789), 3).alias("a"),
                              signif(F.lit(0.000123456), 2).alias("b")).first()
    assert abs(r.a - 1.23) < 1e-12 and abs(r.b - 0.00012) < 1e-15


def test_null_sentinel(spark):
    df = spark.createDataFrame([(-1,), (3,), (None,)], "x bigint")
    assert [r.y for r in df.select(null_sentinel("x").alias("y")).collect()] == [None, 3, None]


def test_cluster_conf_sizes_partitions():
    from clusterlens.session import cluster_conf
    c = cluster_conf(100 * 2**40, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    small = cluster_conf(1 << 20, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 40
