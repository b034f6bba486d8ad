"""Lookups by time open few files; Bloom filters skip row groups by key."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clusterlens.sources.tables import compute
from clusterlens.sources.time_index import TimeIndex

COLS = "job_id long, event_time long, queue string"


def _rows(n=6000):
    rnd = random.Random(1)
    rows = [(rnd.randrange(10 ** 9) * 2, rnd.randrange(100_000), "q") for _ in range(n)]
    return rows + [(7, 500, "hot")] * 3000 + [(9, None, None), (None, 400, "x")]


def _read_files(df):
    return df.select(F.col("_metadata.file_path")).distinct().count()


def test_lookups_equal_plain_filters_and_open_few_files(spark, tmp_path):
    rows = _rows()
    index = TimeIndex(spark, str(tmp_path / "t"))
    index.write(compute(spark.createDataFrame(rows, COLS), "rows"), "event_time", "job_id", files=20)
    data = glob.glob(str(tmp_path / "t" / "data" / "*.parquet"))
    assert 15 <= len(data) <= 20
    assert max(pq.ParquetFile(f).metadata.num_rows for f in data) < 3000  # the instant that many rows share is cut
    key = lambda r: tuple(map(str, r))
    for low, high in ((10_000, 14_000), (500, 501), (-5, 0), (99_999, 10 ** 7)):
        got = index.between(low, high)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(
            (r for r in rows if r[1] is not None and low <= r[1] < high), key=key)
    few = index.between(10_000, 14_000)
    assert len(few.inputFiles()) <= 3 and "PushedFilters: [IsNotNull(event_time)" in few._jdf.queryExecution().toString()
    for keys in ([7], [rows[0][0], 9], [11], []):
        assert sorted(map(tuple, index.where_key(keys).collect()), key=key) == sorted((r for r in rows if r[0] in keys), key=key)
    again = TimeIndex(spark, str(tmp_path / "t"))
    assert again.between(0, 10 ** 6).count() == len(rows) - 1


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    """Odd numbers lie within every row group's limits, and only the filter says that none is there."""
    index = TimeIndex(spark, str(tmp_path / "t"))
    index.write(compute(spark.createDataFrame(_rows(), COLS), "rows"), "event_time", "job_id", files=4)
    for f in glob.glob(str(tmp_path / "t" / "data" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        assert all(meta.row_group(i).column(0).statistics.min < 10 ** 8 for i in range(meta.num_row_groups) if meta.row_group(i).num_rows > 500)

    def scanned(df):
        """Rows that the scan hands on."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if hasattr(plan, "executedPlan") and plan.nodeName().startswith("Adaptive") else plan
        return sum(int(x.metrics().apply("numOutputRows").value()) for x in [plan.collectLeaves().apply(0)])

    old = spark.conf.get("spark.sql.parquet.filterPushdown")
    absent = index.where_key([1_234_567])
    assert scanned(absent) == 0
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    try:
        assert scanned(index.where_key([1_234_567])) == 9002
    finally:
        spark.conf.set("spark.sql.parquet.filterPushdown", old)


def test_empty_table(spark, tmp_path):
    index = TimeIndex(spark, str(tmp_path / "t"))
    index.write(spark.createDataFrame([], COLS), "event_time", "job_id")
    assert index.between(0, 10).count() == 0 and index.where_key([1]).count() == 0
