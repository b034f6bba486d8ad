"""Rows that no sound log holds end no job and drop no other rows."""

import pytest
from pyspark.sql import functions as F

from clusterlens.functions.time import to_ts
from clusterlens.operators import capacity as cap
from clusterlens.operators import series as S
from clusterlens.operators.clean import job_times, time_rejects
from clusterlens.sources.tables import read_table, write_table

COLS = ("job_id long, queue string, approx_start long, approx_end long, num_processors long, avg_mem long, "
        "run_time long, ineligible_pend_time long, num_gpu_rusages long")
GOOD = [(1, "q", 1000, 5000, 2, 1, 1, 1, 1), (2, "q", 3000, 4000, 3, -1, 1, 1, 0)]
FAR = [(3, "q", 2000, 9 * 10 ** 18, 1, 1, 1, 1, 1), (4, "q", -9 * 10 ** 18, 9 * 10 ** 18, 1, 1, 1, 1, 1),
       (5, "q", 2 ** 62, 2 ** 62 + 7, 1, 1, 1, 1, 1), (6, "r", 1000, 1000 + 2 ** 32 + 1, 1, 1, 1, 1, 1)]


@pytest.mark.parametrize("method", ["explode", "sweep"])
@pytest.mark.parametrize("step", [1000, 1])
def test_far_intervals_are_rejects_and_the_rest_stays(spark, method, step):
    good, all_ = spark.createDataFrame(GOOD, COLS), spark.createDataFrame(GOOD + FAR, COLS)
    want = sorted(S.usage_series(good, step=step, clamp=False, method=method).collect())
    assert sorted(S.usage_series(all_, step=step, clamp=False, method=method).collect()) == want
    assert len(want) == (5 if step == 1000 else 4001)


def test_reasons_of_rejected_intervals(spark):
    rows = GOOD + FAR + [(7, "q", 9000, 1000, 1, 1, 1, 1, 1), (8, "q", None, 5000, 1, 1, 1, 1, 1)]
    got = S.interval_rejects(spark.createDataFrame(rows, COLS), clamp=False).first().asDict()
    assert got == {"n_jobs": 8, "n_covering": 2, "n_reversed": 1, "n_too_long": 4, "n_before_first": 0, "n_unknown": 1}


def test_fine_steps_are_generated_in_blocks(spark):
    df = spark.createDataFrame([(1, "q", 5, 200_004, 2, 1, 1, 1, 1), (2, "q", 70_000, 70_100, 1, 1, 1, 1, 1)], COLS)
    a = S.usage_series(df, step=1, clamp=False)
    b = S.usage_series(df, step=1, clamp=False, method="sweep")
    assert a.count() == 200_000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.agg(F.sum("cpus")).first()[0] == 400_000 + 101


@pytest.mark.parametrize("kind", ["double", "decimal(10,2)", "float"])
def test_fractions_add_up_before_they_are_cut(spark, kind):
    df = spark.createDataFrame([("q", 0, 2000, 1.5), ("q", 1000, 2000, 1.5), ("q", 2000, 2000, float("nan"))],
                               "queue string, approx_start long, approx_end long, w double")
    df = df.withColumn("w", F.col("w").try_cast(kind))
    got = [sorted(S.usage_series(df, measures={"w": "w"}, clamp=False, method=m).collect()) for m in ("explode", "sweep")]
    assert got[0] == got[1] and [r.w for r in got[0]] == [1, 3, 3]


def test_far_times_become_null_and_are_counted(spark):
    df = spark.createDataFrame([(10 ** 18, 5, "7"), (-10 ** 18, 5, "9223372036854775807"), (0, -2 ** 63, "1"), (None, 1, None)],
                               "start_time long, submit_time long, run_time string").withColumn("event_time", F.col("start_time"))
    got = job_times(df, "America/Chicago").collect()
    assert [r.start_ts is None for r in got] == [True, True, False, True]
    assert [r.pend_time for r in got] == [10 ** 18 - 5, -10 ** 18 - 5, None, None]
    counts = {r.column: r.n_rows for r in time_rejects(df, "start_time", "submit_time").collect()}
    assert counts == {"start_time": 2, "submit_time": 1}
    ends = spark.createDataFrame([(253_402_128_000,), (-62_135_510_400,)], "t long")
    for zone in ("UTC", "Asia/Tokyo", "America/Chicago"):
        assert ends.select(to_ts("t", zone).cast("string").alias("x")).where("x IS NULL").count() == 0


def test_a_queue_listed_twice_keeps_its_rows_single(spark):
    series = spark.createDataFrame([("q", 1000, 5)], "queue string, second long, cpus long")
    listed = spark.createDataFrame([("q", 10), ("q", 20), ("r", 3), ("r", 3)], "queue string, total_cores int")
    assert [(r.total_cores, r.utilisation) for r in cap.utilisation(series, listed).collect()] == [(20, 0.25)]
    assert [tuple(r) for r in cap.capacity_conflicts(listed).collect()] == [("q", 10, 20)]


def test_csv_table_reads_back_what_was_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n long, t string")
    path = write_table(df, str(tmp_path / "t"), fmt="csv")
    assert sorted(map(tuple, read_table(spark, path, "csv").collect())) == [("1", 'a "b", c'), ("2", None)]
    back = read_table(spark, path, "csv", schema="n long, t string")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
