"""Interval jobs -> tick series: both plans, edge cases, merge of partials."""

from pyspark.sql import functions as F

from clusterlens.operators import series as S
from clusterlens.operators.clean import log_entries, with_grid_times
from clusterlens.plans import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"

COLS = "job_id bigint, queue string, approx_start bigint, approx_end bigint, " \
       "num_processors bigint, avg_mem bigint, run_time bigint, " \
       "ineligible_pend_time bigint, num_gpu_rusages bigint"


def _df(spark, rows):
    return spark.createDataFrame(rows, COLS)


def _as_dict(df):
    return {(r.queue, r.second): (r.cpus, r.mem, r.run, r.pend, r.gpu) for r in df.collect()}


def test_both_ends_included_and_clamp(spark):
    rows = [(1, "q", 1000, 3000, 2, 10, 5, 1, 0),
            (2, "q", 0, 2000, 1, -1, 5, -1, 1),      # starts before the first event
            (3, "r", 5000, 5000, 4, -1, -1, -1, -1)]  # start == end; all measures missing
    df = _df(spark, rows)
    got = _as_dict(S.usage_series(df))
    # first event = min end = 2000: job 2 is clamped to [2000, 2000]
    assert got == {("q", 2000): (3, 10, 10, 1, 1), ("q", 3000): (2, 10, 5, 1, 0),
                   ("r", 5000): (4, 0, 0, 0, 0)}
    assert _as_dict(S.usage_series(df, method="sweep")) == got


def test_ticks_before_first_event_dropped(spark):
    rows = [(1, "q", 1000, 3000, 2, 10, 5, 1, 0), (2, "q", 0, 2000, 1, 7, 5, 3, 1)]
    got = _as_dict(S.usage_series(_df(spark, rows)))
    assert min(k[1] for k in got) == 2000


def test_reversed_interval_covers_nothing(spark):
    rows = [(1, "q", 5000, 3000, 2, 10, 5, 1, 0), (2, "q", 3000, 4000, 1, 1, 1, 1, 1)]
    got = _as_dict(S.usage_series(_df(spark, rows), clamp=False))
    assert got == {("q", 3000): (1, 1, 1, 1, 1), ("q", 4000): (1, 1, 1, 1, 1)}
    got2 = _as_dict(S.usage_series(_df(spark, rows), clamp=False, method="sweep"))
    assert got2 == got


def test_closed_left(spark):
    rows = [(1, "q", 1000, 3000, 2, 0, 0, 0, 0), (2, "q", 3000, 4000, 1, 0, 0, 0, 0)]
    both = _as_dict(S.usage_series(_df(spark, rows), clamp=False))
    left = _as_dict(S.usage_series(_df(spark, rows), clamp=False, closed="left"))
    assert both[("q", 3000)][0] == 3 and left[("q", 3000)][0] == 1
    assert ("q", 4000) not in left


def test_sweep_equals_explode_on_fixture(spark):
    entries = log_entries(fx.jobs(spark, SF_SMALL))
    a = S.usage_series(entries, method="explode")
    b = S.usage_series(entries, method="sweep")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sweep_small_blocks_and_gaps(spark):
    # Gaps between jobs, jobs crossing many blocks, off-grid phases.
    rows = [(1, "q", 0, 50000, 1, 1, 1, 1, 1), (2, "q", 70000, 71000, 2, 2, 2, 2, 2),
            (3, "q", 500, 9500, 4, 4, 4, 4, 4), (4, "r", 10, 10, 8, 8, 8, 8, 8)]
    df = _df(spark, rows)
    a = S.usage_series(df, clamp=False)
    b = S.usage_sweep(df, clamp=False, block_ticks=3)
    assert sorted(a.collect()) == sorted(b.collect())


def test_merge_partials_equals_one_shot(spark):
    entries = log_entries(fx.jobs(spark, SF_SMALL))
    first = S.first_event(entries)
    day = F.floor(F.col("event_time") / 86400)
    parts = S.usage_series(entries.withColumn("b", day % 3), group=("b", "queue"), first=first)
    merged = S.merge_partials(parts)
    one = S.usage_series(entries)
    assert merged.exceptAll(one).count() == 0 and one.exceptAll(merged).count() == 0


def test_grid_rounding(spark):
    df = spark.createDataFrame([(1682116500, 1682117500)], "start_time bigint, event_time bigint")
    r = with_grid_times(df).first()
    assert (r.approx_start, r.approx_end) == (1682116000, 1682118000)


def test_hot_queue_is_split_into_blocks(spark):
    # One queue holds most jobs; the sweep's running sum still runs per time
    # block, so the largest window partition is bounded by block_ticks.
    rows = [(i, "hot", 1000 * (i % 500), 1000 * (i % 500) + 5000, 1, 1, 1, 1, 1) for i in range(3000)]
    rows += [(10000 + i, "cold", 1000 * i, 1000 * i + 2000, 1, 1, 1, 1, 1) for i in range(100)]
    df = _df(spark, rows)
    a = S.usage_series(df, clamp=False)
    b = S.usage_sweep(df, clamp=False, block_ticks=16)
    assert sorted(a.collect()) == sorted(b.collect())
    blocks = (df.filter("queue = 'hot'")
                .select(F.floor(F.col("approx_start") / (1000 * 16)).alias("b")).distinct().count())
    assert blocks > 20


def test_sweep_of_jobs_that_end_between_their_ticks(spark):
    rows = [(i, "q", 300 * i, 300 * i + 137 * (i % 11), i % 5, 1, 1, 1, 1) for i in range(60)]
    df = _df(spark, rows)
    for closed in ("both", "left"):
        a = S.usage_series(df, step=700, clamp=False, closed=closed)
        b = S.usage_sweep(df, step=700, clamp=False, closed=closed, block_ticks=4)
        assert sorted(a.collect()) == sorted(b.collect())
