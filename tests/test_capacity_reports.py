"""Lookup lists, capacity, reports, positions and small profile/forecast cases."""


from pyspark.sql import functions as F

from clusterlens.operators import capacity as cap
from clusterlens.operators import forecast as fc
from clusterlens.operators import profiles as prof
from clusterlens.operators import reports as rep
from clusterlens.operators.clean import clean_names, duplicates, front, null_sentinel
from clusterlens.operators.positions import row_numbered
from clusterlens.sources.lists import ragged_pairs, read_capacity, read_ragged


def test_read_ragged_drops_self_named_line(spark, tmp_path):
    p = tmp_path / "queues_and_node_groups.csv"
    p.write_text("gpu,cab_gpu,pod7\nqueues_and_node_groups.csv,queues_and_node_groups.csv\n"
                 "short,hp3\nshort,hp4,\n")
    got = sorted(tuple(r) for r in read_ragged(spark, str(p), "queue", "group").collect())
    assert got == [("gpu", "cab_gpu"), ("gpu", "pod7"), ("short", "hp3"), ("short", "hp4")]


def test_capacity_and_utilisation(spark, tmp_path):
    p = tmp_path / "cores.csv"
    p.write_text("compbio,100\ngpu,0\n")
    capdf = read_capacity(spark, str(p))
    series = spark.createDataFrame([("compbio", 0, 25), ("gpu", 0, 3), ("other", 0, 1)],
                                   "queue string, second bigint, cpus bigint")
    got = {r.queue: r.utilisation for r in cap.utilisation(series, capdf).collect()}
    assert got == {"compbio": 0.25, "gpu": None, "other": None}


def test_queue_nodes_shared_and_orphans(spark):
    qg = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("b", "g2"), ("c", "g3")], "queue string, group string")
    gn = spark.createDataFrame([("g1", "n1"), ("g1", "n2"), ("g2", "n2")], "group string, node string")
    qn = cap.queue_nodes(qg, gn)
    assert sorted(tuple(r) for r in qn.collect()) == [("a", "n1"), ("a", "n2"), ("b", "n1"), ("b", "n2")]
    shared = {r.node: r.n_queues for r in cap.shared_nodes(qn).collect()}
    assert shared == {"n1": 2, "n2": 2}
    orph = cap.orphans(qg, gn.select("group").distinct(), "group").select("queue", "group")
    assert [tuple(r) for r in orph.collect()] == [("c", "g3")]


def test_ragged_pairs_spread_over_lines(spark):
    text = spark.createDataFrame([("g,a,b",), ("g,c",), ("h, d ,",)], "value string")
    got = sorted(tuple(r) for r in ragged_pairs(text).collect())
    assert got == [("g", "a"), ("g", "b"), ("g", "c"), ("h", "d")]


def test_row_numbered_in_ranges(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    got = row_numbered(df, "k", ranges=7).orderBy("k").collect()
    assert [r.row_number for r in got] == list(range(1, len(got) + 1))
    down = row_numbered(df, "k", descending=True).orderBy("k").collect()
    assert [r.row_number for r in down] == list(range(len(got), 0, -1))


def test_row_numbered_keeps_nulls_and_cuts_hot_keys(spark):
    rows = [(7, i) for i in range(300)] + [(None, i) for i in range(3)] + [(1, 5)]
    got = row_numbered(spark.createDataFrame(rows, "k bigint, t bigint"), "k", tiebreak=["t"], ranges=5).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert {(r.k, r.t): r.row_number for r in got} == {r: i + 1 for i, r in enumerate(want)}
    assert row_numbered(spark.createDataFrame([], "k bigint"), "k").collect() == []


def test_duplicates_and_sentinel_and_front(spark):
    df = spark.createDataFrame([(1, 0, -1), (1, 0, 5), (2, 1, -1)], "a bigint, b bigint, c bigint")
    assert [tuple(r) for r in duplicates(df, ["a", "b"]).collect()] == [(1, 0, 2)]
    assert [r.c for r in null_sentinel(df, keys=["a"]).orderBy("a", "c").collect()] == [None, 5, None]
    assert front(df, "c").columns == ["c", "a", "b"]
    assert clean_names(df.toDF("jobId", "numGPURusages", "jobId")).columns == \
        ["job_id", "num_gpu_rusages", "job_id2"]


def _jobs(spark):
    # 2024-01-07 is a Sunday; hours 0 and 23 (UTC).
    rows = [(1, "u1", "q1", 1704585600, 1704585600, 10, 4),
            (2, "u1", "q2", 1704585600, 1704585600 + 23 * 3600, 10, 2),
            (3, "u2", "q1", 1704672000, 1704672000, 10, 8)]
    return spark.createDataFrame(rows, "job_id bigint, user_name string, queue string, "
                                       "submit_time bigint, start_time bigint, run_time bigint, "
                                       "num_processors bigint").withColumn(
        "event_time", F.col("start_time") + F.col("run_time"))


def test_reports(spark):
    j = _jobs(spark)
    by_day = {(r.day_block, r.queue): r.cpu_sum for r in rep.report_by(j, ["day_block", "queue"]).collect()}
    assert by_day == {("Sun", "q1"): 4, ("Sun", "q2"): 2, ("Mon", "q1"): 8}
    day = {(r.day_block, r.queue): r.cpu_sum for r in rep.report_day(j).collect()}
    assert day == {("Sun", "q1"): 6, ("Sun", "q2"): 6, ("Mon", "q1"): 8}
    uq = {(r.user_name, r.queue): (r.cpu_que_sum, r.total_cpu_sum) for r in rep.report_user_queue(j).collect()}
    assert uq == {("u1", "q1"): (4, 6), ("u1", "q2"): (2, 6), ("u2", "q1"): (8, 8)}
    hours = {(r.hour_block, r.queue): r.cpu_sum for r in rep.report_hour(j).collect()}
    assert hours == {("00-01", "q1"): 12, ("23-24", "q2"): 2}
    w = rep.report_window(j).first()
    assert str(w.window_start) == "2024-01-07" and str(w.window_end) == "2024-01-08"
    order = [r.queue for r in rep.report_by(j, ["queue"], order=True).collect()]
    assert order == ["q2", "q1"]


def test_profiles_and_forecast_small(spark):
    # Two queues, a clean linear trend plus an hour-of-day bump.
    rows = []
    for q, base in (("a", 10), ("b", 100)):
        for i in range(24 * 4):
            s = 1704067200 + i * 3600
            rows.append((q, s, base + i + (5 if i % 24 == 3 else 0), 1, 2))
    series = spark.createDataFrame(rows, "queue string, second bigint, cpus bigint, gpu bigint, mem bigint")
    daily = prof.block_stats_daily(series)
    assert daily.count() == len(rows)
    prof_mean = {(r.queue, r.hour_block): r.mean_cpus_per_block
                 for r in prof.hour_profile(series, "mean").collect()}
    assert prof_mean[("a", "00-01")] == 10 + (0 + 24 + 48 + 72) / 4
    train = fc.series(daily, "cpus")
    model = fc.fit(train)
    m = {(r.queue, r.hour): r for r in model.collect()}
    assert len(m) == 48
    assert abs(m[("a", 0)].slope - 1.0) < 0.01 and m[("a", 3)].effect > m[("a", 0)].effect
    out = fc.predict(model, fc.future(train, periods=48))
    assert out.count() == 2 * (96 + 48)
    last = out.filter("queue = 'a'").orderBy(F.col("second").desc()).first()
    assert abs(last.yhat - (10 + 143)) < 1.0


def test_forecast_single_point(spark):
    series = spark.createDataFrame([("a", 1704067200, 7, 0, 0)],
                                   "queue string, second bigint, cpus bigint, gpu bigint, mem bigint")
    train = fc.series(prof.block_stats_daily(series), "cpus")
    out = fc.predict(fc.fit(train), fc.future(train, periods=3)).collect()
    assert len(out) == 4 and all(abs(r.yhat - 7.0) < 1e-9 for r in out)


def test_forecast_weekly_effect(spark):
    rows = []
    for i in range(24 * 28):                       # four weeks, hourly
        s = 1704067200 + i * 3600                  # 2024-01-01 (a Monday)
        bump = 30 if (i // 24) % 7 == 5 else 0     # Saturdays are busy
        rows.append(("a", s, 50 + bump, 0, 0))
    series = spark.createDataFrame(rows, "queue string, second bigint, cpus bigint, gpu bigint, mem bigint")
    train = fc.series(prof.block_stats_daily(series), "cpus")
    plain = fc.fit(train)
    weekly = fc.fit(train, weekly=True)
    assert plain.count() == 24 and weekly.count() == 24 * 7
    frame = fc.future(train, periods=24 * 7)
    out = fc.predict(weekly, frame).filter(F.col("second") > 1704067200 + 24 * 28 * 3600)
    sat = out.filter(F.dayofweek("ds") == 7).agg(F.avg("yhat")).first()[0]
    tue = out.filter(F.dayofweek("ds") == 3).agg(F.avg("yhat")).first()[0]
    assert sat - tue > 25
    sd_w = weekly.first().sd
    sd_p = plain.first().sd
    assert sd_w < sd_p


def test_forecast_all_weekly_runs(spark):
    from clusterlens.operators.clean import log_entries
    from clusterlens.operators.series import usage_series
    from clusterlens.plans import fixtures as fx
    series = usage_series(log_entries(fx.jobs(spark, "/root/testdata/sf0.001")))
    a = fc.forecast_all(series, periods=6)
    b = fc.forecast_all(series, periods=6, weekly=True)
    assert a.count() == b.count() > 0
    assert b.filter("yhat is null").count() == 0
