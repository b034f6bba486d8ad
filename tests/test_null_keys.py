"""Rows without a queue stay in every series, profile and forecast."""

import math

import pytest
from pyspark.sql import functions as F

from clusterlens.operators import forecast as fc
from clusterlens.operators import profiles as prof
from clusterlens.operators import series as ser
from clusterlens.operators.joins import join_same

COLS = "job_id bigint, queue string, approx_start bigint, approx_end bigint, num_processors bigint, avg_mem bigint, " \
       "run_time bigint, ineligible_pend_time bigint, num_gpu_rusages bigint"
T0 = 1_700_000_000


@pytest.fixture(scope="module")
def entries(spark):
    rows = []
    for i in range(120):
        start = T0 + (i * 7919) % 200 * 1000
        end = start + (i % 11) * 1000 if i % 13 else start - 3000
        rows.append((i, [None, "a", "b"][i % 3], start, end, i % 5 + 1, -1 if i % 4 == 0 else i, 10, 0, i % 2))
    rows += [(900, None, None, T0, 1, 1, 1, 1, 1), (901, "a", T0, None, 1, 1, 1, 1, 1)]
    return spark.createDataFrame(rows, COLS)


@pytest.fixture(scope="module")
def usage(entries):
    return ser.usage_series(entries, first=entries.sparkSession.sql(f"SELECT {T0} AS first_event"))


def test_join_same(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, w int")
    assert join_same(a, b, ["k"]).collect() == [(None, 1, 10)]
    assert sorted(map(tuple, join_same(a, b, ["k"], "left").collect()), key=str) == [("x", 2, None), (None, 1, 10)]


def test_sweep_equals_explode(entries, usage):
    first = entries.sparkSession.sql(f"SELECT {T0} AS first_event")
    swept = ser.usage_sweep(entries, first=first, block_ticks=8)
    assert sorted(map(str, swept.collect())) == sorted(map(str, usage.collect()))
    assert usage.where("queue IS NULL").count() > 0


def test_rejected_intervals_are_counted(entries):
    first = entries.sparkSession.sql(f"SELECT {T0 + 5000} AS first_event")
    r = ser.interval_rejects(entries, first=first).first()
    rows = entries.collect()
    known = [x for x in rows if x.approx_start is not None and x.approx_end is not None]
    reversed_ = [x for x in known if x.approx_start > x.approx_end]
    early = [x for x in known if x.approx_start <= x.approx_end < T0 + 5000]
    assert (r.n_jobs, r.n_reversed, r.n_before_first, r.n_unknown) == (len(rows), len(reversed_), len(early), 2)
    assert r.n_covering == len(known) - len(reversed_) - len(early)


def test_profiles_keep_every_row(usage):
    n = usage.count()
    for df in (prof.block_stats(usage), prof.block_stats_daily(usage)):
        got = df.where("queue IS NULL")
        assert df.count() == n and got.count() == usage.where("queue IS NULL").count()
        assert got.where("mean_cpus_per_block IS NULL").count() == 0


def test_forecast_of_the_queueless(usage):
    out = fc.forecast_all(usage, periods=6)
    hist = usage.where("queue IS NULL").count()
    assert out.where("queue IS NULL").count() == 3 * (hist + 6)
    assert out.where("queue IS NULL AND y IS NULL").count() == 3 * 6


@pytest.mark.parametrize("weekly", [False, True])
def test_fit_equals_direct_least_squares(usage, weekly):
    train = fc.series(prof.block_stats_daily(usage), "cpus")
    rows = train.withColumn("h", F.hour("ds")).withColumn("d", F.dayofweek("ds")).collect()
    model = {(r.queue, r.hour, r.dow if weekly else 0): r for r in fc.fit(train, weekly=weekly).collect()}
    for q in (None, "a"):
        mine = [r for r in rows if r.queue == q]
        o, n = min(r.second for r in mine), len(mine)
        t = [(r.second - o) / 3600 for r in mine]
        mt, my = sum(t) / n, sum(r.y for r in mine) / n
        b = sum((x - mt) * (r.y - my) for x, r in zip(t, mine, strict=True)) / sum((x - mt) ** 2 for x in t)
        a = my - b * mt
        res = [r.y - a - b * x for x, r in zip(t, mine, strict=True)]

        def means(keys, values):
            groups = {}
            for k, v in zip(keys, values, strict=True):
                groups.setdefault(k, []).append(v)
            return {k: sum(v) / len(v) for k, v in groups.items()}

        he = means([r.h for r in mine], res)
        rest = [v - he[r.h] for v, r in zip(res, mine, strict=True)]
        we = means([r.d for r in mine], rest) if weekly else {}
        sd = math.sqrt(sum((v - we.get(r.d, 0)) ** 2 for v, r in zip(rest, mine, strict=True)) / n)
        for h in range(24):
            m = model[q, h, 3 if weekly else 0]
            assert m.n == n and m.origin == o
            assert m.slope == pytest.approx(b, rel=1e-7) and m.intercept == pytest.approx(a, rel=1e-7)
            assert m.sd == pytest.approx(sd, rel=1e-7)
            assert m.effect == pytest.approx(he.get(h, 0) + we.get(3, 0), rel=1e-6, abs=1e-9)
