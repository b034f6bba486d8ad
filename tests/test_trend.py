"""Bending trend and seasons against numpy; the band against its closed form and a held-out tail."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.functions.time import to_ts
from clusterlens.operators import trend as T

START = 1_704_067_200
COLS = "queue string, metric string, second long, y double"


def _train(spark, groups):
    rows = [(q, m, START + 3600 * h, None if v is None else float(v)) for (q, m), ys in groups.items() for h, v in enumerate(ys)]
    df = spark.createDataFrame(rows, COLS).repartition(3)
    return df.withColumn("ds", to_ts("second")).withColumn("date", F.to_date("ds"))


def _terms(n, shape):
    t = np.arange(n) * 3600
    u = t / max(t[-1], 1)
    cols = [np.ones(n), u] + [np.maximum(u - c, 0) for c in shape.at()]
    for period, order in ((T.DAY, shape.daily), (T.WEEK, shape.weekly)):
        angle = (START + t) % period * 2 * math.pi / period
        for k in range(1, order + 1):
            cols += [f(angle * k) * (t[-1] >= 2 * period) for f in (np.sin, np.cos)]
    return np.array(cols).T


def _bent(n, rng=None):
    h = np.arange(n)
    bend = 0.48 * (n - 1)  # one of the 25 instants of the default shape
    y = 100 + 0.5 * h + np.where(h > bend, -1.5 * (h - bend), 0) + 20 * np.sin(2 * math.pi * h / 24)
    return y + (rng.normal(0, 4, n) if rng is not None else 0)


def test_equals_numpy_for_every_group_and_null_queue(spark):
    rng, shape = np.random.default_rng(1), T.Shape(6, 2, 1)
    groups = {("a", "cpus"): _bent(500, rng), ("a", "mem"): rng.normal(size=60), (None, "cpus"): 3 * _bent(400, rng),
              ("flat", "cpus"): np.zeros(50), ("one", "cpus"): [5.0]}
    model = {(r.queue, r.metric): r for r in T.fit_trend(_train(spark, groups), shape).collect()}
    assert set(model) == set(groups)
    for key, y in groups.items():
        x, y = _terms(len(y), shape), np.array(y)
        scale = np.abs(y).max() or 1.0
        xy = np.c_[x, y / scale]
        coef, sd, change = T.solved(xy.T @ xy, shape, 1.0)
        got = model[key]
        assert got.scale == scale and got.sd == pytest.approx(sd, abs=1e-9) and got.change_var == pytest.approx(change, abs=1e-9)
        assert np.allclose(x @ got.coef, x @ coef, atol=1e-7)
        penalty = np.full(shape.size, 1e-9)
        penalty[2:8] = 1.0  # the same as least squares with a row for each penalty
        plain = np.linalg.lstsq(np.r_[x, np.diag(np.sqrt(penalty))], np.r_[y / scale, np.zeros(shape.size)], rcond=None)[0]
        assert np.allclose(x @ coef, x @ plain, atol=1e-5)


def test_a_bent_series_is_recovered(spark):
    y = _bent(1000)
    train = _train(spark, {("q", "cpus"): y})
    bent = T.predict_trend(T.fit_trend(train, ridge=1e-6), train).orderBy("second").toPandas()
    straight = T.predict_trend(T.fit_trend(train, T.Shape(0, 4, 3)), train, T.Shape(0, 4, 3)).orderBy("second").toPandas()
    assert np.abs(bent.yhat - y).max() < 1 < 60 < np.abs(straight.yhat - y).max()


def test_band_widens_and_covers_a_held_out_tail(spark):
    rng = np.random.default_rng(3)
    y = _bent(1200, rng)
    train = _train(spark, {("q", "cpus"): y[:1100]})
    model = T.fit_trend(train)
    ahead = T._ahead(model, 100, 3600, ["queue", "metric"]).withColumn("ds", to_ts("second"))
    got = T.predict_trend(model, ahead).orderBy("second").toPandas()
    half = ((got.yhat_upper - got.yhat_lower) / 2).to_numpy()
    assert (np.diff(half) > 0).all()
    m = model.first()
    h = np.arange(1, 101) * 3600 / (m.last - m.origin)
    want = T.Z80 * m.scale * np.sqrt(m.sd ** 2 + m.change_var * (25 / T.CHANGE_RANGE) * h ** 3 / 3)
    assert np.allclose(half, want)
    inside = ((y[1100:] >= got.yhat_lower) & (y[1100:] <= got.yhat_upper)).mean()
    assert 0.6 <= inside <= 1.0
    history = T.predict_trend(model, train).toPandas()
    assert np.allclose(history.yhat_upper - history.yhat_lower, 2 * T.Z80 * m.sd * m.scale)


def test_missing_values_and_empty_history(spark):
    y = list(_bent(300))
    holes = [v if i % 7 else None for i, v in enumerate(y)]
    holes[0] = holes[-1] = None
    train = _train(spark, {("q", "cpus"): holes, ("none", "cpus"): [None] * 30})
    assert [r.queue for r in T.fit_trend(train).collect()] == ["q"]
    assert T.fit_trend(train.limit(0)).count() == 0


def test_all_queues_and_measures_of_a_usage_series(spark):
    from clusterlens.operators.clean import log_entries
    from clusterlens.operators.series import usage_series
    from clusterlens.plans import fixtures as fx
    from clusterlens.sources.tables import compute
    series = compute(usage_series(log_entries(fx.jobs(spark, "/root/testdata/sf0.001"))), "series")
    out = compute(T.forecast_trend(series, periods=12), "trend")
    n_groups = series.select("queue").distinct().count() * 3
    assert out.where("y IS NULL").count() == 12 * n_groups
    assert out.count() == series.count() * 3 + 12 * n_groups
    assert out.where("yhat IS NULL OR isnan(yhat) OR yhat_lower > yhat_upper").count() == 0
    assert isinstance(out.where("y IS NOT NULL").first().date, dt.date)
