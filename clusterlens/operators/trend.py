"""Forecast with a trend that bends and with smooth seasons, for every (queue, measure) at once.

y is a constant, a slope, a change of slope at each of ``changes`` evenly spaced
instants in the first ``CHANGE_RANGE`` of the history, and Fourier terms of the day
and the week in local time. Time and y are scaled to 1 within each group, so one
penalty on the changes fits all groups; seasons need two periods of history.

The history is read twice: once for the span and scale of each group, once for
its normal equations. These are sums of products of terms, added up in each
batch of rows before the shuffle, so a group that holds most rows is never one
task's work. The equations, a bounded table for each group, are solved group by
group; prediction is an expression of the frame's rows.

The band has two parts: the spread of what the model leaves, and the variance
of changes yet to come, if they come as often and are as large as those fitted.
A slope that changes by variance v at rate r moves the trend by variance
r v h^3 / 3 within h, so the band widens with the horizon.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import ntz_to_epoch, to_ts
from ..session import ship_package
from .forecast import HOUR, Z80, _ahead, series_all
from .joins import join_same
from .profiles import block_stats_daily

#: Share of the history in which the slope may change.
CHANGE_RANGE = 0.8
DAY, WEEK = 86_400, 7 * 86_400


@dataclass(frozen=True)
class Shape:
    """How many changes of slope, and Fourier orders of day and week."""

    changes: int = 25
    daily: int = 4
    weekly: int = 3

    @property
    def size(self) -> int:
        return 2 + self.changes + 2 * self.daily + 2 * self.weekly

    def at(self) -> list[float]:
        """Scaled instants of the changes."""
        return [CHANGE_RANGE * (j + 1) / self.changes for j in range(self.changes)]


def terms(shape: Shape) -> Column:
    """The terms of a row (second, ds; origin, last of its group) as an array of doubles."""
    span = F.col("last") - F.col("origin")
    u = F.when(span > 0, (F.col("second") - F.col("origin")) / span).otherwise(0.0)
    local = ntz_to_epoch("ds")
    out = [F.lit(1.0), u] + [F.greatest(u - c, F.lit(0.0)) for c in shape.at()]
    for period, order in ((DAY, shape.daily), (WEEK, shape.weekly)):
        angle = F.pmod(local, F.lit(period)) * (2 * math.pi / period)
        for k in range(1, order + 1):
            out += [F.when(span >= 2 * period, f(angle * k)).otherwise(0.0) for f in (F.sin, F.cos)]
    return F.array(*[c.cast("double") for c in out])


def spans(train: DataFrame, group: Sequence[str]) -> DataFrame:
    """origin, last, scale (greatest absolute y, 1 if that is 0) of each group."""
    top = F.max(F.abs("y"))
    return train.groupBy(*group).agg(F.min("second").alias("origin"), F.max("second").alias("last"),
                                     F.when(top > 0, top).otherwise(1.0).alias("scale"))


def normal_equations(train: DataFrame, shape: Shape = Shape(), group: Sequence[str] = ("queue", "metric")) -> DataFrame:
    """group, i, j, value with i <= j: sums of products of the terms 0 .. size - 1 and of
    the scaled y, whose number is size. Rows without a y don't count."""
    group = list(group)
    ship_package(train.sparkSession)
    rows = train.where("y IS NOT NULL").select(*group, "second", "ds", "y")
    x = F.concat(terms(shape), F.array(F.col("y") / F.col("scale")))
    terms_of = join_same(rows, spans(rows, group), group).select(*group, x.alias("x"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms_of.schema if f.name in group)
    i, j = np.triu_indices(shape.size + 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(group, dropna=False, sort=False):
                m = np.stack(part["x"].to_numpy())
                yield pd.DataFrame({**{g: [None if pd.isna(k) else k] * len(i) for g, k in zip(group, key, strict=True)},
                                    "i": i, "j": j, "value": (m.T @ m)[i, j]})

    return (terms_of.mapInPandas(products, f"{keys}, i int, j int, value double")
            .groupBy(*group, "i", "j").agg(F.sum("value").alias("value")))


def solved(equations: np.ndarray, shape: Shape, ridge: float) -> tuple[np.ndarray, float, float]:
    """(coefficients, residual deviation, variance of a change) of one group's full matrix of sums."""
    k = shape.size
    penalty = np.full(k, 1e-9)
    penalty[2:2 + shape.changes] = ridge
    a, b = equations[:k, :k], equations[:k, k]
    coef = np.linalg.solve(a + np.diag(penalty), b)
    left = equations[k, k] - 2 * coef @ b + coef @ a @ coef
    bends = coef[2:2 + shape.changes]
    return coef, math.sqrt(max(left, 0.0) / equations[0, 0]), float((bends ** 2).mean()) if len(bends) else 0.0


def fit_trend(train: DataFrame, shape: Shape = Shape(), ridge: float = 1.0,
              group: Sequence[str] = ("queue", "metric")) -> DataFrame:
    """group, origin, last, scale, coef, sd, change_var: one row for each group.

    ``ridge`` is the penalty on each squared change of slope, in squared scaled units of y.
    Groups without a y aren't in the result; no rows give an empty table.
    """
    group = list(group)
    sums = normal_equations(train, shape, group)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in group)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((shape.size + 1, shape.size + 1))
        m[part["i"], part["j"]] = m[part["j"], part["i"]] = part["value"]
        coef, sd, change = solved(m, shape, ridge)
        return pd.DataFrame([[*(None if pd.isna(k) else k for k in key), coef.tolist(), sd, change]],
                            columns=[*group, "coef", "sd", "change_var"])

    model = sums.groupBy(*group).applyInPandas(solve, f"{keys}, coef array<double>, sd double, change_var double")
    return join_same(model, spans(train.where("y IS NOT NULL"), group), group)


def predict_trend(model: DataFrame, frame: DataFrame, shape: Shape = Shape(),
                  group: Sequence[str] = ("queue", "metric"), z: float = Z80) -> DataFrame:
    """yhat with lower and upper bound for every frame row (group, second, ds); further
    columns of the frame pass through behind them."""
    group = list(group)
    more = [c for c in frame.columns if c not in (*group, "second", "ds")]
    df = join_same(frame, model, group).withColumn("_x", terms(shape))
    span = F.col("last") - F.col("origin")
    ahead = F.when((span > 0) & (F.col("second") > F.col("last")), (F.col("second") - F.col("last")) / span).otherwise(0.0)
    scaled = F.aggregate(F.zip_with("_x", "coef", lambda x, c: x * c), F.lit(0.0), lambda a, b: a + b)
    later = F.col("change_var") * (shape.changes / CHANGE_RANGE) * F.pow(ahead, 3.0) / 3
    df = df.select(*group, "second", "ds", (scaled * F.col("scale")).alias("yhat"),
                   (z * F.sqrt(F.col("sd") * F.col("sd") + later) * F.col("scale")).alias("_half"), *more)
    return df.select(*group, "second", "ds", "yhat", (F.col("yhat") - F.col("_half")).alias("yhat_lower"),
                     (F.col("yhat") + F.col("_half")).alias("yhat_upper"), *more)


def forecast_trend(series_df: DataFrame, periods: int = 48, step: int = HOUR, tz: str = "UTC",
                   metrics: Sequence[str] | None = None, queues: Sequence[str] | None = None,
                   shape: Shape = Shape(), ridge: float = 1.0, z: float = Z80) -> DataFrame:
    """Usage series -> daily profiles -> history and ``periods`` steps ahead of every (queue, measure)."""
    group = ["queue", "metric"]
    train = series_all(block_stats_daily(series_df, tz=tz), metrics, queues)
    model = fit_trend(train, shape, ridge, group)
    ahead = _ahead(model, periods, step, group).withColumn("ds", to_ts("second", tz))
    frame = train.select(*group, "second", "ds", "y", "date").unionByName(ahead, allowMissingColumns=True)
    return predict_trend(model, frame, shape, group, z)
