"""Short-term usage forecast for every (queue, measure) in one job.

Model per group: a linear trend in hours since the group's first tick
(``regr_slope`` / ``regr_intercept``), plus an hour-of-day effect (the mean
residual in that hour), plus an interval of +-z times the root mean square
of what is left. It answers the question of the seasonal-trend model the
forecast was built with (linear growth with daily seasonality); it is not
that model's optimiser, so numbers are not the same.

All groups are fitted at once with aggregations keyed by the group, never a
driver loop over queues. Model tables have 24 rows per group; they are joined
to the frame on (group, hour) and the planner broadcasts them when small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import to_ts
from .joins import join_same
from .profiles import block_stats_daily

# Measure name -> column of the daily profile used as y.
METRIC_COLUMNS = {
    "cpus": "mean_cpus_per_block_per_date",
    "gpus": "mean_gpus_per_block_per_date",
    "mem": "mean_mem_per_block_per_date",
}
Z80 = 1.2816  # two-sided 80 % normal interval
HOUR = 3600


def series(daily: DataFrame, metric: str = "cpus", queues: Sequence[str] | None = None,
           metric_columns: dict[str, str] | None = None) -> DataFrame:
    """Training rows of one measure: (hour_block, queue, ds, y, date).

    A usage series has one row per (queue, tick), so the rows are already
    distinct; no de-duplicating shuffle is spent on them.
    """
    cols = metric_columns or METRIC_COLUMNS
    src = cols.get(metric, metric)
    if src not in daily.columns:
        raise ValueError(f"unknown measure {metric!r}")
    df = daily if queues is None else daily.filter(F.col("queue").isin(*queues))
    return (df.select(F.lit(metric).alias("metric"), "hour_block", "queue", "second", "ds",
                      F.col(src).cast("double").alias("y"), "date"))


def series_all(daily: DataFrame, metrics: Sequence[str] | None = None,
               queues: Sequence[str] | None = None,
               metric_columns: dict[str, str] | None = None) -> DataFrame:
    """All measures stacked as rows (metric, ...): one plan, no loop."""
    cols = metric_columns or METRIC_COLUMNS
    metrics = list(metrics or cols)
    df = daily if queues is None else daily.filter(F.col("queue").isin(*queues))
    pairs = ", ".join(f"'{m}', cast(`{cols[m]}` as double)" for m in metrics)
    stacked = df.select("hour_block", "queue", "second", "ds", "date",
                        F.expr(f"stack({len(metrics)}, {pairs}) as (metric, y)"))
    return stacked.select("metric", "hour_block", "queue", "second", "ds", "y", "date")


def fit(train: DataFrame, group: Sequence[str] = ("queue", "metric"),
        step: int = HOUR, weekly: bool = False) -> DataFrame:
    """Fit trend + hour-of-day effect (+ weekday effect) per group.

    Returns 24 rows per group (24 x 7 with ``weekly``): group keys,
    ``hour`` (and ``dow``, 1 = Sunday), ``origin`` (first tick), ``last``
    (last tick), ``slope`` and ``intercept`` (per ``step`` seconds),
    ``effect`` (0 for a slot without history), ``sd`` and ``n`` (training
    rows). The weekday effect is the mean of what the hour effect leaves, per
    weekday; use it when the history covers at least two weeks.

    The history is read once: counts, means, variances and the covariance of
    each (group, hour, weekday), at most 168 rows per group, hold all that
    trend, effects and deviation need.
    """
    group = list(group)
    t = F.col("second") / F.lit(float(step))
    cells = (train.groupBy(*group, F.hour("ds").alias("hour"), F.dayofweek("ds").alias("dow"))
             .agg(F.count(F.lit(1)).alias("k"), F.avg(t).alias("mt"), F.avg("y").alias("my"),
                  F.var_pop(t).alias("vt"), F.var_pop("y").alias("vy"), F.covar_pop("y", t).alias("c"),
                  F.min("second").alias("first"), F.max("second").alias("end")))

    def mean(x: F.Column, *more: str) -> F.Column:
        w = Window.partitionBy(*group, *more)
        return F.sum(F.col("k") * x).over(w) / F.sum("k").over(w)

    whole = Window.partitionBy(*group)
    c = cells.select("*", mean(F.col("mt")).alias("gt"), mean(F.col("my")).alias("gy"),
                     F.sum("k").over(whole).alias("n"), F.min("first").over(whole).alias("origin"),
                     F.max("end").over(whole).alias("last"))
    dt, dy = F.col("mt") - F.col("gt"), F.col("my") - F.col("gy")
    c = c.select("*", mean(F.col("vt") + dt * dt).alias("_v"), mean(F.col("c") + dt * dy).alias("_c"))
    # A flat or single-point history has no slope: predict its mean.
    c = c.withColumn("slope", F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0))
    b = F.col("slope")
    c = c.select("*", (F.col("gy") - b * (F.col("gt") - F.col("origin") / F.lit(float(step)))).alias("intercept"),
                 (dy - b * dt).alias("r"))
    c = c.withColumn("heff", mean(F.col("r"), "hour"))
    c = c.withColumn("weff", mean(F.col("r") - F.col("heff"), "dow") if weekly else F.lit(0.0))
    rest = F.col("r") - F.col("heff") - F.col("weff")
    inside = F.col("vy") - 2 * b * F.col("c") + b * b * F.col("vt")
    c = c.withColumn("sd", F.sqrt(F.greatest(mean(inside + rest * rest), F.lit(0.0))))
    facts = ["origin", "last", "slope", "intercept", "sd", "n"]
    table = c.groupBy(*group).agg(
        *[F.first(x).alias(x) for x in facts],
        F.map_from_entries(F.collect_set(F.struct("hour", "heff"))).alias("by_hour"),
        F.map_from_entries(F.collect_set(F.struct("dow", "weff"))).alias("by_dow"))
    hours = table.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    effect = F.coalesce(F.col("by_hour")[F.col("hour")], F.lit(0.0))
    keys = [*group, "hour"]
    if weekly:
        hours = hours.withColumn("dow", F.explode(F.sequence(F.lit(1), F.lit(7))))
        effect = effect + F.coalesce(F.col("by_dow")[F.col("dow")], F.lit(0.0))
        keys.append("dow")
    return hours.select(*keys, "origin", "last", "slope", "intercept", effect.alias("effect"), "sd", "n")


def _ahead(last: DataFrame, periods: int, step: int, group: Sequence[str]) -> DataFrame:
    """``periods`` ticks behind ``last`` of each row."""
    return last.select(*group, F.explode(F.sequence(
        F.col("last") + step, F.col("last") + periods * step, F.lit(step).cast("bigint"))).alias("second"))


def future(train: DataFrame, periods: int = 48, step: int = HOUR,
           group: Sequence[str] = ("queue", "metric"), tz: str = "UTC",
           include_history: bool = True) -> DataFrame:
    """Every history tick plus ``periods`` steps after the last one."""
    group = list(group)
    frame = _ahead(train.groupBy(*group).agg(F.max("second").alias("last")), periods, step, group)
    if include_history:  # a series has one row per (queue, tick)
        frame = train.select(*group, "second").unionByName(frame)
    return frame.withColumn("ds", to_ts("second", tz))


def predict(model: DataFrame, frame: DataFrame, group: Sequence[str] = ("queue", "metric"),
            step: int = HOUR, z: float = Z80) -> DataFrame:
    """yhat with lower/upper bound for every frame row; further columns of the
    frame (``y``, ``date``) pass through behind them."""
    group = list(group)
    keys = [*group, "hour", "dow"] if "dow" in model.columns else [*group, "hour"]
    more = [c for c in frame.columns if c not in (*group, "second", "ds")]
    slots = frame.withColumn("hour", F.hour("ds")).withColumn("dow", F.dayofweek("ds"))
    df = join_same(slots if "dow" in keys else slots.drop("dow"), model, keys)
    t = (F.col("second") - F.col("origin")) / F.lit(float(step))
    yhat = F.col("intercept") + F.col("slope") * t + F.col("effect")
    return df.select(*group, "second", "ds", yhat.alias("yhat"),
                     (yhat - z * F.col("sd")).alias("yhat_lower"),
                     (yhat + z * F.col("sd")).alias("yhat_upper"), *more)


def backtest(forecast: DataFrame, train: DataFrame,
             group: Sequence[str] = ("queue", "metric")) -> DataFrame:
    """Forecast rows with the observed ``y`` and ``date`` where there is history."""
    group = list(group)
    hist = train.select(*group, "second", "y", "date")
    return join_same(forecast, hist, [*group, "second"], "left")


def horizon(train: DataFrame, group: Sequence[str] = ("queue", "metric")) -> DataFrame:
    """Last observed date per group (the marker between history and forecast)."""
    return train.groupBy(*group).agg(F.max("date").alias("last_date"))


def forecast_all(series_df: DataFrame, periods: int = 48, step: int = HOUR,
                 tz: str = "UTC", metrics: Sequence[str] | None = None,
                 queues: Sequence[str] | None = None, z: float = Z80,
                 weekly: bool = False) -> DataFrame:
    """Usage series -> daily profiles -> every (queue, measure) forecast
    (``weekly`` adds the weekday effect, for histories of two weeks or more)."""
    group = ["queue", "metric"]
    train = series_all(block_stats_daily(series_df, tz=tz), metrics, queues)
    model = fit(train, group, step, weekly)
    # The history rows carry their y and date along, so no join has to find them again.
    ahead = _ahead(model.where("hour = 0" + " AND dow = 1" * weekly), periods, step, group)
    ahead = ahead.withColumn("ds", to_ts("second", tz))
    frame = train.select(*group, "second", "ds", "y", "date").unionByName(ahead, allowMissingColumns=True)
    return predict(model, frame, group, step, z)


__all__ = ["series", "series_all", "fit", "future", "predict", "backtest", "horizon",
           "forecast_all"]
