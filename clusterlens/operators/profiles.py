"""Hour-of-day profiles of a usage series.

Group statistics are computed once with a partial/final aggregation and
joined back to the rows on the group key. The statistics table has at most
24 rows per queue (per date for the daily form); the planner decides at run
time (AQE) whether it is small enough to broadcast, otherwise it is a
shuffle join. Unlike a whole-partition window, no task has to hold all rows
of one (queue, hour) group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import weekday, weekday_index
from .clean import with_hour_block
from .joins import join_same

# Measure of the series -> the name used in profile columns.
PROFILE_MEASURES = {"cpus": "cpus", "gpu": "gpus", "mem": "mem"}


def stat_columns(suffix: str, measures: dict[str, str] | None = None) -> list[str]:
    measures = measures or PROFILE_MEASURES
    out = []
    for _, label in measures.items():
        out += [f"mean_{label}_{suffix}", f"totl_{label}_{suffix}"]
    return out


def group_stats(series: DataFrame, keys: Sequence[str], suffix: str,
                measures: dict[str, str] | None = None, totals: bool = True) -> DataFrame:
    """Mean (and total) of each measure per ``keys`` - one row per group."""
    measures = measures or PROFILE_MEASURES
    aggs = []
    for src, label in measures.items():
        aggs.append(F.avg(src).alias(f"mean_{label}_{suffix}"))
        if totals:
            aggs.append(F.sum(src).alias(f"totl_{label}_{suffix}"))
    return series.groupBy(*keys).agg(*aggs)


def block_stats(series: DataFrame, keys: Sequence[str] = ("queue", "hour_block"),
                suffix: str | None = None, tz: str = "UTC",
                measures: dict[str, str] | None = None, totals: bool = True) -> DataFrame:
    """Attach per-group mean/total of cpus, gpu, mem to every series row.

    ``keys`` ``(queue, hour_block)`` gives the ``*_per_block`` columns,
    ``(queue, hour_block, date)`` the ``*_per_block_per_date`` ones. Hour
    block, ``ds`` and ``date`` are added first when missing.
    """
    keys = list(keys)
    if "hour_block" not in series.columns:
        series = with_hour_block(series, tz=tz)
    if suffix is None:
        suffix = "per_block_per_date" if "date" in keys else "per_block"
    stats = group_stats(series, keys, suffix, measures, totals)
    return join_same(series, stats, keys)


def block_stats_daily(series: DataFrame, tz: str = "UTC",
                      measures: dict[str, str] | None = None) -> DataFrame:
    """Both profiles on every row, plus the weekday of the row's date.

    One aggregation to (queue, hour_block, date) - sums and counts, one row
    per day - feeds both statistics; the coarser one adds up that small table
    in a window. The statistics and the rows they are joined to both come
    from ``series``: give a stored series where computing it is expensive.
    """
    measures = measures or PROFILE_MEASURES
    df = with_hour_block(series, tz=tz) if "hour_block" not in series.columns else series
    fine_keys = ["queue", "hour_block", "date"]
    sums = [F.sum(src).alias(f"_s_{src}") for src in measures]
    fine = df.groupBy(*fine_keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
    days = Window.partitionBy("queue", "hour_block")
    fine = fine.select("*", F.sum("_n").over(days).alias("_cn"),
                       *[F.sum(f"_s_{src}").over(days).alias(f"_c_{src}") for src in measures])
    stats_cols = []
    for src, label in measures.items():
        stats_cols += [
            (F.col(f"_c_{src}") / F.col("_cn")).alias(f"mean_{label}_per_block"),
            F.col(f"_c_{src}").alias(f"totl_{label}_per_block"),
            (F.col(f"_s_{src}") / F.col("_n")).alias(f"mean_{label}_per_block_per_date"),
            F.col(f"_s_{src}").alias(f"totl_{label}_per_block_per_date"),
        ]
    out = join_same(df, fine.select(*fine_keys, *stats_cols), fine_keys)
    return out.withColumn("weekday", weekday("date")).withColumn("weekday_index",
                                                                 weekday_index("date"))


def hour_profile(series: DataFrame, stat: str = "mean", measure: str = "cpus",
                 tz: str = "UTC", label: str | None = None) -> DataFrame:
    """Distinct (queue, hour_block, stat) - the profile table itself."""
    if "hour_block" not in series.columns:
        series = with_hour_block(series, tz=tz)
    label = label or PROFILE_MEASURES.get(measure, measure)
    if stat == "mean":
        agg = F.avg(measure).alias(f"mean_{label}_per_block")
    elif stat in ("sum", "total"):
        agg = F.sum(measure).alias(f"totl_{label}_per_block")
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    return series.groupBy("queue", "hour_block").agg(agg)


__all__ = ["block_stats", "block_stats_daily", "hour_profile", "group_stats",
           "stat_columns"]
