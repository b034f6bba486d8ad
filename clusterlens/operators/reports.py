"""Usage reports over job rows: requested processors summed by weekday,
queue, user and hour block (the tables behind the usage plots).

Every report is a plain group-by with map-side partial sums; the "total
repeated for each queue" forms aggregate to (key, queue) first and take the
key total over that small table, instead of windowing over all job rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import job_times


def _prepared(jobs: DataFrame, tz: str) -> DataFrame:
    return jobs if "day_block" in jobs.columns else job_times(jobs, tz)


def report_window(jobs: DataFrame, tz: str = "UTC") -> DataFrame:
    """First and last event date of the data."""
    df = _prepared(jobs, tz)
    return df.agg(F.to_date(F.min("event_ts")).alias("window_start"),
                  F.to_date(F.max("event_ts")).alias("window_end"))


def report_by(jobs: DataFrame, keys: list[str], value: str = "num_processors",
              out: str = "cpu_sum", tz: str = "UTC", order: bool = False) -> DataFrame:
    """Sum of ``value`` per ``keys`` (weekday rows keep their sort index)."""
    df = _prepared(jobs, tz)
    extra = ["day_index"] if "day_block" in keys else []
    res = df.groupBy(*keys, *extra).agg(F.sum(value).alias(out))
    return res.orderBy(F.col(out).asc(), *keys) if order else res


def report_day(jobs: DataFrame, value: str = "num_processors", tz: str = "UTC") -> DataFrame:
    """Whole-day total (all queues), repeated for each queue seen that day."""
    per = report_by(jobs, ["day_block", "queue"], value, "_q", tz)
    w = Window.partitionBy("day_block")
    return per.select("day_block", "day_index", "queue", F.sum("_q").over(w).alias("cpu_sum"))


def report_user_queue(jobs: DataFrame, value: str = "num_processors", tz: str = "UTC",
                      user: str = "user_name") -> DataFrame:
    """CPUs per (user, queue) and the user's total (for ordering)."""
    per = report_by(jobs, [user, "queue"], value, "cpu_que_sum", tz)
    w = Window.partitionBy(user)
    return per.select(user, "queue", "cpu_que_sum",
                      F.sum("cpu_que_sum").over(w).alias("total_cpu_sum"))


def report_hour(jobs: DataFrame, value: str = "num_processors", tz: str = "UTC") -> DataFrame:
    """All-queue total per hour block, repeated for each queue present."""
    per = report_by(jobs, ["hour_block", "queue"], value, "_q", tz)
    w = Window.partitionBy("hour_block")
    return per.select("hour_block", "queue", F.sum("_q").over(w).alias("cpu_sum"))
