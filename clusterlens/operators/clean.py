"""Row filters, projections and derived columns of job tables (all narrow)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import null_sentinel as _nullif_sentinel
from ..functions.numeric import signif
from ..functions.time import hour_label, to_day, to_ts, weekday, weekday_index
from ..templates import unique_snake_names

# Columns of the narrow job table kept for the time series, in order.
LOG_ENTRY_COLUMNS = [
    "row_number", "job_id", "idx", "requeue_time", "start_time", "approx_start",
    "event_time", "approx_end", "num_processors", "avg_mem", "run_time",
    "ineligible_pend_time", "num_gpu_rusages", "queue",
]
LOG_ENTRY_KEY = ["job_id", "idx", "requeue_time"]


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case every column name; repeats get a numeric suffix."""
    return df.toDF(*unique_snake_names(df.columns))


def started(df: DataFrame, start_col: str = "start_time") -> DataFrame:
    """Jobs that ever started (start time > 0)."""
    return df.filter(F.col(start_col) > 0)


def with_grid_times(df: DataFrame, digits: int = 7) -> DataFrame:
    """``approx_start``/``approx_end``: start and end (event) time rounded to
    ``digits`` significant digits - a 1000 s grid for 10-digit epochs."""
    return (df.withColumn("approx_start", signif("start_time", digits).cast("bigint"))
              .withColumn("approx_end", signif("event_time", digits).cast("bigint")))


def narrow(df: DataFrame, row_number_col: str | None = "row_number") -> DataFrame:
    """The 14-column job table of the series (numbers as BIGINT).

    Parsed logs keep ``requeue_time`` and ``ineligible_pend_time`` as text;
    they are cast here. ``row_number`` is kept when present.
    """
    casts = {c: F.col(c).try_cast("bigint") for c in LOG_ENTRY_COLUMNS
             if c not in ("queue", "row_number") and c in df.columns}
    cols = []
    for c in LOG_ENTRY_COLUMNS:
        if c == "row_number":
            if row_number_col and row_number_col in df.columns:
                cols.append(F.col(row_number_col).alias("row_number"))
            continue
        cols.append(casts[c].alias(c) if c in casts else F.col(c))
    return df.select(*cols)


def log_entries(jobs: DataFrame, digits: int = 7) -> DataFrame:
    """Jobs -> grid times -> started only -> narrow table."""
    return narrow(started(with_grid_times(jobs, digits)), row_number_col=None)


def duplicates(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def null_sentinel(df: DataFrame, keys: Iterable[str] = (), sentinel=-1,
                  columns: Iterable[str] | None = None) -> DataFrame:
    """Replace ``sentinel`` by NULL in every numeric non-key column."""
    keys = set(keys)
    numeric = {"bigint", "int", "smallint", "tinyint", "double", "float"}
    dtypes = dict(df.dtypes)
    targets = set(columns) if columns is not None else {
        c for c, t in dtypes.items() if t in numeric and c not in keys}
    return df.select(*[_nullif_sentinel(c, sentinel).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def job_times(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Report columns of a job row: local start/submit/event/end times,
    pending time, run time, event hour, hour block and weekday. ``run_time``
    may be text, as the parser gives it; text that is no whole number of
    seconds counts as unknown, and so do times outside the years 1 to 9999
    (``time_rejects`` counts these)."""
    ev = to_ts("event_time", tz)
    run = F.col("run_time").try_cast("bigint")
    return df.select(
        "*",
        to_ts("start_time", tz).alias("start_ts"),
        to_ts("submit_time", tz).alias("submit_ts"),
        ev.alias("event_ts"),
        F.try_subtract("start_time", "submit_time").alias("pend_time"),
        to_ts(F.try_add("start_time", run), tz).alias("end_ts"),
        F.hour(ev).alias("event_time_hour"),
        run.alias("run_time_sec"),
        hour_label(F.hour(ev)).alias("hour_block"),
        weekday(ev).alias("day_block"),
        weekday_index(ev).alias("day_index"),
    )


def time_rejects(df: DataFrame, *epoch_cols: str) -> DataFrame:
    """column, n_rows: how many values of each column ``to_ts`` makes NULL because they lie too far out."""
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & to_ts(c).isNull()).alias(c) for c in epoch_cols])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_rows")) for c in epoch_cols])))


def with_hour_block(df: DataFrame, epoch_col: str = "second", tz: str = "UTC") -> DataFrame:
    """``hour_block`` ("00-01".."23-24"), ``ds`` (local time) and ``date``."""
    ds = to_ts(epoch_col, tz)
    return df.select("*", hour_label(F.hour(ds)).alias("hour_block"),
                     ds.alias("ds"), to_day(ds).alias("date"))


def front(df: DataFrame, *first: str) -> DataFrame:
    """Move ``first`` columns to the front, keep the rest in order."""
    rest = [c for c in df.columns if c not in first]
    return df.select(*first, *rest)


def metric(df: DataFrame, name: str, alias: str = "y") -> DataFrame:
    """Pick one measure column by name as ``y``; an unknown name raises."""
    if name not in df.columns:
        raise ValueError(f"unknown measure {name!r}; have {df.columns}")
    return df.withColumn(alias, F.col(name))
