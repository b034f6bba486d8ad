"""The whole accounting flow as one Spark application.

log text -> parsed jobs (+ quarantine, audit) -> narrow job table -> usage
series -> hour profiles and usage reports -> utilisation -> forecast.

Every stage is written as a Parquet table under ``out_dir`` and the next
stage reads it back: the lineage is cut at each written table, a lost
executor only recomputes the current stage, and every intermediate can be
inspected or reused (as the database tables of the original flow were).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import capacity as cap
from ..operators import forecast as fc
from ..operators import parse as P
from ..operators import profiles as prof
from ..operators import reports as rep
from ..operators import series as ser
from ..operators.clean import job_times, log_entries
from ..sources.logs import read_log
from ..sources.tables import write_table


def _save(df: DataFrame, path: str, **kw) -> DataFrame:
    write_table(df, path, **kw)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, log_path: str, out_dir: str, tz: str = "UTC", step: int = 1000, periods: int = 48,
        method: str = "explode", capacity: DataFrame | None = None, weekly: bool = False) -> dict[str, str]:
    """Run every stage; returns the table paths by name.

    All lines are parsed in one pass into one table partitioned by status:
    the accepted rows are its ``ok`` part, the rest is the quarantine, so
    lines of other record types show up in the audit. ``capacity``
    (queue, total_cores) adds the utilisation.
    """
    out, paths = out_dir.rstrip("/"), {}

    def save(name: str, df: DataFrame, **kw) -> DataFrame:
        paths[name] = f"{out}/{name}"
        return _save(df, paths[name], **kw)

    parsed = save("parsed", P.parse_log(read_log(spark, log_path)), partition_by=["status"])
    jobs = P.parsed_rows(parsed)
    save("quarantine", P.quarantine(parsed))
    save("audit", P.parse_audit(parsed))

    entries = save("log_entries", log_entries(jobs))
    save("interval_rejects", ser.interval_rejects(entries))
    series = save("series", ser.usage_series(entries, step=step, method=method))
    save("profiles_daily", prof.block_stats_daily(series, tz=tz))
    for stat in ("mean", "total"):
        save(f"profile_{stat}", prof.hour_profile(series, stat, "cpus", tz=tz))
    if capacity is not None:
        save("utilisation", cap.utilisation(series, capacity))

    report_in = job_times(jobs, tz)
    save("data_window", rep.report_window(report_in))
    save("cpu_by_day", rep.report_day(report_in))
    save("cpu_by_hour", rep.report_hour(report_in))
    save("cpu_by_user_queue", rep.report_user_queue(report_in))
    for name, keys in {"cpu_by_day_queue": ["day_block", "queue"], "cpu_by_queue": ["queue"],
                       "cpu_by_user": ["user_name"], "cpu_by_hour_queue": ["hour_block", "queue"]}.items():
        save(name, rep.report_by(report_in, keys))

    save("forecast", fc.forecast_all(series, periods=periods, tz=tz, weekly=weekly))
    return paths
