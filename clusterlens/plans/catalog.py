"""Named queries over the driver tables: ``(spark, sf_dir) -> DataFrame``.

Each query reads whole tables (or data Spark derives from them) and runs one
operator of the engine, so it can be checked against its SQL twin in
:mod:`clusterlens.plans.oracle`. Computed columns carry the same names there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import signif
from ..functions.time import to_ts
from ..functions.tokens import quoted_tokens, strip_quotes, strip_ws
from ..operators import capacity as cap
from ..operators import forecast as fc
from ..operators import parse as P
from ..operators import pools
from ..operators import profiles as prof
from ..operators import reports as rep
from ..operators import runs
from ..operators import series as ser
from ..operators import trend
from ..operators.clean import (clean_names, duplicates, front, job_times, log_entries,
                               narrow, null_sentinel, started, with_grid_times,
                               with_hour_block)
from ..operators.joins import join_same
from ..operators.positions import row_numbered
from ..sources.lists import capacity_lines, ragged_pairs
from ..session import new_path
from ..sources.logs import PLACE, read_log, read_placed
from ..sources.snapshots import Snapshots
from ..sources.tables import (compute, csv_lines, csv_rejects, csv_rows, read_jobs_csv, read_table,
                              write_table)
from ..sources.time_index import TimeIndex
from ..streaming import ingest
from ..templates import TEMPLATES
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
TZ = "UTC"
LOCAL_TZ = "America/Chicago"
# Model numbers are reported to 7 significant digits: sums of doubles run in
# a different order on every partitioning (and in every engine), which moves
# the last bits; fixed decimals would flip on values near a rounding edge.
SIG_DIGITS = 7


# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------

def _jobs(spark, sf):
    return fx.jobs(spark, sf)


def _numbered_entries(spark, sf):
    """Narrow job table with row numbers taken before the start filter."""
    numbered = row_numbered(_jobs(spark, sf), "job_id", tiebreak=["idx", "requeue_time"])
    return narrow(started(with_grid_times(numbered)))


def _entries(spark, sf):
    return log_entries(_jobs(spark, sf))


def _series(spark, sf, method="explode"):
    return ser.usage_series(_entries(spark, sf), method=method)


def _parsed(spark, sf, fields=None):
    return P.parse_log(fx.lines(spark, sf), fields=fields)


def _daily(spark, sf):
    return prof.block_stats_daily(_series(spark, sf, "explode"), tz=TZ)


def _hosts(spark, sf):
    gn_text, qg_text = fx.hosts_text(spark, sf)
    gn = ragged_pairs(gn_text, "group", "node")
    qg = ragged_pairs(qg_text, "queue", "group")
    return qg, gn


def _capacity(spark, sf):
    """Cores per series queue: queues (event types, by name) and regions (by
    key) are paired in order; cores = 10 per node of the region."""
    qg, gn = _hosts(spark, sf)
    per_region = cap.capacity_from_nodes(cap.queue_nodes(qg, gn), 10)
    region = fx.table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("queue"))
    names = (fx.table(spark, sf, "events").select(F.col("event_type").alias("series_queue"))
             .distinct())
    ranked = names.select("series_queue", F.expr("dense_rank() over (order by series_queue) - 1")
                          .alias("r_regionkey"))
    cores = ranked.join(region, "r_regionkey").join(per_region, "queue")
    return capacity_lines(cores.select(F.concat_ws(",", "series_queue", "total_cores").alias("value")))


# --------------------------------------------------------------------------
# 2.1 / 2.2 scans and parsing
# --------------------------------------------------------------------------

PARSE_COLUMNS = [
    "event_time", "job_id", "user_id", "num_processors", "submit_time", "start_time",
    "user_name", "queue", "idx", "avg_mem", "run_time", "ineligible_pend_time",
    "requeue_time", "num_gpu_rusages", "num_ex_hosts", "num_host_rusage", "command",
    "version_number", "host_factor", "rsv_id", "rsv_id2", "last_resize_time",
]


def q_log_parse(spark, sf):
    rows = P.parsed_rows(_parsed(spark, sf, PARSE_COLUMNS))
    return rows.select(*PARSE_COLUMNS)


def q_log_parse_sql(spark, sf):
    parsed = P.parse_log(fx.lines(spark, sf), fields=PARSE_COLUMNS, engine="sql")
    return P.parsed_rows(parsed).select(*PARSE_COLUMNS)


CSV_SCHEMA = "job_id bigint, idx bigint, command string, queue string, avg_mem bigint"


def q_log_file(spark, sf):
    """Lines written as a text file, some with an undecodable byte, read back and parsed."""
    path = new_path(spark, "log")
    bad = F.when(F.length("value") % 3 == 0, F.concat("value", F.lit("\ufffd"))).otherwise(F.col("value"))
    fx.lines(spark, sf).select(bad).write.text(path)
    parsed = P.parse_log(read_log(spark, path), fields=["job_id", "idx", "queue", "command"], keep_line=False)
    return P.parsed_rows(parsed)


def q_csv_files(spark, sf):
    """Jobs written as CSV files by queue and read back with a schema."""
    path = new_path(spark, "csv")
    jobs = csv_rows(csv_lines(fx.csv_text(spark, sf), CSV_SCHEMA))
    write_table(jobs.withColumn("q", F.coalesce("queue", F.lit("none"))), path, fmt="csv", partition_by=["q"])
    return csv_rows(read_jobs_csv(spark, path, CSV_SCHEMA)).select("job_id", "idx", "command", "queue", "avg_mem")


def q_table_round_trip(spark, sf):
    """A table created, replaced, appended to, scanned and computed to a new path."""
    path = new_path(spark, "jobs")
    jobs = _jobs(spark, sf).select("job_id", "idx", "queue", "event_time")
    write_table(jobs, path)
    write_table(jobs.where("job_id % 2 = 0"), path, sort_within=["event_time"])
    write_table(jobs.where("job_id % 2 = 1"), path, mode="append")
    return compute(read_table(spark, path).where("queue IS NOT NULL"), "with-queue")


def q_table_snapshots(spark, sf):
    """Two versions of a table that is replaced by a part of itself and then appended to."""
    store = Snapshots(spark, new_path(spark, "snapshots"))
    jobs = _jobs(spark, sf).select("job_id", "idx", "queue", "event_time")
    store.replace("jobs", jobs)
    store.replace("jobs", store.read("jobs").where("job_id % 2 = 0"))
    newest = store.append("jobs", jobs.where("job_id % 3 = 1"))
    versions = [store.read("jobs", v).withColumn("version", F.lit(v)) for v in (newest - 1, newest)]
    return versions[0].unionByName(versions[1])


def q_ingest_batches(spark, sf):
    """Two batches of log lines, the second one replayed, as the merged series."""
    lines, out = compute(fx.lines(spark, sf), "lines"), new_path(spark, "ingest")
    early = F.length("value") % 2 == 0
    for i, part in enumerate((lines.where(early), lines.where(~early), lines.where(~early))):
        ingest.write_batch(part, min(i, 1), out)
    return ingest.read_merged(spark, out)


def q_ingest_falling(spark, sf):
    """Batches that come latest events first: each one moves the first event back."""
    jobs, out = fx.log_jobs(spark, sf), new_path(spark, "ingest")
    low, high = _jobs(spark, sf).agg(F.min("event_time"), F.max("event_time")).first()
    third = F.floor((F.col("event_time") - low) * 3 / F.lit(high - low + 1)) if low is not None else F.lit(0)
    for i, part in enumerate((2, 1, 0)):
        ingest.write_batch(fx.render_lines(jobs.where(third == part)), i, out)
    return ingest.read_merged(spark, out)


def q_ingest_unique(spark, sf):
    """Job instances repeated within a load and across loads: what stays, and what is rejected and why."""
    jobs, out = fx.log_jobs(spark, sf), new_path(spark, "ingest")
    some = jobs.where("job_id % 3 <> 0")
    again = jobs.withColumn("num_processors", F.col("num_processors") + 1)
    ingest.write_batch(fx.render_lines(some.unionAll(some.where("job_id % 7 = 0"))), 0, out)
    ingest.write_batch(fx.render_lines(again), 1, out)
    kept = ingest.read_ingested(spark, out, "log_entries").withColumn("reason", F.lit(None).cast("string"))
    rows = kept.unionByName(ingest.read_ingested(spark, out, "repeats"))
    return rows.select("job_id", "idx", "requeue_time", "event_time", "queue", "num_processors", "reason")


def q_ingest_stream(spark, sf):
    """Log files that arrive in three lots, streamed with one checkpoint, compacted in between."""
    lines = compute(fx.lines(spark, sf).withColumn("lot", F.length("value") % 3), "lines")
    base = new_path(spark, "stream")
    for lot in range(3):
        lines.where(F.col("lot") == lot).select("value").write.text(f"{base}/logs/lot{lot}")
        ingest.ingest(spark, f"{base}/logs/*", f"{base}/tables", f"{base}/checkpoint")
        if lot == 1:
            ingest.compact(spark, f"{base}/tables", fan_in=2)
    return ingest.read_merged(spark, f"{base}/tables")


def q_csv_jobs(spark, sf):
    return csv_rows(csv_lines(fx.csv_text(spark, sf), CSV_SCHEMA))


def q_csv_rejects(spark, sf):
    return csv_rejects(csv_lines(fx.csv_text(spark, sf), CSV_SCHEMA))


def q_log_status_counts(spark, sf):
    return P.parse_audit(_parsed(spark, sf, []))


def q_log_groups(spark, sf):
    """All arrays of the ten variable-length groups."""
    tpl = TEMPLATES["JOB_FINISH"]
    arrays = [c for t, c in enumerate(tpl.columns) if t in tpl.array_columns()]
    rows = P.parsed_rows(_parsed(spark, sf, ["job_id", "idx", *arrays]))
    return rows.select("job_id", "idx", *[F.array_join(c, "|").alias(c) for c in arrays])


def q_log_resize(spark, sf):
    parsed = P.parse_log(fx.resize_lines(fx.log_jobs(spark, sf)), "JOB_RESIZE")
    return P.parsed_rows(parsed).select(*[
        F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else f.name
        for f in parsed.schema.fields if f.name not in ("status", "line", "event_type", "resize_type")])


def q_log_status_mixed(spark, sf):
    """Finish and resize records and a reservation record in one log, by status."""
    jobs = fx.log_jobs(spark, sf)
    reserved = jobs.where("job_id % 100 = 1").select(F.lit('"EVENT_ADRSV_FINISH" 1 2').alias("value"))
    mixed = fx.render_lines(jobs).unionAll(fx.resize_lines(jobs)).unionAll(reserved)
    return P.parse_audit(P.parse_log(mixed, fields=[], keep_line=False))


_JOB_ID_IN_LINE = r'^"?[A-Z_]+"\s+"10[.]1"\s+-?[0-9]+\s+([0-9]+)'


def q_log_type_filter(spark, sf):
    kept = P.where_type(fx.lines(spark, sf), "JOB_FINISH")
    return kept.select(F.regexp_extract("value", _JOB_ID_IN_LINE, 1).cast("bigint").alias("job_id"))


def q_log_reject_places(spark, sf):
    """File and line number of every rejected line of a log in many files, of 1000 job numbers each."""
    path, lines = new_path(spark, "logs"), compute(fx.lines(spark, sf), "lines")
    number = F.regexp_extract("value", _JOB_ID_IN_LINE, 1).cast("long")
    ended = F.regexp_extract("value", r'^"?[A-Z_]+"\s+"10[.]1"\s+(-?[0-9]+)', 1).cast("long")
    dealt = lines.select("value", number.alias("number"), F.floor(number / 1000).alias("f"), ended.alias("ended"))
    (dealt.repartition("f").sortWithinPartitions("f", "number", "ended").select("value", "f")
     .write.partitionBy("f").text(path))
    parsed = compute(P.parse_log(read_placed(spark, path), fields=[], carry=PLACE), "parsed")
    return P.reject_places(parsed).select(
        F.regexp_extract("file", "/f=([0-9]+)/", 1).cast("long").alias("f"), "line_number", "status",
        F.regexp_extract("line", _JOB_ID_IN_LINE, 1).cast("long").alias("job_id"))


def q_log_repair(spark, sf):
    """Every line: repaired where its quote was lost, untouched otherwise."""
    fixed = fx.lines(spark, sf).select("value", P.repair_line(F.col("value")).alias("l"))
    return fixed.select(
        F.regexp_extract("l", _JOB_ID_IN_LINE, 1).cast("bigint").alias("job_id"),
        F.col("l").startswith('"').alias("starts_with_quote"),
        (F.col("l") == F.col("value")).alias("untouched"))


def q_log_tokens(spark, sf):
    ln = fx.lines(spark, sf).select(P.repair_line(strip_ws(F.col("value"))).alias("l"))
    tok = ln.select(strip_quotes(quoted_tokens(F.col("l"))).alias("t"))
    return tok.select(F.get("t", 3).cast("bigint").alias("job_id"),
                      F.size("t").alias("n_fields"),
                      F.get("t", 0).alias("record_type"),
                      F.element_at("t", -1).alias("last_field"))


def q_clean_names(spark, sf):
    j = _jobs(spark, sf)
    report = j.select(F.col("start_time").alias("startTime"), F.col("submit_time").alias("submitTime"),
                      F.col("event_time").alias("Event.Time"), F.col("run_time").alias("runTime"),
                      F.col("num_processors").alias("numProcessors"), F.col("max_r_mem").alias("maxRMem"),
                      F.col("user_name").alias("userName"), "queue")
    return clean_names(report)


def q_ragged_explode(spark, sf):
    gn_text, _ = fx.hosts_text(spark, sf)
    return ragged_pairs(gn_text, "key", "value")


# --------------------------------------------------------------------------
# 2.3 cleaning and scalar functions
# --------------------------------------------------------------------------

def q_jobs_started(spark, sf):
    return started(_jobs(spark, sf))


def q_signif_grid(spark, sf):
    j = _jobs(spark, sf)
    return j.select("job_id", "start_time", signif("start_time", 7).cast("bigint").alias("approx_start"),
                    "event_time", signif("event_time", 7).cast("bigint").alias("approx_end"),
                    signif("run_time", 2).alias("run_time_2"))


def q_row_numbered(spark, sf):
    numbered = row_numbered(_jobs(spark, sf).select("job_id", "idx", "requeue_time", "queue"), "job_id",
                            tiebreak=["idx", "requeue_time"])
    return numbered.drop("idx", "requeue_time")


def q_log_entries(spark, sf):
    return _numbered_entries(spark, sf)


def q_event_lookup(spark, sf):
    """Jobs looked up by time (the second quarter of the window) and by job number (three of the window's)."""
    index, jobs = TimeIndex(spark, new_path(spark, "jobs")), _jobs(spark, sf).select("job_id", "idx", "queue", "event_time")
    index.write(compute(jobs, "jobs"), "event_time", "job_id")
    files = read_table(spark, f"{index.path}/files")
    low, high = files.agg(F.min("first"), F.max("last")).first()
    low, high = low or 0, high or 0
    step = (high - low) // 4
    keys = [r["job_id"] for r in jobs.agg(F.min("job_id").alias("a"), F.max("job_id").alias("b"))
            .select(F.explode(F.array("a", F.floor((F.col("a") + F.col("b")) / 2), "b")).alias("job_id")).collect()]
    by_time = index.between(low + step, low + 2 * step).withColumn("by", F.lit("time"))
    return by_time.unionByName(index.where_key(keys).withColumn("by", F.lit("key")))


def q_duplicate_keys(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return duplicates(li, ["l_orderkey", "l_linenumber"])


def q_sentinel_nulls(spark, sf):
    return null_sentinel(_entries(spark, sf), keys=["job_id", "idx", "requeue_time"])


def q_epoch_to_ts(spark, sf):
    j = _jobs(spark, sf)
    return j.select("job_id", to_ts("start_time", TZ).alias("start_ts"),
                    to_ts("submit_time", TZ).alias("submit_ts"),
                    to_ts("event_time", TZ).alias("event_ts"),
                    to_ts("event_time", LOCAL_TZ).alias("event_ts_local"))


_JOB_TIME_COLS = ["job_id", "pend_time", "end_ts", "run_time_sec", "event_time_hour",
                  "hour_block", "day_block", "day_index"]


def q_job_times(spark, sf):
    return job_times(_jobs(spark, sf), TZ).select(*_JOB_TIME_COLS)


def q_weekdays(spark, sf):
    return job_times(_jobs(spark, sf), LOCAL_TZ).select("job_id", "day_block", "day_index")


def q_hour_blocks(spark, sf):
    return _iso(with_hour_block(_series(spark, sf), "second", LOCAL_TZ).select(
        "queue", "second", "hour_block", "ds", "date"), "date")


def q_front_columns(spark, sf):
    df = job_times(_jobs(spark, sf), TZ)
    return front(df, "hour_block", "day_block", "start_ts", "submit_ts", "event_ts",
                 "event_time_hour", "run_time_sec", "num_processors", "max_r_mem", "user_name")


def q_series_select(spark, sf):
    return _iso(fc.series(_daily(spark, sf), "mem"), "date")


# --------------------------------------------------------------------------
# 2.4 series
# --------------------------------------------------------------------------

def q_first_event(spark, sf):
    return ser.first_event(_entries(spark, sf))


def q_job_ticks(spark, sf):
    return ser.job_ticks(_entries(spark, sf)).select("job_id", "queue", "second", "num_processors")


def q_usage_series(spark, sf):
    return _series(spark, sf, "explode")


def q_usage_sweep(spark, sf):
    return _series(spark, sf, "sweep")


def _with_position(df):
    """The place of each row in the order in which ``df`` gives its rows."""
    return row_numbered(df.withColumn("_at", F.monotonically_increasing_id()), "_at", out="position").drop("_at")


def q_usage_series_sorted(spark, sf):
    return _with_position(ser.sorted_series(_series(spark, sf, "sweep")))


def q_interval_rejects(spark, sf):
    return ser.interval_rejects(_entries(spark, sf))


def q_usage_runs(spark, sf):
    return runs.usage_runs(_entries(spark, sf))


def q_usage_at(spark, sf):
    """Totals of each queue over each day on which it has a job's end, and over two days from noon."""
    entries = _entries(spark, sf)
    days = entries.select("queue", F.floor(F.col("approx_end") / 86400).alias("d")).distinct()
    windows = days.select("queue", F.inline(F.array(
        F.struct((F.col("d") * 86400).alias("from"), (F.col("d") * 86400 + 86400).alias("to")),
        F.struct((F.col("d") * 86400 + 43200).alias("from"), (F.col("d") * 86400 + 216000).alias("to")))))
    totals = runs.usage_at(runs.usage_runs(entries), windows)
    return totals.select("queue", "from", "to", "seconds", *[F.col(m).cast("bigint").alias(m) for m in ser.DEFAULT_MEASURES])


def q_series_one_queue(spark, sf):
    return _iso(fc.series(_daily(spark, sf), "cpus", queues=["click"]), "date")


def q_usage_merge(spark, sf):
    """Partial series per ingest batch (one batch per event day), merged."""
    entries = _entries(spark, sf)
    first = ser.first_event(entries)
    batch = F.floor(F.col("event_time") / 86400)
    partials = ser.usage_series(entries.withColumn("batch", batch), group=("batch", "queue"),
                                first=first)
    return ser.merge_partials(partials)


# --------------------------------------------------------------------------
# 2.5 profiles
# --------------------------------------------------------------------------

_BLOCK_COLS = ["queue", "second", "hour_block", "cpus", "gpu", "mem"]


def q_block_stats(spark, sf):
    df = prof.block_stats(_series(spark, sf, "explode"), tz=TZ)
    return df.select(*_BLOCK_COLS, *prof.stat_columns("per_block"))


def q_block_stats_daily(spark, sf):
    return _iso(_daily(spark, sf).select(*_BLOCK_COLS, "date", "weekday",
                                         *prof.stat_columns("per_block"),
                                         *prof.stat_columns("per_block_per_date")), "date")


def q_profile_mean(spark, sf):
    return prof.hour_profile(_series(spark, sf, "explode"), "mean", "cpus", tz=TZ)


def q_profile_total(spark, sf):
    return prof.hour_profile(_series(spark, sf, "explode"), "sum", "cpus", tz=TZ)


# --------------------------------------------------------------------------
# 2.6 reports
# --------------------------------------------------------------------------

def _report_input(spark, sf):
    return job_times(_jobs(spark, sf), TZ)


def q_data_window(spark, sf):
    return _iso(rep.report_window(_report_input(spark, sf)), "window_start", "window_end")


def q_cpu_by_day_queue(spark, sf):
    return rep.report_by(_report_input(spark, sf), ["day_block", "queue"])


def q_cpu_by_day(spark, sf):
    return rep.report_day(_report_input(spark, sf))


def q_cpu_by_queue(spark, sf):
    return _with_position(rep.report_by(_report_input(spark, sf), ["queue"], order=True))


def q_cpu_by_user(spark, sf):
    return _with_position(rep.report_by(_report_input(spark, sf), ["user_name"], order=True))


def q_cpu_by_user_queue(spark, sf):
    return rep.report_user_queue(_report_input(spark, sf))


def q_cpu_by_hour(spark, sf):
    return rep.report_hour(_report_input(spark, sf))


def q_cpu_by_hour_queue(spark, sf):
    return rep.report_by(_report_input(spark, sf), ["hour_block", "queue"])


# --------------------------------------------------------------------------
# 2.7 forecast
# --------------------------------------------------------------------------

def _r(c):
    return signif(F.col(c), SIG_DIGITS).alias(c)


def _iso(df, *cols):
    """DATE columns as ISO text in query output (engines hand dates to pandas
    differently; text compares the same everywhere)."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _train(spark, sf, metric=None):
    daily = _daily(spark, sf)
    return fc.series_all(daily) if metric is None else fc.series(daily, metric)


def q_forecast_fit(spark, sf):
    model = fc.fit(_train(spark, sf))
    return model.select("queue", "metric", "hour", "origin", _r("slope"), _r("intercept"),
                        _r("effect"), _r("sd"), "n")


def q_forecast_frame(spark, sf):
    train = _train(spark, sf, "cpus")
    frame = fc.future(train, 48, tz=TZ)
    return _iso(join_same(frame, fc.horizon(train), ["queue", "metric"]), "last_date")


def _rounded_forecast(df):
    df = _iso(df, "date")
    return df.select(*[c for c in df.columns if c not in ("yhat", "yhat_lower", "yhat_upper", "y")],
                     _r("yhat"), _r("yhat_lower"), _r("yhat_upper"),
                     *([_r("y")] if "y" in df.columns else []))


def q_forecast(spark, sf):
    train = _train(spark, sf, "cpus")
    out = fc.predict(fc.fit(train), fc.future(train, 48, tz=TZ))
    return _rounded_forecast(out)


def q_forecast_backtest(spark, sf):
    train = _train(spark, sf, "cpus")
    out = fc.backtest(fc.predict(fc.fit(train), fc.future(train, 48, tz=TZ)), train)
    return _rounded_forecast(out)


def q_forecast_all(spark, sf):
    return _rounded_forecast(fc.forecast_all(_series(spark, sf, "explode"), tz=TZ))


def q_forecast_weekly(spark, sf):
    return _rounded_forecast(fc.forecast_all(_series(spark, sf), tz=TZ, weekly=True))


TREND_SHAPE = trend.Shape(changes=8, daily=3, weekly=1)


def q_forecast_trend(spark, sf):
    """The normal equations of the bending trend with its seasons."""
    sums = trend.normal_equations(_train(spark, sf), TREND_SHAPE)
    return sums.select("queue", "metric", "i", "j", (F.round("value", 6) + 0.0).alias("value"))


# --------------------------------------------------------------------------
# 2.8 capacity
# --------------------------------------------------------------------------

def q_queue_nodes(spark, sf):
    qg, gn = _hosts(spark, sf)
    return cap.queue_nodes(qg, gn)


def q_utilisation(spark, sf):
    util = cap.utilisation(_series(spark, sf, "explode"), _capacity(spark, sf))
    return util.select("queue", "second", "cpus", "total_cores",
                       F.round("utilisation", 4).alias("utilisation"))


def q_pool_utilisation(spark, sf):
    """Queues of the series are paired with regions as for ``utilisation``; regions that share nodes pool."""
    qg, gn = _hosts(spark, sf)
    qn = cap.queue_nodes(qg, gn)
    names = (fx.table(spark, sf, "events").select(F.col("event_type").alias("series_queue")).distinct()
             .select("series_queue", F.expr("dense_rank() over (order by series_queue) - 1").alias("r_regionkey")))
    region = fx.table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("queue"))
    used = compute(names.join(region, "r_regionkey").join(qn, "queue")
                   .select(F.col("series_queue").alias("queue"), "node"), "series-nodes")
    pool_of = pools.pools(used)
    cores = pools.pool_cores(used, pool_of, 10)
    out = pools.pool_utilisation(_series(spark, sf), pool_of, cores)
    return out.withColumn("utilisation", F.round("utilisation", 4))


def q_orphan_groups(spark, sf):
    qg, gn = _hosts(spark, sf)
    return cap.orphans(qg, gn.select("group").distinct(), "group")


def q_shared_nodes(spark, sf):
    qg, gn = _hosts(spark, sf)
    return cap.shared_nodes(cap.queue_nodes(qg, gn))


QUERIES: dict[str, Query] = {
    # scans and parsing
    "log_parse": q_log_parse,
    "log_parse_sql": q_log_parse_sql,
    "log_file": q_log_file,
    "csv_files": q_csv_files,
    "table_round_trip": q_table_round_trip,
    "table_snapshots": q_table_snapshots,
    "ingest_batches": q_ingest_batches,
    "ingest_falling": q_ingest_falling,
    "ingest_unique": q_ingest_unique,
    "ingest_stream": q_ingest_stream,
    "csv_jobs": q_csv_jobs,
    "csv_rejects": q_csv_rejects,
    "log_status_counts": q_log_status_counts,
    "log_groups": q_log_groups,
    "log_resize": q_log_resize,
    "log_status_mixed": q_log_status_mixed,
    "log_type_filter": q_log_type_filter,
    "log_reject_places": q_log_reject_places,
    "log_repair": q_log_repair,
    "log_tokens": q_log_tokens,
    "clean_names": q_clean_names,
    "ragged_explode": q_ragged_explode,
    # cleaning
    "jobs_started": q_jobs_started,
    "signif_grid": q_signif_grid,
    "row_numbered": q_row_numbered,
    "log_entries": q_log_entries,
    "duplicate_keys": q_duplicate_keys,
    "event_lookup": q_event_lookup,
    "sentinel_nulls": q_sentinel_nulls,
    "epoch_to_ts": q_epoch_to_ts,
    "job_times": q_job_times,
    "weekdays": q_weekdays,
    "hour_blocks": q_hour_blocks,
    "front_columns": q_front_columns,
    "series_select": q_series_select,
    # series
    "first_event": q_first_event,
    "job_ticks": q_job_ticks,
    "usage_series": q_usage_series,
    "usage_sweep": q_usage_sweep,
    "usage_series_sorted": q_usage_series_sorted,
    "usage_merge": q_usage_merge,
    "usage_runs": q_usage_runs,
    "usage_at": q_usage_at,
    "interval_rejects": q_interval_rejects,
    "series_one_queue": q_series_one_queue,
    # profiles
    "block_stats": q_block_stats,
    "block_stats_daily": q_block_stats_daily,
    "profile_mean": q_profile_mean,
    "profile_total": q_profile_total,
    # reports
    "data_window": q_data_window,
    "cpu_by_day_queue": q_cpu_by_day_queue,
    "cpu_by_day": q_cpu_by_day,
    "cpu_by_queue": q_cpu_by_queue,
    "cpu_by_user": q_cpu_by_user,
    "cpu_by_user_queue": q_cpu_by_user_queue,
    "cpu_by_hour": q_cpu_by_hour,
    "cpu_by_hour_queue": q_cpu_by_hour_queue,
    # forecast
    "forecast_fit": q_forecast_fit,
    "forecast_frame": q_forecast_frame,
    "forecast": q_forecast,
    "forecast_backtest": q_forecast_backtest,
    "forecast_all": q_forecast_all,
    "forecast_weekly": q_forecast_weekly,
    "forecast_trend": q_forecast_trend,
    # capacity
    "queue_nodes": q_queue_nodes,
    "utilisation": q_utilisation,
    "pool_utilisation": q_pool_utilisation,
    "orphan_groups": q_orphan_groups,
    "shared_nodes": q_shared_nodes,
}
