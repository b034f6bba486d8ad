"""SQL twins of the catalog queries, for DuckDB over the same parquet tables.

Each string is self-contained (tables ``events``, ``lineitem``, ``region``,
``nation``, ``supplier`` are views). Shared steps are written once as CTE
snippets and composed; column names match the Spark queries exactly.
"""

from __future__ import annotations

CHICAGO = "America/Chicago"


def _signif(x: str, digits: int) -> str:
    e = f"(floor(log10(abs(CAST({x} AS DOUBLE)))) - {digits - 1})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN CAST(0 AS DOUBLE) "
            f"WHEN {e} >= 0 THEN round_even(CAST({x} AS DOUBLE) / pow(10, {e}), 0) * pow(10, {e}) "
            f"ELSE round_even(CAST({x} AS DOUBLE) * pow(10, -{e}), 0) / pow(10, -{e}) END)")


def _ts(x: str, tz: str = "UTC") -> str:
    if tz == "UTC":
        return f"make_timestamp(CAST({x} AS BIGINT) * 1000000)"
    return f"timezone('{tz}', to_timestamp(CAST({x} AS BIGINT)))"


def _hour_label(h: str) -> str:
    return f"printf('%02d-%02d', {h}, {h} + 1)"


JOBS = """
jobs AS (
  SELECT CASE WHEN event_id % 10 = 3 THEN event_id - event_id % 100 + 3 ELSE event_id END AS job_id,
         user_id, 'user' || CAST(user_id AS VARCHAR) AS user_name,
         CASE WHEN event_id % 31 <> 4 THEN event_type END AS queue, ep AS submit_time,
         CASE WHEN event_id % 29 = 0 THEN CAST(0 AS BIGINT) ELSE ep + k * 60 END AS start_time,
         CASE WHEN event_id % 37 = 5 THEN ep + k * 60 - 5000 ELSE ep + k * 60 + run END AS event_time,
         run AS run_time,
         event_id % 8 + 1 AS num_processors,
         CASE WHEN event_id % 13 = 0 THEN CAST(-1 AS BIGINT) ELSE k * 1024 END AS avg_mem,
         CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS num_gpu_rusages,
         CAST(0 AS BIGINT) AS max_r_mem,
         CAST(CASE WHEN event_id % 10 = 3 THEN floor(event_id % 100 / 10) ELSE 0 END AS BIGINT) AS idx,
         CAST(0 AS BIGINT) AS requeue_time,
         CASE WHEN event_id % 29 = 0 THEN CAST(-1 AS BIGINT) ELSE k * 60 END AS ineligible_pend_time
  FROM (SELECT event_id, user_id, event_type,
               CAST(floor(epoch(ts)) AS BIGINT) AS ep,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(floor(value * 100) AS BIGINT) AS run
        FROM events) e
)"""

ENTRY_COLS = ("job_id, idx, requeue_time, start_time, approx_start, event_time, approx_end, "
              "num_processors, avg_mem, run_time, ineligible_pend_time, num_gpu_rusages, queue")

GRID = f"""
grid AS (
  SELECT *, CAST({_signif('start_time', 7)} AS BIGINT) AS approx_start,
            CAST({_signif('event_time', 7)} AS BIGINT) AS approx_end
  FROM jobs
)"""

ENTRIES = JOBS + "," + GRID + f""",
entries AS (SELECT {ENTRY_COLS} FROM grid WHERE start_time > 0),
first AS (SELECT min(approx_end) AS first_event FROM entries),
clamped AS (
  SELECT entries.*, greatest(first.first_event, approx_start) AS s FROM entries, first
),
ticks AS (
  SELECT *, unnest(generate_series(s, approx_end, 1000)) AS second
  FROM clamped WHERE s <= approx_end
)"""

SERIES = ENTRIES + """,
series AS (
  SELECT queue, second,
         CAST(coalesce(sum(nullif(num_processors, -1)), 0) AS BIGINT) AS cpus,
         CAST(coalesce(sum(nullif(avg_mem, -1)), 0) AS BIGINT) AS mem,
         CAST(coalesce(sum(nullif(run_time, -1)), 0) AS BIGINT) AS run,
         CAST(coalesce(sum(nullif(ineligible_pend_time, -1)), 0) AS BIGINT) AS pend,
         CAST(coalesce(sum(nullif(num_gpu_rusages, -1)), 0) AS BIGINT) AS gpu
  FROM ticks GROUP BY queue, second
)"""


def _same(a: str, b: str, *keys: str) -> str:
    """A join condition in which NULL meets NULL."""
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def _hb(tz: str = "UTC") -> str:
    return f""",
hb AS (
  SELECT *, {_hour_label('CAST(hour(ds) AS INTEGER)')} AS hour_block, CAST(ds AS DATE) AS date
  FROM (SELECT *, {_ts('second', tz)} AS ds FROM series) x
)"""


def _stats(keys: str, suffix: str) -> str:
    return (f"SELECT {keys}, "
            f"avg(cpus) AS mean_cpus_{suffix}, CAST(sum(cpus) AS BIGINT) AS totl_cpus_{suffix}, "
            f"avg(gpu) AS mean_gpus_{suffix}, CAST(sum(gpu) AS BIGINT) AS totl_gpus_{suffix}, "
            f"avg(mem) AS mean_mem_{suffix}, CAST(sum(mem) AS BIGINT) AS totl_mem_{suffix} "
            f"FROM hb GROUP BY {keys}")


def _stat_cols(suffix: str) -> str:
    return ", ".join(f"{s}_{m}_{suffix}" for m in ("cpus", "gpus", "mem") for s in ("mean", "totl"))


DAILY = SERIES + _hb() + f""",
by_block AS ({_stats('queue, hour_block', 'per_block')}),
by_date AS ({_stats('queue, hour_block, date', 'per_block_per_date')}),
daily AS (
  SELECT hb.*, {_stat_cols('per_block')}, {_stat_cols('per_block_per_date')},
         strftime(hb.date, '%a') AS weekday
  FROM hb JOIN by_block b ON {_same('hb', 'b', 'queue', 'hour_block')}
  JOIN by_date d ON {_same('hb', 'd', 'queue', 'hour_block', 'date')}
)"""


def _train(metrics: tuple[str, ...]) -> str:
    cols = {"cpus": "mean_cpus_per_block_per_date", "gpus": "mean_gpus_per_block_per_date",
            "mem": "mean_mem_per_block_per_date"}
    parts = [f"SELECT '{m}' AS metric, hour_block, queue, second, ds, "
             f"CAST({cols[m]} AS DOUBLE) AS y, date FROM daily" for m in metrics]
    return DAILY + f""",
train AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) u)"""


FIT = f""",
origin AS (SELECT queue, metric, min(second) AS origin FROM train GROUP BY queue, metric),
tt AS (
  SELECT train.*, origin.origin,
         CAST(second - origin.origin AS DOUBLE) / CAST(3600 AS DOUBLE) AS t
  FROM train JOIN origin ON {_same('train', 'origin', 'queue', 'metric')}
),
trend AS (
  SELECT queue, metric, origin, count(*) AS n,
         coalesce(regr_slope(y, t), CAST(0 AS DOUBLE)) AS slope,
         CASE WHEN regr_slope(y, t) IS NULL THEN avg(y) ELSE regr_intercept(y, t) END AS intercept
  FROM tt GROUP BY queue, metric, origin
),
resid AS (
  SELECT tt.queue, tt.metric, CAST(hour(ds) AS INTEGER) AS hour, CAST(dayofweek(ds) + 1 AS INTEGER) AS dow,
         y - (intercept + slope * t) AS r
  FROM tt JOIN trend ON {_same('tt', 'trend', 'queue', 'metric')}
),
effect AS (SELECT queue, metric, hour, avg(r) AS effect FROM resid GROUP BY queue, metric, hour),
spread AS (
  SELECT resid.queue, resid.metric, sqrt(avg(pow(r - effect, 2))) AS sd
  FROM resid JOIN effect ON {_same('resid', 'effect', 'queue', 'metric', 'hour')} GROUP BY resid.queue, resid.metric
),
model AS (
  SELECT tr.queue, tr.metric, h.hour, tr.origin, tr.slope, tr.intercept,
         coalesce(e.effect, CAST(0 AS DOUBLE)) AS effect, sp.sd, tr.n
  FROM trend tr
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
  LEFT JOIN effect e ON {_same('e', 'tr', 'queue', 'metric')} AND e.hour = h.hour
  JOIN spread sp ON {_same('sp', 'tr', 'queue', 'metric')}
),
lastt AS (SELECT queue, metric, max(second) AS l FROM train GROUP BY queue, metric),
frame0 AS (
  SELECT DISTINCT queue, metric, second FROM train
  UNION ALL
  SELECT queue, metric, l + 3600 * r.k AS second FROM lastt, range(1, 49) r(k)
),
frame AS (SELECT *, make_timestamp(second * 1000000) AS ds FROM frame0),
pred AS (
  SELECT f.queue, f.metric, f.second, f.ds,
         m.intercept + m.slope * (CAST(f.second - m.origin AS DOUBLE) / CAST(3600 AS DOUBLE))
           + m.effect AS yhat, m.sd
  FROM frame f JOIN model m
    ON {_same('m', 'f', 'queue', 'metric')} AND m.hour = CAST(hour(f.ds) AS INTEGER)
),
fcst AS (
  SELECT queue, metric, second, ds, yhat,
         yhat - CAST(1.2816 AS DOUBLE) * sd AS yhat_lower,
         yhat + CAST(1.2816 AS DOUBLE) * sd AS yhat_upper
  FROM pred
)"""

def _sig(c: str) -> str:
    return f"{_signif(c, 7)} AS {c.split('.')[-1]}"


_FC_COLS = ", ".join(_sig(c) for c in ("yhat", "yhat_lower", "yhat_upper"))


def _w(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + body


_JOB_ID_COND_BAD = "job_id % 50 IN (7, 8, 9, 10, 12)"


def _group_text(cnt: str, name: str, j: int) -> str:
    return (f"CASE WHEN {cnt} > 0 THEN array_to_string(list_transform(range(1, {cnt} + 1), "
            f"lambda m: '{name}.{j} ' || CAST(m AS VARCHAR)), '|') END")


JT = JOBS + f""",
jt AS (
  SELECT jobs.*, {_ts('start_time')} AS start_ts, {_ts('submit_time')} AS submit_ts,
         {_ts('event_time')} AS event_ts, start_time - submit_time AS pend_time,
         {_ts('start_time + run_time')} AS end_ts,
         CAST(hour({_ts('event_time')}) AS INTEGER) AS event_time_hour,
         run_time AS run_time_sec,
         {_hour_label(f"CAST(hour({_ts('event_time')}) AS INTEGER)")} AS hour_block,
         strftime({_ts('event_time')}, '%a') AS day_block,
         CAST(dayofweek({_ts('event_time')}) + 1 AS INTEGER) AS day_index
  FROM jobs
)"""

HOSTS = """
gn AS (SELECT DISTINCT n_name AS "group", s_name AS node FROM nation JOIN (
         SELECT s_name, s_nationkey AS k FROM supplier
         UNION ALL SELECT s_name, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 5 = 0) m
       ON m.k = n_nationkey WHERE n_nationkey <> 7),
qg AS (SELECT DISTINCT r_name AS queue, n_name AS "group"
       FROM region JOIN nation ON n_regionkey = r_regionkey),
qn AS (SELECT DISTINCT queue, node FROM qg JOIN gn USING ("group"))"""

SQL: dict[str, str] = {}

# ---- parsing -------------------------------------------------------------
SQL["log_parse"] = _w(JOBS, f"""
SELECT event_time, job_id, user_id, num_processors, submit_time, start_time, user_name, queue,
       idx, avg_mem, CAST(run_time AS VARCHAR) AS run_time,
       CAST(ineligible_pend_time AS VARCHAR) AS ineligible_pend_time,
       CAST(requeue_time AS VARCHAR) AS requeue_time, num_gpu_rusages,
       job_id % 4 AS num_ex_hosts, job_id % 3 AS num_host_rusage,
       'run ""a b"" --x' AS command, '10.1' AS version_number,
       CAST(0 AS DOUBLE) AS host_factor, CAST(NULL AS VARCHAR) AS rsv_id,
       CAST(NULL AS VARCHAR) AS rsv_id2, CAST(0 AS BIGINT) AS last_resize_time
FROM jobs WHERE NOT ({_JOB_ID_COND_BAD})""")

SQL["log_status_counts"] = """
SELECT status, count(*) AS n_lines FROM (
  SELECT CASE event_id % 50 WHEN 7 THEN 'bad_width' WHEN 8 THEN 'empty_segment'
         WHEN 9 THEN 'unknown_type' WHEN 10 THEN 'bad_type' WHEN 12 THEN 'bad_group'
         ELSE 'ok' END AS status
  FROM events) s
GROUP BY status"""

#: count expression of each group of the rendered finish records, and its columns
_GROUPS = {
    "num_ex_hosts": ("job_id % 4", ["exec_hosts"]),
    "num_host_rusage": ("job_id % 3", [f"host_rusage_{x}" for x in ("hostname", "mem", "swap", "utime", "stime")]),
    "num_gpu_rusages": ("num_gpu_rusages", [f"g_rusage_{x}" for x in ("hostname", "num_kvp", "key", "value")]),
} | {name: (f"(CASE WHEN job_id % 7 = {k} THEN job_id % 3 ELSE 0 END)", cols) for k, (name, cols) in enumerate({
    "num_asked_hosts": ["asked_hosts"],
    "submit_ext_num": ["submit_ext_key", "submit_ext_value"],
    "num_network": ["network_id", "network_alloc_num_window"],
    "num_alloc_slots": ["alloc_slots"],
    "index_range_cnt": [f"index_range_{x}" for x in ("start1", "end1", "step1", "start_n", "end_n", "step_n")],
    "storage_info_c": ["storage_info_v"],
    "finish_kvp_num_kvp": ["finish_kvp_key", "finish_kvp_value"]}.items())}

_ALL_GROUPS = ", ".join(f"{_group_text(cnt, name, j)} AS {c}"
                        for name, (cnt, cols) in _GROUPS.items() for j, c in enumerate(cols))
SQL["log_groups"] = _w(JOBS, f"""
SELECT job_id, idx, {_ALL_GROUPS} FROM jobs WHERE NOT ({_JOB_ID_COND_BAD})""")


def _resize_group(cnt: str, name: str, count_col: str, col: str) -> str:
    return (f"CAST({cnt} AS BIGINT) AS {count_col}, CASE WHEN {cnt} > 0 THEN array_to_string(list_transform("
            f"range(1, {cnt} + 1), lambda m: '{name} ' || CAST(m AS VARCHAR)), '|') END AS {col}")


SQL["log_resize"] = _w(JOBS, f"""
SELECT event_time, job_id, CAST(idx AS VARCHAR) AS tdx, start_time, user_id, user_name,
       submit_time AS last_resize_time,
       {_resize_group('job_id % 4', 'exec host', 'num_exec_hosts', 'exec_hosts')},
       {_resize_group('job_id % 3', 'new host', 'num_resize_hosts', 'resize_hosts')},
       {_resize_group('job_id % 2', 'slots', 'num_alloc_slots', 'alloc_slots')},
       {_resize_group('(job_id + 1) % 3', 'new slots', 'num_resize_slots', 'resize_slots')}
FROM jobs""")

SQL["log_status_mixed"] = _w(JOBS, """
SELECT status, count(*) AS n_lines FROM (
  SELECT CASE job_id % 50 WHEN 7 THEN 'bad_width' WHEN 8 THEN 'empty_segment' WHEN 9 THEN 'unknown_type'
         WHEN 10 THEN 'bad_type' WHEN 12 THEN 'bad_group' ELSE 'ok' END AS status FROM jobs
  UNION ALL SELECT 'other_type' FROM jobs
  UNION ALL SELECT 'unsupported_type' FROM jobs WHERE job_id % 100 = 1) s
GROUP BY status""")

SQL["log_type_filter"] = _w(JOBS, "SELECT job_id FROM jobs WHERE job_id % 50 <> 9")

SQL["log_reject_places"] = _w(JOBS + """,
placed AS (SELECT job_id, job_id // 1000 AS f,
                  row_number() OVER (PARTITION BY job_id // 1000 ORDER BY job_id, event_time) AS line_number
           FROM jobs)""", """
SELECT f, line_number, CASE job_id % 50 WHEN 7 THEN 'bad_width' WHEN 8 THEN 'empty_segment' WHEN 9 THEN 'unknown_type'
       WHEN 10 THEN 'bad_type' ELSE 'bad_group' END AS status, job_id
FROM placed WHERE job_id % 50 IN (7, 8, 9, 10, 12)""")

SQL["log_repair"] = _w(JOBS, """
SELECT job_id, true AS starts_with_quote, job_id % 50 <> 11 AS untouched FROM jobs""")

_WIDTHS = " + ".join(f"{len(cols)} * ({cnt})" for cnt, cols in _GROUPS.values())
SQL["log_tokens"] = _w(JOBS, f"""
SELECT job_id,
       CAST(108 + {_WIDTHS}
            + CASE WHEN job_id % 50 = 7 THEN 1 ELSE 0 END AS INTEGER) AS n_fields,
       CASE WHEN job_id % 50 = 9 THEN 'JOB_NEW' ELSE 'JOB_FINISH' END AS record_type,
       CASE WHEN job_id % 50 = 7 THEN 'extra'
            WHEN job_id % 7 = 6 AND job_id % 3 > 0 THEN 'finish_kvp_num_kvp.1 ' || CAST(job_id % 3 AS VARCHAR)
            ELSE '0' END AS last_field
FROM jobs""")

SQL["clean_names"] = _w(JOBS, """
SELECT start_time, submit_time, event_time, run_time, num_processors, max_r_mem, user_name, queue
FROM jobs""")

SQL["ragged_explode"] = _w(HOSTS, 'SELECT "group" AS key, node AS value FROM gn')

SQL["log_parse_sql"] = SQL["log_parse"]

SQL["log_file"] = _w(JOBS, f"""
SELECT job_id, idx, queue, 'run ""a b"" --x' AS command FROM jobs WHERE NOT ({_JOB_ID_COND_BAD})""")

SQL["table_round_trip"] = _w(JOBS, "SELECT job_id, idx, queue, event_time FROM jobs WHERE queue IS NOT NULL")

SQL["ingest_batches"] = _w(SERIES.replace(
    "FROM grid WHERE start_time > 0", f"FROM grid WHERE start_time > 0 AND NOT ({_JOB_ID_COND_BAD})"),
    "SELECT * FROM series")

SQL["ingest_falling"] = SQL["ingest_stream"] = SQL["ingest_batches"]

_READ = f"FROM jobs WHERE start_time > 0 AND NOT ({_JOB_ID_COND_BAD})"
_INSTANCE = "SELECT job_id, idx, requeue_time, event_time, queue"
SQL["ingest_unique"] = _w(JOBS, f"""
{_INSTANCE}, num_processors, CAST(NULL AS VARCHAR) AS reason {_READ} AND job_id % 3 <> 0
UNION ALL {_INSTANCE}, num_processors, 'within_load' {_READ} AND job_id % 3 <> 0 AND job_id % 7 = 0
UNION ALL {_INSTANCE}, num_processors + 1, NULL {_READ} AND job_id % 3 = 0
UNION ALL {_INSTANCE}, num_processors + 1, 'known' {_READ} AND job_id % 3 <> 0""")

SQL["table_snapshots"] = _w(JOBS, """
SELECT job_id, idx, queue, event_time, version FROM jobs, (VALUES (2), (3)) v(version) WHERE job_id % 2 = 0
UNION ALL SELECT job_id, idx, queue, event_time, 3 FROM jobs WHERE job_id % 3 = 1""")

SQL["csv_jobs"] = _w(JOBS, """
SELECT job_id, idx, 'sh -c "x,' || job_id || '" z' AS command, queue, avg_mem FROM jobs WHERE user_id % 17 <> 0""")

SQL["csv_files"] = SQL["csv_jobs"]

SQL["csv_rejects"] = _w(JOBS, """
SELECT job_id || ',' || idx || ',"sh -c ""x,' || job_id || '"" z",' || coalesce(queue, '') || ',abc' AS line
FROM jobs WHERE user_id % 17 = 0""")

# ---- cleaning ------------------------------------------------------------
SQL["jobs_started"] = _w(JOBS, "SELECT * FROM jobs WHERE start_time > 0")

SQL["signif_grid"] = _w(JOBS, f"""
SELECT job_id, start_time, CAST({_signif('start_time', 7)} AS BIGINT) AS approx_start,
       event_time, CAST({_signif('event_time', 7)} AS BIGINT) AS approx_end,
       {_signif('run_time', 2)} AS run_time_2
FROM jobs""")

SQL["row_numbered"] = _w(JOBS, """
SELECT job_id, queue, row_number() OVER (ORDER BY job_id, idx, requeue_time) AS row_number FROM jobs""")

SQL["log_entries"] = _w(JOBS + "," + GRID, f"""
SELECT row_number, {ENTRY_COLS} FROM (
  SELECT *, row_number() OVER (ORDER BY job_id, idx, requeue_time) AS row_number FROM grid) g
WHERE start_time > 0""")

SQL["event_lookup"] = _w(JOBS + """,
span AS (SELECT min(event_time) AS low, (max(event_time) - min(event_time)) // 4 AS step,
                min(job_id) AS a, max(job_id) AS b FROM jobs)""", """
SELECT job_id, idx, queue, event_time, 'time' AS by FROM jobs, span
WHERE event_time >= low + step AND event_time < low + 2 * step
UNION ALL SELECT job_id, idx, queue, event_time, 'key' FROM jobs, span WHERE job_id IN (a, (a + b) // 2, b)""")

SQL["duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

SQL["sentinel_nulls"] = _w(ENTRIES, """
SELECT job_id, idx, requeue_time,
       nullif(start_time, -1) AS start_time, nullif(approx_start, -1) AS approx_start,
       nullif(event_time, -1) AS event_time, nullif(approx_end, -1) AS approx_end,
       nullif(num_processors, -1) AS num_processors, nullif(avg_mem, -1) AS avg_mem,
       nullif(run_time, -1) AS run_time,
       nullif(ineligible_pend_time, -1) AS ineligible_pend_time,
       nullif(num_gpu_rusages, -1) AS num_gpu_rusages, queue
FROM entries""")

SQL["epoch_to_ts"] = _w(JOBS, f"""
SELECT job_id, {_ts('start_time')} AS start_ts, {_ts('submit_time')} AS submit_ts,
       {_ts('event_time')} AS event_ts, {_ts('event_time', CHICAGO)} AS event_ts_local
FROM jobs""")

SQL["job_times"] = _w(JT, """
SELECT job_id, pend_time, end_ts, run_time_sec, event_time_hour, hour_block, day_block, day_index
FROM jt""")

SQL["weekdays"] = _w(JOBS, f"""
SELECT job_id, strftime({_ts('event_time', CHICAGO)}, '%a') AS day_block,
       CAST(dayofweek({_ts('event_time', CHICAGO)}) + 1 AS INTEGER) AS day_index
FROM jobs""")

SQL["hour_blocks"] = _w(SERIES + _hb(CHICAGO),
                        "SELECT queue, second, hour_block, ds, CAST(date AS VARCHAR) AS date FROM hb")

SQL["front_columns"] = _w(JT, "SELECT * FROM jt")

SQL["series_select"] = _w(_train(("mem",)), """
SELECT metric, hour_block, queue, second, ds, y, CAST(date AS VARCHAR) AS date FROM train""")

# ---- series --------------------------------------------------------------
SQL["first_event"] = _w(ENTRIES, "SELECT first_event FROM first")
SQL["job_ticks"] = _w(ENTRIES, "SELECT job_id, queue, second, num_processors FROM ticks")
for _k in ("usage_series", "usage_sweep", "usage_merge"):
    SQL[_k] = _w(SERIES, "SELECT * FROM series")
_SUMMED = {"cpus": "num_processors", "mem": "avg_mem", "run": "run_time", "pend": "ineligible_pend_time",
           "gpu": "num_gpu_rusages"}


def _points(at: str, sign: str) -> str:
    sums = ", ".join(f"{sign}coalesce(nullif({c}, -1), 0) AS {m}" for m, c in _SUMMED.items())
    return f"SELECT queue, {at} AS t, {sign}1 AS jobs, {sums} FROM clamped WHERE s <= approx_end"


_RUNS = ENTRIES + f""",
points AS (SELECT queue, t, {', '.join(f'sum({m}) AS {m}' for m in ('jobs', *_SUMMED))}
           FROM ({_points('s', '')} UNION ALL {_points('approx_end + 1', '-')}) p GROUP BY queue, t),
levels AS (SELECT queue, t AS "from", lead(t) OVER w AS "to",
                  {', '.join(f'CAST(sum({m}) OVER w AS BIGINT) AS {m}' for m in ('jobs', *_SUMMED))}
           FROM points WINDOW w AS (PARTITION BY queue ORDER BY t)),
runs AS (SELECT * FROM levels WHERE jobs > 0)"""
SQL["usage_runs"] = _w(_RUNS, "SELECT * FROM runs")

_OVERLAP = 'least(w."to", r."to") - greatest(w."from", r."from")'
SQL["usage_at"] = _w(_RUNS + """,
days AS (SELECT DISTINCT queue, approx_end // 86400 AS d FROM entries),
windows AS (SELECT queue, d * 86400 AS "from", d * 86400 + 86400 AS "to" FROM days
            UNION ALL SELECT queue, d * 86400 + 43200, d * 86400 + 216000 FROM days)""", f"""
SELECT w.queue, w."from", w."to", CAST(coalesce(sum({_OVERLAP}) FILTER (r.jobs > 0), 0) AS BIGINT) AS seconds,
       {', '.join(f'CAST(coalesce(sum({m} * ({_OVERLAP})) FILTER (r.jobs > 0), 0) AS BIGINT) AS {m}' for m in _SUMMED)}
FROM windows w LEFT JOIN runs r
  ON r.queue IS NOT DISTINCT FROM w.queue AND r."from" < w."to" AND w."from" < r."to"
GROUP BY w.queue, w."from", w."to"
""")

SQL["usage_series_sorted"] = _w(SERIES, """
SELECT *, row_number() OVER (ORDER BY second NULLS FIRST, queue NULLS FIRST) AS position FROM series""")

SQL["interval_rejects"] = _w(JOBS + "," + GRID + """,
entries AS (SELECT * FROM grid WHERE start_time > 0),
first AS (SELECT min(approx_end) AS f FROM entries)""", """
SELECT count(*) AS n_jobs,
       count(*) FILTER (greatest(f, approx_start) <= approx_end AND approx_end - approx_start <= 4294967296) AS n_covering,
       count(*) FILTER (approx_start > approx_end) AS n_reversed,
       count(*) FILTER (approx_end - approx_start > 4294967296) AS n_too_long,
       count(*) FILTER (approx_start <= approx_end AND greatest(f, approx_start) > approx_end) AS n_before_first,
       count(*) FILTER (approx_start IS NULL OR approx_end IS NULL) AS n_unknown
FROM entries, first""")

SQL["series_one_queue"] = _w(_train(("cpus",)), """
SELECT metric, hour_block, queue, second, ds, y, CAST(date AS VARCHAR) AS date FROM train WHERE queue = 'click'""")

# ---- profiles ------------------------------------------------------------
SQL["block_stats"] = _w(SERIES + _hb() + f""",
by_block AS ({_stats('queue, hour_block', 'per_block')})""", f"""
SELECT hb.queue, second, hb.hour_block, cpus, gpu, mem, {_stat_cols('per_block')}
FROM hb JOIN by_block b ON {_same('hb', 'b', 'queue', 'hour_block')}""")

SQL["block_stats_daily"] = _w(DAILY, f"""
SELECT queue, second, hour_block, cpus, gpu, mem, CAST(date AS VARCHAR) AS date, weekday,
       {_stat_cols('per_block')}, {_stat_cols('per_block_per_date')}
FROM daily""")

SQL["profile_mean"] = _w(SERIES + _hb(), """
SELECT queue, hour_block, avg(cpus) AS mean_cpus_per_block FROM hb GROUP BY queue, hour_block""")

SQL["profile_total"] = _w(SERIES + _hb(), """
SELECT queue, hour_block, CAST(sum(cpus) AS BIGINT) AS totl_cpus_per_block
FROM hb GROUP BY queue, hour_block""")

# ---- reports -------------------------------------------------------------
SQL["data_window"] = _w(JT, """
SELECT CAST(CAST(min(event_ts) AS DATE) AS VARCHAR) AS window_start,
       CAST(CAST(max(event_ts) AS DATE) AS VARCHAR) AS window_end
FROM jt""")

SQL["cpu_by_day_queue"] = _w(JT, """
SELECT day_block, queue, day_index, CAST(sum(num_processors) AS BIGINT) AS cpu_sum
FROM jt GROUP BY day_block, queue, day_index""")

SQL["cpu_by_day"] = _w(JT, """
SELECT day_block, day_index, queue, CAST(sum(q) OVER (PARTITION BY day_block) AS BIGINT) AS cpu_sum
FROM (SELECT day_block, day_index, queue, sum(num_processors) AS q
      FROM jt GROUP BY day_block, day_index, queue) x""")

SQL["cpu_by_queue"] = _w(JT, """
SELECT *, row_number() OVER (ORDER BY cpu_sum, queue NULLS FIRST) AS position FROM (
  SELECT queue, CAST(sum(num_processors) AS BIGINT) AS cpu_sum FROM jt GROUP BY queue) x""")

SQL["cpu_by_user"] = _w(JT, """
SELECT *, row_number() OVER (ORDER BY cpu_sum, user_name NULLS FIRST) AS position FROM (
  SELECT user_name, CAST(sum(num_processors) AS BIGINT) AS cpu_sum FROM jt GROUP BY user_name) x""")

SQL["cpu_by_user_queue"] = _w(JT, """
SELECT user_name, queue, CAST(q AS BIGINT) AS cpu_que_sum,
       CAST(sum(q) OVER (PARTITION BY user_name) AS BIGINT) AS total_cpu_sum
FROM (SELECT user_name, queue, sum(num_processors) AS q FROM jt GROUP BY user_name, queue) x""")

SQL["cpu_by_hour"] = _w(JT, """
SELECT hour_block, queue, CAST(sum(q) OVER (PARTITION BY hour_block) AS BIGINT) AS cpu_sum
FROM (SELECT hour_block, queue, sum(num_processors) AS q FROM jt GROUP BY hour_block, queue) x""")

SQL["cpu_by_hour_queue"] = _w(JT, """
SELECT hour_block, queue, CAST(sum(num_processors) AS BIGINT) AS cpu_sum
FROM jt GROUP BY hour_block, queue""")

# ---- forecast ------------------------------------------------------------
_ALL = ("cpus", "gpus", "mem")
SQL["forecast_fit"] = _w(_train(_ALL) + FIT, f"""
SELECT queue, metric, hour, origin, {_sig('slope')}, {_sig('intercept')},
       {_sig('effect')}, {_sig('sd')}, n
FROM model""")

SQL["forecast_frame"] = _w(_train(("cpus",)) + FIT, f"""
SELECT f.queue, f.metric, f.second, f.ds, CAST(h.last_date AS VARCHAR) AS last_date
FROM frame f JOIN (SELECT queue, metric, max(date) AS last_date FROM train GROUP BY queue, metric) h
  ON {_same('f', 'h', 'queue', 'metric')}""")

SQL["forecast"] = _w(_train(("cpus",)) + FIT, f"""
SELECT queue, metric, second, ds, {_FC_COLS} FROM fcst""")

_BACKTEST = f"""
SELECT f.queue, f.metric, f.second, f.ds, CAST(t.date AS VARCHAR) AS date, {_FC_COLS},
       {_sig('t.y')}
FROM fcst f LEFT JOIN train t ON {_same('f', 't', 'queue', 'metric', 'second')}"""
SQL["forecast_backtest"] = _w(_train(("cpus",)) + FIT, _BACKTEST)
SQL["forecast_all"] = _w(_train(_ALL) + FIT, _BACKTEST)

_WEEKLY = f""",
rest AS (SELECT resid.*, effect, r - effect AS r2
         FROM resid JOIN effect ON {_same('resid', 'effect', 'queue', 'metric', 'hour')}),
weffect AS (SELECT queue, metric, dow, avg(r2) AS weffect FROM rest GROUP BY queue, metric, dow),
wsd AS (SELECT rest.queue, rest.metric, sqrt(avg(pow(r2 - weffect, 2))) AS sd
        FROM rest JOIN weffect w ON {_same('rest', 'w', 'queue', 'metric', 'dow')} GROUP BY rest.queue, rest.metric),
wpred AS (
  SELECT f.queue, f.metric, f.second, f.ds, s.sd,
         m.intercept + m.slope * (CAST(f.second - m.origin AS DOUBLE) / CAST(3600 AS DOUBLE))
           + m.effect + coalesce(w.weffect, CAST(0 AS DOUBLE)) AS yhat
  FROM frame f JOIN model m ON {_same('m', 'f', 'queue', 'metric')} AND m.hour = CAST(hour(f.ds) AS INTEGER)
  JOIN wsd s ON {_same('s', 'f', 'queue', 'metric')}
  LEFT JOIN weffect w ON {_same('w', 'f', 'queue', 'metric')} AND w.dow = CAST(dayofweek(f.ds) + 1 AS INTEGER)),
wfcst AS (
  SELECT queue, metric, second, ds, yhat, yhat - CAST(1.2816 AS DOUBLE) * sd AS yhat_lower,
         yhat + CAST(1.2816 AS DOUBLE) * sd AS yhat_upper FROM wpred)"""
SQL["forecast_weekly"] = _w(_train(_ALL) + FIT + _WEEKLY, _BACKTEST.replace("fcst f", "wfcst f"))



def _seasons(period: int, order: int) -> list[str]:
    angle = f"((local % {period}) * (2 * pi() / {period}))"
    return [f"CASE WHEN last - origin >= {2 * period} THEN {f}({angle} * {k}) ELSE 0 END"
            for k in range(1, order + 1) for f in ("sin", "cos")]


_U = "CASE WHEN last > origin THEN CAST(second - origin AS DOUBLE) / (last - origin) ELSE 0 END"
_TERMS = ["1", "u", *[f"greatest(u - {0.8 * (j + 1) / 8!r}::DOUBLE, 0)" for j in range(8)],
          *_seasons(86400, 3), *_seasons(7 * 86400, 1), "y / scale"]
SQL["forecast_trend"] = _w(_train(_ALL) + f""",
span AS (SELECT queue, metric, min(second) AS origin, max(second) AS last,
                coalesce(nullif(max(abs(y)), 0), 1) AS scale FROM train GROUP BY queue, metric),
placed AS (SELECT train.queue, train.metric, y, origin, last, scale, {_U} AS u,
                  CAST(floor(epoch(ds)) AS BIGINT) AS local
           FROM train JOIN span ON {_same('train', 'span', 'queue', 'metric')}),
x AS (SELECT queue, metric, [{', '.join(f'CAST({t} AS DOUBLE)' for t in _TERMS)}] AS x FROM placed)""", f"""
SELECT queue, metric, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x[i + 1] * x[j + 1]), 6) + 0.0 AS value
FROM x, range({len(_TERMS)}) a(i), range({len(_TERMS)}) b(j) WHERE i <= j GROUP BY queue, metric, i, j""")

# ---- capacity ------------------------------------------------------------
SQL["queue_nodes"] = _w(HOSTS, "SELECT queue, node FROM qn")

SQL["utilisation"] = _w(SERIES + "," + HOSTS + """,
per_region AS (SELECT queue, CAST(count(DISTINCT node) * 10 AS INTEGER) AS total_cores
               FROM qn GROUP BY queue),
names AS (SELECT series_queue, CAST(dense_rank() OVER (ORDER BY series_queue) - 1 AS INTEGER) AS rk
          FROM (SELECT DISTINCT event_type AS series_queue FROM events) d),
capacity AS (
  SELECT n.series_queue AS queue, p.total_cores
  FROM names n JOIN region r ON r.r_regionkey = n.rk JOIN per_region p ON p.queue = r.r_name
)""", """
SELECT s.queue, s.second, s.cpus, c.total_cores,
       round(CAST(s.cpus AS DOUBLE) / nullif(c.total_cores, 0), 4) AS utilisation
FROM series s LEFT JOIN capacity c USING (queue)""")

SQL["pool_utilisation"] = _w(SERIES + "," + HOSTS + """,
names AS (SELECT series_queue, dense_rank() OVER (ORDER BY series_queue) - 1 AS rk
          FROM (SELECT DISTINCT event_type AS series_queue FROM events WHERE event_type IS NOT NULL) d),
sn AS (SELECT DISTINCT n.series_queue AS queue, qn.node
       FROM names n JOIN region r ON r.r_regionkey = n.rk JOIN qn ON qn.queue = r.r_name),
reach(queue, other) AS (
  SELECT DISTINCT queue, queue FROM sn
  UNION SELECT reach.queue, b.queue FROM reach JOIN sn a ON a.queue = reach.other JOIN sn b ON b.node = a.node),
pool AS (SELECT queue, min(other) AS pool FROM reach GROUP BY queue),
cores AS (SELECT pool, count(DISTINCT node) * 10 AS total_cores FROM sn JOIN pool USING (queue) GROUP BY pool),
used AS (SELECT pool, second, CAST(sum(cpus) AS BIGINT) AS cpus FROM series JOIN pool USING (queue) GROUP BY pool, second)""", """
SELECT pool, second, cpus, total_cores, round(CAST(cpus AS DOUBLE) / nullif(total_cores, 0), 4) AS utilisation
FROM used JOIN cores USING (pool)""").replace("WITH ", "WITH RECURSIVE ", 1)

SQL["orphan_groups"] = _w(HOSTS, """
SELECT queue, "group" FROM qg WHERE "group" NOT IN (SELECT "group" FROM gn)""")

SQL["shared_nodes"] = _w(HOSTS, """
SELECT node, count(DISTINCT queue) AS n_queues FROM qn GROUP BY node
HAVING count(DISTINCT queue) >= 2""")
