"""Incremental ingest of accounting logs with a mergeable state.

A job is logged when it ends but covers ticks back to its start, so no
watermark bounds how late a tick can still change short of the longest job.
Instead of streaming state, every micro-batch adds a part to each of six
tables below ``out_dir``:

* ``log_entries`` - the narrow job rows of the batch whose instance (job_id, idx,
  requeue_time) no batch before holds;
* ``repeats``     - its rows that repeat an instance, with the reason;
* ``quarantine``  - its rejected lines with their status;
* ``audit``       - its lines per status;
* ``points``      - change points of the usage, summed per queue and instant;
* ``events``      - the first event of the batch and its number of jobs.

The parts of a batch become visible in one commit (see ``Snapshots``), which also
records the batch: a batch that failed halfway left nothing, and a batch that
was committed is skipped when it comes again. Change points are not clamped to
the observed window; readers clamp them to the least first event of all
batches. So batches may come in any order of time, and the order doesn't
change the result.

``compact`` merges parts of like size, so what a reader opens grows with the
logarithm of the number of batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse as P
from ..operators import series as ser
from ..operators.clean import LOG_ENTRY_KEY, log_entries
from ..operators.series import DEFAULT_MEASURES, usage_series
from ..sources.key_index import KeyIndex
from ..sources.logs import without_bad_bytes
from ..sources.snapshots import Snapshots
from ..sources.tables import compute

#: The fields that job rows, series and row order need.
FIELDS = ["job_id", "queue", "start_time", "event_time", "num_processors", "avg_mem", "run_time",
          "ineligible_pend_time", "num_gpu_rusages", "idx", "requeue_time"]
_AS_NUMBER = ["run_time", "ineligible_pend_time", "requeue_time"]
TABLES = ["log_entries", "repeats", "quarantine", "audit", "points", "events"]
_SUMS = ["d_n", *[f"d_{m}" for m in DEFAULT_MEASURES]]


def batch_entries(parsed: DataFrame) -> DataFrame:
    """Accepted rows of a parse of ``FIELDS`` -> narrow job rows."""
    rows = P.parsed_rows(parsed)
    return log_entries(rows.select(*[F.col(c).try_cast("bigint").alias(c) if c in _AS_NUMBER else c
                                     for c in FIELDS]))


def partial_series(lines: DataFrame, first: int | None, step: int = 1000,
                   method: str = "explode") -> DataFrame:
    """Log lines of one batch -> partial usage series of their jobs."""
    parsed = P.parse_log(P.where_type(without_bad_bytes(lines), "JOB_FINISH"), fields=FIELDS, keep_line=False)
    # staged, as filters on job times that are pushed into the parse take long to plan
    return usage_series(P.stage(batch_entries(parsed)), step=step, method=method,
                        first=_one_row(lines.sparkSession, first))


def _one_row(spark: SparkSession, first: int | None) -> DataFrame | None:
    if first is None:
        return None
    return spark.range(1).select(F.lit(first).cast("bigint").alias("first_event"))


def change_points(entries: DataFrame, sentinel: int = -1) -> DataFrame:
    """queue, at, ends, d_n, d_<measure>: what starts (``ends`` false) and ends at each instant.

    Neither clamped to a window nor laid on a grid, so states of batches are merged by
    adding them up. Jobs that cover no tick whatever the window are left out.
    """
    start, end = F.col("approx_start"), F.col("approx_end")
    rows = entries.where((start <= end) & ~ser.too_long(start, end))
    sums = [F.lit(1).cast("bigint").alias("d_n"),
            *[F.coalesce(F.nullif(F.col(src), F.lit(sentinel)), F.lit(0)).cast("bigint").alias(f"d_{m}")
              for m, src in DEFAULT_MEASURES.items()]]
    points = rows.select("queue", F.inline(F.array(
        F.struct(start.alias("at"), F.lit(False).alias("ends"), *sums),
        F.struct(end.alias("at"), F.lit(True).alias("ends"), *sums))))
    return merge_points(points)


def merge_points(points: DataFrame) -> DataFrame:
    return points.groupBy("queue", "at", "ends").agg(*[F.sum(c).alias(c) for c in _SUMS])


def usage_of_points(points: DataFrame, first: int, step: int = 1000) -> DataFrame:
    """The usage series from ``first`` on of change points that lie on one grid of ``step``.

    What started before ``first`` counts from there; what also ended before cancels.
    """
    at, f = F.col("at"), F.lit(first).cast("bigint")
    sign = F.when(F.col("ends"), -1).otherwise(1)
    clamped = points.select("queue", F.when(at < f, f).when(F.col("ends"), at + step).otherwise(at).alias("_t"),
                            *[(F.col(c) * sign).alias(c) for c in _SUMS])
    names = list(DEFAULT_MEASURES)
    return ser.level_ticks(ser.levels(clamped, ["queue"], step, names), ["queue"], step, names, "second")


def _ranges(batches: Sequence[Sequence[int]], more: int) -> list[list[int]]:
    """Sorted, closed ranges of batch ids with one id more."""
    out: list[list[int]] = []
    for low, high in sorted([*map(list, batches), [more, more]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _index(spark: SparkSession, out_dir: str) -> KeyIndex:
    return KeyIndex(spark, f"{out_dir.rstrip('/')}/job_keys")


def write_batch(lines: DataFrame, batch_id: int, out_dir: str, first: int | None = None) -> None:
    """Add one batch to every table; a batch that was committed before is skipped.

    ``first``, if given, is the start of the observed window of all batches, instead
    of the least first event.
    """
    spark = lines.sparkSession
    store, index = Snapshots(spark, out_dir), _index(spark, out_dir)
    base = store.state()
    facts = {"batches": [], "loads": [], "first_event": None, **base["facts"]}
    if any(low <= batch_id <= high for low, high in facts["batches"]):
        return
    parsed = compute(P.parse_log(without_bad_bytes(lines), fields=FIELDS), "parsed")
    load = f"b{batch_id}"
    fresh, repeats = index.split(batch_entries(parsed), LOG_ENTRY_KEY, load, facts["loads"])
    entries = store.part(fresh, level=0)
    kept = store.parts_frame([entries], entries["schema"])
    parts = {
        "log_entries": entries,
        "repeats": store.part(repeats, level=0),
        "quarantine": store.part(P.quarantine(parsed), level=0),
        "audit": store.part(P.parse_audit(parsed), level=0),
        "points": store.part(change_points(kept), level=0),
        "events": store.part(kept.agg(F.min("approx_end").alias("first_event"), F.count(F.lit(1)).alias("n_jobs")), level=0),
    }
    facts |= {"batches": _ranges(facts["batches"], batch_id), "loads": [*facts["loads"], load]}
    if first is not None:
        facts["first_event"] = first
    store.commit(base, {name: store.extended(base, name, part) for name, part in parts.items()}, facts)


def compact(spark: SparkSession, out_dir: str, fan_in: int = 8, keep: int = 2) -> int:
    """Merge parts of one level, ``fan_in`` or more of them, into one of the next, in one
    commit; the number of parts merged. Versions before the newest ``keep`` are removed.

    Each row is rewritten once for each level, and levels grow by ``fan_in``. The key index
    is merged likewise: its loads are written once more before the old ones go, as a key
    that is stored twice does no harm.
    """
    store, index = Snapshots(spark, out_dir), _index(spark, out_dir)
    base = store.state()
    merged, tables = 0, {}
    for name, table in base["tables"].items():
        parts = table["parts"]
        for level in sorted({p["level"] for p in parts}):
            group = [p for p in parts if p["level"] == level]
            if len(group) < fan_in:
                continue
            rows = store.parts_frame(group, table["schema"])
            if name == "points":
                rows = merge_points(rows)
            elif name == "audit":
                rows = rows.groupBy("status").agg(F.sum("n_lines").alias("n_lines"))
            elif name == "events":
                rows = rows.agg(F.min("first_event").alias("first_event"), F.sum("n_jobs").alias("n_jobs"))
            else:
                rows = rows.hint("rebalance")
            whole = store.part(rows, level=level + 1)
            parts = [p for p in parts if p["level"] != level] + Snapshots.table([whole])["parts"]
            merged += len(group)
        if parts is not table["parts"]:
            tables[name] = {"schema": table["schema"], "parts": parts}
    facts, old = base["facts"], []
    if len(facts.get("loads", [])) >= fan_in:
        old = facts["loads"]
        load = f"m{base['version']}"
        index.merge(old, load)
        facts = {**facts, "loads": [load]}
    if tables or old:
        store.commit(base, tables, facts)
    store.expire(keep)
    live = set(store.state()["facts"].get("loads", []))
    index.drop([x for x in index.loads() if x not in live])
    return merged


def ingest(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
           first_event: int | None = None, max_files_per_trigger: int | None = None,
           fan_in: int | None = None) -> None:
    """Process every log file not seen yet under ``source_dir``, then stop.

    Runs a text ``readStream`` with ``trigger(availableNow=True)``. Progress
    lives in ``checkpoint_dir``: a restart picks up only new files. With ``fan_in``
    the parts are compacted behind every batch.
    """
    def batch(lines: DataFrame, batch_id: int) -> None:
        write_batch(lines, batch_id, out_dir, first_event)
        if fan_in:
            compact(lines.sparkSession, out_dir, fan_in)

    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.load(source_dir).writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_ingested(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """One of ``TABLES`` over all committed batches; audit, points and events as their parts."""
    return Snapshots(spark, out_dir).read(name)


def stored_first_event(spark: SparkSession, out_dir: str) -> int | None:
    """The start of the observed window: as given to a batch, else the least event of
    all batches; None before a batch with a job."""
    store = Snapshots(spark, out_dir)
    state = store.state()
    if state["facts"].get("first_event") is not None:
        return state["facts"]["first_event"]
    if "events" not in state["tables"]:
        return None
    return store.read("events").agg(F.min("first_event")).first()[0]


def read_merged(spark: SparkSession, out_dir: str, step: int = 1000) -> DataFrame:
    """The usage series of all committed batches.

    It is made of the change points if those of the window lie on one grid, as
    rounded times do. Otherwise each job has a grid of its own, and the series is
    made of the job rows.
    """
    store, first = Snapshots(spark, out_dir), stored_first_event(spark, out_dir)
    if first is None:
        no_rows = spark.createDataFrame([], "queue string, second long")
        return no_rows.select("*", *[F.lit(0).cast("bigint").alias(m) for m in DEFAULT_MEASURES])
    points = store.read("points")
    off = points.where((F.col("at") > first) & (F.pmod(F.col("at") - first, F.lit(step)) != 0))
    if off.limit(1).count():
        return ser.usage_sweep(store.read("log_entries"), step=step, first=_one_row(spark, first))
    return usage_of_points(points, first, step)
