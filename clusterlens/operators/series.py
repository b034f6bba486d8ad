"""Job intervals -> resources in use per queue and tick.

Two plans give the same table:

* ``explode``: every job becomes one row per tick it covers (both ends
  included), then one partial/final aggregation on (queue, tick). Work is
  proportional to the total number of job-ticks.
* ``sweep``: every job becomes two change points (+w at its first tick, -w
  one step after its last); change points are summed per (queue, tick), a
  running sum gives the level between change points, and only the ticks
  where at least one job is active are written out. Work before the output
  is proportional to the number of jobs, whatever their length.

The running sum is computed in time blocks: a window per (queue, phase,
block) plus a carried-in offset from the (small) table of block totals, so
no task ever holds a whole queue, however hot the queue is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_same

# Measure column of the series -> job column it sums.
DEFAULT_MEASURES = {
    "cpus": "num_processors",
    "mem": "avg_mem",
    "run": "run_time",
    "pend": "ineligible_pend_time",
    "gpu": "num_gpu_rusages",
}


def first_event(entries: DataFrame, end_col: str = "approx_end") -> DataFrame:
    """One-row table: the first observed (rounded) end time."""
    return entries.agg(F.min(end_col).alias("first_event"))


def _clamped(entries: DataFrame, start_col: str, end_col: str,
             clamp: bool, first: DataFrame | None) -> DataFrame:
    """Add ``_s`` (start clamped to the first event) and ``_e`` (end)."""
    if clamp:
        first = first if first is not None else first_event(entries, end_col)
        # One row, one column, whatever was given: safe to broadcast at any scale.
        df = entries.crossJoin(F.broadcast(first.agg(F.min("first_event").alias("first_event"))))
        s = F.greatest(F.col("first_event"), F.col(start_col))
    else:
        df = entries.withColumn("first_event", F.lit(None).cast("bigint"))
        s = F.col(start_col)
    return df.withColumn("_s", s).withColumn("_e", F.col(end_col))


#: A job that claims to run longer than this many seconds, or beyond this instant, is an error in the log.
MAX_SECONDS, MAX_INSTANT = 1 << 32, 1 << 60
#: Ticks that one generated array holds at most.
MAX_ARRAY = 1 << 23


def too_long(start: F.Column, end: F.Column) -> F.Column:
    """Whether a job's claimed interval can't be one (NULL where an end is unknown)."""
    far = (F.abs(start.cast("double")) > MAX_INSTANT) | (F.abs(end.cast("double")) > MAX_INSTANT)
    return far | (F.try_subtract(end, start) > MAX_SECONDS)


def _ordered(df: DataFrame, start_col: str, end_col: str, closed: str, step: int) -> tuple[DataFrame, F.Column, F.Column]:
    """Jobs of a clamped table that start before they end, the last instant of their
    grid, and whether their interval can be one. That is left to the generators to
    test: as a filter it would be pushed into the parse and take minutes to plan."""
    last = F.col("_e") if closed == "both" else F.col("_e") - step
    return df.filter(F.col("_s") <= last), last, ~too_long(F.col(start_col), F.col(end_col))


def with_ticks(df: DataFrame, keep: Sequence, start: F.Column, last: F.Column, step: int, tick_col: str) -> DataFrame:
    """``keep`` and one row for each tick from ``start`` to ``last``. Where the step is so fine that
    the longest job's ticks are no bounded array, they are generated block by block."""
    width = F.lit(step).cast("bigint")
    if MAX_SECONDS // step <= MAX_ARRAY:
        return df.select(*keep, F.explode(F.sequence(start, last, width)).alias(tick_col))
    block = F.lit(step * MAX_ARRAY // 128).cast("bigint")
    blocks = df.select("*", last.alias("_last"), F.explode(F.sequence(start, last, block)).alias("_from"))
    until = F.least(F.col("_last"), F.col("_from") + block - width)
    return blocks.select(*keep, F.explode(F.sequence(F.col("_from"), until, width)).alias(tick_col))


def interval_rejects(entries: DataFrame, start_col: str = "approx_start", end_col: str = "approx_end",
                     clamp: bool = True, first: DataFrame | None = None) -> DataFrame:
    """One row: jobs that give no tick, by reason.

    ``n_reversed`` started after their end, ``n_too_long`` claim an interval that
    can't be one (see ``too_long``), ``n_before_first`` ended before the first event
    (none when the first event is taken from ``entries``), ``n_unknown`` lack a
    start or an end; ``n_covering`` cover a tick.
    """
    df = _clamped(entries, start_col, end_col, clamp, first)
    start, end = F.col(start_col), F.col(end_col)
    reason = (F.when(start.isNull() | end.isNull(), "unknown").when(start > end, "reversed")
              .when(too_long(start, end), "too_long").when(F.col("_s") <= end, "covering").otherwise("before_first"))
    return df.select(reason.alias("why")).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        *[F.count_if(F.col("why") == w).alias(f"n_{w}")
          for w in ("covering", "reversed", "too_long", "before_first", "unknown")])


def job_ticks(entries: DataFrame, step: int = 1000, start_col: str = "approx_start",
              end_col: str = "approx_end", tick_col: str = "second",
              clamp: bool = True, closed: str = "both",
              first: DataFrame | None = None) -> DataFrame:
    """One row per job and tick it covers.

    Ticks run from the (clamped) start to the end in ``step`` seconds, both
    ends included (``closed='left'`` drops the end tick). Jobs whose start
    lies after their end or whose interval is too long to be one cover no
    tick; ``interval_rejects`` counts them.
    """
    df, last, sound = _ordered(_clamped(entries, start_col, end_col, clamp, first), start_col, end_col, closed, step)
    return with_ticks(df, entries.columns, F.col("_s"), F.when(sound, last), step, tick_col)


def _measure_exprs(entries: DataFrame, measures: dict[str, str], sentinel) -> dict[str, F.Column]:
    """Values to add up by measure. Whole numbers stay BIGINT, others become decimals of
    6 places, so that sums are exact and don't depend on the order; the sum is cut to whole
    numbers once, at the end."""
    kinds, out = dict(entries.dtypes), {}
    for name, src in measures.items():
        v = F.col(src)
        if sentinel is not None:
            v = F.nullif(v, F.lit(sentinel))
        out[name] = v.cast("bigint") if kinds.get(src) in _WHOLE else v.try_cast("decimal(28,6)")
    return out


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def usage_series(entries: DataFrame, group: Sequence[str] = ("queue",),
                 step: int = 1000, measures: dict[str, str] | None = None,
                 start_col: str = "approx_start", end_col: str = "approx_end",
                 tick_col: str = "second", sentinel=-1, clamp: bool = True,
                 closed: str = "both", method: str = "explode",
                 first: DataFrame | None = None) -> DataFrame:
    """Sum of each measure over the jobs active at each (group, tick).

    A ``sentinel`` value (-1) counts as missing; missing values are skipped,
    an all-missing sum is 0. Only ticks with at least one active job appear.
    ``method``: ``explode`` or ``sweep``, which give the same rows; sweep pays
    where the grid is fine against the length of the jobs.
    """
    measures = dict(measures or DEFAULT_MEASURES)
    if method not in ("explode", "sweep"):
        raise ValueError(f"unknown method {method!r}")
    if method == "sweep":
        return usage_sweep(entries, group, step, measures, start_col, end_col,
                           tick_col, sentinel, clamp, closed, first=first)
    group = list(group)
    ticks = job_ticks(entries, step, start_col, end_col, tick_col, clamp, closed, first)
    vals = _measure_exprs(entries, measures, sentinel)
    aggs = [F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(n) for n, v in vals.items()]
    return ticks.groupBy(*group, tick_col).agg(*aggs)


def usage_sweep(entries: DataFrame, group: Sequence[str] = ("queue",), step: int = 1000,
                measures: dict[str, str] | None = None,
                start_col: str = "approx_start", end_col: str = "approx_end",
                tick_col: str = "second", sentinel=-1, clamp: bool = True,
                closed: str = "both", block_ticks: int = 4096,
                first: DataFrame | None = None) -> DataFrame:
    """The series of :func:`usage_series` by change points instead of
    exploding every job (see the module notes)."""
    measures, group = dict(measures or DEFAULT_MEASURES), list(group)
    points = change_points(entries, group, step, measures, start_col, end_col, sentinel, clamp, closed, first)
    names = list(measures)
    return level_ticks(levels(points, group, step, names, block_ticks), group, step, names, tick_col)


def change_points(entries: DataFrame, group: Sequence[str], step: int, measures: dict[str, str],
                  start_col: str = "approx_start", end_col: str = "approx_end", sentinel=-1, clamp: bool = True,
                  closed: str = "both", first: DataFrame | None = None) -> DataFrame:
    """group, _t, d_n, d_<measure>: what each job adds at its first tick and takes away a step behind its last."""
    df, last, sound = _ordered(_clamped(entries, start_col, end_col, clamp, first), start_col, end_col, closed, step)
    vals = _measure_exprs(entries, measures, sentinel)
    # Value and "is present" deltas: a sum over present values is 0 when no
    # active job has the value, like the exploded sum. Both change points of a
    # job come out of one pass over the jobs.
    plus = [F.coalesce(v, F.lit(0)).alias(f"d_{n}") for n, v in vals.items()]
    minus = [(-F.coalesce(v, F.lit(0))).alias(f"d_{n}") for n, v in vals.items()]
    # A job ends one step behind its last tick, which lies on its own grid.
    behind = last - F.pmod(last - F.col("_s"), F.lit(step)) + step
    return df.select(*group, F.inline(F.when(sound, F.array(
        F.struct(F.col("_s").alias("_t"), F.lit(1).cast("bigint").alias("d_n"), *plus),
        F.struct(behind.alias("_t"), F.lit(-1).cast("bigint").alias("d_n"), *minus)))))


def levels(points: DataFrame, group: Sequence[str], step: int, names: Sequence[str],
           block_ticks: int = 4096) -> DataFrame:
    """Change points (group, _t, d_n, d_<name>) -> group, _t, _next, d_n, d_<name>: the
    level from each change point up to the next, where a job is active.

    Ticks of a job sit at its start + k * step; jobs of different phase never
    share a tick, so each phase is its own sweep.
    """
    dcols = ["d_n"] + [f"d_{n}" for n in names]
    # Map-side partial sums collapse the change points before the shuffle. The
    # block is a key of the sums and the join below takes NULL keys, so both
    # uses of the change points have the same plan and share one exchange.
    width = step * block_ticks
    part = [*group, "_ph"]
    cp = (points.select(*group, F.pmod(F.col("_t"), F.lit(step)).alias("_ph"), "_t", *dcols)
          .withColumn("_b", F.floor(F.col("_t") / F.lit(width)).cast("bigint"))
          .groupBy(*part, "_b", "_t").agg(*[F.sum(c).alias(c) for c in dcols]))
    # Block totals and the level carried into each block (small table).
    blocks = cp.groupBy(*part, "_b").agg(*[F.sum(c).alias(f"b_{c}") for c in dcols],
                                         F.min("_t").alias("_bfirst"))
    wb = Window.partitionBy(*part).orderBy("_b")
    blocks = blocks.select(
        *part, "_b",
        *[F.coalesce(F.sum(f"b_{c}").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"o_{c}") for c in dcols],
        F.lead("_bfirst").over(wb).alias("_next_block_first"))
    # Running level within the block, plus the carried-in offset.
    w = Window.partitionBy(*part, "_b").orderBy("_t")
    run = join_same(cp, blocks, [*part, "_b"]).select(
        *part, "_t",
        *[(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"o_{c}")).alias(c)
          for c in dcols],
        F.coalesce(F.lead("_t").over(w), F.col("_next_block_first")).alias("_next"))
    # Each level holds from its change point up to the next one.
    return run.filter((F.col("d_n") > 0) & F.col("_next").isNotNull()).select(*group, "_t", "_next", *dcols)


def level_ticks(live: DataFrame, group: Sequence[str], step: int, names: Sequence[str], tick_col: str) -> DataFrame:
    """The rows of ``levels`` as one row for each tick."""
    out = with_ticks(live, [*group, *[f"d_{n}" for n in names], "_t"], F.col("_t"), F.col("_next") - step, step, tick_col)
    return out.select(*group, tick_col, *[F.col(f"d_{n}").cast("bigint").alias(n) for n in names])


def merge_partials(partials: DataFrame, group: Sequence[str] = ("queue",),
                   tick_col: str = "second", measures: Sequence[str] | None = None) -> DataFrame:
    """Combine partial series (e.g. one per ingest batch) into the final one."""
    measures = list(measures or DEFAULT_MEASURES)
    return (partials.groupBy(*group, tick_col)
            .agg(*[F.sum(m).cast("bigint").alias(m) for m in measures]))


def sorted_series(series: DataFrame, tick_col: str = "second",
                  group: Sequence[str] = ("queue",)) -> DataFrame:
    """Output order by tick (then group) - a range-partitioned global sort."""
    return series.orderBy(tick_col, *group)
