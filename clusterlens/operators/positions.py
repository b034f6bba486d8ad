"""Positions in an order without a single-task window.

``row_number() over (order by k)`` with no partition moves every row into one
task, and with a partition the rows of its largest group. Here the rows are
dealt into ranges of the whole order (group, key, then tiebreak, so that a key
which many rows share is cut too), sorted inside their range and written once
with their place in it. The place of the first row of each (group, range) and
the number of rows of the group in the ranges before are a small table that
is joined to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path
from .joins import join_same

# monotonically_increasing_id() holds the partition above this many bits of row count
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "position",
             size: str | None = None, ranges: int | None = None) -> DataFrame:
    """0-based ``out`` of each row in ``order`` within its group of ``by``; the
    rows of the group go to ``size`` if it is named.

    NULL keys of ``by`` form a group. Rows equal in ``order`` are numbered in
    any order. ``ranges`` defaults to the session's shuffle partitions. The
    rows are written to the shared scratch folder, because the limits of the
    ranges are sampled and must not be drawn twice; ``df`` is read twice, so
    it should be a table that was written itself.
    """
    spark, by = df.sparkSession, list(by)
    place, range_, first, before = (f"_{x}_{out}" for x in ("place", "range", "first", "before"))
    path = new_path(spark, "ranges")
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    dealt = (df.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
             .sortWithinPartitions(*keys).withColumn(place, F.monotonically_increasing_id()))
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn(range_, F.shiftright(place, _ROW_BITS))
    parts = dealt.groupBy(*by, range_).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("n"))
    if by:
        w = Window.partitionBy(*by)
        earlier = w.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*by, range_, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
                             *([F.sum("n").over(w).alias(size)] if size else []))
    else:  # one row for each range
        rows = sorted(tuple(r) for r in parts.collect())
        ends = list(accumulate(r[2] for r in rows))
        table = [(r[0], r[1], end - r[2], ends[-1]) for r, end in zip(rows, ends, strict=True)]
        parts = spark.createDataFrame(table, f"{range_} long, {first} long, {before} long, {size or 'n'} long")
        parts = parts if size else parts.drop("n")
    return join_same(dealt, parts, [*by, range_]).select(
        *df.columns, (F.col(place) - F.col(first) + F.col(before)).alias(out), *([size] if size else []))


def row_numbered(df: DataFrame, key: str, out: str = "row_number", tiebreak: list[str] | None = None,
                 descending: bool = False, ranges: int | None = None) -> DataFrame:
    """1-based position of each row in the order of ``key``, then ``tiebreak``.

    NULLs come last and are numbered like other rows. Rows equal in key and
    tiebreak are numbered in any order.
    """
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    rows = numbered(df, [first, *(F.col(c).asc_nulls_last() for c in tiebreak or [])], out=out, ranges=ranges)
    return rows.withColumn(out, F.col(out) + 1)
