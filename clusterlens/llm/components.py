"""Connected components of a link table by alternating large and small stars.

Every round is two keyed aggregations over the links, written to the shared
scratch folder. No group is ever collected: what belongs to a hub with many
links meets its rows by a broadcast of fewer than ``HOT_KEYS`` rows, and only
the other nodes' rows are shuffled to a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import stage


#: Keys with more than one in HOT_KEYS of all rows are broadcast; there are always fewer than that.
HOT_KEYS = 1000


def with_least(rows: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` with m, the least ``value`` (null last) of all rows of the same non-null ``key``.

    ``total`` is at least the number of rows, which bounds the number of hot keys.
    """
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(least.where(F.col("n") * HOT_KEYS > total).select(key, "m"))
    cold = least.where(F.col("n") * HOT_KEYS <= total).select(key, "m")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u gets linked with the least of u and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (with_least(both, "u", "v", 2 * total).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """u and every smaller neighbour get linked with the least of them."""
    # the neighbour that is the least itself gives the link of u
    end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return with_least(links, "u", "v", total).select(end.alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, component): the least node that can be reached.

    Nodes without links, and the least nodes themselves, are not in the result.
    Links of a node with itself and null ends are ignored, repeated links count
    once; no links give an empty table.
    """
    now = stage(links.where(F.col("a") != F.col("b"))
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before or not n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = n, mark
        # a large star has no more rows than the links it is made of
        now = stage(_small_star(_large_star(now, n), n), "stars")
