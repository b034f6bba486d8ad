"""Pools of queues that share nodes, and their utilisation.

Queues whose nodes overlap can't be judged one by one: a node that two queues
share counts for both. A pool is a connected component of the graph of queues and
nodes, and its capacity counts each node once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..sources.tables import compute


def pools(qn: DataFrame) -> DataFrame:
    """(queue, pool): the least queue that is reached through shared nodes, for pairs (queue, node).

    Each round gives every node the least label among its queues and every queue the least among
    its nodes, then follows the labels once more, so long chains take few rounds.
    Labels are one row for each queue or node; a node of many queues, or a queue of many
    nodes, meets them in joins of the pairs themselves, which adaptive execution splits.
    Pairs with a NULL don't count.
    """
    pairs = compute(qn.where("queue IS NOT NULL AND node IS NOT NULL").select("queue", "node").distinct(), "pairs")
    now = compute(pairs.select("queue", F.col("queue").alias("pool")).distinct(), "pools")
    while True:
        of_node = pairs.join(now, "queue").groupBy("node").agg(F.min("pool").alias("pool"))
        near = pairs.join(of_node, "node").groupBy("queue").agg(F.min("pool").alias("near"))
        labels = now.select(F.col("queue").alias("near"), F.col("pool").alias("far"))
        after = compute(near.join(labels, "near").select("queue", F.least("near", "far").alias("pool")), "pools")
        changed = after.join(now, ["queue", "pool"], "left_anti").limit(1).count()
        now = after
        if not changed:
            return now


def pool_cores(qn: DataFrame, pool_of: DataFrame, cores_per_node: int) -> DataFrame:
    """pool, n_queues, n_nodes, total_cores: every node of a pool once."""
    members = qn.join(pool_of, "queue")
    return members.groupBy("pool").agg(
        F.count_distinct("queue").alias("n_queues"), F.count_distinct("node").alias("n_nodes"),
        (F.count_distinct("node") * cores_per_node).alias("total_cores"))


def pool_utilisation(series: DataFrame, pool_of: DataFrame, cores: DataFrame, measure: str = "cpus") -> DataFrame:
    """pool, second, the measure summed over the pool's queues, total_cores and utilisation.

    Series rows of queues without a pool (NULL among them) form no pool and are left out.
    """
    used = (series.join(pool_of, "queue").groupBy("pool", "second").agg(F.sum(measure).alias(measure)))
    return (used.join(cores.select("pool", "total_cores"), "pool")
            .withColumn("utilisation", safe_div(F.col(measure), F.col("total_cores"))))
