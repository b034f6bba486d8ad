"""Queue -> node maps, queue capacity and utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div


def queue_nodes(queue_groups: DataFrame, group_nodes: DataFrame) -> DataFrame:
    """(queue, group) x (group, node) -> distinct (queue, node)."""
    return (queue_groups.join(group_nodes, on="group", how="inner")
            .select("queue", "node").distinct())


def capacity_from_nodes(qn: DataFrame, cores_per_node: int) -> DataFrame:
    """Capacity as nodes of the queue times cores per node."""
    return qn.groupBy("queue").agg((F.count_distinct("node") * cores_per_node)
                                   .cast("int").alias("total_cores"))


def utilisation(series: DataFrame, capacity: DataFrame, measure: str = "cpus") -> DataFrame:
    """Share of the queue's cores in use at each tick (NULL without capacity).

    Capacities are per queue and never summed: queues share nodes. A queue that
    the capacity table lists more than once counts once, with the largest number;
    ``capacity_conflicts`` reports those whose numbers differ. The planner
    broadcasts the table when small and shuffles otherwise.
    """
    once = capacity.groupBy("queue").agg(F.max("total_cores").alias("total_cores"))
    return (series.join(once, on="queue", how="left")
            .withColumn("utilisation", safe_div(F.col(measure), F.col("total_cores"))))


def capacity_conflicts(capacity: DataFrame) -> DataFrame:
    """queue, least, most: queues listed with different numbers of cores."""
    return (capacity.groupBy("queue").agg(F.min("total_cores").alias("least"), F.max("total_cores").alias("most"))
            .where("least <> most"))


def orphans(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``left`` whose key has no match in ``right``."""
    return left.join(right, on=key, how="left_anti")


def shared_nodes(qn: DataFrame, min_queues: int = 2) -> DataFrame:
    """Nodes that serve at least ``min_queues`` queues."""
    return (qn.groupBy("node").agg(F.count_distinct("queue").alias("n_queues"))
            .filter(F.col("n_queues") >= min_queues))
