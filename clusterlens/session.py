"""Session helpers: a local session for tests and benches, and the shared
scratch folder taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clusterlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and read as is; without it the
    call raises, since a folder of the driver's own would not reach the
    executors. Only with a local master an unset folder is replaced by a
    private one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="clusterlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder (never reused)."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so
    that their Python workers can import it (they need numpy and pyarrow, but
    no installed copy). The archive travels through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_clusterlens_shipped", False):
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="clusterlens-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(path))
    context._clusterlens_shipped = True


def cluster_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                 partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster run (e.g. 100 TB of logs on 1000 executors).

    * input splits of ``partition_bytes`` (text and Parquet alike), so a task
      reads a bounded slice whatever the total size;
    * the first shuffle starts with enough partitions for the whole input
      (never fewer than the cores), and AQE coalesces them to
      ``partition_bytes`` after each stage and splits skewed ones - a queue
      holding a third of all rows is cut into many tasks at joins;
    * broadcasts only below AQE's measured 64 MB; every join falls back to
      a shuffle join above it;
    * Arrow batches of at most 10,000 lines for the vectorised parser, which
      cuts them into slices of 1 MB whatever the length of the lines.

    ``spark.checkpoint.dir`` is not set here: it must name the shared folder
    of the cluster, and :func:`scratch_dir` reads it from the session.
    """
    cores = executors * cores_per_executor
    initial = max(cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }
