"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators are tuned for: adaptive execution (coalescing small
# shuffle partitions, splitting skewed join partitions), UTC so timestamps
# agree with other engines, Arrow for the few Python stages, and no UI server.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go with the last reference to their DataFrame.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tablestats", extra: dict | None = None) -> SparkSession:
    """Return a session configured for these operators.

    On a cluster leave ``master`` unset and let the launcher decide; size
    ``shuffle_partitions`` so one partition is roughly 128-256 MB of shuffle
    data at the target scale (AQE coalesces downwards when it is smaller).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). Only when neither is set and the master is local
    (tests), a folder is created and registered; on a cluster a missing
    setting is an error - a machine-local folder would not survive the loss
    of an executor or be visible to the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
    local = tempfile.mkdtemp(prefix="tablestats-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_made: list[str] = []


def release_work(spark: SparkSession) -> int:
    """Delete the work folders made by this process; returns how many.

    For use when the results read from them are no longer needed; each holds a
    copy of what was written to it.
    """
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A fresh, uniquely named folder under the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1) if path.startswith("file:") else path, exist_ok=True)
    return path


def sizing_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan settings for an input of ``input_bytes``.

    About one shuffle partition per ``partition_bytes`` of input (at least
    two per core), so a partition fits executor memory without spilling;
    adaptive execution coalesces them when a stage's output is smaller, and
    splits skewed join partitions. Scan splits of the same size.
    """
    parts = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }
