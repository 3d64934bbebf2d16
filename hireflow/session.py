"""Spark session settings for the engine.

The settings below are the ones every job relies on: adaptive execution (runtime
re-planning, partition coalescing, skew-join splitting and runtime broadcast
conversion), UTC session time, and no web UI. On a cluster the session is built
by the platform; ``configure`` only fills in what is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Size under which AQE may turn a sort-merge join into a broadcast join after it
# has measured the real size of a shuffle stage. This is the size check behind
# every join whose side is not bounded by the domain itself.
RUNTIME_BROADCAST_BYTES = 32 * 1024 * 1024
# Plan-time threshold, judged from file sizes (compressed parquet understates
# memory size), so it stays at Spark's conservative default.
PLAN_BROADCAST_BYTES = 10 * 1024 * 1024

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(RUNTIME_BROADCAST_BYTES),
    "spark.sql.autoBroadcastJoinThreshold": str(PLAN_BROADCAST_BYTES),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "hireflow",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session. On a cluster use the platform session + ``configure``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULTS)
    conf["spark.driver.memory"] = os.environ.get("HIREFLOW_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf and master:
        conf["spark.checkpoint.dir"] = _own_folder(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill in the engine's SQL settings that a session leaves unset (cluster use)."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql.") and spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def _own_folder(master: str) -> str:
    """A temporary folder for tests on one machine; a cluster must name a shared one."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="hireflow-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared filesystem path set by the platform; it is
    read, never replaced. Only on one machine (tests), where it is unset, a folder
    under the system temp dir is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return path
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = _own_folder(sc.master)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (snapshots, stream state)."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])
