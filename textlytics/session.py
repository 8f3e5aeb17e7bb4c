"""Session helpers: a tuned SparkSession and a shared scratch/checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "textlytics") -> SparkSession:
    """Local/test session.  On a cluster, pass nothing: master and sizing come
    from spark-submit, this only adds the SQL settings the operators rely on."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Spark runs one task per core: numpy inside a task must not start its
        # own BLAS/OpenMP thread pool on top (oversubscription)
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.MKL_NUM_THREADS": "1",
        # checkpoint files of a query are removed once its data is unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # partition sizing: 128 MB scan splits; AQE coalesces post-shuffle
        # partitions towards 128 MB and splits skewed ones (> 5x median and
        # > 256 MB), so partition counts follow the data, not a fixed number
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (and let Python workers import the package).

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without one this raises.  Only in local mode (tests) a private folder
    is created."""
    sc = spark.sparkContext
    _reach_workers(sc)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="textlytics-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _reach_workers(sc) -> None:
    """Let Python workers on this machine import the package from where the driver did.
    (On a cluster the package is installed on the nodes or sent with --py-files.)"""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([home, *known])


def fixed_splits(spark: SparkSession) -> SparkSession:
    """The session, set to split files the same way from now on.

    Spark cuts a scan by the number of cores that it sees when a job starts.  That number
    falls when an executor is lost, and row numbers by split would name other rows then."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for round-trip sinks."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "textlytics-scratch", f"{name}-{uuid.uuid4().hex[:12]}")
