"""Session helpers: building a session for tests/bench and reading cluster settings."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every panelfx job relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones; UTC keeps
# date_trunc / to_date stable across executors.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "panelfx",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and benchmarks. On a cluster, use the cluster's own session."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                 "spark.driver.memory": "16g", **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster (a shared file system every
    executor can reach) and is used as is. Only in local mode, where every task can read
    the driver's disk, is a private scratch folder created when it is unset.
    """
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share; "
                               "a machine-local one would lose what other executors write")
        d = tempfile.mkdtemp(prefix="panelfx-ckpt-", dir=os.environ.get("PANELFX_SCRATCH", "/tmp"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_ROOTS: dict[str, str] = {}      # application -> its folder of written forks


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below this application's own root; ``release``
    removes the root, at the latest when the driver's interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages-{app}"
        atexit.register(release, spark)
    return f"{_ROOTS[app]}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the forks this application has written; call it once results are consumed."""
    try:
        root = _ROOTS.pop(spark.sparkContext.applicationId, None)
        if root:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already; the folder is then left to the cluster's cleaning
        pass


def materialize(df: DataFrame, name: str = "fork") -> DataFrame:
    """Write `df` once as Parquet to the shared folder and continue from the written copy.

    Use at a fork -- a stage that several later branches read (the unit-time panel,
    the cohort table): the raw scan, join and aggregation behind it then run once
    instead of once per branch, each branch reads only the columns and row groups it
    needs, and a lost executor recomputes nothing above it. Runs a job when called.
    Never a local checkpoint: the copy lives in the folder of ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
