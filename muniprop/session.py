"""Session helpers: a local session for tests/bench and a shared checkpoint location."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans joins and partition counts at runtime and
# splits skewed join partitions (one municipality can hold a third of all rows).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "muniprop", shuffle_partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MUNIPROP_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}  # application id -> scratch folder of a local session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the deployment must set it to shared storage; a machine-local folder would be
    empty on every other executor, so an unset value is an error there. Only a local session
    (one JVM, as in tests) gets a scratch folder of its own, removed when Python exits.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="muniprop-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
        current = _LOCAL_SCRATCH[app]
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a parquet table in the shared checkpoint folder and reading it back.

    Used where a plan forks (the branches would otherwise recompute everything upstream) and
    as a recovery point: a lost executor costs the work since the last written table only.
    (``DataFrame.checkpoint`` would compute the plan twice: once to count, once to write.)
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)
