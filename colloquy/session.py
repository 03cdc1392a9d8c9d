"""Session construction and the shared folder for intermediate data."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the run-time work the operators rely on: it splits skewed join
# partitions, coalesces small ones and turns a join into a broadcast only once
# it has measured the small side.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text rows are dear to work on: splits of 32 MB spread a table over more cores.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.ui.enabled": "false",
}

_local_roots: dict[str, str] = {}


def build_session(
    app: str = "colloquy",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings above; `master` stays unset under spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only a
    local master may go without: there a temporary folder is visible to all
    tasks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app_id = context.applicationId
        if app_id not in _local_roots:
            _local_roots[app_id] = tempfile.mkdtemp(prefix="colloquy-")
            # what this process made for itself goes with it
            atexit.register(shutil.rmtree, _local_roots[app_id], ignore_errors=True)
        root = _local_roots[app_id]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_back(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, so that what reads it twice does not make it twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
