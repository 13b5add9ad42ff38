"""Session set-up, the shared folder, and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: folders inside the application's folder that hold what is written now
_scope: ContextVar[str] = ContextVar("_scope", default="")

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where the operator above it then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What one task reads. Spark joins small partitions up to these sizes and cuts files at them, so a task on a larger table
# holds no more; a setting of the cluster's own wins.
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "16MB"),
    "spark.sql.files.maxPartitionBytes": ("128MB", "32MB"),
}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, app: str = "basketry", **conf: str) -> SparkSession:
    """A session with the settings this library expects; the cluster's own settings win for the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
            )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    ship_code()
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere; its time zone stays."""
    for key, value in RUNTIME_CONF.items():
        if key != "spark.sql.session.timeZone":
            spark.conf.set(key, value)
    for key, (default, value) in TASK_BYTES.items():
        if spark.conf.get(key) in (default, f"{int(default[:-2]) << 20}b"):
            spark.conf.set(key, value)
    ship_code()
    return spark


def small_batches(spark: SparkSession, size: str = "4MB") -> None:
    """Rows go to Python workers about 4 MB at a time from now on, unless the session has a limit of its own.

    Spark's limit of 10,000 rows makes batches as large as the rows are long, and the executor and its
    worker hold several of them.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def ship_code() -> None:
    """Send this package's functions to the workers with the tasks, for workers without it installed."""
    import basketry

    cloudpickle.register_pickle_by_value(basketry)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is made, but only in local mode: on a cluster a
    folder on one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="basketry-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder, under one folder per application."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/basketry-{spark.sparkContext.applicationId}/{_scope.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Intermediate tables written inside go to one folder, of which the path is given; ``drop_path``
    frees them when every result that reads them has been written."""
    folder = scratch_path(spark, name)
    token = _scope.set(folder.split(f"basketry-{spark.sparkContext.applicationId}/", 1)[1] + "/")
    try:
        yield folder
    finally:
        _scope.reset(token)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's intermediate tables, wherever the shared folder is."""
    if f"/basketry-{spark.sparkContext.applicationId}/" not in path:
        raise ValueError(f"not a scratch path of this application: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, if it is read by fewer tasks: a small table in one file would keep one busy.

    Only the number of its partitions is looked at, no column is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores, *keys) if tasks < cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor, like a checkpoint, but keeps column
    pruning and gives the planner the true size, so that it can decide on a broadcast by itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
