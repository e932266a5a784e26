"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Input for each core below which rows are dealt out anew.
SPREAD_BYTES = 32 << 20

# Runtime settings the plans rely on; all are ordinary Spark options.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot host must be split even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows written to cut a lineage go when no plan refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str, shuffle_partitions: int, app: str = "spindrift") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master without that setting;
    on a cluster the setting is required.
    """
    sc = spark.sparkContext
    root = configured_root(spark)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
        return sc.getCheckpointDir()  # the setting cannot be changed any more, but this can be asked for
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def configured_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run's tables."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to reliable storage, so that a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The rows dealt over all cores, if their tables (those of ``like``) are so small that a few tasks would read them.

    Work on texts then keeps all cores busy; rows of large tables stay where
    they are read.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = (df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SPREAD_BYTES else df


def side_by_side(*jobs: Callable) -> list:
    """What the functions give, each run in a thread of its own: small Spark jobs then fill the cluster together."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))
