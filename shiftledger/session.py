"""Session helpers: the shared scratch folder and reliable lineage cuts."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings that suit these jobs on a cluster; adaptive execution itself is on by default.
RECOMMENDED = {
    # Lookup tables up to this size are broadcast, on the size measured at run time.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Beyond it, partitions this small are hashed instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Split a hot partition even where the next step would have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def ship_with_tasks(module: str) -> None:
    """Send the functions of a module along with the tasks, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local session that names none.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shiftledger-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; never reused."""
    return f"{shared_root(spark)}/shiftledger/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them from there on."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
