"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# What only a new session can take: checkpoint files go when nothing refers to them any more.
STATIC_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

PARTITION_BYTES = 256 * 1024 * 1024


def sized_conf(shuffle_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Settings for a job whose biggest shuffle moves about ``shuffle_bytes``: AQE joins what turns out smaller.

    Stateful streams keep the number of partitions they were first started with.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-shuffle_bytes // partition_bytes))),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }


def build(app: str = "spokeflow", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**STATIC_CONF, **RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or a scratch one on a local master only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.mkdtemp(prefix="spokeflow-")
    context.setCheckpointDir(scratch)
    return scratch


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, for one run's tables and stream checkpoints; it goes when the session's JVM ends."""
    made = f"{shared_dir(spark)}/spokeflow/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{made}/run"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder; survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
