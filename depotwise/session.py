"""Session settings the jobs rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: coalesce small shuffle partitions, split skewed join partitions, switch a
# shuffled join to a broadcast one only when the measured size allows it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stream state (one row per shipment, per link and country) lives on local disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(
    cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the bench. `folder` takes the written intermediates."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("depotwise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if folder is not None:
        builder = builder.config(CHECKPOINT_KEY, folder)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for written intermediates. Only a session without that setting
    that runs inside one JVM (tests, bench) gets a temporary folder of its own."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    # the setting is fixed once a session runs, so the folder is kept where Spark keeps the one set at run time
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="depotwise-"))
    return context.getCheckpointDir()


WRITTEN: dict[str, list[str]] = {}  # paths by application


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all intermediates that this application has written; nothing made from them may be in use any more.
    Returns how many there were."""
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def discard(*frames: DataFrame) -> None:
    """Delete intermediates that `materialise` gave; what is made from them must have been written before."""
    for df in frames:
        spark = df.sparkSession
        paths = WRITTEN.get(spark.sparkContext.applicationId, [])
        names = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
        for path in [p for p in paths if p.rsplit("/", 1)[-1] in names]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            paths.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back. Used where several outputs or passes
    share an expensive step: it cuts the lineage, survives lost executors and gives the planner the
    real size of the data."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
