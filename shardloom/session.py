"""Session settings, and the shared folder that staged tables and shard files live under."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Payload blobs make rows wide: bound Arrow batches by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "shardloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shardloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, by the session's default file system, so tasks resolve it as Spark does."""
    context = spark.sparkContext
    jvm_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path of a glob, is there."""
    context = spark.sparkContext
    jvm_path = context._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """A folder and all that is in it."""
    context = spark.sparkContext
    jvm_path = context._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(jvm_path, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return qualified(spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame) -> DataFrame:
    """Materialise a narrow table in the shared folder, so later passes neither rescan payloads nor depend
    on the executors that computed it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
