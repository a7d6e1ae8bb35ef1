from pyspark.sql import SparkSession

from shardloom.sources.chunks import Chunks
from shardloom.sources.indexed_tar import TarSlices
from shardloom.sources.loglines import LogLines
from shardloom.sources.mds import Mds
from shardloom.sources.tar import TarShards


def register(spark: SparkSession) -> SparkSession:
    """Make the shard formats known to a session."""
    # Readers take filters on the shard column; Spark refuses such readers while this is off.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TarShards, Mds, Chunks, TarSlices, LogLines):
        spark.dataSource.register(source)
    return spark
