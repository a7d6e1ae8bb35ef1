"""A write whose tasks fail on their first attempt; run by test_retry in a session that allows retries."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shardloom.operators.checks import reconcile  # noqa: E402
from shardloom.plans.prepare import read_shards, write_mds, write_tar  # noqa: E402
from shardloom.session import build_session, fresh_dir  # noqa: E402
from shardloom.sources.storage import locate  # noqa: E402


def fail_late_once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt lost")


spark = build_session("retry", "local[4,3]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(400).select(F.col("id").alias("sample_id"), F.encode(F.repeat(F.lit("x"), 50), "UTF-8").alias("image"),
                               F.col("id").cast("string").alias("text"))
shaky = rows.mapInArrow(fail_late_once, rows.schema)
for source, path in (("tarshards", write_tar(shaky, fresh_dir(spark, "tar"), 900, 30, least_bytes=0, digits=1)),
                     ("mds", write_mds(shaky, fresh_dir(spark, "mds"), 1500, digits=1))):
    filesystem, base = locate(path)
    names = os.listdir(base)
    key = F.col("text") if source == "mds" else F.decode("txt", "UTF-8")
    written = read_shards(spark, source, path).select(key.cast("long").alias("sample_id"))
    assert reconcile(rows, written).count() == 0
    assert not [n for n in names if n.endswith(".part")]
    print(source, "whole", len(names))

# Downstream of the exchange the writer task itself dies, after files of it are complete.
path = fresh_dir(spark, "tar")
sharded = rows.select((F.col("sample_id") % 8).alias("shard"), F.format_string("k%d", "sample_id").alias("__key__"),
                      F.col("image").alias("jpg")).repartitionById(3, F.pmod("shard", F.lit(3)).cast("int"))
sharded = sharded.sortWithinPartitions("shard", "__key__")
sharded.mapInArrow(fail_late_once, sharded.schema).write.format("tarshards").mode("overwrite").save(path)
assert read_shards(spark, "tarshards", path).count() == 400
assert sorted(os.listdir(locate(path)[1])) == [f"dataset-train-{n:06d}.tar" for n in range(8)] + ["index.json"]
print("writer whole")
spark.stop()
