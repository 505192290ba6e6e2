"""Files that newly arrive, once each: what a batch job does with rows it has no result for, as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_up(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], key: str) -> None:
    """Runs job on the files in source not yet seen and adds rows whose key target does not hold, one row of each key.

    Each batch is a folder of target, named by the stream and the batch's number and written beside it first: a batch
    that was cut off leaves nothing that a reader sees, and one that is repeated after its folder got its name adds
    nothing. Of several rows of one key in a batch the least one stays, so a repetition would choose the same.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def one(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        done = path(f"{target}/batch={stream}-{number}")
        if fs.exists(done):
            return
        new = job(batch)
        columns = new.columns
        if fs.exists(path(target)) and any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path(target))):
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        new = new.groupBy(key).agg(F.min(F.struct(*columns)).alias("x")).select("x.*").select(*columns)
        beside = path(f"{target}/_new-{uuid.uuid4().hex}")
        new.write.parquet(beside.toString())
        if not fs.rename(beside, done):
            raise OSError(f"{done} could not be named")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
