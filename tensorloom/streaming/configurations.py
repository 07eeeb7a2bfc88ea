"""The work queue: each configuration is evaluated once, as its file or rows arrive.

Where a queue of configuration names was shared through a locked file, here a
stream delivers new ones and its checkpoint remembers which were done; a batch
that is run again writes the same partitions again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unfinished(configurations: DataFrame, done: DataFrame) -> DataFrame:
    """Those of which no result exists yet."""
    return configurations.join(done.select("cfg").distinct(), "cfg", "left_anti")


def finished(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("cfg").distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "cfg string")


def run_queue(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True):
    """Evaluates the arriving rows (with a cfg column) and overwrites their partitions of target.

    once: what is there now, then it ends; else it keeps running.
    """

    def batch(rows: DataFrame, _: int) -> None:
        out = evaluate(rows)
        out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("cfg").parquet(target)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_mean(stream: DataFrame, key: str, value: str, time: str, window: str, late: str) -> DataFrame:
    """Means per window of event time, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
