"""Streaming forms of the mergeable statistics.

The inputs are keyed by method or run, so state stays one row per key and no
watermark is needed; with an event time, add ``withWatermark`` before the call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitelake.operators.metrics import confusion, finite


def streaming_confusion(stream: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("method",)) -> DataFrame:
    """Confusion counts over all score batches so far; write in complete or update mode."""
    return confusion(stream, threshold, by)


def streaming_stats(stream: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample variance, min and max of finite values so far."""
    aggs = []
    for c in cols:
        v = finite(c)
        aggs += [F.count(v).alias(f"{c}_n"), F.avg(v).alias(f"{c}_mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(f"{c}_var"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return stream.groupBy(*by).agg(*aggs)


def streaming_best_epoch(stream: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Best epoch per run of a growing log, the earlier one among equals."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e")))
    return stream.groupBy(run).agg(best.alias("b"), F.max(epoch).alias("last_epoch")).select(
        run, (-F.col("b.e")).alias("best_epoch"), F.col("b.m").alias("best_value"), "last_epoch")


def late_tolerant(stream: DataFrame, time: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """Rows of a log that come at most ``delay`` behind the newest event time, each key once.

    A run that is started again writes its epochs again; within the delay only the
    first row of a key counts. State for older keys is dropped, so it stays bounded
    however long the log grows. A batch table is deduplicated as a whole.
    """
    if not stream.isStreaming:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def drain(spark: SparkSession, result: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Run a streaming aggregate over everything available now and return its final table.

    Each micro-batch writes the rows of the ``keys`` that it has changed under its
    batch number in the shared folder; the newest row of each key is read back. A
    batch that runs again after a failure writes its own folder again. A restart on
    the same checkpoint without new input returns the table of the run before.
    """
    keys = list(keys)
    rest = [c for c in result.columns if c not in keys]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    changes = spark.read.schema(StructType([*result.schema.fields, StructField("batch", LongType())])).parquet(path)
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in result.columns])
