"""Streams drained in several runs: changed keys only, repeated and late epochs, a batch that fails once."""

import glob

import pytest
from pyspark.sql import functions as F

from sitelake.streaming import metrics as T

LOG = "run string, epoch int, metric double, at timestamp"


def rows(spark, *items):
    return spark.createDataFrame([(r, e, m, t) for r, e, m, t in items], "run string, epoch int, metric double, t long").select("run", "epoch", "metric", F.timestamp_seconds("t").alias("at"))


def test_best_epochs_over_restarts(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
        return {r.run: (r.best_epoch, r.best_value, r.last_epoch) for r in T.drain(spark, T.streaming_best_epoch(stream, "metric"), out, state, ["run"]).collect()}

    rows(spark, ("a", 1, 0.5, 0), ("b", 1, 0.1, 0)).coalesce(1).write.mode("append").parquet(src)
    assert run() == {"a": (1, 0.5, 1), "b": (1, 0.1, 1)}
    rows(spark, ("a", 2, 0.5, 1), ("a", 3, 0.9, 2)).coalesce(1).write.mode("append").parquet(src)
    assert run() == {"a": (3, 0.9, 3), "b": (1, 0.1, 1)}
    newest = max(glob.glob(f"{out}/batch=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    assert [r.run for r in spark.read.parquet(newest).collect()] == ["a"]  # b did not change and is not written again
    assert run() == {"a": (3, 0.9, 3), "b": (1, 0.1, 1)}


def test_repeated_and_late_epochs(spark, tmp_path):
    src = f"{tmp_path}/in"

    def kept():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
        q = T.late_tolerant(stream, "at", "100 seconds", ["run", "epoch"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.run, r.epoch, r.metric) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = rows(spark, ("a", 1, 0.5, 1000), ("a", 2, 0.6, 1010))
    first.coalesce(1).write.mode("append").parquet(src)
    assert kept() == [("a", 1, 0.5), ("a", 2, 0.6)]
    rows(spark, ("a", 1, 0.7, 1020), ("a", 3, 0.8, 1500)).coalesce(1).write.mode("append").parquet(src)  # epoch 1 again
    assert kept() == [("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.8)]
    rows(spark, ("b", 1, 0.1, 1000), ("b", 2, 0.2, 1450)).coalesce(1).write.mode("append").parquet(src)  # 500 and 50 seconds behind
    assert kept() == [("a", 1, 0.5), ("a", 2, 0.6), ("a", 3, 0.8), ("b", 2, 0.2)]
    assert T.late_tolerant(first.unionByName(first), "at", "100 seconds", ["run", "epoch"]).count() == 2


def test_a_failed_batch_is_written_again(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("m", 1, 0.7), ("m", 0, 0.2), ("n", 1, 0.1)], "method string, label int, score double").write.parquet(src)
    stream = spark.readStream.schema("method string, label int, score double").parquet(src)
    failing = T.streaming_confusion(stream.withColumn("score", F.when(F.col("method") == "n", F.raise_error("stop")).otherwise(F.col("score"))))
    with pytest.raises(Exception, match="stop"):
        T.drain(spark, failing, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r.method: (r.tp, r.fp, r.tn, r.fn) for r in T.drain(spark, T.streaming_confusion(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got == {"m": (1, 0, 1, 0), "n": (0, 0, 0, 1)}
