"""Streaming queries (T01, T02): the tables arrive as files and are drained by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.plans import fixtures as fx
from sitelake.plans.metrics_q import COUNTS_05, long_base, round_all
from sitelake.plans.registry import query
from sitelake.plans.sources_q import folder
from sitelake.streaming import metrics as T


def arriving(spark, df, name):
    """Written in the files that its tasks make and read two per micro-batch."""
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("t01_streaming_confusion", f"WITH {fx.LONG_BASE_SQL} {COUNTS_05}")
def _(spark, sf):
    stream = arriving(spark, long_base(spark, sf).select("method", "label", "score"), "stream-scores")
    return T.drain(spark, T.streaming_confusion(stream), folder(spark, "stream-out"), folder(spark, "stream-state"), ["method"])


@query("t02_streaming_stats", """
SELECT event_type, count(value) AS value_n, round(avg(value), 6) AS value_mean, round(coalesce(var_samp(value), 0), 4) AS value_var, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY event_type""")
def _(spark, sf):
    stream = arriving(spark, fx.table(spark, sf, "events").select("event_type", "value"), "stream-events")
    out = T.drain(spark, T.streaming_stats(stream, ["value"], ["event_type"]), folder(spark, "stream-out"), folder(spark, "stream-state"), ["event_type"])
    return round_all(out.withColumn("value_var", F.round("value_var", 4)))


@query("t02_streaming_best_epoch", f"""
WITH {fx.RUNS_SQL} SELECT run, min(epoch) FILTER (metric = top) AS best_epoch, max(metric) AS best_value, max(epoch) AS last_epoch FROM (SELECT *, max(metric) OVER (PARTITION BY run) AS top FROM runs) GROUP BY run""")
def _(spark, sf):
    stream = arriving(spark, fx.runs(spark, sf).select("run", "epoch", "metric"), "stream-runs")
    return T.drain(spark, T.streaming_best_epoch(stream, "metric"), folder(spark, "stream-out"), folder(spark, "stream-state"), ["run"])
