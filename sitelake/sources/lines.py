"""Lines of text files with their place in the file, without a file ever being one value.

Spark cuts a text file into byte ranges and gives a line to the range in which it
starts. The start of the range and a number that rises within the range put all
lines of a file in order, however many tasks have read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.core import durable

PLACE = ("file", "block", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line, value)``: within a file, ``block`` and then ``line`` rise in the order of its lines.

    Lines may end in ``\\n``, ``\\r\\n`` or ``\\r``. A compressed file is one range.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def with_running_counts(lines: DataFrame, **flags: Column) -> DataFrame:
    """Add for each flag how many lines of the file up to and with this one have it.

    Lines are counted within their range; what the ranges before it hold is added
    from one row per range. The lines are written first, so ranges and numbers
    stay the same for both; pass only those that are needed.
    """
    kept = durable(lines.withColumns({n: F.coalesce(f.cast("long"), F.lit(0).cast("long")) for n, f in flags.items()}), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("file", "block").agg(*[F.sum(n).alias(f"__{n}") for n in flags])
    offsets = sums.select("file", "block", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in flags])
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # Few rows: one per range of a file.
    return kept.join(offsets, ["file", "block"]).select(
        *lines.columns, *[(F.sum(n).over(inside) + F.col(f"__{n}")).alias(n) for n in flags])
