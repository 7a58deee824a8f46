"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable


def _stars(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every end of ``links(u, v)``; a component is named by its smallest node.

    Links with a null end and loops are ignored. Large-star always emits
    ``u > v``, so small-star only moves the remaining neighbours of ``u`` below
    its smallest one. The number of rounds is logarithmic whatever the diameter.
    Every round is written to the shared folder; minima are combined before the
    shuffle and AQE splits a hot node in the joins. Only a count and a checksum
    of a round reach the driver. Raises after ``max_rounds`` rather than return
    components that are not final.
    """
    e = durable(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        e = durable(_stars(e), "links")
    else:
        raise DataContractError(f"components did not settle in {max_rounds} rounds; {seen[0]} links are left")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
