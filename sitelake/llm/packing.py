"""Packing documents into fixed-length training sequences by cutting stock.

Each document is encoded once. Its ids are cut into pieces of the capacity, each
a sequence of its own, and one shorter last piece. The lengths of the last pieces
are counted in units of a few tokens; that histogram (``capacity / unit`` numbers
at most, whatever the table) goes to the driver, where column generation finds
the patterns. Pieces are ranked per length without moving texts and look up
their sequence by rank; inside a sequence they lie without gaps.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm.cutting_stock import plan
from sitelake.llm.pretokens import byte_level

PIECES = (
    "doc_id long, doc_tokens long, part int, whole array<long>, whole_rank long, "
    "last_length int, last_units int, last_crc long, last_rank long"
)


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, unit: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: checksums of its pieces, and ranks of the pieces within the task that made them."""

    def encode(batches):
        from pyspark import TaskContext

        encoder, end = byte_level(tokenizer), end_id.to_bytes(4, "little")
        part, ranks, whole_rank = TaskContext.get().partitionId(), Counter(), 0
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ids = encoder.encode(t or "") + end
                n = len(ids) // 4
                cut = n - n % capacity
                whole = [zlib.crc32(ids[4 * s : 4 * (s + capacity)]) for s in range(0, cut, capacity)]
                units = -(-(n - cut) // unit)
                rows.append((i, n, part, whole, whole_rank, n - cut, units, zlib.crc32(ids[4 * cut :]), ranks[units]))
                whole_rank += len(whole)
                ranks[units] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "doc_tokens", "part", "whole", "whole_rank", "last_length", "last_units", "last_crc", "last_rank"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(encode, PIECES)


def _before(counts: DataFrame, by: list[str]) -> DataFrame:
    """Running count over the tasks; the window holds one row per task and key."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("before", F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, unit: int = 4, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece.

    Null and empty texts still hold the end id. Copies are packed like any other
    rows, null ids too. Lengths are planned in ``unit`` tokens, rounded up, which
    leaves at most ``unit - 1`` tokens per piece unused; ``unit`` divides
    ``capacity``. An empty table gives no rows.
    """
    if capacity % unit:
        raise ValueError("the capacity must be a multiple of the unit")
    spark = docs.sparkSession
    pieces = durable(encode_pieces(docs, tokenizer, capacity, unit, end_id, doc_id, text), "pieces")
    lasts = pieces.where("last_length > 0").drop("whole", "whole_rank")
    by_length = durable(lasts.groupBy("last_units", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in by_length.groupBy("last_units").agg(F.sum("n")).collect()}
    rows, sequences = plan(histogram, capacity // unit)
    where = spark.createDataFrame(rows, "at int, first_rank long, end_rank long, first_sequence long, copies long, place int")
    inside = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, 0)
    lasts = (
        lasts.join(_before(by_length, ["last_units"]).drop("n"), ["last_units", "part"])
        .withColumn("rank", F.col("last_rank") + F.col("before"))
        # At most a row for each length in each pattern: bounded by the capacity, not by the table.
        .join(F.broadcast(where), (F.col("at") == F.col("last_units")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .withColumn("sequence_id", (F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("copies"))).cast("long"))
        .select(
            "doc_id", (F.col("doc_tokens") - F.col("last_length")).alias("start"), F.col("last_length").cast("long").alias("length"),
            F.col("last_crc").alias("ids_crc32"), "doc_tokens", "sequence_id",
            # A sequence has at most ``capacity`` pieces.
            (F.sum("last_length").over(inside) - F.col("last_length")).cast("long").alias("offset"),
        )
    )
    by_part = pieces.groupBy("part").agg(F.sum(F.size("whole")).alias("n"))
    wholes = (
        pieces.where(F.size("whole") > 0).join(_before(by_part, []).drop("n"), "part")
        .select("doc_id", "doc_tokens", (F.col("whole_rank") + F.col("before")).alias("base"), F.posexplode("whole").alias("i", "ids_crc32"))
        .select(
            "doc_id", (F.col("i") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.lit(sequences) + F.col("base") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return lasts.unionByName(wholes)
