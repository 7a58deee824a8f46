"""Shards by jump consistent hashing.

A key walks through a pseudo-random sequence of jumps; the last place before the
number of shards is its shard. There is no table of ring positions, and a key's
walk does not depend on the number of shards: one more shard only takes keys
into itself, one in ``n + 1`` of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, running_totals
from sitelake.llm.frames import free_name

# Fixed values of the published algorithm: the multiplier of its generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``: all keys walk together until the last has left the range."""
    if shards < 1:
        raise DataContractError(f"{shards} shards")
    keys = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), np.int64)
    walking = np.arange(len(keys))
    step = np.zeros(len(keys), np.int64)
    while len(walking):
        at[walking] = step
        keys[walking] = keys[walking] * MULTIPLIER + np.uint64(1)
        span = (keys[walking] >> np.uint64(33)).astype(np.float64) + 1.0
        step = ((step + 1) * (float(1 << 31) / span)).astype(np.int64)
        inside = step < shards
        walking, step = walking[inside], step[inside]
    return at


def stable_key(c: Column) -> Column:
    """64 bits of a value's decimal text, as a long; the same in every engine and session. Null counts as the empty text."""
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    # Two halves, as a long has no unsigned form.
    high, low = (F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def shard_of(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards`` - 1) of a long key, in Arrow batches of the key alone."""

    @F.pandas_udf("int")
    def walk(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return walk(key)


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with its shard in a new column; a column of that name raises.

    Rows of one key share a shard. To keep equal texts together, pass a column with
    a digest of the text as ``key``.
    """
    if name in docs.columns:
        raise DataContractError(f"there is a column {name} already")
    return docs.withColumn(name, shard_of(stable_key(F.col(key)), shards))


def moved(docs: DataFrame, shards: int, grown: int, key: str = "doc_id") -> DataFrame:
    """Rows that another shard holds once ``grown`` shards replace ``shards``, with ``from_shard`` and ``to_shard``."""
    both = with_shard(with_shard(docs, shards, key, "from_shard"), grown, key, "to_shard")
    return both.where("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, shards: int, files: int = 4, key: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, one folder ``shard=k`` each, of ``files`` files at most.

    Rows are dealt by shard and a second hash, so a shard never goes through one task.
    """
    shard, salt = free_name(docs, "shard"), free_name(docs, "salt")
    dealt = with_shard(docs, shards, key, shard).withColumn(salt, F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    dealt.repartition(shards * files, shard, salt).drop(salt).write.partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, place in it and size of every row of ``docs(doc_id, text)``.

    ``size`` is the bytes of the UTF-8 text plus 1 (null or empty: 1), ``text_crc32``
    its checksum, ``slot`` counts the rows of a shard from 0 by ``doc_id`` (nulls
    first), ``size`` and checksum; rows that agree in all three are alike but for
    their slots. ``grown_shard`` is the shard with one more. The law is ``key``: the
    id and the number of shards decide, so equal texts follow their ids and rows of
    one id stay together, null ids as well. An empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = stable_key(F.col("doc_id"))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    # Written first: the sort samples its input, and texts are to be read once.
    ranked = running_totals(durable(read, "shards"), ["doc_id", "size", "text_crc32"], by=["shard"], rank="slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard",
    )
