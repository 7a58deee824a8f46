"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ends words everywhere in this folder: the six ASCII white-space characters.
SPACES = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The same for bytes of UTF-8, where it leaves all longer sequences alone.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_crc(c: Column) -> Column:
    """CRC-32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty and lone surrogates become ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    while name in df.columns:
        name += "_"
    return name


def add_from_text(docs: DataFrame, text: str, fields: dict[str, str], make: Callable[[list], list]) -> DataFrame:
    """``docs`` with new columns made from its texts; all other columns pass through as they are.

    ``fields`` are names and Spark types; ``make`` gets the texts of a batch (null:
    ``None``) and returns a list of values for each field. Names must be new.
    """
    import pyarrow as pa

    schema = StructType(list(docs.schema.fields))
    for name, kind in fields.items():
        schema.add(name, kind)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            made = [pa.array(v) for v in make(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *fields])

    return docs.mapInArrow(run, schema)


def parts_for(rows: int, each: int) -> int:
    """Number of hash parts so that one holds about ``each`` rows."""
    return max(1, -(-int(rows) // each))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Shuffle files go when the driver collects the garbage of their plans, which a
    driver with an idle heap does rarely; the next step then needs twice the disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
