"""Session settings the operators count on; all can be changed at run time."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Splits hot join keys and coalesces small shuffle partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Wide window
    # and feature projections pass that, so let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # A worker gets at most 32 MB of text pieces at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

#: AQE merges shuffle partitions, and scans cut files, by compressed size. Rows of a few numbers take ten
#: times that in a sort or a hash map: 64 and 128 MB of them spill. Queries of such rows take less at a time.
NARROW_ROWS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.files.maxPartitionBytes": 16 << 20}
_own: dict[tuple[str, str], str] = {}


def _size_parts(spark: SparkSession, narrow: bool) -> None:
    """Bound both sizes for narrow rows; otherwise give the session back its own values."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in NARROW_ROWS.items():
        app, now = (spark.sparkContext.applicationId, key), spark.conf.get(key)
        if narrow and as_bytes(now) > most:
            _own[app] = now
            spark.conf.set(key, f"{most}b")
        elif not narrow and app in _own:
            own = _own.pop(app)
            if as_bytes(now) == most:
                spark.conf.set(key, own)


def tune(spark: SparkSession, narrow: bool = False) -> SparkSession:
    # Python workers find this package where the driver has it.
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    _size_parts(spark, narrow)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
