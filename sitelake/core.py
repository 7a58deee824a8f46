"""Building blocks shared by the operators.

Everything here exists to keep one group, one window or one driver from ever
holding an unbounded number of rows:

* ``durable``        cuts lineage by writing a table to the shared folder;
* ``running_totals`` exact running sums and ranks without a one-task window;
* ``with_halo``      bounded frames over long sequences, cut into fixed blocks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dirs: dict[str, str] = {}


class DataContractError(ValueError):
    """Raised when an input table breaks a rule an operator relies on."""


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise DataContractError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-sitelake-", dir="/tmp")
    return _local_dirs[app]


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage, survives lost executors and gives every later
    branch of a plan the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``durable`` wrote for ``df``, once nothing will read it again.

    Loops use it for the round before, when the next one has been written: from then
    on a lost executor is answered by the newer table.
    """
    path = getattr(df, "_written_to", None)
    if path is None:
        raise DataContractError("only the result of durable can be discarded")
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataContractError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail when ``violations`` holds any row; at most five of them reach the driver."""
    rows = violations.take(5)
    if rows:
        raise DataContractError(f"{message}; for example {[r.asDict() for r in rows]}")


def sort_keys(order: Sequence[str]) -> list[Column]:
    """``"-name"`` sorts descending, ``"name"`` ascending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    sums: dict[str, str] | None = None,
    rank: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add inclusive running sums (and a 1-based row number) per ``by`` group.

    ``keep`` names the columns of ``df`` to return, all by default; the others only sort.

    A plain window would put a whole group, or with no group the whole table,
    into one task. Here the rows are range-sorted on ``(by, order)``, so a hot
    group spreads over many partitions. Each sorted partition is summed on its way
    to a written table, which is the only shuffle of the rows. Only the first group
    of a partition can have begun before it, so what earlier partitions add is a
    row per partition. Sums of decimals go through a window per partition instead.
    """
    by = list(by)
    keep = df.columns if keep is None else list(keep)
    measures = {out: F.col(src) for out, src in (sums or {}).items()}
    if rank:
        measures[rank] = F.lit(1)
    kinds = {o: df.select(F.sum(m).alias(o)).schema[o].dataType for o, m in measures.items()}
    ordered = df.orderBy(*sort_keys(by), *sort_keys(order)).withColumn("__part", F.spark_partition_id())
    names = [f"__s{i}" for i in range(len(measures))]
    if any(isinstance(k, T.DecimalType) for k in kinds.values()):
        ranged = durable(ordered, "ranged")
        inside = Window.partitionBy(*by, "__part").orderBy(*sort_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
        at = Window.partitionBy("__part").orderBy(*sort_keys(by), *sort_keys(order))
        ranged = durable(ranged.withColumns({n: F.sum(m).over(inside) for n, m in zip(names, measures.values())} | {
            "__head": F.lag(F.lit(1)).over(at).isNull(), "__tail": F.lead(F.lit(1)).over(at).isNull()}), "summed")
    else:
        values = ordered.withColumns({n: m.cast(kinds[o]) for n, (o, m) in zip(names, measures.items())})
        # Equal keys by their bits: -0.0 and 0.0, and all NaN, are one key as in a grouping.
        keyed = values.withColumn("__key", F.struct(*[_one_bit_pattern(df, c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("none")))
        values = values.select(*dict.fromkeys([*by, *keep, "__part", *names]))
        # What only sorts stays out of the Python workers and of the written table.
        keyed = keyed.select(*values.columns, "__key")
        out = T.StructType([T.StructField(f.name, f.dataType) for f in values.schema.fields] + [T.StructField(f, T.BooleanType()) for f in ("__head", "__tail")])
        ranged = durable(keyed.mapInArrow(_sum_sorted(values.columns, names), out), "ranged")
    # The last row of a partition holds the whole of its last group there.
    group = F.struct(F.lit(0).alias("none"), *by)
    later = ranged.where("__head").select("__part", group.alias("__first"))
    earlier = ranged.where("__tail").select(F.col("__part").alias("__q"), group.alias("__last"), *names)
    before = later.join(earlier, F.col("__first").eqNullSafe(F.col("__last")) & (F.col("__q") < F.col("__part"))).groupBy("__part", "__first").agg(
        *[F.sum(n).alias(f"__o{n}") for n in names]).withColumnRenamed("__part", "__p")
    same = (F.col("__part") == F.col("__p")) & group.eqNullSafe(F.col("__first"))
    both = ranged.join(F.broadcast(before), same, "left")  # at most a row per sort partition
    total = lambda n: F.coalesce(F.col(n) + F.col(f"__o{n}"), F.col(n), F.col(f"__o{n}"))
    return both.select(*keep, *[total(n).alias(o) for n, o in zip(names, measures)])


def _one_bit_pattern(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(name) + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(name)


def _sum_sorted(columns: Sequence[str], names: Sequence[str]) -> Callable:
    """Running sums of sorted batches that start again at every new key; NULL until a group's first value."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key_before, ready = None, None
        held = {n: (0, False) for n in names}
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = batch.column(batch.schema.get_field_index("__key"))
            new = np.zeros(size, bool)
            for k in range(keys.type.num_fields - 1):
                new[1:] |= _differs(keys.field(k))
            key = repr(keys[0].as_py())  # repr: NaN equals itself
            new[0] = key != key_before
            key_before = repr(keys[size - 1].as_py())
            group = np.cumsum(new)
            begins = np.flatnonzero(new)
            sums = []
            for n in names:
                column = batch.column(batch.schema.get_field_index(n))
                value = np.array(column.fill_null(0).to_numpy(zero_copy_only=False))
                seen = ~column.is_null().to_numpy(zero_copy_only=False)
                carry, known = held[n]
                if value.dtype.kind == "f":
                    total = np.empty(size)
                    for a, b in zip(np.concatenate([[0], begins[begins > 0]]), np.append(begins[begins > 0], size)):
                        value[a] += carry if a == 0 and not new[0] else 0.0
                        np.cumsum(value[a:b], out=total[a:b])
                else:
                    total = np.cumsum(value)
                    base = np.concatenate([[0 if new[0] else -carry], (total[begins] - value[begins])[begins > 0] if len(begins) else []]).astype(total.dtype)
                    total = total - base[np.cumsum(new & (np.arange(size) > 0))]
                count = np.cumsum(seen)
                prior = np.concatenate([[0], count])[np.maximum.accumulate(np.where(new, np.arange(size), 0))]
                have = (count > prior) | ((group == 0) & known)
                held[n] = (total[-1], bool(have[-1]))
                sums.append(pa.array(total, column.type, mask=~have))
            rest = [sums[names.index(c)] if c in names else batch.column(batch.schema.get_field_index(c)) for c in columns]
            if ready:
                yield flagged(*ready, False)
            ready = (rest, ready is None)
        if ready:
            yield flagged(*ready, True)

    def flagged(arrays, first, last):
        import numpy as np
        import pyarrow as pa

        head, tail = np.zeros(len(arrays[0]), bool), np.zeros(len(arrays[0]), bool)
        head[0], tail[-1] = first, last
        return pa.RecordBatch.from_arrays([*arrays, pa.array(head), pa.array(tail)], names=[*columns, "__head", "__tail"])

    return run


def _differs(values):
    """Whether each value but the first differs from the one before; NULL equals NULL and NaN equals NaN."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    a, b = values[:-1], values[1:]
    if pa.types.is_nested(values.type):
        listed = [repr(v) for v in values.to_pylist()]
        return np.array([x != y for x, y in zip(listed, listed[1:])], bool)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(values.type):
        nan = pc.fill_null(pc.is_nan(values), False).to_numpy(zero_copy_only=False)
        unequal = unequal & ~(nan[:-1] & nan[1:])
    null = values.is_null().to_numpy(zero_copy_only=False)
    return unequal | (null[:-1] != null[1:])


def exact_quantile(df: DataFrame, col: str, q: float, by: Sequence[str] = (), out: str = "quantile") -> DataFrame:
    """Interpolated quantile per group, from counts of distinct values and their running sums.

    The built-in percentile keeps every distinct value of a group in one buffer.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__n"))
    cum = running_totals(counts, by=by, order=[col], sums={"__cum": "__n"})
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("__size"))
    at = (F.col("__size") - 1) * F.lit(q)
    # Without groups the one size is joined on a constant.
    keys = by or ["__one"]
    both = cum.join(sizes, by) if by else cum.withColumn("__one", F.lit(1)).join(sizes.withColumn("__one", F.lit(1)), keys)
    ends = both.groupBy(*by).agg(
        F.min(F.when(F.col("__cum") > F.floor(at), F.col(col))).cast("double").alias("__lo"),
        F.min(F.when(F.col("__cum") > F.ceil(at), F.col(col))).cast("double").alias("__hi"),
        F.first(at - F.floor(at)).alias("__f"))
    return ends.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(out))


def with_halo(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    reach: int,
    build: Callable[[DataFrame, Window], DataFrame],
    block: int = 3968,
) -> DataFrame:
    """Evaluate window expressions that look at most ``reach`` rows away.

    ``pos`` must count 0,1,2,... within ``by``. Rows are cut into blocks of at
    least ``block`` positions, of twice the reach for wide frames; the ``reach``
    rows on either side of a block are copied into every block that they touch, so
    a long sequence never needs one task and every frame is whole. With the
    default block and a small reach a block and its halo stay below 4096 rows, the
    size up to which Spark keeps a window group in plain memory.
    """
    block = max(block, 2 * reach)
    home = F.floor(F.col(pos) / block)
    homes = F.sequence(F.greatest(F.lit(0), F.floor((F.col(pos) - reach) / block)), F.floor((F.col(pos) + reach) / block))
    spread = df.withColumn("__block", F.explode(homes)).withColumn("__core", F.col("__block") == home)
    window = Window.partitionBy(*by, "__block").orderBy(pos)
    return build(spread, window).where("__core").drop("__block", "__core")


def halo_rows(reach: int, block: int = 3968) -> int:
    """The most rows that ``with_halo`` puts into one window group."""
    return max(block, 2 * reach) + 2 * reach


def frame_sum(prefix: str, total: str, radius: int, window: Window) -> Column:
    """Sum over rows ``-radius..radius`` from a running sum: two lookups instead of a sliding frame."""
    upper = F.coalesce(F.lead(prefix, radius).over(window), F.col(total))
    return upper - F.coalesce(F.lag(prefix, radius + 1).over(window), F.lit(0))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` before they are expanded, so that few files do not make few tasks of long texts or many rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn ``-0.0`` into ``0.0``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with ``default`` where the denominator is zero or NULL."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))
