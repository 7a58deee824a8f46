"""Sinks and the packed form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, require_empty, running_totals
from sitelake.operators.metrics import status_summary


def fasta_lines(df: DataFrame, width: int = 80, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """One record per row, wrapped at ``width`` letters."""
    wrapped = F.regexp_replace(F.col(seq), F.lit(f"(.{{{width}}})(?=.)"), F.lit("$1\n"))
    return df.select(F.concat(F.lit(">"), F.col(seq_id).cast("string"), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    fasta_lines(df, width).write.text(path)


def pack(scored: DataFrame, block: int = 65536) -> DataFrame:
    """Columnar form: arrays of labels and scores in position order with running offsets.

    A chain longer than ``block`` becomes several rows, so no array grows without
    bound. ``position`` counts from 1.
    """
    cut = scored.withColumn("block", F.floor((F.col("position") - 1) / block))
    cells = cut.groupBy("chain", "block").agg(F.sort_array(F.collect_list(F.struct("position", "label", "score"))).alias("c"))
    rows = cells.select(
        "chain", "block", F.size("c").alias("length"), F.transform("c", lambda s: s["label"].cast("byte")).alias("labels"), F.transform("c", lambda s: s["score"]).alias("scores"))
    lengths = running_totals(rows.select("chain", "block", "length"), order=["chain", "block"], sums={"stop": "length"})
    return rows.join(lengths.select("chain", "block", (F.col("stop") - F.col("length")).alias("offset")), ["chain", "block"])


def unpack(packed: DataFrame, block: int = 65536) -> DataFrame:
    """Back to one row per residue, after checking the offsets."""
    check_packed(packed)
    flat = packed.select("chain", "block", F.posexplode(F.arrays_zip("labels", "scores")).alias("i", "z"))
    return flat.select("chain", (F.col("block") * block + F.col("i") + 1).cast("int").alias("position"), F.col("z.labels").cast("int").alias("label"), F.col("z.scores").alias("score"))


def check_packed(packed: DataFrame) -> None:
    """Array lengths must equal ``length`` and offsets must tile the range from 0."""
    require_empty(packed.where((F.size("labels") != F.col("length")) | (F.size("scores") != F.col("length"))).select("chain", "block"), "packed arrays have another length")
    ends = packed.select((F.col("offset") + F.col("length")).alias("offset"))
    starts = packed.select("offset").unionByName(packed.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("offset")))
    loose = starts.where("offset <> 0").join(ends, "offset", "left_anti")
    require_empty(loose, "packed offsets are not a running sum")


def write_manifest(df: DataFrame, path: str, key: str, status: str = "status", error: str = "error", n_examples: int = 20) -> DataFrame:
    """Publish rows sorted by key and return counts per status, with examples.

    The rows are written next to ``path`` and read back; only when all of them are
    there does the folder take its name. A failing write leaves an older manifest
    as it was. With a column ``error``, the examples are the first ``n_examples``
    keys whose ``error`` is given, with its text (``errors``); else the first keys.
    """
    spark = df.sparkSession
    # The store's own client renames; both names are in one folder, so it is one step there.
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    staged, old = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{kind}-{tag}") for kind in ("staged", "old"))
    fixed = durable(df, "manifest")
    try:
        fixed.orderBy(key).write.option("header", True).csv(staged.toString())
        wanted, there = fixed.count(), spark.read.schema(fixed.schema).option("header", True).csv(staged.toString()).count()
        if wanted != there:
            raise DataContractError(f"{there} of {wanted} manifest rows were written")
        had = store.exists(target)
        if had and not store.rename(target, old):
            raise DataContractError(f"{path} could not be moved aside")
        if not store.rename(staged, target):
            if had:
                store.rename(old, target)
            raise DataContractError(f"{path} could not be published")
        if had:
            store.delete(old, True)
    finally:
        store.delete(staged, True)
    if error not in df.columns:
        return status_summary(fixed, status, example=key, n_examples=n_examples)
    erring = fixed.where(F.col(error).isNotNull() & (F.col(error) != ""))
    first = Window.partitionBy(status).orderBy(key)
    top = erring.select(status, key, error).withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n_examples)
    shown = F.sort_array(F.collect_list(F.struct("__rn", F.col(key).alias("k"), F.col(error).alias("e"))))
    found = top.groupBy(status).agg(F.count("*").alias("n_shown"), shown.alias("s")).select(status, F.col("s.k").alias("examples"), F.col("s.e").alias("errors"))
    return fixed.groupBy(status).agg(F.count("*").alias("n"), F.count_if(F.col(error).isNotNull() & (F.col(error) != "")).alias("n_errors")).join(found, status, "left")


# Columns of the eight per-metric tables.
METRIC_VIEWS = {
    m: ["prot", "chain", "prot_mark", *c]
    for m, c in {
        "seq": ["seq", "len_seq"],
        "nchain": ["nchain"],
        "rez": ["rez"],
        "met": ["met"],
        "mthm": ["mthm"],
        "bio_name": ["bio_name"],
        "head": ["head"],
        "desc": ["desc"],
    }.items()
}


def metric_views(df: DataFrame, views: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    return {n: df.select(*c) for n, c in (views or METRIC_VIEWS).items() if set(c) <= set(df.columns)}


def write_metric_views(df: DataFrame, folder: str, views: dict[str, list[str]] | None = None) -> list[str]:
    """Headerless tab-separated tables, one folder per metric."""
    out = metric_views(df, views)
    for name, view in out.items():
        view.write.option("sep", "\t").csv(f"{folder}/{name}")
    return sorted(out)


def read_metric_view(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(schema).csv(f"{folder}/{name}")
