"""Top-k, argmax and set operators.

Picks of one row per group are ``min_by``/``max_by`` aggregations and small-k
picks are row-number filters, which Spark cuts to k rows per task before the
shuffle. Neither gathers a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import require_empty, sort_keys
from sitelake.operators.metrics import examples


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First ``k`` rows per group; for k that grows with the group use ``chain_ranks``."""
    w = Window.partitionBy(*by).orderBy(*sort_keys(order))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representatives(df: DataFrame, by: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """The first row per group by ``order`` (ties by id) with ``duplicate_count``."""
    rest = [c for c in df.columns if c not in by]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("oid"))
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("r"), F.count("*").alias("duplicate_count"))
    return best.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest], "duplicate_count")


def reverse_map(df: DataFrame, reps: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Every member with the id of its representative, one row each: a group of copies may be of any size."""
    return df.select(*by, F.col(id_col).alias("member")).join(
        reps.select(*by, F.col(id_col).alias("representative")), list(by))


def argmax_lex(df: DataFrame, by: Sequence[str], keys: Sequence[Column]) -> DataFrame:
    """The row with the lexicographically largest ``keys`` per group."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias("r"))
    return best.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def nearest(sweep: DataFrame, col: str, value: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """The row whose ``col`` lies nearest to ``value``, the smaller one among equals."""
    return argmax_lex(sweep, by, [-F.abs(F.col(col) - value), -F.col(col)])


def largest(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` largest groups: count first, then a distributed top-n."""
    return df.groupBy(*by).agg(F.count("*").alias("size")).orderBy(*sort_keys(order)).limit(n)


def upsert_leaderboard(board: DataFrame, rows: DataFrame, prefix: str, order: Sequence[str]) -> DataFrame:
    """Replace the rows of a method family and sort."""
    return board.where(~F.col("method").startswith(prefix)).unionByName(rows).orderBy(*sort_keys(order))


def canonical_source(df: DataFrame, key: str, order: Sequence[Column], file_hash: str) -> DataFrame:
    """The preferred source per key, with occurrence and model counts; ``conflict`` marks unequal files."""
    rest = [c for c in df.columns if c != key]
    pick = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r"),
        F.count("*").alias("occurrences"),
    )
    models = df.select(key, file_hash).distinct().groupBy(key).agg(F.count("*").alias("distinct_models"))
    return pick.join(models, key).select(
        key, *[F.col(f"r.{c}").alias(c) for c in rest], "occurrences", "distinct_models", (F.col("distinct_models") > 1).alias("conflict"))


def pairwise_overlap(df: DataFrame, key: str, split: str = "split", splits: Sequence[str] = ("train", "val", "test"),
                     n_examples: int = 20) -> DataFrame:
    """Keys shared by two splits: count and first examples per pair, also for pairs without any."""
    flags = df.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(f"in_{s}") for s in splits])
    pairs = F.array(*[
        F.when((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1), f"{a}__{b}") for a, b in combinations(splits, 2)])
    shared = flags.select(key, F.explode(F.array_compact(pairs)).alias("pair"))
    names = df.sparkSession.createDataFrame([(f"{a}__{b}",) for a, b in combinations(splits, 2)], "pair string")
    counts = shared.groupBy("pair").agg(F.count("*").alias("n_shared"))
    return names.join(counts, "pair", "left").na.fill(0, ["n_shared"]).join(examples(shared, ["pair"], key, n_examples), "pair", "left")


def key_diff(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of one table that the other lacks."""
    on = list(on)
    l, r = left.select(*on).distinct(), right.select(*on).distinct()
    return l.join(r, on, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        r.join(l, on, "left_anti").withColumn("side", F.lit("extra")))


def duplicates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def union_splits(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """One membership table from id tables; an id in two splits, or twice in one, is an error."""
    merged = reduce(DataFrame.unionByName, [p.select(key, F.lit(s).alias("split")) for s, p in parts.items()])
    require_empty(duplicates(merged, [key]), "ids occur more than once")
    return merged


def distinct_first(df: DataFrame, key: Column, order: str, out: str = "id") -> DataFrame:
    """Distinct keys with the row they first appear in."""
    return df.groupBy(key.alias(out)).agg(F.min(order).alias("first_row"))
