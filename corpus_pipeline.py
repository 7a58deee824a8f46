"""The corpus pipeline: language, quality, exact copies, near copies, packing.

Every stage is a function of ``(spark, docs, sf_dir)``. Its result is written as
Parquet and read again as the next one's ``docs``. All stages but the last return
the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm import langid, quality
from sitelake.llm.exact_dedup import exact_dedup, with_digest
from sitelake.llm.frames import free_name, table
from sitelake.llm.ngram_join import similar_documents, with_set_digest
from sitelake.llm.packing import pack_documents
from sitelake.llm.queries import prepare, tokenizer


def _keep(docs: DataFrame, marked: DataFrame, tag: str) -> DataFrame:
    """Rows of ``docs`` (with a digest in ``tag``) that ``marked(doc_id, digest, kept)`` keeps.

    Rows that agree in id and digest cannot be told apart; where there are more of
    them than are kept, one stays.
    """
    wanted = marked.groupBy("doc_id", "digest").agg(F.count("*").alias("__rows"), F.max("kept").alias("__kept")).where("__kept")
    names = [c for c in docs.columns if c != tag]
    wanted = wanted.withColumnsRenamed({"doc_id": "__id", "digest": "__d"})
    left = docs.select(F.struct(*names).alias("doc"), F.col("doc_id").cast("long").alias("__i"), F.col(tag).alias("__t"))
    # The short table is hashed, so the texts are moved once and not sorted.
    found = left.join(wanted.hint("shuffle_hash"), F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__d")))
    once = found.where("__rows = 1").select("doc")
    again = found.where("__rows > 1").groupBy("__i", "__t").agg(F.first("doc").alias("doc")).select("doc")
    return once.unionByName(again).select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts of which too few n-grams are of the best known language."""
    filters = langid.learn(docs)
    floor = langid.floors(docs, filters)
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_share", "lang_grams"))
    judged = langid.identify(docs, filters, names=names)
    return judged.where((F.col(names[0]) != langid.UNDETERMINED) & langid.covered(floor, names[0], *names[2:])).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the classifier takes for label 0."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return quality.score_documents(docs, model, name=name).where(F.col(name) >= 0.5).select(docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; the older half of the ids is the history."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    marked = exact_dedup(docs, F.col("doc_id") <= (0 if low is None else (low + high) // 2))
    tag = free_name(docs, "digest")
    return _keep(with_digest(docs, out=tag), durable(marked.select("doc_id", "digest", "kept"), "kept"), tag)


def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    marked = similar_documents(docs)
    tag = free_name(docs, "digest")
    return _keep(with_set_digest(docs, out=tag), durable(marked.select("doc_id", "digest", "kept"), "kept"), tag)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of 1024."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


def _stage(function: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: function(prepare(spark), docs, sf_dir)


STAGES = [
    ("language", _stage(language)),
    ("quality", _stage(good_quality)),
    ("exact_dedup", _stage(distinct_texts)),
    ("near_dedup", _stage(dissimilar_texts)),
    ("packing", _stage(packed)),
]

#: The learned stages are beyond SQL; the tests compare every stage with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
