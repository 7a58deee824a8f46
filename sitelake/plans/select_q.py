"""Selection and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.core import rounded as R
from sitelake.operators import metrics as M
from sitelake.operators import select as S
from sitelake.plans import fixtures as fx
from sitelake.plans.metrics_q import F1, MCC, label_manifest, long_base, round_all, sweep_sql
from sitelake.plans.registry import query


@query("k01_top_k", f"""
WITH {fx.SCORED_SQL} SELECT chain, position, label, s2 AS score, CAST(rk AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY s2 DESC, position) AS rk FROM scored) WHERE rk <= 10""")
def _(spark, sf):
    s = fx.scored(spark, sf).select("chain", "position", "label", F.col("s2").alias("score"))
    return S.top_k(s, 10, ["chain"], ["-score", "position"])


RANK_SQL = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


def split_rank():
    return F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)


@query("k02_representatives", f"""
WITH {fx.DEDUP_SQL}
SELECT seq_hash, id, source, split, n, duplicate_count FROM
 (SELECT *, count(*) OVER (PARTITION BY seq_hash) AS duplicate_count,
    row_number() OVER (PARTITION BY seq_hash ORDER BY {RANK_SQL}, source, id) AS rn FROM dedup) WHERE rn = 1""")
def _(spark, sf):
    d = fx.dedup(spark, sf).select("seq_hash", "id", "source", "split", "n")
    return S.representatives(d, ["seq_hash"], [split_rank(), F.col("source")], "id")


@query("k02_reverse_map", f"""
WITH {fx.DEDUP_SQL}
SELECT seq_hash, id AS member, first_value(id) OVER (PARTITION BY seq_hash ORDER BY {RANK_SQL}, source, id) AS representative FROM dedup""")
def _(spark, sf):
    d = fx.dedup(spark, sf).select("seq_hash", "id", "source", "split")
    return S.reverse_map(d, S.representatives(d, ["seq_hash"], [split_rank(), F.col("source")], "id"), ["seq_hash"], "id")


@query("k03_argmax_lex", f"""
WITH {fx.LONG_BASE_SQL}, {sweep_sql(100, 1, 99)}, m AS (SELECT *, {MCC} AS mcc, {F1} AS f1 FROM swept)
SELECT method, threshold, round(f1, 6) AS f1, round(mcc, 6) + 0.0 AS mcc FROM m
QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, mcc DESC, abs(threshold - 0.5), threshold) = 1""")
def _(spark, sf):
    sweep = M.threshold_sweep(long_base(spark, sf), 100).select("method", "threshold", "f1", "mcc")
    best = S.argmax_lex(sweep, ["method"], [F.col("f1"), F.col("mcc"), -F.abs(F.col("threshold") - 0.5), -F.col("threshold")])
    return round_all(best, skip=("threshold",))


@query("k04_nearest", f"""
WITH {fx.LONG_BASE_SQL}, {sweep_sql(100, 1, 99)}
SELECT method, threshold, tp, fp FROM swept
QUALIFY row_number() OVER (PARTITION BY method ORDER BY abs(threshold - 0.4287), threshold) = 1""")
def _(spark, sf):
    return S.nearest(M.threshold_sweep(long_base(spark, sf), 100).select("method", "threshold", "tp", "fp"), "threshold", 0.4287, ["method"])


@query("k05_examples", """
SELECT l_returnflag, array_to_string(list_sort(list(l_orderkey)), ';') AS examples FROM
 (SELECT * FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) <= 50)
GROUP BY l_returnflag""")
def _(spark, sf):
    keys = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    ex = M.examples(keys, ["l_returnflag"], "l_orderkey", 50)
    return ex.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ";"))


@query("k06_largest", """
SELECT l_partkey, l_suppkey, count(*) AS size FROM lineitem GROUP BY ALL ORDER BY size DESC, l_partkey, l_suppkey LIMIT 10""")
def _(spark, sf):
    return S.largest(fx.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], 10, ["-size", "l_partkey", "l_suppkey"])


@query("k07_upsert_leaderboard", """
WITH e AS (SELECT CONCAT(event_type, '_', user_id) AS method, value FROM events),
b AS (SELECT method, round(avg(value), 6) AS ap FROM e GROUP BY method)
SELECT * FROM b WHERE method NOT LIKE 'click%'
UNION ALL SELECT 'click_all', round(avg(value), 6) FROM e WHERE method LIKE 'click%'""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.concat_ws("_", "event_type", "user_id").alias("method"), "value")
    board = e.groupBy("method").agg(R(F.avg("value")).alias("ap"))
    row = e.where(F.col("method").startswith("click")).agg(F.lit("click_all").alias("method"), R(F.avg("value")).alias("ap"))
    return S.upsert_leaderboard(board, row, "click", ["-ap", "method"])


@query("k08_canonical_source", r"""
WITH d AS (SELECT sha256(regexp_replace(text, '\s+', '', 'g')) AS seq_hash, source, doc_id, sha256(text) AS file_hash FROM documents)
SELECT seq_hash, source, doc_id, file_hash, occurrences, distinct_models, distinct_models > 1 AS conflict FROM
 (SELECT *, row_number() OVER (PARTITION BY seq_hash ORDER BY source, doc_id) AS rn FROM d) JOIN
 (SELECT seq_hash, count(*) AS occurrences, count(DISTINCT file_hash) AS distinct_models FROM d GROUP BY seq_hash) USING (seq_hash) WHERE rn = 1""")
def _(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("seq_hash"), "source", "doc_id", F.sha2("text", 256).alias("file_hash"))
    return S.canonical_source(d, "seq_hash", [F.col("source"), F.col("doc_id")], "file_hash")


@query("u01_pairwise_overlap", f"""
WITH {fx.DEDUP_SQL}, k AS (SELECT DISTINCT seq_hash, split FROM dedup),
p AS (SELECT a.seq_hash, concat(a.split, '__', b.split) AS pair FROM k a JOIN k b USING (seq_hash)
  WHERE (a.split = 'train' AND b.split = 'val') OR (a.split = 'train' AND b.split = 'test') OR (a.split = 'val' AND b.split = 'test'))
SELECT n.pair, count(p.seq_hash) AS n_shared, array_to_string(list_sort(list(seq_hash) FILTER (rn <= 20)), ';') AS examples
FROM (VALUES ('train__val'), ('train__test'), ('val__test')) n(pair)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY seq_hash) AS rn FROM p) p USING (pair) GROUP BY n.pair""")
def _(spark, sf):
    return S.pairwise_overlap(fx.dedup(spark, sf), "seq_hash").withColumn("examples", F.array_join("examples", ";"))


@query("u02_key_diff", """
SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT conv_id + 500 FROM conversations)
UNION ALL SELECT DISTINCT conv_id + 500, 'extra' FROM conversations WHERE conv_id + 500 NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    right = fx.table(spark, sf, "conversations").select((F.col("conv_id") + 500).alias("doc_id"))
    return S.key_diff(fx.table(spark, sf, "documents"), right, ["doc_id"])


@query("u03_union_splits", f"WITH {fx.SCORED_BASE_SQL} SELECT DISTINCT chain AS id, split FROM scored_base")
def _(spark, sf):
    man = label_manifest(spark, sf)
    return S.union_splits({s: man.where(F.col("split") == s) for s in ("train", "val", "test")})


@query("u04_distinct_first", """
SELECT array_to_string(string_split(url, '/')[1:3], '/') AS id, min(page_id) AS first_row FROM pages GROUP BY 1""")
def _(spark, sf):
    return S.distinct_first(fx.table(spark, sf, "pages"), F.substring_index("url", "/", 3), "page_id")


@query("u05_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return S.duplicates(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
