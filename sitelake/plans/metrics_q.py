"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.core import durable, rounded as R
from sitelake.operators import metrics as M
from sitelake.plans import fixtures as fx
from sitelake.plans.registry import query


def long_base(spark, sf):
    return fx.by_method(fx.scored_base(spark, sf).select("chain", "split", "label", "s1", "s2"))


def long(spark, sf):
    return fx.by_method(fx.scored(spark, sf))


def round_all(df, digits=6, skip=()):
    return df.select(*[
        R(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c) for c, t in df.dtypes
    ])


MCC = """coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) /
   nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0), 0)"""
F1 = "coalesce(2 * tp::DOUBLE / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0)"


def curve_sql(by: str, src: str = "long", tag: str = "") -> str:
    return f"""
counts{tag} AS (SELECT {by}, score, sum(label)::BIGINT AS tp, count(*) AS n FROM {src} GROUP BY ALL),
curve{tag} AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM counts{tag}
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
ranking{tag} AS (SELECT {by}, sum(tp)::BIGINT AS n_positive, sum(n)::BIGINT AS n_residues,
  coalesce(sum(tp * (ctp::DOUBLE / cn)) / nullif(sum(tp), 0), 0) AS average_precision,
  coalesce(sum(tp * (ctp::DOUBLE / cn + CASE WHEN cn = n THEN 1 ELSE (ctp - tp)::DOUBLE / (cn - n) END) / 2)
     / nullif(sum(tp), 0), 0) AS auprc,
  sum((n - tp) * (ctp - tp / 2.0)::DOUBLE) / nullif((sum(tp) * (sum(n) - sum(tp)))::DOUBLE, 0) AS auroc
  FROM curve{tag} GROUP BY {by})"""


@query("a01_status_summary", """
WITH s AS (SELECT o_orderstatus AS status, o_orderkey, o_custkey FROM orders)
SELECT status, count(*) AS n, sum(o_custkey)::BIGINT AS sum_o_custkey,
       array_to_string(list_sort(list(o_orderkey) FILTER (rn <= 20)), ';') AS examples
FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) AS rn FROM s) GROUP BY status""")
def _(spark, sf):
    df = fx.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    return M.status_summary(df, "status", ["o_custkey"], "o_orderkey").withColumn(
        "examples", F.array_join(F.col("examples").cast("array<string>"), ";"))


COUNTS_05 = """SELECT method,
  sum((score >= 0.5 AND label = 1)::INT)::BIGINT AS tp, sum((score >= 0.5 AND label = 0)::INT)::BIGINT AS fp,
  sum((score < 0.5 AND label = 0)::INT)::BIGINT AS tn, sum((score < 0.5 AND label = 1)::INT)::BIGINT AS fn
  FROM long GROUP BY method"""


@query("a02_confusion", f"WITH {fx.LONG_BASE_SQL} {COUNTS_05}")
def _(spark, sf):
    return M.confusion(long_base(spark, sf), 0.5)


@query("a03_metrics_from_counts", f"""
WITH {fx.LONG_BASE_SQL}, c AS ({COUNTS_05})
SELECT method, tp, fp, tn, fn,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round({F1}, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
  round({MCC}, 6) + 0.0 AS mcc FROM c""")
def _(spark, sf):
    return round_all(M.metrics_from_counts(M.confusion(long_base(spark, sf), 0.5)))


def sweep_sql(n, lo, hi, src="long", by="method"):
    return f"""
grid AS (SELECT CAST(i AS DOUBLE) / {n} AS threshold FROM range({lo}, {hi} + 1) t(i)),
hist AS (SELECT {by}, score, sum(label) AS p, count(*) AS c FROM {src} GROUP BY ALL),
swept AS (SELECT {by}, threshold,
  sum(CASE WHEN score >= threshold THEN p ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN score >= threshold THEN c - p ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN score < threshold THEN c - p ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN score < threshold THEN p ELSE 0 END)::BIGINT AS fn
  FROM hist, grid GROUP BY ALL)"""


@query("a04_threshold_sweep", f"""
WITH {fx.LONG_BASE_SQL}, {sweep_sql(100, 1, 99)}
SELECT method, threshold, tp, fp, tn, fn,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round({F1}, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
  round({MCC}, 6) + 0.0 AS mcc FROM swept""")
def _(spark, sf):
    return round_all(M.threshold_sweep(long_base(spark, sf), 100), skip=("threshold",))


for _name, _col in (("a05_average_precision", "average_precision"), ("a06_auprc", "auprc"), ("a07_auroc", "auroc")):

    @query(_name, f"WITH {fx.LONG_BASE_SQL}, {curve_sql('method')} SELECT method, round({_col}, 6) AS {_col} FROM ranking")
    def _(spark, sf, col=_col):
        return round_all(getattr(M, col)(long_base(spark, sf)))


@query("a08_best_f1", f"""
WITH {fx.LONG_BASE_SQL}, {curve_sql('method')},
f AS (SELECT method, score, 2.0::DOUBLE * ctp / (cn + n_positive) AS f1 FROM curve JOIN ranking USING (method))
SELECT method, round(f1, 6) AS best_f1, score AS best_f1_threshold FROM f
QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, score) = 1""")
def _(spark, sf):
    return round_all(M.best_f1(long_base(spark, sf)))


@query("a09_best_mcc", f"""
WITH {fx.LONG_BASE_SQL}, {sweep_sql(1000, 0, 1000)}, m AS (SELECT *, {MCC} AS mcc, {F1} AS f1 FROM swept)
SELECT method, round(mcc, 6) + 0.0 AS best_mcc, threshold AS best_mcc_threshold, round(f1, 6) AS f1_at_best_mcc FROM m
QUALIFY row_number() OVER (PARTITION BY method ORDER BY mcc DESC, threshold) = 1""")
def _(spark, sf):
    return round_all(M.best_mcc(long_base(spark, sf)), skip=("best_mcc_threshold",))


@query("a10_chain_macro_ap", f"""
WITH {fx.LONG_BASE_SQL}, {curve_sql('method, chain')}
SELECT method, round(avg(average_precision), 6) AS chain_ap_macro, count(*) AS n_chains,
  sum((n_positive = 0)::INT)::BIGINT AS all_negative, sum((n_positive = n_residues)::INT)::BIGINT AS all_positive
FROM ranking GROUP BY method""")
def _(spark, sf):
    return round_all(M.chain_macro_ap(long_base(spark, sf)))


@query("a11_chain_report", f"""
WITH {fx.LONG_BASE_SQL}, {curve_sql('method, chain')}
SELECT method, chain, n_residues, n_positive, round(average_precision, 6) AS average_precision, round(auprc, 6) AS auprc,
  round(auroc, 6) AS auroc, n_positive > 0 AND n_positive < n_residues AS two_class FROM ranking""")
def _(spark, sf):
    return round_all(M.chain_report(long_base(spark, sf))[0])


@query("a11_chain_report_macro", f"""
WITH {fx.LONG_BASE_SQL}, {curve_sql('method, chain')}
SELECT method, count(*) AS n_chains, sum((auroc IS NOT NULL)::INT)::BIGINT AS n_two_class,
  round(avg(average_precision), 6) AS chain_ap_macro, round(avg(auroc), 6) AS chain_auroc_macro FROM ranking GROUP BY method""")
def _(spark, sf):
    return round_all(M.chain_report(long_base(spark, sf))[1])


def ratio_table(spark, sf, threshold):
    ratios = M.chain_ratios(long_base(spark, sf), threshold)
    return durable(ratios.select("method", "chain", R("true_ratio", 9).alias("true_ratio"),
                                 R("predicted_ratio", 9).alias("predicted_ratio")), "ratios")


def ratio_sql(pred):
    return f"""
WITH {fx.LONG_BASE_SQL},
r AS (SELECT method, chain, round(avg(label), 9) AS t, round(avg({pred}), 9) AS p FROM long GROUP BY method, chain),
k AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY t) + (count(*) OVER (PARTITION BY method, t) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY method ORDER BY p) + (count(*) OVER (PARTITION BY method, p) - 1) / 2.0 AS rp FROM r)
SELECT method, count(*) AS n_chains, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse,
  round(avg(p - t), 6) + 0.0 AS bias, round(corr(t, p), 6) + 0.0 AS pearson,
  round(corr(rt::DOUBLE, rp::DOUBLE), 6) + 0.0 AS spearman FROM k GROUP BY method"""


@query("a12_ratio_metrics", ratio_sql("score"))
def _(spark, sf):
    return round_all(M.ratio_metrics(ratio_table(spark, sf, None)))


@query("a12_ratio_metrics_thresholded", ratio_sql("(score >= 0.5)::DOUBLE"))
def _(spark, sf):
    return round_all(M.ratio_metrics(ratio_table(spark, sf, 0.5)))


TOP_SQL = f"""
WITH {fx.LONG_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY method, chain ORDER BY score DESC, position) AS rk,
  count(*) OVER (PARTITION BY method, chain) AS length, sum(label) OVER (PARTITION BY method, chain) AS positives FROM long)"""


def top_l_sql():
    ks = ", ".join(f"greatest(1, floor(length / {d}::DOUBLE)) AS k{d}, sum(CASE WHEN rk <= greatest(1, floor(length / {d}::DOUBLE)) THEN label ELSE 0 END) AS h{d}" for d in (20, 10, 5))
    out = ", ".join(f"round(avg(h{d} / k{d}), 6) AS l{d}_acc_macro, round(sum(h{d}) / sum(k{d}), 6) AS l{d}_acc_micro, sum(h{d})::BIGINT AS l{d}_hits, sum(k{d})::BIGINT AS l{d}_k" for d in (20, 10, 5))
    return f"{TOP_SQL}, c AS (SELECT method, chain, {ks} FROM ranked GROUP BY method, chain, length) SELECT method, {out} FROM c GROUP BY method"


@query("a13_top_l", top_l_sql())
def _(spark, sf):
    return round_all(M.top_l(M.chain_ranks(long(spark, sf))))


def top_frac_sql():
    def k(p):
        return f"greatest(1, ceil(length * ({p} / 100.0::DOUBLE)))"

    ks = ", ".join(f"{k(p)} AS k{p}, sum(CASE WHEN rk <= {k(p)} THEN label ELSE 0 END) AS h{p}" for p in (5, 10, 20))
    out = ", ".join(f"""round(sum(h{p}) / sum(k{p}), 6) AS top{p}_precision_micro,
      round(sum(h{p}) / sum(positives), 6) AS top{p}_recall_micro,
      round(sum(h{p}) / sum(k{p}) / (sum(positives) / sum(length)), 6) AS top{p}_enrichment_micro,
      round(avg(h{p} / k{p}), 6) AS top{p}_precision_macro,
      round(avg(coalesce(h{p} / nullif(positives, 0), 0)), 6) AS top{p}_recall_macro,
      round(avg(coalesce(h{p} / k{p} / nullif(positives / length::DOUBLE, 0), 0)), 6) AS top{p}_enrichment_macro""" for p in (5, 10, 20))
    return f"{TOP_SQL}, c AS (SELECT method, chain, length, positives, {ks} FROM ranked GROUP BY ALL) SELECT method, {out} FROM c GROUP BY method"


@query("a14_top_frac", top_frac_sql())
def _(spark, sf):
    return round_all(M.top_frac(M.chain_ranks(long(spark, sf))))


@query("a15_fit_stats", """
WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE v)
SELECT l_returnflag, feature, count(v) AS n, round(avg(v), 6) AS mean, round(var_samp(v), 4) AS variance,
  round(stddev_samp(v), 6) AS std, min(v) + 0.0 AS min, max(v) AS max FROM u GROUP BY l_returnflag, feature""")
def _(spark, sf):
    out = M.fit_stats(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return out.select("l_returnflag", "feature", "n", R("mean").alias("mean"), R("variance", 4).alias("variance"),
                      R("std").alias("std"), R("min").alias("min"), R("max").alias("max"))


@query("a16_zscore", f"""
WITH {fx.SCORED_BASE_SQL},
s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS d1, avg(l_tax) AS m2, stddev_pop(l_tax) AS d2
      FROM scored_base WHERE split = 'train')
SELECT split, l_linenumber, count(*) AS n, round(avg((l_quantity - m1) / d1), 6) + 0.0 AS quantity,
  round(avg((l_tax - m2) / d2), 6) + 0.0 AS tax FROM scored_base, s GROUP BY split, l_linenumber""")
def _(spark, sf):
    base = fx.scored_base(spark, sf)
    cols = ["l_quantity", "l_tax"]
    z = M.apply_zscore(base, M.fit_zscore(base.where("split = 'train'"), cols), cols)
    return z.groupBy("split", "l_linenumber").agg(F.count("*").alias("n"), R(F.avg("l_quantity")).alias("quantity"), R(F.avg("l_tax")).alias("tax"))


@query("a17_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return M.value_counts(fx.table(spark, sf, "events"), "event_type")


def composition_sql():
    chain = ", ".join(f"sum((aa = '{a}')::INT) AS n_{a}" for a in fx.LETTERS)
    total = " + ".join(f"n_{a}" for a in fx.LETTERS)
    c = ", ".join(f"coalesce(n_{a}::DOUBLE / nullif({total}, 0), 0) AS c_{a}" for a in fx.LETTERS)
    wtotal = " + ".join(f"w_{a}" for a in fx.LETTERS)
    w = ", ".join(f"sum(n_{a}) OVER (PARTITION BY complex) AS w_{a}" for a in fx.LETTERS)
    out = ", ".join(f"""round(c_{a}, 6) AS chain_{a}, round(w_{a}::DOUBLE / ({wtotal}), 6) AS complex_{a},
      round(c_{a} - w_{a}::DOUBLE / ({wtotal}), 6) + 0.0 AS diff_{a}""" for a in fx.LETTERS)
    return f"""WITH {fx.RESIDUES_SQL}, n AS (SELECT complex, chain, {chain} FROM residues GROUP BY complex, chain),
    c AS (SELECT complex, chain, {c}, {w} FROM n) SELECT complex, chain, {out} FROM c"""


@query("a18_composition", composition_sql())
def _(spark, sf):
    return round_all(M.composition_levels(fx.residues(spark, sf), "complex", "chain", "aa", fx.LETTERS))


@query("a19_seed_summary", """
SELECT event_type, 'value' AS metric, count(value) AS n, round(avg(value), 6) AS mean,
  round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'k', count(*), round(avg(k), 6), round(coalesce(stddev_samp(k), 0), 6), min(k), max(k)
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return round_all(M.seed_summary(ev, ["value", "k"], ["event_type"]))


@query("a20_group_summary", """
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS c_acctbal_mean,
  round(coalesce(stddev_pop(c_acctbal), 0), 6) AS c_acctbal_std FROM customer GROUP BY c_mktsegment, c_nationkey""")
def _(spark, sf):
    return round_all(M.group_summary(fx.table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], ["c_acctbal"]))


def label_manifest(spark, sf):
    """Per chain: residues, positives, negatives and split."""
    return fx.scored_base(spark, sf).groupBy(F.col("chain").alias("id"), "split").agg(
        F.count("*").alias("n_residues"), F.sum("label").alias("n_positive"), F.sum(1 - F.col("label")).alias("n_negative"))


@query("a21_class_weight", f"""
WITH {fx.SCORED_BASE_SQL}, s AS (SELECT sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS q FROM scored_base WHERE split = 'train')
SELECT p AS n_positive, q AS n_negative, round(CASE WHEN p <= 0 THEN 1 ELSE least(5, q / p::DOUBLE) END, 6) AS pos_weight FROM s""")
def _(spark, sf):
    man = label_manifest(spark, sf)
    return round_all(M.class_weight(man, man.where("split = 'train'"), 5.0))


COVERAGE_SQL = """
cov AS (SELECT l_orderkey AS complex, count(*) AS n_residues, sum((l_returnflag = 'R')::INT) AS n_positive,
  sum((l_returnflag <> 'R')::INT) AS n_negative, avg((l_linestatus = 'F')::INT) AS coverage FROM lineitem GROUP BY l_orderkey)"""


def complex_labels(spark, sf):
    return fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("complex")).agg(
        F.count("*").alias("n_residues"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("n_positive"),
        F.sum((F.col("l_returnflag") != "R").cast("long")).alias("n_negative"),
        F.avg((F.col("l_linestatus") == "F").cast("int")).alias("coverage"),
    )


@query("a22_coverage_table", f"""
WITH {COVERAGE_SQL}, b AS (SELECT *, n_positive / n_residues::DOUBLE AS positive_fraction,
  CASE WHEN coverage <= 0 THEN 'eq0' WHEN coverage < 0.5 THEN 'lt0.5' ELSE 'ge0.5' END AS bucket FROM cov)
SELECT d.bucket, count(b.bucket) AS n, coalesce(sum(n_residues), 0)::BIGINT AS sum_n_residues,
  coalesce(sum(n_positive), 0)::BIGINT AS sum_n_positive, round(avg(positive_fraction), 6) AS mean_positive_fraction,
  round(avg(coverage), 6) AS mean_coverage, coalesce(sum((coverage >= 0.5 AND n_positive > 0)::INT), 0)::BIGINT AS n_usable
FROM (VALUES ('eq0'), ('lt0.5'), ('ge0.5')) d(bucket) LEFT JOIN b USING (bucket) GROUP BY d.bucket""")
def _(spark, sf):
    df = complex_labels(spark, sf).withColumn("positive_fraction", F.col("n_positive") / F.col("n_residues"))
    return round_all(M.coverage_table(df, "coverage", ["n_residues", "n_positive"], ["positive_fraction", "coverage"],
                                      (F.col("coverage") >= 0.5) & (F.col("n_positive") > 0)))


@query("a25_dup_histogram", f"""
WITH {fx.DEDUP_SQL}, c AS (SELECT seq_hash, count(*) AS copies FROM dedup GROUP BY seq_hash)
SELECT copies, count(*) AS n_keys FROM c GROUP BY copies""")
def _(spark, sf):
    return M.dup_histogram(fx.dedup(spark, sf), "seq_hash")


def mixed_sql(rep, draw, seed, n):
    return f"""(SELECT d % {n} FROM (SELECT (c * c + a) % 2147483647 AS d FROM (SELECT a, (b * 48271) % 2147483647 AS c FROM
      (SELECT a, (a * a + 12345) % 2147483647 AS b FROM (SELECT ({rep} * 7919 + {draw} * 104729 + {seed * 15485863}) % 2147483647 AS a)))))"""


@query("a26_bootstrap_ci", f"""
WITH RECURSIVE {fx.COMPONENTS_SQL}, {fx.SCORED_BASE_SQL},
e AS (SELECT l_orderkey AS complex, abs(avg(s1) - avg(label)) - abs(avg(s2) - avg(label)) AS diff FROM scored_base GROUP BY l_orderkey),
u AS (SELECT component, sum(diff) AS s, count(*) AS c, row_number() OVER (ORDER BY component) - 1 AS idx FROM e JOIN cc USING (complex) GROUP BY component),
k AS (SELECT count(*) AS n, sum(s) / sum(c) AS observed FROM u),
draws AS (SELECT rep, {mixed_sql('rep', 'draw', 42, 'n')} AS idx FROM k, range(0, 10000) r(rep), range(0, n) d(draw)),
packed AS (SELECT list(s ORDER BY idx) AS ls, list(c ORDER BY idx) AS lc FROM u),
deltas AS (SELECT rep, sum(ls[idx + 1]) / sum(lc[idx + 1]) AS delta FROM draws, packed GROUP BY rep)
SELECT any_value(n) AS n_units, count(*) AS replicates, round(any_value(observed), 6) AS difference,
  round(avg(delta), 6) AS bootstrap_mean, round(quantile_cont(delta, 0.025), 6) AS ci_low,
  round(quantile_cont(delta, 0.975), 6) AS ci_high,
  quantile_cont(delta, 0.975) < 0 OR quantile_cont(delta, 0.025) > 0 AS excludes_zero FROM deltas, k""")
def _(spark, sf):
    from sitelake.plans.graph_q import components

    err = fx.scored_base(spark, sf).groupBy(F.col("l_orderkey").alias("complex")).agg(
        (F.abs(F.avg("s1") - F.avg("label")) - F.abs(F.avg("s2") - F.avg("label"))).alias("diff"))
    return round_all(M.bootstrap_ci(err.join(components(spark, sf), "complex"), "component", "diff", 10_000, 42))


@query("a27_profile_log", """
SELECT user_id AS run, count(*) AS samples, round(avg(k), 6) AS util_mean, round(median(k), 6) AS util_median,
  round(avg((k >= 50)::INT), 6) AS util_ge50, max(value) AS memory_max, round(avg(value), 6) AS memory_mean
FROM (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY user_id""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), "value",
                                              F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return round_all(M.profile_log(ev, "run", "k", "value"))


@query("a28_min_mean_max", """
SELECT o_custkey, min(cents) AS min, avg(cents) AS mean, max(cents) AS max
FROM (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY o_custkey""")
def _(spark, sf):
    cents = fx.table(spark, sf, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return M.min_mean_max(cents, "cents", ["o_custkey"])


def evaluate_sql():
    one_of = {f"l{d}": f"greatest(1, floor(length / {d}::DOUBLE))" for d in (20, 10, 5)} | {f"top{p}": f"greatest(1, ceil(length * ({p} / 100.0::DOUBLE)))" for p in (5, 10, 20)}
    ks = ", ".join(f"{k} AS k_{n}, sum(CASE WHEN rk <= {k} THEN label ELSE 0 END) AS h_{n}" for n, k in one_of.items())
    tops = [f"round(avg(h_{n} / k_{n}), 6) AS {n}_acc_macro, round(sum(h_{n}) / sum(k_{n}), 6) AS {n}_acc_micro, sum(h_{n})::BIGINT AS {n}_hits, sum(k_{n})::BIGINT AS {n}_k" for n in ("l20", "l10", "l5")]
    tops += [f"""round(sum(h_{n}) / sum(k_{n}), 6) AS {n}_precision_micro, round(coalesce(sum(h_{n}) / nullif(sum(positives), 0), 0), 6) AS {n}_recall_micro,
  round(coalesce((sum(h_{n}) / sum(k_{n})) / nullif(sum(positives) / sum(length), 0), 0), 6) AS {n}_enrichment_micro, round(avg(h_{n} / k_{n}), 6) AS {n}_precision_macro,
  round(avg(coalesce(h_{n} / nullif(positives, 0)::DOUBLE, 0)), 6) AS {n}_recall_macro, round(avg(coalesce((h_{n} / k_{n}) / nullif(positives / length::DOUBLE, 0), 0)), 6) AS {n}_enrichment_macro""" for n in ("top5", "top10", "top20")]

    def block(cut, suffix):
        return f"""SELECT method, tp AS tp{suffix}, fp AS fp{suffix}, tn AS tn{suffix}, fn AS fn{suffix},
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision{suffix}, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall{suffix},
  round({F1}, 6) AS f1{suffix}, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy{suffix}, round({MCC}, 6) + 0.0 AS mcc{suffix}
  FROM (SELECT method, sum((score >= {cut} AND label = 1)::INT)::BIGINT AS tp, sum((score >= {cut} AND label = 0)::INT)::BIGINT AS fp,
    sum((score < {cut} AND label = 0)::INT)::BIGINT AS tn, sum((score < {cut} AND label = 1)::INT)::BIGINT AS fn FROM long JOIN bm USING (method) GROUP BY method)"""

    def ratios(v, suffix):
        return f"""round(avg(abs({v} - t)), 6) AS ratio_mae_{suffix}, round(sqrt(avg(({v} - t) * ({v} - t))), 6) AS ratio_rmse_{suffix}, round(avg({v} - t), 6) + 0.0 AS ratio_bias_{suffix},
  round(corr(t, {v}), 6) + 0.0 AS ratio_pearson_{suffix}, round(corr(rt, r{v}), 6) + 0.0 AS ratio_spearman_{suffix}"""

    def place(v):
        return f"rank() OVER (PARTITION BY method ORDER BY {v}) + (count(*) OVER (PARTITION BY method, {v}) - 1) / 2.0::DOUBLE AS r{v}"

    return f"""{TOP_SQL}, {curve_sql('method')}, {curve_sql('method, chain', tag='_c')}, {sweep_sql(1000, 0, 1000)},
m AS (SELECT *, {MCC} AS mcc, {F1} AS f1 FROM swept),
bm AS (SELECT method, round(mcc, 6) + 0.0 AS best_mcc, threshold AS best_mcc_threshold, round(f1, 6) AS f1_at_best_mcc FROM m
  QUALIFY row_number() OVER (PARTITION BY method ORDER BY mcc DESC, threshold) = 1),
f AS (SELECT method, score, 2.0::DOUBLE * ctp / (cn + n_positive) AS f1 FROM curve JOIN ranking USING (method)),
bf AS (SELECT method, round(f1, 6) AS best_f1, score AS best_f1_threshold FROM f
  QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, score) = 1),
macro AS (SELECT method, round(avg(average_precision), 6) AS chain_ap_macro, count(*) AS n_chains,
  sum((n_positive = 0)::INT)::BIGINT AS all_negative, sum((n_positive = n_residues)::INT)::BIGINT AS all_positive FROM ranking_c GROUP BY method),
c1 AS ({block('0.5', '')}),
c2 AS ({block('0.6', '_second')}),
c3 AS ({block('best_mcc_threshold', '_selected')}),
tc AS (SELECT method, chain, length, positives, {ks} FROM ranked GROUP BY method, chain, length, positives),
tl AS (SELECT method, {", ".join(tops)} FROM tc GROUP BY method),
ra AS (SELECT method, chain, round(avg(label), 12) AS t, round(avg(score), 12) AS p, round(avg((score >= 0.5)::DOUBLE), 12) AS q FROM long GROUP BY method, chain),
rk AS (SELECT *, {place('t')}, {place('p')}, {place('q')} FROM ra),
rr AS (SELECT method, {ratios('p', 'raw')}, {ratios('q', 'thresholded')} FROM rk GROUP BY method)
SELECT method, n_residues, n_positive, round(average_precision, 6) AS average_precision, round(auprc, 6) AS auprc, round(auroc, 6) AS auroc,
  bf.* EXCLUDE (method), bm.* EXCLUDE (method), macro.* EXCLUDE (method), c1.* EXCLUDE (method), c2.* EXCLUDE (method), c3.* EXCLUDE (method), tl.* EXCLUDE (method), rr.* EXCLUDE (method)
FROM ranking JOIN bf USING (method) JOIN bm USING (method) JOIN macro USING (method) JOIN c1 USING (method) JOIN c2 USING (method) JOIN c3 USING (method) JOIN tl USING (method) JOIN rr USING (method)"""


@query("a29_evaluate", evaluate_sql())
def _(spark, sf):
    return round_all(M.evaluate(long(spark, sf)), skip=("best_mcc_threshold",))


@query("a30_integrity_scan", """
WITH k AS (SELECT l_orderkey AS complex, l_linenumber, count(*) AS n,
    sum((len(string_split(l_returnflag, '')) <> len(string_split(concat(l_returnflag, l_linestatus), '')))::INT) AS u,
    sum((CASE WHEN l_linestatus = 'O' THEN 'A' ELSE '' END <> '')::INT) AS i FROM lineitem GROUP BY ALL),
s AS (SELECT complex, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicate_keys, sum(u)::BIGINT AS n_uneven,
  sum(i)::BIGINT AS n_insertion_rows FROM k GROUP BY complex),
d AS (SELECT o_orderkey AS complex, CAST(o_custkey % 7 + 1 AS BIGINT) AS declared FROM orders)
SELECT complex, n_rows, n_duplicate_keys, n_uneven, n_insertion_rows, declared,
  CASE WHEN n_rows IS NULL THEN 'MISSING' WHEN declared IS NULL THEN 'EXTRA'
    WHEN n_rows <> declared OR n_uneven > 0 OR n_duplicate_keys > 0 THEN 'FAIL' ELSE 'OK' END AS status
FROM s FULL JOIN d USING (complex)""")
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("complex"), "l_linenumber",
        F.when(F.col("l_linestatus") == "O", "A").otherwise("").alias("icode"),
        F.split("l_returnflag", "").alias("names"), F.split(F.concat("l_returnflag", "l_linestatus"), "").alias("coords"))
    declared = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("complex"), (F.col("o_custkey") % 7 + 1).alias("declared"))
    return M.integrity_scan(rows, "complex", declared, ["l_linenumber"], ["names", "coords"])
