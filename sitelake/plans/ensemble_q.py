"""Ensembling and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.core import exact_quantile
from sitelake.core import rounded as R
from sitelake.functions.numeric import float_grid
from sitelake.operators import ensemble as E
from sitelake.operators import metrics as M
from sitelake.plans import fixtures as fx
from sitelake.plans.joins_q import SEED_SQL, score_sets, seed_tables
from sitelake.plans.metrics_q import F1, MCC, curve_sql, round_all, sweep_sql
from sitelake.plans.registry import query

ALPHAS = float_grid("0:1:0.1")
LOGIT = "(ln(greatest(1e-7, least(1 - 1e-7, {c}))) - ln(1 - greatest(1e-7, least(1 - 1e-7, {c}))))"
BLEND = f"1 / (1 + exp(-((1 - alpha) * {LOGIT.format(c='s1')} + alpha * {LOGIT.format(c='s2')})))"


def pairs(spark, sf, split):
    return fx.scored_base(spark, sf).where(F.col("split") == split).select("chain", "label", F.col("s1").alias("left"), F.col("s2").alias("right"))


@query("e01_blend", f"""
WITH {fx.SCORED_BASE_SQL}, b AS (SELECT chain, {BLEND.replace('alpha', '0.3::DOUBLE')} AS s FROM scored_base) SELECT chain, count(*) AS n, round(avg(s), 6) AS mean_score FROM b GROUP BY chain""")
def _(spark, sf):
    s = fx.scored_base(spark, sf).select("chain", E.blend("s1", "s2", 0.3).alias("s"))
    return s.groupBy("chain").agg(F.count("*").alias("n"), R(F.avg("s")).alias("mean_score"))


for _space, _expr in (("logit", BLEND.replace("alpha", "0.5::DOUBLE")), ("probability", "(s1 + s2) / 2")):

    @query(f"e02_average_{_space}", f"WITH {fx.SCORED_BASE_SQL} SELECT chain, count(*) AS n, sum(label)::BIGINT AS positives, round(avg({_expr}), 6) AS mean_score FROM scored_base GROUP BY chain")
    def _(spark, sf, space=_space):
        return E.average(score_sets(spark, sf), space).groupBy("chain").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), R(F.avg("score")).alias("mean_score"))


def blended_sql(split, name):
    return f"""{name} AS (SELECT chain, label, alpha, {BLEND} AS score FROM scored_base, (SELECT round(0.1::DOUBLE * i, 10) AS alpha FROM range(0, 11) r(i)) WHERE split = '{split}')"""


SWEEP_SQL = f"""WITH {fx.SCORED_BASE_SQL}, {blended_sql('val', 'vb')}, {curve_sql('alpha', 'vb')}, {curve_sql('alpha, chain', 'vb', '_c')},
mac AS (SELECT alpha, avg(average_precision) AS chain_ap_macro FROM ranking_c GROUP BY alpha),
sw AS (SELECT alpha, round(average_precision, 6) AS average_precision, round(chain_ap_macro, 6) AS chain_ap_macro FROM ranking JOIN mac USING (alpha))"""


@query("e03_alpha_sweep", f"{SWEEP_SQL} SELECT * FROM sw")
def _(spark, sf):
    return round_all(E.alpha_sweep(pairs(spark, sf, "val"), ALPHAS), skip=("alpha",))


@query("e03_best_alpha", f"{SWEEP_SQL} SELECT alpha, average_precision, chain_ap_macro FROM sw ORDER BY chain_ap_macro DESC, average_precision DESC, abs(alpha - 0.5), alpha LIMIT 1")
def _(spark, sf):
    return E.best_alpha(round_all(E.alpha_sweep(pairs(spark, sf, "val"), ALPHAS), skip=("alpha",)))


JOINT_SQL = f"""WITH {fx.SCORED_BASE_SQL}, {blended_sql('val', 'vb')}, {sweep_sql(100, 1, 99, 'vb', 'alpha')}, js AS (SELECT *, {MCC} AS mcc, {F1} AS f1 FROM swept),
best AS (SELECT alpha, threshold, f1, mcc FROM js ORDER BY f1 DESC, mcc DESC, abs(alpha - 0.5), abs(threshold - 0.5), alpha, threshold LIMIT 1)"""


@query("e04_joint_sweep", f"{JOINT_SQL} SELECT alpha, threshold, round(f1, 6) AS f1, round(mcc, 6) + 0.0 AS mcc FROM best")
def _(spark, sf):
    best = E.best_joint(E.joint_sweep(pairs(spark, sf, "val"), ALPHAS).select("alpha", "threshold", "f1", "mcc"))
    return round_all(best, skip=("alpha", "threshold"))


@query("e05_freeze_apply", f"""
{JOINT_SQL}, {blended_sql('test', 'tb')}, tt AS (SELECT tb.* FROM tb JOIN best USING (alpha)), {curve_sql('alpha', 'tt', '_t')},
c AS (SELECT tt.alpha, any_value(threshold) AS threshold, any_value(best.f1) AS val_f1, sum((score >= threshold AND label = 1)::INT)::BIGINT AS tp, sum((score >= threshold AND label = 0)::INT)::BIGINT AS fp,
  sum((score < threshold AND label = 0)::INT)::BIGINT AS tn, sum((score < threshold AND label = 1)::INT)::BIGINT AS fn FROM tt JOIN best USING (alpha) GROUP BY tt.alpha)
SELECT c.alpha, threshold, round(val_f1, 6) AS val_f1, tp, fp, tn, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round({F1}, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round({MCC}, 6) + 0.0 AS mcc, round(average_precision, 6) AS average_precision FROM c JOIN ranking_t USING (alpha)""")
def _(spark, sf):
    return round_all(E.freeze_apply(pairs(spark, sf, "val"), pairs(spark, sf, "test"), ALPHAS), skip=("alpha", "threshold"))


def candidate_sql(split, name):
    return f"""{name} AS (SELECT chain, label, u.candidate, u.score FROM (SELECT chain, label, [
  {{'candidate': 'left', 'score': s1}}, {{'candidate': 'right', 'score': s2}},
  {{'candidate': 'unweighted', 'score': (SELECT {BLEND} FROM (SELECT 0.5::DOUBLE AS alpha))}},
  {{'candidate': 'selected', 'score': {BLEND}}}] AS l FROM scored_base, chosen WHERE split = '{split}'), unnest(l) t(u))"""


def confusion_sql(name, src, threshold):
    return f"""{name} AS (SELECT candidate, sum((score >= {threshold} AND label = 1)::INT)::BIGINT AS tp, sum((score >= {threshold} AND label = 0)::INT)::BIGINT AS fp,
  sum((score < {threshold} AND label = 0)::INT)::BIGINT AS tn, sum((score < {threshold} AND label = 1)::INT)::BIGINT AS fn FROM {src} GROUP BY candidate)"""


FROZEN_SQL = f"""{SWEEP_SQL}, chosen AS (SELECT alpha FROM ranking JOIN mac USING (alpha) ORDER BY chain_ap_macro DESC, average_precision DESC, abs(alpha - 0.5), alpha LIMIT 1),
{candidate_sql('val', 'cv')}, {candidate_sql('test', 'ct')},
{sweep_sql(100, 1, 99, 'cv', 'candidate')}, cs AS (SELECT *, {MCC} AS mcc, {F1} AS f1 FROM swept),
frozen AS (SELECT candidate, threshold, f1 AS val_f1, mcc AS val_mcc FROM cs
  QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY f1 DESC, mcc DESC, abs(threshold - 0.5), threshold) = 1),
{curve_sql('candidate', 'cv', '_v')}, {curve_sql('candidate, chain', 'cv', '_vc')}, {curve_sql('candidate', 'ct', '_t')}, {curve_sql('candidate, chain', 'ct', '_tc')},
macros AS (SELECT candidate, v AS val_macro, t AS macro FROM (SELECT candidate, avg(average_precision) AS v FROM ranking_vc GROUP BY 1) JOIN (SELECT candidate, avg(average_precision) AS t FROM ranking_tc GROUP BY 1) USING (candidate)),
tf AS (SELECT ct.*, threshold FROM ct JOIN frozen USING (candidate)), {confusion_sql('c0', 'tf', 'threshold')}, {confusion_sql('c5', 'ct', '0.5')}, {confusion_sql('c6', 'ct', '0.6')},
rec AS (SELECT candidate, chosen.alpha, threshold, val_f1, val_mcc, v.average_precision AS val_ap, val_macro, t.average_precision AS ap, macro,
  c0.tp, c0.fp, c0.tn, c0.fn, m0.f1, m0.mcc, m5.f1 AS f1_05, m5.mcc AS mcc_05, m6.f1 AS f1_06, m6.mcc AS mcc_06
  FROM frozen JOIN chosen ON true JOIN ranking_v v USING (candidate) JOIN ranking_t t USING (candidate) JOIN macros USING (candidate) JOIN c0 USING (candidate)
  JOIN (SELECT candidate, {F1} AS f1, {MCC} AS mcc FROM c0) m0 USING (candidate) JOIN (SELECT candidate, {F1} AS f1, {MCC} AS mcc FROM c5) m5 USING (candidate)
  JOIN (SELECT candidate, {F1} AS f1, {MCC} AS mcc FROM c6) m6 USING (candidate))"""
RECORD = ["val_f1", "val_mcc", "val_ap", "val_macro", "ap", "macro", "f1", "mcc", "f1_05", "mcc_05", "f1_06", "mcc_06"]


def frozen_candidates(spark, sf):
    return E.freeze_candidates(pairs(spark, sf, "val"), pairs(spark, sf, "test"), ALPHAS)


@query("e05_freeze_candidates", f"{FROZEN_SQL} SELECT candidate, alpha, threshold, tp, fp, tn, fn, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in RECORD)} FROM rec")
def _(spark, sf):
    out = frozen_candidates(spark, sf)
    return out.select("candidate", "alpha", "threshold", "tp", "fp", "tn", "fn", *[R(c).alias(c) for c in RECORD])


@query("e06_promotion_frozen", f"""
{FROZEN_SQL}, s AS (SELECT * FROM rec WHERE candidate = 'selected'), o AS (SELECT * FROM rec WHERE candidate IN ('unweighted', 'right')),
ok AS (SELECT any_value(s.alpha) AS alpha, bool_and(s.alpha > 0 AND s.alpha < 1 AND abs(s.alpha - 0.5) > 1e-9 * greatest(s.alpha, 0.5)
  AND s.val_macro > o.val_macro AND s.val_ap > o.val_ap AND s.val_f1 >= o.val_f1 AND s.val_mcc >= o.val_mcc) AS promoted FROM s, o),
best AS (SELECT candidate FROM rec WHERE candidate <> 'selected' ORDER BY val_macro DESC, val_ap DESC, val_f1 DESC, list_position(['left', 'right', 'unweighted'], candidate) LIMIT 1)
SELECT alpha, promoted, CASE WHEN promoted THEN 'selected' ELSE candidate END AS selected_method FROM ok, best""")
def _(spark, sf):
    return E.promotion(E.promotion_row(frozen_candidates(spark, sf))).select("alpha", "promoted", "selected_method")


NAMES = {"click": "sel", "view": "unw", "error": "right", "purchase": "left"}


@query("e06_promotion", """
WITH e AS (SELECT user_id AS run, (user_id % 11) / 10.0::DOUBLE AS alpha, {cols} FROM events GROUP BY user_id),
c AS (SELECT run, alpha > 0 AND alpha < 1 AND abs(alpha - 0.5) > 1e-9 * greatest(alpha, 0.5) AND sel_macro > unw_macro AND sel_macro > right_macro AND sel_ap > unw_ap AND sel_ap > right_ap
  AND sel_f1 >= unw_f1 AND sel_f1 >= right_f1 AND sel_mcc >= unw_mcc AND sel_mcc >= right_mcc AS promoted,
  CASE WHEN (left_macro, left_ap, left_f1) >= (right_macro, right_ap, right_f1) AND (left_macro, left_ap, left_f1) >= (unw_macro, unw_ap, unw_f1) THEN 'left'
    WHEN (right_macro, right_ap, right_f1) >= (unw_macro, unw_ap, unw_f1) THEN 'right' ELSE 'unweighted' END AS fallback FROM e)
SELECT run, promoted, CASE WHEN promoted THEN 'selected' ELSE fallback END AS selected_method FROM c""".format(cols=", ".join(
    f"round(coalesce({a} FILTER (event_type = '{ev}'), 0), 6) AS {p}_{m}" for ev, p in NAMES.items() for m, a in (("macro", "avg(value)"), ("ap", "max(value)"), ("f1", "min(value)"), ("mcc", "count(value)")))))
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    fns = {"macro": F.avg, "ap": F.max, "f1": F.min, "mcc": F.count}
    row = ev.groupBy(F.col("user_id").alias("run")).agg(*[
        R(F.coalesce(fn(F.when(F.col("event_type") == e, F.col("value"))).cast("double"), F.lit(0.0))).alias(f"{p}_{m}") for e, p in NAMES.items() for m, fn in fns.items()])
    return E.promotion(row.withColumn("alpha", (F.col("run") % 11) / 10.0)).select("run", "promoted", "selected_method")


@query("e07_screen", """
WITH b AS (SELECT avg(value) AS macro, median(value) AS ap FROM events), c AS (SELECT user_id AS candidate, avg(value) AS macro, median(value) AS ap FROM events GROUP BY user_id)
SELECT candidate, round(c.macro, 6) AS macro, round(c.ap, 6) AS ap, round(c.macro - b.macro, 6) + 0.0 AS delta_macro, round(c.ap - b.ap, 6) + 0.0 AS delta_ap,
  c.macro - b.macro >= 0.005 AND c.ap - b.ap >= -0.003 AS passes FROM c, b""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events")
    named = ev.select(F.col("user_id").alias("candidate"), "value")
    base = {"macro": ev.agg(F.avg("value")).first()[0], "ap": exact_quantile(ev, "value", 0.5).first()[0]}
    per = named.groupBy("candidate").agg(F.avg("value").alias("macro")).join(exact_quantile(named, "value", 0.5, ["candidate"], "ap"), "candidate")
    return round_all(E.screen(base, per))


@query("e08_confirm", f"""
WITH {SEED_SQL}, d AS (SELECT d - c AS m, (d - c) * 0.5 AS a FROM seeds)
SELECT count(*) AS n_seeds, round(avg(m), 6) + 0.0 AS macro_mean, round(coalesce(stddev_samp(m), 0), 6) AS macro_std, sum((m > 0)::INT)::BIGINT AS macro_positive,
  round(avg(a), 6) + 0.0 AS ap_mean, round(coalesce(stddev_samp(a), 0), 6) AS ap_std, sum((a > 0)::INT)::BIGINT AS ap_positive, avg(m) >= 0.005 AND avg(a) >= -0.003 AS promote FROM d""")
def _(spark, sf):
    control, candidate = (t.select("seed", F.col("ap").alias("macro"), (F.col("ap") * 0.5).alias("ap")) for t in seed_tables(spark, sf))
    return round_all(E.confirm(control, candidate, 0.005, 0.003))


CHAIN_SWEEP = sweep_sql(100, 1, 99, "cl", "run")


@query("e09_experiment_rows", f"""
WITH {fx.SCORED_BASE_SQL}, cl AS (SELECT chain AS run, label, s2 AS score FROM scored_base), {CHAIN_SWEEP}, js AS (SELECT run, threshold, round({F1}, 9) AS f1 FROM swept),
r AS (SELECT l_suppkey AS run, l_linenumber AS epoch, max(l_quantity) AS metric FROM lineitem GROUP BY 1, 2),
b AS (SELECT run, epoch, metric, metric / 101 AS frozen FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) = 1),
f AS (SELECT js.run, f1 FROM js JOIN b USING (run) QUALIFY row_number() OVER (PARTITION BY js.run ORDER BY abs(threshold - frozen), threshold) = 1),
o AS (SELECT run, f1, threshold FROM js QUALIFY row_number() OVER (PARTITION BY run ORDER BY f1 DESC, threshold) = 1)
SELECT b.run, epoch, metric, round(frozen, 6) AS frozen, round(f.f1, 6) AS f1_frozen, round(a.f1, 6) AS f1_at_50, round(c.f1, 6) AS f1_at_60, round(o.f1, 6) AS f1_oracle, o.threshold AS oracle_threshold
FROM b JOIN f USING (run) JOIN js a ON a.run = b.run AND a.threshold = 0.5 JOIN js c ON c.run = b.run AND c.threshold = 0.6 JOIN o ON o.run = b.run""")
def _(spark, sf):
    rows = fx.scored_base(spark, sf).select(F.col("chain").alias("run"), "label", F.col("s2").alias("score"))
    sweeps = M.threshold_sweep(rows, 100, by=["run"]).select("run", "threshold", F.round("f1", 9).alias("f1"))
    runs = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.max("l_quantity").alias("metric")).withColumn("frozen", F.col("metric") / 101)
    return round_all(E.experiment_rows(runs, sweeps), skip=("oracle_threshold",))


@query("e10_curated", f"WITH {fx.RUNS_SQL} SELECT run, epoch, metric FROM runs WHERE run IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, sf):
    manifest = fx.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("run"))
    return E.curated(fx.runs(spark, sf).withColumn("scope", F.lit("all")), manifest, guards=["scope"]).select("run", "epoch", "metric")


@query("e10_curated_guarded", f"WITH {fx.RUNS_SQL} SELECT run, epoch, metric FROM runs WHERE event = 'purchase' AND run IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    """The guard is the event of the rows themselves."""
    manifest = fx.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("run"))
    return E.curated(fx.runs(spark, sf).where("event = 'purchase'"), manifest, guards=["event"]).select("run", "epoch", "metric")
