"""Validation-locked ensembling and experiment decisions.

Anything chosen on validation data comes back as one row of plain numbers before
test rows are read, so a test row can never influence a choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, spread
from sitelake.functions.numeric import logit, sigmoid
from sitelake.operators import metrics as M
from sitelake.operators.joins import align_scores, paired_delta
from sitelake.operators.select import argmax_lex, nearest


def blend(left: Column | str, right: Column | str, alpha: Column | float) -> Column:
    """Two scores mixed in logit space with weight ``alpha`` on the right one."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return sigmoid((1.0 - a) * logit(left) + a * logit(right))


def average(tables: Sequence[DataFrame], space: str = "logit") -> DataFrame:
    """Mean of N aligned score sets, of probabilities or of logits."""
    joined = align_scores(tables)
    cols = [f"score_{i}" for i in range(len(tables))]
    mean = lambda cs: reduce(lambda a, b: a + b, cs) / float(len(cs))
    if space == "logit":
        score = sigmoid(mean([logit(c) for c in cols]))
    elif space == "probability":
        score = mean([F.col(c) for c in cols])
    else:
        raise DataContractError(f"unknown space {space}")
    return joined.withColumn("score", score).drop(*cols)


def blended(pairs: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Every row once per alpha (a fixed grid of at most a few dozen); the metrics aggregate before anything is sorted."""
    each = pairs.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    score = blend("left", "right", F.col("alpha"))
    return each.select("chain", "label", "alpha", score.alias("score"))


def alpha_sweep(pairs: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Chain-macro AP and pooled AP per alpha.

    Pairs and counts are dealt before they are aggregated, so that the hash maps of a task
    hold its share of them and not a whole file. Both values come from one table of counts.
    """
    keys = ["alpha", "chain"]
    counts = durable(M.score_counts(blended(spread(pairs, "chain", "left", "right"), alphas), keys), "score-counts")
    pooled = spread(counts, "chain", "score").groupBy("alpha", "score").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    macro = M.chain_macro_of(M.ranking_metrics(M.curve_of(counts, keys), keys), ["alpha"])
    whole = M.ranking_metrics(M.curve_of(pooled, ["alpha"]), ["alpha"])
    return whole.select("alpha", "average_precision").join(macro.select("alpha", "chain_ap_macro"), "alpha")


def best_alpha(sweep: DataFrame) -> DataFrame:
    """Largest macro AP, then pooled AP, then the alpha nearest 0.5."""
    key = [F.col("chain_ap_macro"), F.col("average_precision"), -F.abs(F.col("alpha") - 0.5), -F.col("alpha")]
    return argmax_lex(sweep.withColumn("__all", F.lit(1)), ["__all"], key).drop("__all")


def joint_sweep(pairs: DataFrame, alphas: Sequence[float], steps: int = 100) -> DataFrame:
    """Threshold sweep per alpha."""
    return M.threshold_sweep(blended(pairs, alphas), steps, by=["alpha"])


def best_joint(sweep: DataFrame) -> DataFrame:
    """Largest F1, then MCC, then alpha and threshold nearest 0.5."""
    a, t = F.abs(F.col("alpha") - 0.5), F.abs(F.col("threshold") - 0.5)
    return argmax_lex(sweep.withColumn("__all", F.lit(1)), ["__all"], [F.col("f1"), F.col("mcc"), -a, -t, -F.col("alpha"), -F.col("threshold")]).drop("__all")


def freeze_apply(val: DataFrame, test: DataFrame, alphas: Sequence[float], steps: int = 100) -> DataFrame:
    """Choose alpha and threshold on validation, then evaluate once on test."""
    chosen = best_joint(joint_sweep(val, alphas, steps).select("alpha", "threshold", "f1", "mcc")).first()
    scored = blended(test, [chosen["alpha"]])
    counts = M.metrics_from_counts(M.confusion(scored, chosen["threshold"], ["alpha"]))
    return counts.join(M.average_precision(scored, ["alpha"]), "alpha").withColumns({
        "threshold": F.lit(chosen["threshold"]), "val_f1": F.lit(chosen["f1"])})


CANDIDATES = ("left", "right", "unweighted", "selected")


def candidates(pairs: DataFrame, alpha: float) -> DataFrame:
    """Every row once per candidate: both models as they are, the even blend and the blend with the chosen weight."""
    scores = [F.col("left"), F.col("right"), blend("left", "right", 0.5), blend("left", "right", alpha)]
    each = F.array(*[F.struct(F.lit(n).alias("candidate"), s.alias("score")) for n, s in zip(CANDIDATES, scores)])
    return pairs.select("chain", "label", F.inline(each))


def freeze_candidates(val: DataFrame, test: DataFrame, alphas: Sequence[float], steps: int = 100) -> DataFrame:
    """Weight and thresholds from validation, then one record per candidate on test.

    The weight is that of ``best_alpha``. Every candidate gets its own threshold:
    largest F1 on validation, then MCC, then the threshold nearest 0.5. Columns:
    ``candidate, alpha, threshold``, the validation values ``val_macro, val_ap,
    val_f1, val_mcc``, and on test macro AP, pooled AP and the confusion record at
    the frozen threshold, at 0.5 and at 0.6 (``_05``, ``_06``).
    """
    alpha = best_alpha(alpha_sweep(val, alphas)).first()["alpha"]
    by = ["candidate"]
    on_val, on_test = candidates(val, alpha), candidates(test, alpha)
    swept = M.threshold_sweep(on_val, steps, by=by)
    near = -F.abs(F.col("threshold") - 0.5)
    chosen = argmax_lex(swept, by, [F.col("f1"), F.col("mcc"), near, -F.col("threshold")]).select(
        *by, "threshold", F.col("f1").alias("val_f1"), F.col("mcc").alias("val_mcc"))
    # Four rows, fixed before any test row is read.
    frozen = chosen.collect()
    cut = F.lit(None).cast("double")
    for r in frozen:
        cut = F.when(F.col("candidate") == r["candidate"], F.lit(r["threshold"])).otherwise(cut)
    ranked = lambda rows, p: M.average_precision(rows, by).select(*by, F.col("average_precision").alias(f"{p}ap")).join(
        M.chain_macro_ap(rows, by).select(*by, F.col("chain_ap_macro").alias(f"{p}macro")), by)
    out = test.sparkSession.createDataFrame(frozen, chosen.schema).withColumn("alpha", F.lit(float(alpha)))
    out = out.join(ranked(on_val, "val_"), by).join(ranked(on_test, ""), by).join(M.metrics_from_counts(M.confusion(on_test, cut, by)), by)
    for name, t in (("05", 0.5), ("06", 0.6)):
        fixed = M.metrics_from_counts(M.confusion(on_test, t, by))
        out = out.join(fixed.select(*by, F.col("f1").alias(f"f1_{name}"), F.col("mcc").alias(f"mcc_{name}")), by)
    return out


def promotion_row(frozen: DataFrame) -> DataFrame:
    """The validation values of all candidates side by side, as ``promotion`` takes them."""
    short = {"left": "left", "right": "right", "unweighted": "unw", "selected": "sel"}
    value = lambda c, m: F.max(F.when(F.col("candidate") == c, F.col(f"val_{m}"))).alias(f"{short[c]}_{m}")
    return frozen.groupBy("alpha").agg(*[value(c, m) for c in CANDIDATES for m in ("macro", "ap", "f1", "mcc")])


def promotion(row: DataFrame) -> DataFrame:
    """Nine checks of a learned blend against the unweighted blend and the right model; all must hold.

    Columns: ``alpha`` and, per candidate ``sel``, ``unw``, ``right`` and ``left``,
    the values ``_macro``, ``_ap``, ``_f1`` and ``_mcc``. Without promotion the
    fallback is the best of the other three by (macro, ap, f1).
    """
    a = F.col("alpha")
    checks = {
        "alpha_learned": (a > 0) & (a < 1) & (F.abs(a - 0.5) > 1e-9 * F.greatest(a, F.lit(0.5))),
        **{f"{m}_gt_{o}": F.col(f"sel_{m}") > F.col(f"{o}_{m}") for m in ("macro", "ap") for o in ("unw", "right")},
        **{f"{m}_ge_{o}": F.col(f"sel_{m}") >= F.col(f"{o}_{m}") for m in ("f1", "mcc") for o in ("unw", "right")},
    }
    checked = row.withColumns(checks)
    names = {"left": "left", "right": "right", "unw": "unweighted"}
    # a tie keeps the earlier candidate
    best = F.array_max(F.array(*[
        F.struct(F.col(f"{p}_macro").alias("a"), F.col(f"{p}_ap").alias("b"), F.col(f"{p}_f1").alias("c"), F.lit(-i).alias("d"), F.lit(n).alias("name"))
        for i, (p, n) in enumerate(names.items())]))["name"]
    ok = reduce(lambda x, y: x & y, [F.col(c) for c in checks])
    return checked.withColumn("promoted", ok).withColumn("selected_method", F.when(F.col("promoted"), "selected").otherwise(best))


def screen(baseline: dict[str, float], candidates: DataFrame, gate: float = 0.005, tolerance: float = 0.003) -> DataFrame:
    """Candidates with their gain over a baseline, a verdict, and best first."""
    d_macro, d_ap = F.col("macro") - baseline["macro"], F.col("ap") - baseline["ap"]
    out = candidates.withColumns({"delta_macro": d_macro, "delta_ap": d_ap})
    return out.withColumn("passes", (F.col("delta_macro") >= gate) & (F.col("delta_ap") >= -tolerance)).orderBy(F.desc("delta_macro"), F.desc("delta_ap"), "candidate")


def confirm(control: DataFrame, candidate: DataFrame, gate: float, tolerance: float, on: str = "seed") -> DataFrame:
    """Paired-seed confirmation: mean and sample deviation of the gains, winning seeds, and the gate."""
    d = paired_delta(control, candidate, on, ["macro", "ap"])
    aggs = [F.count("*").alias("n_seeds")]
    for m in ("macro", "ap"):
        v = F.col(f"delta_{m}")
        aggs += [F.avg(v).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{m}_std"), F.sum((v > 0).cast("long")).alias(f"{m}_positive")]
    return d.agg(*aggs).withColumn("promote", (F.col("macro_mean") >= gate) & (F.col("ap_mean") >= -tolerance))


def experiment_rows(runs: DataFrame, sweeps: DataFrame, by: str = "run", metric: str = "metric", fixed: Sequence[float] = (0.5, 0.6)) -> DataFrame:
    """Per run: the best epoch, and its sweep at the frozen threshold, at fixed thresholds and at the best one.

    ``runs(run, epoch, metric, frozen)``, ``sweeps(run, threshold, f1)``.
    """
    best = argmax_lex(runs, [by], [F.col(metric), -F.col("epoch")])
    frozen = nearest(sweeps.join(best.select(by, "frozen"), by), "threshold", F.col("frozen"), [by]).select(by, F.col("f1").alias("f1_frozen"))
    out = best.join(frozen, by, "left")
    for t in fixed:
        out = out.join(nearest(sweeps, "threshold", t, [by]).select(by, F.col("f1").alias(f"f1_at_{int(round(t * 100)):02d}")), by, "left")
    oracle = argmax_lex(sweeps, [by], [F.col("f1"), -F.col("threshold")]).select(by, F.col("f1").alias("f1_oracle"), F.col("threshold").alias("oracle_threshold"))
    return out.join(oracle, by, "left")


def curated(runs: DataFrame, manifest: DataFrame, key: str = "run", guards: Sequence[str] = ()) -> DataFrame:
    """Runs named in a manifest; they must share one value of every guard column."""
    kept = runs.join(manifest.select(key), key, "left_semi")
    for g in guards:
        if kept.select(g).distinct().limit(2).count() > 1:
            raise DataContractError(f"curated runs mix several values of {g}")
    return kept
