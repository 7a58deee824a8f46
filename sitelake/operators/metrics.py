"""Metrics over scored residues: ``(method, chain, position, label, score)``.

Ranking metrics work on per-score counts. Equal scores are merged before any
sort (map-side combine), and the running sums over distinct scores come from
``running_totals``, which never gathers a method or a chain in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, exact_quantile, ratio, running_totals

# ---------------------------------------------------------------- summaries


def status_summary(df: DataFrame, status: str = "status", sums: Sequence[str] = (), example: str | None = None,
                   n_examples: int = 20) -> DataFrame:
    """Rows and sums per status, with the first ``n_examples`` keys in sorted order."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    if example is None:
        return counts
    return counts.join(examples(df, [status], example, n_examples), status, "left")


def examples(df: DataFrame, by: Sequence[str], key: str, n: int = 20) -> DataFrame:
    """First ``n`` keys per group. The row-number filter is cut to ``n`` rows per task before the shuffle."""
    first = Window.partitionBy(*by).orderBy(key)
    top = df.select(*by, key).withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("examples"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts per value, most common first, ties by value."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


# ---------------------------------------------------------------- thresholds


def score_counts(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Positives ``tp`` and rows ``n`` per distinct score."""
    return scored.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("tp"), F.count("*").alias("n"))


def _as_counts(df: DataFrame) -> DataFrame:
    """Rows of a score-count table as they are; a scored residue is a count of one."""
    if {"tp", "n"} <= set(df.columns):
        return df
    return df.withColumns({"tp": F.col("label").cast("long"), "n": F.lit(1).cast("long")})


def confusion(scored: DataFrame, threshold: float | Column = 0.5, by: Sequence[str] = ("method",)) -> DataFrame:
    """Counts for the rule ``score >= threshold``, from scored rows or score counts."""
    hit, tp, n = F.col("score") >= threshold, F.col("tp"), F.col("n")
    total = lambda cond, v: F.sum(F.when(cond, v).otherwise(0))
    return _as_counts(scored).groupBy(*by).agg(
        total(hit, tp).alias("tp"), total(hit, n - tp).alias("fp"), total(~hit, n - tp).alias("tn"), total(~hit, tp).alias("fn"))


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and MCC; zero where a denominator is zero."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("mcc", ratio(tp * tn - fp * fn, spread))
    )


def threshold_sweep(scored: DataFrame, steps: int = 100, first: int = 1, last: int | None = None,
                    by: Sequence[str] = ("method",)) -> DataFrame:
    """Confusion counts and metrics at every threshold ``i/steps``, ``first <= i <= last``.

    Each row falls into the bucket of the largest ``i`` with ``i/steps <= score``;
    one aggregation counts the buckets and a suffix sum over at most ``steps``
    buckets per group gives every threshold. Rows are never paired with the grid.
    """
    by = list(by)
    last = steps - 1 if last is None else last
    guess = F.floor(F.col("score") * steps)
    up = F.when((guess + 1) / F.lit(float(steps)) <= F.col("score"), 1).otherwise(0)
    down = F.when(guess / F.lit(float(steps)) > F.col("score"), 1).otherwise(0)
    bucket = F.least(F.greatest(guess + up - down, F.lit(first - 1)), F.lit(last))
    counts = _as_counts(scored).groupBy(*by, bucket.alias("i")).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    grid = counts.groupBy(*by).agg(F.sum("tp").alias("all_tp"), F.sum("n").alias("all_n")).withColumn(
        "i", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
    )
    at_or_above = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(counts, [*by, "i"], "left").na.fill(0, ["tp", "n"])
    swept = filled.select(
        *by,
        (F.col("i") / F.lit(float(steps))).alias("threshold"),
        F.sum("tp").over(at_or_above).alias("tp"),
        F.sum("n").over(at_or_above).alias("__n"),
        "all_tp",
        "all_n",
    ).select(
        *by, "threshold", "tp",
        (F.col("__n") - F.col("tp")).alias("fp"),
        (F.col("all_n") - F.col("all_tp") - F.col("__n") + F.col("tp")).alias("tn"),
        (F.col("all_tp") - F.col("tp")).alias("fn"),
    )
    return metrics_from_counts(swept)


def best_mcc(scored: DataFrame, steps: int = 1000, mode: str = "first", by: Sequence[str] = ("method",)) -> DataFrame:
    """Best MCC on ``0, 1/steps, ..., 1``.

    ``mode="first"`` keeps the lowest threshold among equals, ``mode="central"``
    prefers the higher F1 and then the threshold nearest 0.5.
    """
    sweep = threshold_sweep(scored, steps=steps, first=0, last=steps, by=by)
    if mode == "first":
        key = F.struct(F.col("mcc"), (-F.col("threshold")).alias("b"))
    elif mode == "central":
        key = F.struct(F.col("mcc"), F.col("f1"), (-F.abs(F.col("threshold") - 0.5)).alias("c"), (-F.col("threshold")).alias("d"))
    else:
        raise DataContractError(f"unknown tie rule {mode}")
    best = sweep.groupBy(*by).agg(F.max_by(F.struct("threshold", "mcc", "f1"), key).alias("b"))
    return best.select(*by, F.col("b.mcc").alias("best_mcc"), F.col("b.threshold").alias("best_mcc_threshold"),
                       F.col("b.f1").alias("f1_at_best_mcc"))


# ---------------------------------------------------------------- ranking metrics


def ranking_curve(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Distinct scores, highest first, with counts and cumulative counts of positives and rows."""
    return curve_of(score_counts(scored, by), by)


def curve_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return running_totals(counts, by=by, order=["-score"], sums={"cum_tp": "tp", "cum_n": "n"})


def ranking_metrics(curve: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """AP, trapezoid AUPRC and AUROC from one curve.

    With ``i`` running over distinct scores downwards, AP = sum dR_i P_i, the
    trapezoid averages P_i with P_(i-1) starting at the point (0, 1), and AUROC
    counts, per negative, the positives above plus half of those tied. AUROC is
    NULL with a single class; AP and AUPRC of a group without positives are 0.
    """
    tp, n, ctp, cn = (F.col(c).cast("double") for c in ("tp", "n", "cum_tp", "cum_n"))
    before = F.coalesce(F.try_divide(ctp - tp, cn - n), F.lit(1.0))
    sums = curve.groupBy(*by).agg(
        F.sum("tp").alias("n_positive"),
        F.sum("n").alias("n_residues"),
        F.sum(tp * ctp / cn).alias("__ap"),
        F.sum(tp * (ctp / cn + before) / 2).alias("__pr"),
        F.sum((n - tp) * (ctp - tp / 2)).alias("__roc"),
    )
    pos, neg = F.col("n_positive"), F.col("n_residues") - F.col("n_positive")
    return sums.select(
        *by, "n_residues", "n_positive",
        ratio(F.col("__ap"), pos).alias("average_precision"),
        ratio(F.col("__pr"), pos).alias("auprc"),
        ratio(F.col("__roc"), pos * neg, None).alias("auroc"),
    )


def average_precision(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return ranking_metrics(ranking_curve(scored, by), by).select(*by, "average_precision")


def auprc(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return ranking_metrics(ranking_curve(scored, by), by).select(*by, "auprc")


def auroc(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return ranking_metrics(ranking_curve(scored, by), by).select(*by, "auroc")


def best_f1(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Best F1 over all points of the precision-recall curve, lowest threshold among equals."""
    return best_f1_of(ranking_curve(scored, by), by)


def best_f1_of(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = curve.groupBy(*by).agg(F.sum("tp").alias("pos"))
    f1 = ratio(2 * F.col("cum_tp"), F.col("cum_n") + F.col("pos"))
    best = curve.join(totals, list(by)).groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("t"))).alias("b"))
    return best.select(*by, F.col("b.f1").alias("best_f1"), (-F.col("b.t")).alias("best_f1_threshold"))


def chain_macro_ap(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Mean of per-chain AP; a chain without positives counts 0."""
    keys = [*by, "chain"]
    return chain_macro_of(ranking_metrics(ranking_curve(scored, keys), keys), by)


def chain_macro_of(per_chain: DataFrame, by: Sequence[str]) -> DataFrame:
    return per_chain.groupBy(*by).agg(
        F.avg("average_precision").alias("chain_ap_macro"),
        F.count("*").alias("n_chains"),
        F.sum((F.col("n_positive") == 0).cast("long")).alias("all_negative"),
        F.sum((F.col("n_positive") == F.col("n_residues")).cast("long")).alias("all_positive"),
    )


def chain_report(scored: DataFrame, by: Sequence[str] = ("method",)) -> tuple[DataFrame, DataFrame]:
    """Per-chain AP and AUROC, and their macro means (AUROC over two-class chains only)."""
    keys = [*by, "chain"]
    rows = ranking_metrics(ranking_curve(scored, keys), keys).withColumn(
        "two_class", (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_residues"))
    )
    macro = rows.groupBy(*by).agg(
        F.count("*").alias("n_chains"),
        F.sum(F.col("two_class").cast("long")).alias("n_two_class"),
        F.avg("average_precision").alias("chain_ap_macro"),
        F.avg("auroc").alias("chain_auroc_macro"),
    )
    return rows, macro


# ---------------------------------------------------------------- per-chain ratios and top-k


def chain_ratios(scored: DataFrame, threshold: float | Column | None = None, by: Sequence[str] = ("method",)) -> DataFrame:
    """True share of positives and predicted share (mean score, or share at or above ``threshold``)."""
    predicted = F.col("score") if threshold is None else (F.col("score") >= threshold).cast("double")
    return _as_counts(scored).groupBy(*by, "chain").agg(
        (F.sum("tp") / F.sum("n")).alias("true_ratio"), (F.sum(predicted * F.col("n")) / F.sum("n")).alias("predicted_ratio"))


def _average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranks = running_totals(counts, by=by, order=[value], sums={"__c": "__n"})
    ranks = ranks.select(*by, value, (F.col("__c") - (F.col("__n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def ratio_metrics(ratios: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """MAE, RMSE, bias, Pearson and Spearman of predicted against true ratios.

    ``ratios`` should be a written table: ranks are joined back on its values.
    """
    err = F.col("predicted_ratio") - F.col("true_ratio")
    ranked = _average_rank(_average_rank(ratios, by, "true_ratio", "__rt"), by, "predicted_ratio", "__rp")
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_chains"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
        F.corr("true_ratio", "predicted_ratio").alias("pearson"),
        F.corr("__rt", "__rp").alias("spearman"),
    )


def chain_ranks(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Rank of each residue in its chain by (score desc, position) plus chain length and positives."""
    keys = [*by, "chain"]
    ranked = running_totals(scored.select(*keys, "position", "label", "score"), by=keys, order=["-score", "position"], rank="rank")
    sizes = scored.groupBy(*keys).agg(F.count("*").alias("length"), F.sum("label").cast("long").alias("positives"))
    return ranked.join(sizes, keys)


def _chain_hits(ranked: DataFrame, ks: dict[str, Column], by: Sequence[str]) -> DataFrame:
    keys = [*by, "chain", "length", "positives"]
    return ranked.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).cast("long").alias(f"hits_{n}") for n, k in ks.items()]
    ).select("*", *[k.alias(f"k_{n}") for n, k in ks.items()])


def top_l(ranked: DataFrame, denoms: Sequence[int] = (20, 10, 5), by: Sequence[str] = ("method",)) -> DataFrame:
    """Precision in the top ``max(1, floor(L/d))`` residues per chain: macro mean and micro share."""
    ks = {str(d): F.greatest(F.lit(1).cast("long"), F.floor(F.col("length") / d)) for d in denoms}
    hits = _chain_hits(ranked, ks, by)
    aggs = []
    for d in ks:
        h, k = F.col(f"hits_{d}"), F.col(f"k_{d}")
        aggs += [
            F.avg(h / k).alias(f"l{d}_acc_macro"),
            ratio(F.sum(h), F.sum(k)).alias(f"l{d}_acc_micro"),
            F.sum(h).alias(f"l{d}_hits"),
            F.sum(k).alias(f"l{d}_k"),
        ]
    return hits.groupBy(*by).agg(*aggs)


def top_frac(ranked: DataFrame, percents: Sequence[int] = (5, 10, 20), by: Sequence[str] = ("method",)) -> DataFrame:
    """Precision, recall and enrichment in the top ``max(1, ceil(L*f))`` residues, micro and macro."""
    ks = {str(p): F.greatest(F.lit(1).cast("long"), F.ceil(F.col("length") * (p / 100.0))) for p in percents}
    hits = _chain_hits(ranked, ks, by)
    base = ratio(F.col("positives"), F.col("length"))
    aggs = []
    for p in ks:
        h, k = F.col(f"hits_{p}"), F.col(f"k_{p}")
        micro = ratio(F.sum(h), F.sum(k))
        aggs += [
            micro.alias(f"top{p}_precision_micro"),
            ratio(F.sum(h), F.sum("positives")).alias(f"top{p}_recall_micro"),
            ratio(micro, ratio(F.sum("positives"), F.sum("length"))).alias(f"top{p}_enrichment_micro"),
            F.avg(h / k).alias(f"top{p}_precision_macro"),
            F.avg(ratio(h, F.col("positives"))).alias(f"top{p}_recall_macro"),
            F.avg(ratio(h / k, base)).alias(f"top{p}_enrichment_macro"),
        ]
    return hits.groupBy(*by).agg(*aggs)


#: Names of the cut-offs of A13 (a share 1/d of the chain, rounded down) and A14 (percent, rounded up).
TOP_L = (20, 10, 5)
TOP_PERCENT = (5, 10, 20)


def _cut_offs(length: Column) -> dict[str, Column]:
    one = F.lit(1).cast("long")
    return {
        **{f"l{d}": F.greatest(one, F.floor(length / d)) for d in TOP_L},
        **{f"top{p}": F.greatest(one, F.ceil(length * (p / 100.0))) for p in TOP_PERCENT},
    }


def _chain_records(scored: DataFrame, chains: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """One row per chain from its curve: size, AP sum, predicted sums, and hits at every cut-off.

    A cut-off takes whole scores from the curve. Only where it falls inside a score
    that has positives and negatives are the residues of that score ranked.
    """
    sizes = chains.groupBy(*keys).agg(F.sum("n").alias("length"), F.sum("tp").alias("positives"))
    tp, n, ctp, cn = F.col("tp"), F.col("n"), F.col("cum_tp"), F.col("cum_n")
    aggs = []
    for name, k in _cut_offs(F.col("length")).items():
        room = k - (cn - n)  # residues of this score that the cut-off still takes
        even = F.when(tp == 0, F.lit(0).cast("long")).when(tp == n, room)
        aggs += [
            F.max(F.when(cn <= k, ctp).when(room > 0, ctp - tp + F.coalesce(even, F.lit(0).cast("long")))).alias(f"hits_{name}"),
            F.max(F.when((room > 0) & (cn > k) & even.isNull(), F.struct("score", room.alias("room")))).alias(f"cut_{name}"),
        ]
    rows = durable(chains.join(sizes, keys).groupBy(*keys, "length", "positives").agg(
        F.sum(tp * ctp / cn).alias("ap"), F.sum(F.col("score") * n).alias("raw"), F.sum(F.when(F.col("score") >= threshold, n).otherwise(0)).alias("above"), *aggs), "chains")
    names = [a.removeprefix("cut_") for a in rows.columns if a.startswith("cut_")]
    cuts = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"cut_{c}.score").alias("score"), F.col(f"cut_{c}.room").alias("room")) for c in names])).alias("c"))
    cuts = durable(cuts.select(*keys, "c.*").where("score is not null"), "cuts")
    tied = scored.select(*keys, "position", "label", "score").join(cuts.select(*keys, "score").distinct(), [*keys, "score"], "left_semi")
    ranked = running_totals(tied, by=[*keys, "score"], order=["position"], rank="rank")
    inside = ranked.join(cuts, [*keys, "score"]).where("rank <= room").groupBy(*keys).agg(
        *[F.sum(F.when(F.col("cut") == c, F.col("label"))).alias(f"more_{c}") for c in names])
    return rows.join(inside, keys, "left").select(
        *keys, "length", "positives", "ap", "raw", "above",
        *[(F.col(f"hits_{c}") + F.coalesce(f"more_{c}", F.lit(0))).cast("long").alias(f"hits_{c}") for c in names])


def _ratio_record(rows: DataFrame, by: list[str]) -> DataFrame:
    """A12 for the mean score and for the share above the threshold; all average ranks come from one range sort.

    Ratios that agree to twelve digits are equal: sums depend on their order beyond that.
    """
    shares = {"true": F.col("positives"), "raw": F.col("raw"), "thresholded": F.col("above")}
    long = durable(rows.select(*by, "chain", *[F.round(c / F.col("length"), 12).alias(n) for n, c in shares.items()]).unpivot([*by, "chain"], list(shares), "kind", "value"), "ratios")
    ranked = _average_rank(long, [*by, "kind"], "value", "rank")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = ranked.groupBy(*by, "chain").agg(*[pick(k, c).alias(f"{c}_{k}") for k in shares for c in ("value", "rank")])
    aggs = []
    for k in ("raw", "thresholded"):
        err = F.col(f"value_{k}") - F.col("value_true")
        aggs += [
            F.avg(F.abs(err)).alias(f"ratio_mae_{k}"), F.sqrt(F.avg(err * err)).alias(f"ratio_rmse_{k}"), F.avg(err).alias(f"ratio_bias_{k}"),
            F.corr("value_true", f"value_{k}").alias(f"ratio_pearson_{k}"), F.corr("rank_true", f"rank_{k}").alias(f"ratio_spearman_{k}"),
        ]
    return wide.groupBy(*by).agg(*aggs)


def evaluate(scored: DataFrame, threshold: float = 0.5, second: float = 0.6, by: Sequence[str] = ("method",)) -> DataFrame:
    """One evaluation record per method: A02-A14.

    Ranking metrics (A05-A07), best F1 and MCC (A08, A09), chain macros (A10), top-L
    and top-percent shares (A13, A14), ratio metrics for mean scores and for shares
    above ``threshold`` (A12), and counts with their metrics (A02, A03) at three
    thresholds: ``threshold``, ``second`` (suffix ``_second``) and the method's
    best-MCC threshold (suffix ``_selected``).

    The rows are reduced once to counts per (method, chain, score). Chains and whole
    methods share one range sort, whose curves give everything but the order of
    residues within a score.
    """
    by = list(by)
    keys = [*by, "chain"]
    counts = durable(score_counts(scored, keys), "score-counts")
    pooled = counts.groupBy(*by, "score").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    none = F.lit(None).cast(counts.schema["chain"].dataType).alias("chain")
    both = counts.select(F.lit(1).alias("level"), *keys, "score", "tp", "n").unionByName(
        pooled.select(F.lit(0).alias("level"), *by, none, "score", "tp", "n"))
    curves = durable(curve_of(both, ["level", *keys]), "curves")
    whole, chains = curves.where("level = 0").drop("level", "chain"), curves.where("level = 1").drop("level")
    rows = durable(_chain_records(scored, chains, threshold, keys), "chain-records")

    base = ratio(F.col("positives"), F.col("length"))
    aggs = [
        F.avg(ratio(F.col("ap"), F.col("positives"))).alias("chain_ap_macro"), F.count("*").alias("n_chains"),
        F.sum((F.col("positives") == 0).cast("long")).alias("all_negative"), F.sum((F.col("positives") == F.col("length")).cast("long")).alias("all_positive"),
    ]
    for name, k in _cut_offs(F.col("length")).items():
        h = F.col(f"hits_{name}")
        micro = ratio(F.sum(h), F.sum(k))
        if name.startswith("l"):
            aggs += [F.avg(h / k).alias(f"{name}_acc_macro"), micro.alias(f"{name}_acc_micro"), F.sum(h).alias(f"{name}_hits"), F.sum(k).alias(f"{name}_k")]
        else:
            aggs += [
                micro.alias(f"{name}_precision_micro"), ratio(F.sum(h), F.sum("positives")).alias(f"{name}_recall_micro"),
                ratio(micro, ratio(F.sum("positives"), F.sum("length"))).alias(f"{name}_enrichment_micro"),
                F.avg(h / k).alias(f"{name}_precision_macro"), F.avg(ratio(h, F.col("positives"))).alias(f"{name}_recall_macro"),
                F.avg(ratio(h / k, base)).alias(f"{name}_enrichment_macro"),
            ]
    selected = durable(best_mcc(whole, by=by), "selected")
    record = ranking_metrics(whole, by).join(best_f1_of(whole, by), by).join(selected, by)
    # The threshold of each method is a row of a table as small as the record.
    cuts = {"": F.lit(threshold), "_second": F.lit(second), "_selected": F.col("best_mcc_threshold")}
    chosen = whole.join(F.broadcast(selected.select(*by, "best_mcc_threshold")), by)
    for suffix, cut in cuts.items():
        block = metrics_from_counts(confusion(chosen, cut, by))
        record = record.join(block.withColumnsRenamed({c: f"{c}{suffix}" for c in block.columns if c not in by}), by)
    return record.join(rows.groupBy(*by).agg(*aggs), by).join(_ratio_record(rows, by), by)


# ---------------------------------------------------------------- statistics


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def fit_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mergeable statistics of finite values in long form; the sample variance of one value is 0."""
    long = df.select(*by, *[finite(c).alias(c) for c in cols]).unpivot(list(by), list(cols), "feature", "value")
    return long.groupBy(*by, "feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def fit_zscore(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (a deviation below 1e-8 becomes 1): one row to the driver."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= 1e-8 else 1.0) for c in cols}


def apply_zscore(df: DataFrame, stats: dict[str, tuple[float, float]], cols: Sequence[str]) -> DataFrame:
    """Scale ``cols``; statistics for another set of columns leave the table as it is."""
    if set(stats) != set(cols):
        return df
    return df.withColumns({c: (F.col(c) - stats[c][0]) / stats[c][1] for c in cols})


def seed_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation (0 for one seed), min and max per metric, long form."""
    long = df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def group_summary(df: DataFrame, by: Sequence[str], values: Sequence[str], single: str | None = None) -> DataFrame:
    """Row count, mean and population deviation ignoring NULLs (0 for one value).

    ``single`` names a column that must hold one value in the whole input.
    """
    if single is not None and df.select(single).distinct().limit(2).count() > 1:
        raise DataContractError(f"rows mix several values of {single}")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(v).alias(f"{v}_mean") for v in values],
        *[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{v}_std") for v in values],
    )


def class_weight(manifest: DataFrame, ids: DataFrame, cap: float, key: str = "id") -> DataFrame:
    """``min(negatives / positives, cap)`` over the listed ids; 1 without positives."""
    sums = manifest.join(ids.select(key), key, "left_semi").agg(
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum("n_negative"), F.lit(0)).alias("n_negative"),
    )
    weight = F.when(F.col("n_positive") <= 0, 1.0).otherwise(F.least(F.lit(float(cap)), ratio(F.col("n_negative"), F.col("n_positive"))))
    return sums.withColumn("pos_weight", weight)


def size_stats(df: DataFrame, col: str) -> DataFrame:
    """Rows, min, max, mean and median of a column; zeros for an empty table."""
    stats = df.agg(
        F.count(col).alias("n"), F.coalesce(F.min(col), F.lit(0)).alias("min"), F.coalesce(F.max(col), F.lit(0)).alias("max"),
        F.coalesce(F.avg(col), F.lit(0.0)).alias("mean"))
    middle = exact_quantile(df, col, 0.5, out="median").first()
    return stats.withColumn("median", F.lit(float(middle["median"]) if middle and middle["median"] is not None else 0.0))


def dup_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, ..."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("n_keys"))


def min_mean_max(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))


def profile_log(df: DataFrame, run: str, util: str, memory: str) -> DataFrame:
    """Utilisation mean, median and share at or above 50, and peak and mean memory per run."""
    stats = df.groupBy(run).agg(
        F.count("*").alias("samples"),
        F.avg(util).alias("util_mean"),
        F.avg((F.col(util) >= 50).cast("double")).alias("util_ge50"),
        F.max(memory).alias("memory_max"),
        F.avg(memory).alias("memory_mean"),
    )
    return stats.join(exact_quantile(df, util, 0.5, [run], "util_median"), run, "left")


def coverage_bucket(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c <= 0, "eq0").when(c < 0.5, "lt0.5").otherwise("ge0.5")


def coverage_table(df: DataFrame, coverage: str, sums: Sequence[str], means: Sequence[str], usable: Column) -> DataFrame:
    """One row per coverage bucket, also for empty ones (zero counts, NULL means)."""
    buckets = df.sparkSession.createDataFrame([("eq0",), ("lt0.5",), ("ge0.5",)], "bucket string")
    found = df.groupBy(coverage_bucket(coverage).alias("bucket")).agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        F.sum(usable.cast("long")).alias("n_usable"),
    )
    return buckets.join(found, "bucket", "left").na.fill(0, ["n", "n_usable", *[f"sum_{c}" for c in sums]])


def composition(df: DataFrame, by: Sequence[str], letter: str, letters: str) -> DataFrame:
    """Share of each letter among valid letters; zeros for a group without any."""
    valid = F.sum(F.col(letter).isin(*letters).cast("long"))
    return df.groupBy(*by).agg(
        *[ratio(F.sum((F.col(letter) == a).cast("long")), valid).alias(f"aac_{a}") for a in letters]
    )


def composition_levels(df: DataFrame, outer: str, inner: str, letter: str, letters: str) -> DataFrame:
    """Chain composition, complex composition and their difference; both levels from one pass over the rows."""
    n = {a: f"n_{a}" for a in letters}
    chain = df.groupBy(outer, inner).agg(*[F.sum((F.col(letter) == a).cast("long")).alias(n[a]) for a in letters])
    whole = chain.groupBy(outer).agg(*[F.sum(n[a]).alias(f"w{n[a]}") for a in letters])

    def share(prefix):
        total = sum((F.col(prefix + c) for c in n.values()), F.lit(0))
        return {a: ratio(F.col(prefix + n[a]), total) for a in letters}

    c, w = share(""), share("w")
    return chain.join(whole, outer).select(
        outer, inner,
        *[c[a].alias(f"chain_{a}") for a in letters],
        *[w[a].alias(f"complex_{a}") for a in letters],
        *[(c[a] - w[a]).alias(f"diff_{a}") for a in letters],
    )


def mixed_index(rep: Column, draw: Column, seed: int, n: int) -> Column:
    """The unit, ``0..n-1``, that a draw of ``bootstrap_ci`` hits, as a column: integer mixing modulo 2^31-1."""
    _drawable(n)
    p = F.lit(2147483647).cast("long")
    a = (rep * 7919 + draw * 104729 + F.lit(seed * 15485863).cast("long")) % p
    b = (a * a + 12345) % p
    c = (b * 48271) % p
    return (c * c + a) % p % n


def _drawable(n: int) -> None:
    """Fails for more units than the mixing can reach."""
    if n > 2147483647:
        raise DataContractError(f"{n} units; at most 2147483647 can be drawn from")


def _draw_places(replicates: int, n: int, seed: int) -> tuple:
    """Where on the circle of 2^31-1 places the replicates draw, cut into stretches with the same replicates.

    The number that is mixed for draw ``d`` of replicate ``r`` is ``7919 r + 104729 d + const``
    modulo a prime, so with place ``j`` standing for ``104729 j`` a replicate draws at
    the ``n`` places in a row from its first one on. Returns the replicates, the first
    stretch and the one behind the last of each, the borders of the stretches and the
    places in each that any replicate draws at. A range over the end of the circle is two.
    """
    import numpy as np

    p = 2147483647
    rep = np.arange(replicates, dtype=np.int64)
    low = (rep * 7919 + seed * 15485863 % p) % p * pow(104729, -1, p) % p
    over = low + n > p
    lows = np.concatenate([low, np.zeros(over.sum(), np.int64)])
    highs = np.concatenate([np.minimum(low + n, p), (low + n - p)[over]])
    borders = np.unique(np.concatenate([lows, highs]))
    first, behind = np.searchsorted(borders, lows), np.searchsorted(borders, highs)
    depth = np.cumsum(np.bincount(first, minlength=len(borders)) - np.bincount(behind, minlength=len(borders)))
    return np.concatenate([rep, rep[over]]), first, behind, borders, np.where(depth[:-1] > 0, np.diff(borders), 0)


def bootstrap_ci(df: DataFrame, unit: str, diff: str, replicates: int, seed: int, block: int = 1 << 22, slices: int = 96) -> DataFrame:
    """Paired cluster bootstrap of the mean of ``diff``: units are drawn with replacement.

    Per-unit sums shrink the data first. Units are then numbered and dealt, in rows of
    4096 units, to arrays of ``block`` units, which a task fills in its worker. Draw
    ``d`` of replicate ``r`` hits the unit that integer mixing modulo 2^31-1 gives, the
    same in any SQL engine; a replicate draws at neighbouring places of one circle
    (``_draw_places``), so a place that several replicates share is drawn once, and all
    together make 2^31-1 draws an array at most. About ``slices`` tasks share the circle;
    each adds up the draws that hit its units and emits two sums per replicate, so a draw
    is never a row and nothing is joined. Sum and count of a unit are one complex
    number, so a draw reads memory once. A null unit is a unit, null differences do not
    count, and without units the record has zero units and nulls.
    """
    import numpy as np
    import pyarrow as pa

    units = running_totals(
        df.where(F.col(diff).isNotNull()).groupBy(unit).agg(F.sum(diff).cast("double").alias("s"), F.count("*").alias("c")), order=[unit], rank="number"
    ).select((F.col("number") - 1).alias("idx"), "s", "c")
    units = durable(units, "units")
    n, total, rows = units.agg(F.count("*"), F.sum("s"), F.sum("c")).first()
    _drawable(n)
    blocks = max(1, -(-n // block))
    shares = -(-slices // blocks)  # of the circle, for every array
    listed = units.groupBy(F.floor(F.col("idx") / block).alias("block"), F.floor(F.col("idx") % block / 4096)).agg(F.sort_array(F.collect_list(F.struct("idx", "s", "c"))).alias("u"))
    lists = listed.select("block", F.col("u.idx")[0].alias("first"), F.col("u.s").alias("s"), F.col("u.c").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def draw(batches):
        p, chunk = 2147483647, 1 << 15

        def reduced(x):  # x mod 2^31-1 of numbers below 2^62
            x = (x & p) + (x >> 31)
            x = (x & p) + (x >> 31)
            return np.where(x >= p, x - p, x)

        arrays = {}  # one, as every share of every array is a partition
        for batch in batches:
            for i in range(batch.num_rows):
                part = (batch.column(0)[i].as_py(), batch.column(4)[i].as_py())
                if part not in arrays:
                    arrays[part] = np.zeros(min(block, n - part[0] * block), complex)
                at = batch.column(1)[i].as_py() - part[0] * block
                s, c = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                arrays[part][at : at + len(s)] = s + 1j * c
        for (number, share), both in arrays.items():
            reps, begin, behind, borders, places = _draw_places(replicates, n, seed)
            upto = np.concatenate([[0], np.cumsum(places)])
            lo, hi = (int(upto[-1]) * k // shares for k in (share, share + 1))
            stretch = np.zeros(len(places), complex)
            for k in np.flatnonzero((upto[:-1] < hi) & (upto[1:] > lo)).tolist():
                shift = int(borders[k] - upto[k])
                end = min(hi, int(upto[k + 1])) + shift
                for low in range(max(lo, int(upto[k])) + shift, end, chunk):
                    a = reduced(np.arange(low, min(end, low + chunk), dtype=np.int64) * 104729)
                    b = reduced(a * a + 12345)
                    m = reduced(b * 48271)
                    x = reduced(m * m + a)
                    at = x - x // n * n
                    if len(both) < n:
                        at = at - number * block
                        at = at[(at >= 0) & (at < len(both))]
                    stretch[k] += both[at].sum()
            totals = np.array([stretch[a:b].sum() for a, b in zip(begin.tolist(), behind.tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(totals.real.copy()), pa.array(np.rint(totals.imag).astype(np.int64))], names=["rep", "s", "c"])

    part = (F.col("block") * shares + F.col("share")).cast("int")
    drawn = lists.select("block", "first", "s", "c", "share").repartitionById(blocks * shares, part).mapInArrow(draw, "rep long, s double, c long")
    deltas = drawn.groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("delta"))
    return deltas.agg(
        F.lit(n).alias("n_units"),
        F.count("*").alias("replicates"),
        F.lit(total / rows if rows else None).cast("double").alias("difference"),
        F.avg("delta").alias("bootstrap_mean"),
        F.percentile("delta", 0.025).alias("ci_low"),
        F.percentile("delta", 0.975).alias("ci_high"),
    ).withColumn("excludes_zero", (F.col("ci_high") < 0) | (F.col("ci_low") > 0))


def component_metrics(members: DataFrame, clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component: complexes, distinct clusters, residues, positives, share and mean coverage of covered ones.

    ``members(complex, component)``, ``clusters(complex, cluster)``,
    ``labels(complex, n_residues, n_positive, n_negative[, coverage])``.
    """
    coverage = F.col("coverage") if "coverage" in labels.columns else F.lit(None).cast("double")
    sums = members.join(labels.withColumn("__cov", coverage), "complex", "left").groupBy("component").agg(
        F.count("*").alias("n_complexes"),
        F.coalesce(F.sum("n_residues"), F.lit(0)).alias("n_residues"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum("n_negative"), F.lit(0)).alias("n_negative"),
        F.coalesce(F.avg("__cov"), F.lit(0.0)).alias("coverage_mean"),
        F.min("complex").alias("first_complex"),
    )
    # A cluster lies in one component, so distinct clusters are counted after a
    # duplicate-free projection instead of by a set per component.
    n_clusters = members.join(clusters, "complex").select("component", "cluster").distinct().groupBy("component").agg(
        F.count("*").alias("n_clusters"))
    share = ratio(F.col("n_positive"), F.greatest(F.lit(1), F.col("n_positive") + F.col("n_negative")))
    return sums.join(n_clusters, "component", "left").na.fill(0, ["n_clusters"]).withColumn("positive_fraction", share)


def integrity_scan(df: DataFrame, by: str, declared: DataFrame, key: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Per complex: rows, declared size, unequal array lengths, duplicate residue keys, insertion rows.

    Duplicates are counted from per-key counts so no complex is gathered.
    """
    sizes = [F.size(a) for a in arrays]
    uneven = F.greatest(*sizes) != F.least(*sizes) if len(sizes) > 1 else F.lit(False)
    per_key = df.groupBy(by, *key).agg(
        F.count("*").alias("__n"), F.sum(uneven.cast("long")).alias("__u"),
        F.sum((F.trim(F.coalesce(F.col("icode"), F.lit(""))) != "").cast("long")).alias("__i"),
    )
    scan = per_key.groupBy(by).agg(
        F.sum("__n").alias("n_rows"),
        F.sum(F.col("__n") - 1).alias("n_duplicate_keys"),
        F.sum("__u").alias("n_uneven"),
        F.sum("__i").alias("n_insertion_rows"),
    )
    return scan.join(declared, by, "full_outer").withColumn(
        "status",
        F.when(F.col("n_rows").isNull(), "MISSING").when(F.col("declared").isNull(), "EXTRA")
        .when((F.col("n_rows") != F.col("declared")) | (F.col("n_uneven") > 0) | (F.col("n_duplicate_keys") > 0), "FAIL")
        .otherwise("OK"),
    )
