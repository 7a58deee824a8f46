import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, running_totals
from sitelake.operators import metrics as M

COLS = "method string, chain string, position int, label int, score double"


def scored(spark, rows):
    return spark.createDataFrame(rows, COLS)


def chain(name, labels, scores, method="m"):
    return [(method, name, i + 1, l, float(s)) for i, (l, s) in enumerate(zip(labels, scores))]


def brute_ranking(labels, scores):
    pos, neg = sum(labels), len(labels) - sum(labels)
    ap = pr = 0.0
    last_p, last_tp = 1.0, 0
    for t in sorted(set(scores), reverse=True):
        n = sum(s >= t for s in scores)
        tp = sum(l for l, s in zip(labels, scores) if s >= t)
        if pos:
            ap += (tp - last_tp) / pos * tp / n
            pr += (tp - last_tp) / pos * (tp / n + last_p) / 2
        last_p, last_tp = tp / n, tp
    roc = None
    if pos and neg:
        p = [s for l, s in zip(labels, scores) if l]
        q = [s for l, s in zip(labels, scores) if not l]
        roc = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / pos / neg
    return ap, pr, roc


def test_ranking_metrics_match_brute_force_with_ties(spark):
    rnd = random.Random(1)
    groups = {f"m{i}": ([rnd.randint(0, 1) for _ in range(60)], [rnd.randint(0, 9) / 10 for _ in range(60)]) for i in range(4)}
    rows = [r for m, (l, s) in groups.items() for r in chain("c", l, s, m)]
    got = {r["method"]: r for r in M.ranking_metrics(M.ranking_curve(scored(spark, rows))).collect()}
    for m, (l, s) in groups.items():
        ap, pr, roc = brute_ranking(l, s)
        assert got[m]["average_precision"] == pytest.approx(ap)
        assert got[m]["auprc"] == pytest.approx(pr)
        assert got[m]["auroc"] == pytest.approx(roc)


def test_edge_chains(spark):
    rows = chain("neg", [0, 0, 0], [0.1, 0.2, 0.3]) + chain("pos", [1, 1], [0.5, 0.5]) + chain("one", [1], [0.9]) + chain("flat", [1, 0], [0.4, 0.4])
    per = {r["chain"]: r for r in M.chain_report(scored(spark, rows))[0].collect()}
    assert per["neg"]["average_precision"] == 0.0 and per["neg"]["auroc"] is None
    assert per["pos"]["average_precision"] == 1.0 and per["pos"]["auroc"] is None
    assert per["flat"]["average_precision"] == 0.5 and per["flat"]["auroc"] == 0.5
    macro = M.chain_macro_ap(scored(spark, rows)).first()
    assert macro["chain_ap_macro"] == pytest.approx((0 + 1 + 1 + 0.5) / 4)
    assert (macro["all_negative"], macro["all_positive"], macro["n_chains"]) == (1, 2, 4)


def test_sweep_is_exact_on_thresholds(spark):
    rows = chain("c", [1, 0, 1, 0], [0.29, 0.57, 0.58, 1.0])
    sweep = {round(r["threshold"], 2): r for r in M.threshold_sweep(scored(spark, rows)).collect()}
    for t in (0.28, 0.29, 0.3, 0.57, 0.58, 0.99):
        tp = sum(l for l, s in zip([1, 0, 1, 0], [0.29, 0.57, 0.58, 1.0]) if s >= t)
        assert sweep[t]["tp"] == tp, t
    ordered = [sweep[t]["tp"] for t in sorted(sweep)]
    assert ordered == sorted(ordered, reverse=True)


def test_best_mcc_modes(spark):
    rows = chain("c", [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert M.best_mcc(scored(spark, rows), 100).first()["best_mcc_threshold"] == pytest.approx(0.21)
    assert M.best_mcc(scored(spark, rows), 100, mode="central").first()["best_mcc_threshold"] == pytest.approx(0.5)
    with pytest.raises(DataContractError):
        M.best_mcc(scored(spark, rows), mode="other")


def test_top_l_breaks_ties_by_position_and_keeps_one(spark):
    rows = chain("a", [0, 1, 1], [0.5, 0.5, 0.1]) + chain("b", [1] * 10 + [0] * 10, [0.9] * 20)
    out = M.top_l(M.chain_ranks(scored(spark, rows)), denoms=(5,)).first()
    assert out["l5_k"] == 1 + 4 and out["l5_hits"] == 0 + 4
    assert out["l5_acc_macro"] == pytest.approx(0.5)


def test_counts_and_rows_agree(spark):
    rnd = random.Random(3)
    df = scored(spark, [r for c in "abc" for r in chain(c, [rnd.randint(0, 1) for _ in range(40)], [round(rnd.random(), 1) for _ in range(40)])])
    counts = M.score_counts(df, ["method", "chain"])
    assert M.confusion(df, 0.4).collect() == M.confusion(counts, 0.4).collect()
    assert sorted(M.threshold_sweep(df).collect()) == sorted(M.threshold_sweep(counts).collect())


def test_running_totals_with_one_hot_group(spark):
    n = 5000
    rows = [("hot" if i % 3 else "cold", i, (i * 7919) % 1000) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, v int").repartition(16)
    out = running_totals(df, by=["g"], order=["-v", "id"], sums={"total": "v"}, rank="rn").collect()
    for g in ("hot", "cold"):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["rn"])
        total = 0
        for i, (w, r) in enumerate(zip(want, got)):
            total += w[2]
            assert (r["id"], r["rn"], r["total"]) == (w[1], i + 1, total)


def test_running_totals_of_odd_groups_and_values(spark):
    import decimal

    nan = float("nan")
    rows = [(g, k, i, None if i % 5 == 0 or (g == "n" and i < 40) else i % 7, None if i % 3 == 0 else i / 8.0, decimal.Decimal(i) / 4)
            for g in ("a", None, "n") for k in (0.0, -0.0, nan, None, 2.5) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k double, i int, v int, x double, d decimal(10,2)").repartition(13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups and batches end at different rows
    try:
        def check(sums, by):
            got = running_totals(df, by=by, order=["i", "g", "k", "v"], sums=sums, rank="rn")
            cols, w = list(sums), Window.partitionBy(*by).orderBy("i").rangeBetween(Window.unboundedPreceding, 0)
            last = got.groupBy(*by, "i").agg(F.max_by(F.struct(*cols), "rn").alias("s"), F.max("rn").alias("rn")).select(*by, "i", *[f"s.{c}" for c in cols], "rn")
            want = df.select(*by, "i", *[F.sum(s).over(w).alias(o) for o, s in sums.items()], F.count("*").over(w).alias("rn")).distinct()
            assert sorted(map(repr, last.collect())) == sorted(map(repr, want.collect()))

        check({"tv": "v", "tx": "x"}, ["g", "k"])
        check({"tv": "v"}, [])
        check({"td": "d", "tv": "v"}, ["g"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_totals_shuffle_the_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = running_totals(df, by=["g"], order=["id"], rank="rn")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # a window over the written rows would shuffle and sort them again


def test_seed_and_group_summary_use_their_deviation(spark):
    # Golden values: F1 at the validation threshold of three seeded runs and their published mean and population deviation.
    f1 = [0.6375509152354241, 0.6430063287405059, 0.6317160294590024]
    df = spark.createDataFrame([("a", v) for v in f1] + [("b", 0.5)], "g string, f1 double")
    mean = sum(f1) / 3
    got = {r["g"]: r for r in M.group_summary(df, ["g"], ["f1"]).collect()}
    assert got["a"]["f1_mean"] == pytest.approx(mean) and got["b"]["f1_std"] == 0.0
    assert got["a"]["f1_std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in f1) / 3))
    seeds = {r["g"]: r for r in M.seed_summary(df, ["f1"], ["g"]).collect()}
    assert seeds["a"]["std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in f1) / 2)) and seeds["b"]["std"] == 0.0
    with pytest.raises(DataContractError):
        M.group_summary(df, ["g"], ["f1"], single="g")


def test_fit_stats_skips_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    r = M.fit_stats(df, ["v"]).first()
    assert (r["n"], r["mean"], r["variance"]) == (2, 2.0, 2.0)


def test_class_weight_without_positives(spark):
    man = spark.createDataFrame([("a", 0, 9), ("b", 2, 8)], "id string, n_positive int, n_negative int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert M.class_weight(man, ids("a"), 5.0).first()["pos_weight"] == 1.0
    assert M.class_weight(man, ids("a", "b"), 5.0).first()["pos_weight"] == 5.0
    assert M.class_weight(man, ids("b"), 5.0).first()["pos_weight"] == 4.0


def test_ratio_metrics_average_ranks(spark):
    df = spark.createDataFrame([("m", "a", 0.1, 0.2), ("m", "b", 0.1, 0.4), ("m", "c", 0.5, 0.3)], "method string, chain string, true_ratio double, predicted_ratio double")
    r = M.ratio_metrics(df).first()
    assert r["mae"] == pytest.approx((0.1 + 0.3 + 0.2) / 3)
    assert r["spearman"] == pytest.approx(0.0, abs=1e-12)
    assert df.agg(F.count("*")).first()[0] == 3


def test_bootstrap_draws_in_blocks(spark):
    """Partial sums over blocks of units equal a resampling in plain Python and the column rule; no draw is a row."""
    rows = [(f"u{i % 23}" if i % 7 else None, (i * 37 % 101) / 10 - 4) for i in range(300)] + [("u3", None)]
    df = spark.createDataFrame(rows, "unit string, diff double")
    sums = {}
    for u, d in rows:
        if d is not None:
            s, c = sums.get(u, (0.0, 0))
            sums[u] = s + d, c + 1
    units = [sums[u] for u in sorted(sums, key=lambda u: (u is not None, u))]
    n, deltas = len(units), []
    at = spark.range(40).crossJoin(spark.range(n).withColumnRenamed("id", "draw")).select("id", "draw", M.mixed_index(F.col("id"), F.col("draw"), 5, n).alias("at"))
    hits = {(r.id, r.draw): r.at for r in at.collect()}
    for rep in range(40):
        drawn = [units[hits[rep, d]] for d in range(n)]
        deltas.append(sum(s for s, _ in drawn) / sum(c for _, c in drawn))
    for block in (5, 1 << 18):
        out = M.bootstrap_ci(df, "unit", "diff", 40, 5, block=block, slices=3)
        plan = out._jdf.queryExecution().toString()
        assert "Join" not in plan and "Generate explode(sequence" in plan.replace("Generate explode(org", "Generate explode(sequence")
        got = out.first()
        assert (got.n_units, got.replicates) == (n, 40)
        assert got.difference == pytest.approx(sum(s for s, _ in units) / sum(c for _, c in units))
        assert got.bootstrap_mean == pytest.approx(np.mean(deltas))
        assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(deltas, [0.025, 0.975])))
    empty = M.bootstrap_ci(df.limit(0), "unit", "diff", 40, 5).first()
    assert (empty.n_units, empty.replicates, empty.difference) == (0, 0, None)


def test_evaluate_equals_its_parts(spark):
    """The record from counts equals the metrics taken one by one, with ties at the cut-offs and chains of one class."""
    rnd = random.Random(8)
    rows = []
    for m in ("a", "b"):
        for c in range(25):
            n = rnd.randint(1, 60)
            labels = [int(rnd.random() < rnd.choice([0.0, 0.3, 1.0])) for _ in range(n)]
            rows += chain(f"c{c}", labels, [rnd.choice([0.1, 0.5, 0.55, 0.6, 0.9]) if m == "a" else rnd.random() for _ in range(n)], m)
    df = scored(spark, rows).repartition(3)
    got = {r.method: r for r in M.evaluate(df).collect()}
    ranked = M.chain_ranks(df)
    for part in (M.top_l(ranked), M.top_frac(ranked), M.chain_macro_ap(df), M.best_mcc(df), M.best_f1(df), M.metrics_from_counts(M.confusion(df, 0.5)), M.ranking_metrics(M.ranking_curve(df))):
        for r in part.collect():
            assert {c: got[r.method][c] for c in r.asDict()} == pytest.approx(r.asDict()), r
    for r in M.metrics_from_counts(M.confusion(df, 0.6)).collect():
        assert {c: got[r.method][f"{c}_second"] for c in r.asDict() if c != "method"} == pytest.approx({c: v for c, v in r.asDict().items() if c != "method"})
    for m, r in got.items():
        want = M.confusion(df.where(F.col("method") == m), r.best_mcc_threshold).first()
        assert (r.tp_selected, r.fp_selected, r.tn_selected, r.fn_selected) == (want.tp, want.fp, want.tn, want.fn)
    for suffix, cut in (("raw", None), ("thresholded", 0.5)):
        for r in M.ratio_metrics(M.chain_ratios(df, cut)).collect():
            for c in ("mae", "rmse", "bias", "pearson", "spearman"):
                assert got[r.method][f"ratio_{c}_{suffix}"] == pytest.approx(r[c])


def test_bootstrap_makes_a_draw_once_for_millions_of_units(spark):
    import inspect

    import numpy as np
    # Each array of units repeats all draws of its replicates: 3.2 million units must be one array, not thirteen.
    assert inspect.signature(M.bootstrap_ci).parameters["block"].default >= 3_200_000
    n, p = 300_000, 2147483647
    df = spark.range(n).select(F.col("id").alias("unit"), (F.col("id") % 1000 / 7.0).alias("diff"))
    got = M.bootstrap_ci(df, "unit", "diff", 3, 42).first()
    s, d, means = (np.arange(n) % 1000) / 7.0, np.arange(n, dtype=np.int64), []
    for rep in range(3):
        a = (rep * 7919 + d * 104729 + 42 * 15485863) % p
        c = (a * a + 12345) % p * 48271 % p
        means.append(s[(c * c + a) % p % n].mean())
    assert got["n_units"] == n and got["bootstrap_mean"] == pytest.approx(np.mean(means))


def test_bootstrap_draws_shared_places_once_and_in_short_rows(spark):
    """Replicates draw at ranges of one circle: each of ``n`` places, all of 2^31-1 at most; no row holds a whole array."""
    import numpy as np

    p, n, seed = 2147483647, 300_000, 11
    reps, first, behind, borders, places = M._draw_places(9_000, n, seed)
    assert places.sum() <= p < 9_000 * n
    held = np.zeros(9_000, np.int64)
    np.add.at(held, reps, [places[a:b].sum() for a, b in zip(first, behind)])
    assert (held == n).all()
    # The first draws of a replicate are the numbers mixed at its first places.
    for rep in (0, 17, 8_999):
        k = int(first[np.flatnonzero(reps == rep)[0]])
        assert [(int(borders[k]) + d) % p * 104729 % p for d in range(3)] == [(rep * 7919 + d * 104729 + seed * 15485863) % p for d in range(3)]
    # A range that goes over the end of the circle, and one that is the whole of it.
    for many in (p - 5, p):
        reps, first, behind, borders, places = M._draw_places(3, many, seed)
        assert places.sum() == p and [sum(int(places[a:b].sum()) for r, a, b in zip(reps, first, behind) if r == k) for k in range(3)] == [many] * 3
    df = spark.range(20_000).select(F.col("id").alias("unit"), (F.col("id") % 1000 / 7.0).alias("diff"))
    plan = M.bootstrap_ci(df, "unit", "diff", 3, 42)._jdf.queryExecution().analyzed().toString()
    assert "/ cast(4096" in plan and "RepartitionByExpression" in plan
    got = [M.bootstrap_ci(df, "unit", "diff", 300, 42, block=b, slices=s).first() for b, s in ((1 << 22, 96), (7_000, 4))]
    assert got[0].replicates == 300 and got[0].asDict() == pytest.approx(got[1].asDict())
