import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.functions import text as T
from sitelake.operators import joins as J
from sitelake.operators import spatial as X
from sitelake.operators import strips as Z
from sitelake.operators import windows as W


def cloud(n, seed, copies=0, spread=20.0):
    rnd = random.Random(seed)
    rows = [(0, i, rnd.randrange(3), *(rnd.uniform(0, spread) for _ in range(3))) for i in range(n)]
    rows += [(0, n + i, i % 3, 5.0, 5.0, 5.0) for i in range(copies)]  # copies share one place
    rows.append((0, 10**6, 1, 500.0, 500.0, 500.0))  # an outlier far away
    return rows


def points(spark, rows):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    return spark.createDataFrame([(*r, letters[r[1] % 20]) for r in rows], "complex int, pid long, chain int, x double, y double, z double, aa string")


def dist(a, b):
    return math.dist(a[3:6], b[3:6])


def test_knn_with_copies_and_outlier(spark):
    rows = cloud(60, 1, copies=40)
    got = {}
    for r in X.knn(points(spark, rows), 5).collect():
        got.setdefault(r["pid"], {})[r["rank"]] = r["neighbor"]
    for p in rows:
        want = [q[1] for q in sorted((q for q in rows if q[1] != p[1]), key=lambda q: (dist(p, q), q[1]))[:5]]
        assert [got[p[1]][k] for k in range(1, 6)] == want, p


def test_knn_of_a_tiny_group(spark):
    rows = cloud(2, 3)
    assert sorted((r["pid"], r["neighbor"]) for r in X.knn(points(spark, rows), 5).collect()) == sorted((a[1], b[1]) for a in rows for b in rows if a != b)


def test_neighbor_sums_with_copies(spark):
    rows = cloud(50, 2, copies=30)
    pts = points(spark, rows)
    strict = {r["pid"]: r for r in X.radius_neighbors(pts, [5.0, 10.0]).collect()}
    pocket = {r["pid"]: r for r in X.neighbor_sums(pts, 6.0, {"k": (X.within(6.0, False), None)}, strict=False).collect()}
    for p in rows:
        assert strict[p[1]]["n_5"] == sum(0 < dist(p, q) < 5 for q in rows)
        assert strict[p[1]]["n_10"] == sum(0 < dist(p, q) < 10 for q in rows)
        assert pocket[p[1]]["k"] == sum(dist(p, q) <= 6 for q in rows if q[1] != p[1])


def test_contact_labels(spark):
    rows = cloud(80, 4, copies=10, spread=30.0)
    got = {r["pid"]: r["label"] for r in X.contact_labels(points(spark, rows), 5.0, ["complex", "chain", "pid"]).collect()}
    for p in rows:
        assert got[p[1]] == int(any(p[2] != q[2] and dist(p, q) <= 5.0 for q in rows))


def test_anisotropy_against_numpy(spark):
    rows = cloud(60, 5)
    got = {r["pid"]: r for r in X.anisotropy(points(spark, rows)).collect()}
    for p in rows:
        near = np.array([q[3:6] for q in rows if 0 < dist(p, q) < 10])
        if len(near) < 3:
            assert got[p[1]]["anisotropy"] == 0.0 and got[p[1]]["normal_magnitude"] == 0.0
            continue
        c = near - near.mean(axis=0)
        e = np.sort(np.linalg.eigvalsh(c.T @ c))
        s = near - np.array(p[3:6])
        f = np.sort(np.linalg.eigvalsh(s.T @ s))
        assert got[p[1]]["anisotropy"] == pytest.approx((e[2] - e[0]) / (e[2] + 1e-8), abs=1e-6)
        assert got[p[1]]["normal_magnitude"] == pytest.approx(1 - f[0] / f[2], abs=1e-6)


def residues(spark, text, by="c"):
    return spark.createDataFrame([(by, i, a) for i, a in enumerate(text)], "complex string, ord int, aa string")


def test_windows_across_block_borders(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(9000))  # more than two blocks
    rows = {r["ord"]: r for r in W.rolling_class_share(residues(spark, text), sizes=(5, 33), entropy=True).collect()}
    near = {r["ord"]: r for r in W.neighbor_letters(residues(spark, text)).collect()}
    for i in [0, 1, 15, 3966, 3967, 3968, 3969, 3984, 7935, 7936, 8998, 8999]:
        for w in (5, 33):
            part = [a for a in text[max(0, i - w // 2): i + w // 2 + 1] if a != "X"]
            n = max(1, len(part))
            assert rows[i][f"win{w}_frac_polar"] == pytest.approx(sum(a in "STNQCY" for a in part) / n)
            assert rows[i][f"win{w}_max_aa_frac"] == pytest.approx(max([part.count(a) for a in set(part)] or [0]) / n)
            ent = -sum(part.count(a) / n * math.log(part.count(a) / n + 1e-12) for a in set(part)) / math.log(20)
            assert rows[i][f"win{w}_aa_entropy"] == pytest.approx(ent)
        assert near[i]["prev_aa"] == (text[i - 1] if i else "X")
        assert near[i]["next_aa"] == (text[i + 1] if i + 1 < len(text) else "X")
    assert len(rows) == len(text)


def test_moment_restarts_at_the_frame(spark):
    from sitelake.functions.residue import field

    h = field("hydropathy")
    text = "AXKLIVWDEFXXGHTR"
    got = {r["ord"]: r for r in W.rolling_moment(residues(spark, text), sizes=(9,)).collect()}
    for i in range(len(text)):
        part = text[max(0, i - 4): i + 5]
        x = sum(h[a] * math.cos(math.radians(100 * k)) for k, a in enumerate(part) if a != "X")
        y = sum(h[a] * math.sin(math.radians(100 * k)) for k, a in enumerate(part) if a != "X")
        n = sum(a != "X" for a in part)
        assert got[i]["win9_moment_100"] == pytest.approx(min(1.0, math.hypot(x, y) / (n * 4.5)) if n else 0.0)


def test_segments_and_contiguity(spark):
    df = residues(spark, "AAABBA")
    segs = W.segments(df, "aa", ["complex"], "ord")
    assert sorted((r["segment"], r["aa"], r["start"], r["stop"]) for r in segs.collect()) == [(0, "A", 0, 3), (1, "B", 3, 5), (2, "A", 5, 6)]
    with pytest.raises(DataContractError):
        W.require_contiguous_values(segs, "aa", ["complex"])


def test_best_window_and_occurrences(spark):
    df = spark.createDataFrame([("ABAB", "XXABABABYY"), ("ABCD", "ZABXDAACDQ"), ("LONG", "AB"), ("QQ", "ABC")], "query string, target string")
    got = {r["query"]: (r["window_start"], r["window_matches"]) for r in T.best_window(df).collect()}

    def brute(q, t):
        if len(t) < len(q):
            return -1, -1
        return max(((-s, sum(a == b for a, b in zip(q, t[s:]))) for s in range(len(t) - len(q) + 1)), key=lambda v: (v[1], v[0]))

    for q, t in [("ABAB", "XXABABABYY"), ("ABCD", "ZABXDAACDQ"), ("LONG", "AB"), ("QQ", "ABC")]:
        s, m = brute(q, t)
        assert got[q] == ((s, m) if len(t) < len(q) else (-s, m))
    occ = spark.createDataFrame([("aa", "aaaa"), ("a.b", "xa.ba.b"), ("z", "abc")], "q string, t string").select("q", T.occurrences("t", "q").alias("s"))
    assert {r["q"]: r["s"] for r in occ.collect()} == {"aa": [1, 2, 3], "a.b": [2, 5], "z": []}


def test_cigar_rules(spark):
    df = spark.createDataFrame([("a", "2M1D1I2M"), ("b", "2M1Q"), ("c", "M2")], "chain string, c string").withColumn("ops", T.parse_cigar("c"))
    assert {r["chain"]: r["ops"] is None for r in df.collect()} == {"a": False, "b": True, "c": True}
    rows = sorted((r["query_pos"], r["target_pos"]) for r in T.map_positions(df.where("ops is not null")).na.fill(-1).collect())
    assert rows == [(0, 0), (1, 1), (2, -1), (3, 3), (4, 4)]


def test_joins_that_must_fail(spark):
    a = spark.createDataFrame([("c", 1, 0, 0.5)], "chain string, position int, label int, score double")
    with pytest.raises(DataContractError):
        J.align_scores([a, a.withColumn("label", F.lit(1))])
    s = spark.createDataFrame([(1, 0.5), (2, 0.6)], "seed int, ap double")
    with pytest.raises(DataContractError):
        J.paired_delta(s, s.where("seed = 1"), metrics=["ap"])
    with pytest.raises(DataContractError):
        J.validated_join(s, s.unionByName(s), ["seed"])


def test_intervals_across_blocks_against_plain_code(spark):
    sizes = {"a": 2100, "b": 5, "c": 1024, "d": 0}
    regions = [("a", -3, 1500, "M", 1), ("a", 1000, 1100, "I", 2), ("a", 1024, 1025, "K", 4), ("a", 2000, 9999, "O", 3), ("a", 50, 40, "E", 9),
               ("c", 1024, 1024, "Z", 1), ("c", 1, 1, "Y", 1), ("e", 1, 5, "N", 1)]
    seqs = spark.createDataFrame(list(sizes.items()), "chain string, n int")
    df = spark.createDataFrame(regions, "chain string, beg int, end int, code string, ordinal int")
    got = {(r["chain"], r["position"]): r["code"] for r in J.assign_intervals(seqs, df).collect()}
    want = {(c, p): max(((o, code) for k, b, e, code, o in regions if k == c and b <= p <= e), default=(0, None))[1] for c, n in sizes.items() for p in range(1, n + 1)}
    assert got == want


def test_first_difference_of_whole_sequences(spark):
    long = "ACDE" * 3000
    rows = {"same": (long, long), "late": (long, long[:9000] + "XX" + long[9002:]), "short": ("ACD", "AC"), "left": ("A", None), "right": ("", "AB"), "empty": ("", "")}
    left = spark.createDataFrame([(k, v[0], list(v[0])) for k, v in rows.items()], "chain string, aa string, code array<string>")
    right = spark.createDataFrame([(k, v[1], list(v[1])) for k, v in rows.items() if v[1] is not None], "chain string, aa string, code array<string>")
    got = {r["chain"]: (r["pos"], r["field"], r["n_differences"]) for r in J.first_difference(left, right, ["aa", "code"], pos="pos").collect()}
    assert got == {"late": (9000, "aa", 2), "short": (2, "missing_right", 1), "left": (0, "missing_right", 1), "right": (0, "missing_left", 2)}


def held_as_text(spark, lengths=(300, 1, 0, 700, 2, 2, 1100, 40)):
    """Two complexes of chains as text, and the same as rows."""
    rnd = random.Random(3)
    chains, rows = [], []
    for c in "pq":
        start = 0
        for k, n in enumerate(lengths):
            seq = "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWYXXX\u00e9") for _ in range(n))
            chains.append((c, f"{c}{k}", seq, start))
            rows += [(c, f"{c}{k}", start + i, i, a if a in "ACDEFGHIKLMNPQRSTVWY" else "X") for i, a in enumerate(seq)]
            start += n
    return (spark.createDataFrame(chains, "complex string, chain string, seq string, start long"),
            spark.createDataFrame(rows, "complex string, chain string, ord int, pos int, aa string"))


def same_rows(strip, rows, cols):
    got = {(r["complex"], r["ord"]): r for r in strip.collect()}
    want = {(r["complex"], r["ord"]): r for r in rows.collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["key"] == w["chain"]
        assert [got[k][c] for c in cols] == pytest.approx([w[c] for c in cols], abs=1e-9)


def test_strips_give_the_rows_of_the_windows(spark):
    chains, rows = held_as_text(spark)
    cut = Z.strips(chains, 31, block=100)
    roll = [f"win{w}_{p}_{s}" for w in (7, 63) for p in ("hydropathy", "charge", "mass", "volume") for s in ("mean", "std")]
    same_rows(Z.strip_rows(cut, Z.stats_kernel((7, 63)), roll), W.rolling_stats(rows, (7, 63)), roll)
    ent = [f"win{w}_entropy" for w in (7, 63)]
    same_rows(Z.strip_rows(cut, Z.letters_kernel((7, 63), entropy=True), ent), W.rolling_entropy(rows, (7, 63)), ent)
    share = W.rolling_class_share(rows, (5, 33), entropy=True)
    cols = [c for c in share.columns if c.startswith("win")]
    same_rows(Z.strip_rows(cut, Z.letters_kernel((5, 33), shares=True, entropy=True), cols), share, cols)
    turn = ["win9_moment_100", "win33_moment_160"]
    same_rows(Z.strip_rows(cut, Z.moment_kernel(), turn), W.rolling_moment(rows), turn)
    means = {r["chain"]: (r["n"], r["win7_entropy"]) for r in Z.strip_means(cut, Z.letters_kernel((7,), entropy=True), ["win7_entropy"]).collect()}
    plain = W.rolling_entropy(rows, (7,)).groupBy("chain").agg(F.count("*").alias("n"), F.avg("win7_entropy").alias("m"))
    assert means == {r["chain"]: (r["n"], pytest.approx(r["m"])) for r in plain.collect()}


def test_strips_of_wide_frames_and_single_chains(spark):
    chains, rows = held_as_text(spark)
    cols = ["win1501_mass_mean", "win1501_mass_std"]
    same_rows(Z.strip_rows(Z.strips(chains, 750, block=64), Z.stats_kernel((1501,)), cols), W.rolling_stats(rows, (1501,)), cols)
    alone = Z.strips(chains.withColumn("start", F.lit(0)), 4, by=["chain"], block=50)
    got = {(r["chain"], r["ord"]): (r["wm3"], r["wm9"]) for r in Z.strip_rows(alone, Z.strict_mean_kernel(), ["wm3", "wm9"], by=["chain"]).collect()}
    from sitelake.functions import residue as P
    want = W.rolling_mean_strict(rows.withColumn("pi", P.lookup("aa", P.field("pi"), 6.0)), ["pi"])
    assert got == {(r["chain"], r["pos"]): (pytest.approx(r["3_wm_pi"]), pytest.approx(r["9_wm_pi"])) for r in want.collect()}


def test_strips_of_neighbors_and_segments(spark):
    chains, rows = held_as_text(spark, lengths=(300, 1, 0, 700, 2))
    chains = chains.withColumn("seq", F.when(F.col("chain") == "q3", F.repeat(F.lit("A"), 700)).otherwise(F.col("seq")))  # a run over several strips
    rows = rows.withColumn("aa", F.when(F.col("chain") == "q3", "A").otherwise(F.col("aa")))
    cut = Z.strips(chains, 1, block=64)
    plain = W.neighbor_letters(rows).groupBy("prev_aa", "aa", "next_aa").agg(F.count("*").alias("n"))
    assert sorted(Z.neighbor_counts(cut).collect()) == sorted(plain.collect())
    order = ["complex", "segment", "start", "stop"]
    gaps = W.segments(rows.withColumn("gap", F.col("aa") == "X"), "gap", ["complex"], "ord")
    assert sorted(Z.strip_segments(cut).select(*order, "gap").collect()) == sorted(gaps.select(*order, "gap").collect())
    by_chain = W.segments(rows, "chain", ["complex"], "ord")
    assert sorted(Z.strip_segments(cut, col="chain", keys=True).select(*order, "chain").collect()) == sorted(by_chain.select(*order, "chain").collect())


def test_strips_of_sequences_with_a_gap_are_refused(spark):
    chains = spark.createDataFrame([("p", "a", "ACD", 0), ("p", "b", "ACD", 4)], "complex string, chain string, seq string, start long")
    with pytest.raises(Exception, match="do not follow each other"):
        Z.neighbor_counts(Z.strips(chains, 1)).collect()


def test_window_queries_shuffle_no_residues(spark, tmp_path):
    import sys
    sys.path.insert(0, ".")
    from sitelake.plans import QUERIES, load_all
    load_all()
    for name in ("w03_rolling_stats", "w03_wide_window", "w04_rolling_mean_strict", "w05_rolling_entropy", "w06_rolling_class_share", "w07_rolling_moment", "w08_neighbor_letters"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "MapInArrow" in plan


def test_structure_id_has_five_digits_as_in_sql(spark):
    import duckdb
    rows = [(0, ""), (1, "ACD"), (2, "A" * 99_999), (3, "A" * 123_456), (4, None)]
    df = spark.createDataFrame(rows, "i int, s string").select("i", T.structure_id("s").alias("id"))
    con = duckdb.connect()
    con.execute("create table t (i int, s varchar)")
    con.executemany("insert into t values (?, ?)", rows)
    want = dict(con.execute("select i, concat('L', lpad(CAST(length(s) AS VARCHAR), 5, '0'), '_', substr(sha256(s), 1, 16)) from t").fetchall())
    assert {r["i"]: r["id"] for r in df.collect()} == want


def test_positions_are_mapped_where_the_alignment_is(spark):
    rows = [("a", "2M1D1I2M"), ("b", "1Q"), ("c", "3I2X10D1M"), ("d", None), ("e", "0M4="), ("f", "12M"), ("g", "")]
    df = spark.createDataFrame(rows, "chain string, c string").withColumn("ops", T.parse_cigar("c"))
    assert [(r["chain"], r["ops"] is None) for r in df.orderBy("chain").collect()] == [(c, c in "bdg") for c, _ in rows]
    out = T.map_positions(df)
    got = sorted(((r["chain"], r["query_pos"], r["target_pos"]) for r in out.collect()), key=lambda r: r[:2])
    want = []
    for chain, cigar in rows:
        q = t = 0
        for n, op in re.findall(r"(\d+)([MIDX=])", cigar or "") if chain not in "bdg" else []:
            for _ in range(int(n)):
                if op != "I":
                    want.append((chain, q, t if op != "D" else None))
                q, t = q + (op != "I"), t + (op != "D")
    assert got == want
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_alignments_are_parsed_as_a_plain_pattern_does(spark):
    rnd = random.Random(8)
    texts = ["", None, "M", "3", "3M4", "M3", "3MM", "12M0I7D", "9223372036854775807M", "0000000000000000000000005X", "3\u00e9", "4=2X", " 3M", "3M "]
    texts += ["".join(rnd.choice("0123456789MIDX=") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").repartition(3).select("i", T.parse_cigar("c").alias("ops"))
    got = {r["i"]: None if r["ops"] is None else [(o["n"], o["op"]) for o in r["ops"]] for r in df.collect()}
    for i, t in enumerate(texts):
        fits = t is not None and re.fullmatch(r"(\d+[MIDX=])+", t, re.ASCII)
        assert got[i] == ([(int(n), o) for n, o in re.findall(r"(\d+)([MIDX=])", t)] if fits else None), t
