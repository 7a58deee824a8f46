"""Wide frames, odd records and restarts: no row is lost and no failure is silent."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError, running_totals, with_halo
from sitelake.operators import ensemble as E
from sitelake.operators import metrics as M
from sitelake.operators import spatial as X
from sitelake.operators import splits as D
from sitelake.operators import windows as W
from sitelake.plans import registry as Q
from sitelake.session import tune
from sitelake.sources import readers as S
from sitelake.streaming import metrics as T


def test_frame_wider_than_two_blocks(spark):
    df = spark.range(3000).select(F.lit("a").alias("g"), F.col("id").alias("pos"))
    got = with_halo(df, ["g"], "pos", 1000, lambda d, w: d.withColumn("n", F.count("*").over(w.rowsBetween(-1000, 1000))), block=128)
    rows = {r.pos: r.n for r in got.collect()}
    assert rows == {i: min(2999, i + 1000) - max(0, i - 1000) + 1 for i in range(3000)}


def test_window_of_more_rows_than_a_packed_counter_holds(spark):
    n, size = 20_000, 17_001
    df = spark.range(n).select(F.lit("a").alias("complex"), F.col("id").alias("ord"), F.when(F.col("id") % 5 == 0, "C").otherwise("A").alias("aa"))
    at = {r.ord: r[f"win{size}_entropy"] for r in W.rolling_entropy(df, [size]).where(F.col("ord").isin(0, 10_000, n - 1)).collect()}
    for p, got in at.items():
        frame = range(max(0, p - size // 2), min(n, p + size // 2 + 1))
        c = sum(i % 5 == 0 for i in frame) / len(frame)
        assert got == pytest.approx(-(c * math.log(c) + (1 - c) * math.log(1 - c)) / math.log(20), abs=1e-9)


def test_keys_that_cross_splits_fail(spark):
    df = spark.createDataFrame([("k", "1", "train"), ("k", "2", "val"), ("m", "3", "val")], "key string, id string, split string")
    with pytest.raises(DataContractError, match="several splits"):
        D.nonredundant(df, "key", [F.col("split")])
    assert D.nonredundant(df, "key", [F.col("split")], crossing_ok=True)["crossing"].count() == 1


def test_too_many_units_fail():
    with pytest.raises(DataContractError):
        M.mixed_index(F.lit(1), F.lit(1), 1, 2**31)


def atom(serial, name, chain, resseq, x, alt=" "):
    return f"ATOM  {serial:>5} {name:<4}{alt}ALA {chain}{resseq:>4}    {x:8.3f}{x + 1:8.3f}{x + 2:8.3f}  1.00{x:6.2f}"


def test_atoms_with_odd_serials_and_blank_chains(spark, tmp_path):
    lines = [atom("*****", " CA ", "A", 1, 5.0), atom("*****", " CB ", "A", 1, 6.0), atom(7, " CA ", " ", 2, 1.0), atom(8, " CA ", " ", 2, 2.0),
             atom(9, " N  ", "B", 3, 1.0), atom(10, " C  ", "B", 3, 3.0)]
    (tmp_path / "a.pdb").write_text("\n".join(lines))
    got = {(r.chain, r.resseq): (r.atom, r.x, r.y) for r in S.read_atoms(spark, str(tmp_path), "CA").collect()}
    assert got == {("A", 1): ("CA", 5.0, 6.0), ("A", 2): ("CA", 1.0, 2.0), ("B", 3): ("N", 2.0, 3.0)}


def test_profile_rows_are_strict(spark, tmp_path):
    good = " ".join(["1", "A", *["-1.7"] * 20])
    (tmp_path / "p.txt").write_text(f"Query profile of sequence x\n{good}\n")
    ids = spark.createDataFrame([("s", 1)], "seq_id string, ordinal int")
    row = S.read_profile_blocks(spark, str(tmp_path), ids).first()
    assert row.profile == [round(1 / (1 + math.exp(1)), 6)] * 20
    (tmp_path / "p.txt").write_text(f"Query profile of sequence x\n{good[:-5]}\n")
    with pytest.raises(DataContractError):
        S.read_profile_blocks(spark, str(tmp_path), ids)


def test_drain_restarts_without_new_input(spark, tmp_path):
    spark.createDataFrame([("m", 1, 0.7), ("m", 0, 0.2)], "method string, label int, score double").write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("method string, label int, score double").parquet(f"{tmp_path}/in")
        return T.drain(spark, T.streaming_confusion(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()

    assert run() == run()


def test_knn_with_a_far_point_equals_brute_force(spark):
    rnd = random.Random(3)
    points = [(1, i, *(float(rnd.randint(-8, 8)) for _ in "xyz")) for i in range(150)] + [(1, 150, 1e6, 1e6, 1e6), (2, 0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "complex int, pid long, x double, y double, z double")
    got = {}
    for r in X.knn(df, 6).collect():
        got.setdefault((r.complex, r.pid), []).append((r["rank"], r.neighbor))
    for c, i, *p in points:
        near = sorted((math.dist(p, q), j) for d, j, *q in points if d == c and j != i)[:6]
        assert [j for _, j in sorted(got[c, i])] == [j for _, j in near]


def test_structure_headers_of_all_customers_and_more_xml_files(spark):
    """A header for every customer; as many XML parts as shuffle partitions ask for."""
    import glob

    from sitelake.core import shared_dir
    from sitelake.plans import QUERIES, load_all

    load_all()
    sf, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.shuffle.partitions")
    names = [r.c_name.lower() for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    got = QUERIES["s06_all_headers"](spark, sf).collect()
    assert sorted(r["desc"].split(" of ")[1] for r in got) == sorted(names)
    molecules = {(r.chain, r.molecule): r.n for r in QUERIES["s06_all_molecules"](spark, sf).collect()}
    assert molecules[("A", "kinase")] == molecules[("B", "kinase")] == len(names) == sum(n for (c, _), n in molecules.items() if c == "C")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        QUERIES["s07_xml_chains"](spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = shared_dir(spark).removeprefix("file:")
    assert max(len(glob.glob(f"{p}/part=*")) for p in glob.glob(f"{root}/sitelake/*/xml-*")) > 8


def test_rounds_of_components_are_deleted(spark):
    """A long chain takes many rounds; only the last table is left, and the result can still be read."""
    import glob

    from sitelake.core import discard, durable, shared_dir
    from sitelake.operators import graph as G

    root = shared_dir(spark).removeprefix("file:")
    tables = lambda: set(glob.glob(f"{root}/sitelake/{spark.sparkContext.applicationId}/links-*"))
    before = tables()
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = G.connected_components(spark.range(301).withColumnRenamed("id", "complex"), links)
    assert len(tables() - before) == 1
    assert {r.component for r in out.collect()} == {0}
    kept = durable(links, "links")
    discard(kept)
    with pytest.raises(DataContractError):
        discard(links)


def _stages(spark, run):
    """The ended stages of the jobs of ``run``, with their metrics."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def ended():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [s for s in (found.apply(i) for i in range(found.size())) if s.status().toString() == "COMPLETE"]

    before = max((s.stageId() for s in ended()), default=-1)
    run()
    time.sleep(1)
    return [s for s in ended() if s.stageId() > before]


def test_knn_shuffles_the_copies_of_sites(spark, tmp_path):
    """Finding of round 3: the 27 copies of all sites were broadcast and one task per file sorted all pairs."""
    rng = random.Random(5)
    rows = [(i // 100, i, rng.gauss(0, 9), rng.gauss(0, 9), rng.gauss(0, 9)) for i in range(4000)]
    spark.createDataFrame(rows, "complex long, pid long, x double, y double, z double").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    stages = _stages(spark, lambda: X.knn(df, 10).write.format("noop").mode("overwrite").save())
    assert max(s.shuffleReadRecords() for s in stages) >= 27 * 4000


def test_registered_queries_take_narrow_rows_in_small_parts(spark):
    """Finding of round 3: partitions of 64 MB and splits of 128 MB spilled in every sort and hash map of narrow rows."""
    merge, scan = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    tune(spark)
    usual = spark.conf.get(merge), spark.conf.get(scan)
    try:
        spark.conf.set(scan, "4m")  # a session's own smaller value stays
        Q.load_all()
        Q.QUERIES["a17_value_counts"](spark, "/root/testdata/sf0.001")
        assert (spark.conf.get(merge), spark.conf.get(scan)) == ("8388608b", "4m")
        spark.conf.set(scan, "32m")
        Q.QUERIES["a17_value_counts"](spark, "/root/testdata/sf0.001")
        assert (spark.conf.get(merge), spark.conf.get(scan)) == ("8388608b", "16777216b")
        tune(spark)
        assert (spark.conf.get(merge), spark.conf.get(scan)) == (usual[0], "32m")
    finally:
        tune(spark)
        spark.conf.set(scan, usual[1])


def test_alpha_sweep_deals_the_pairs_of_one_file(spark, tmp_path):
    """Finding of round 3: a task made a row per alpha of a whole file and kept all of them in one hash map."""
    rows = spark.range(40_000).select((F.col("id") % 7).alias("chain"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                      (F.col("id") % 22 / 25 + 0.05).alias("left"), (F.pmod(F.hash("id"), F.lit(9973)) / 10000 + 0.001).alias("right"))
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    pairs = spark.read.parquet(str(tmp_path / "p"))
    alphas = [0.0, 0.3, 0.5, 1.0]
    got = {}
    stages = _stages(spark, lambda: got.update({r.alpha: r for r in E.alpha_sweep(pairs, alphas).collect()}))
    read = [s.shuffleWriteRecords() for s in stages if s.inputRecords() == 40_000]
    assert read and max(read) <= 40_000
    for a, r in got.items():
        one = E.blended(pairs, [a])
        want = M.average_precision(one, ["alpha"]).first().average_precision, M.chain_macro_ap(one, ["alpha"]).first().chain_ap_macro
        assert (r.average_precision, r.chain_ap_macro) == pytest.approx(want, abs=1e-12)
    assert sorted(got) == alphas


def test_running_totals_write_only_what_is_kept(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"), F.hash("id").cast("string").alias("wide"), F.col("id").alias("v"))
    got = running_totals(df, by=["g"], order=["o", "wide"], sums={"total": "v"}, rank="rn", keep=["v"])
    assert got.columns == ["v", "total", "rn"]
    want = {(r.v, r.total, r.rn) for r in running_totals(df, by=["g"], order=["o", "wide"], sums={"total": "v"}, rank="rn").collect()}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in plan and "o#" not in plan.replace("__o", "")
