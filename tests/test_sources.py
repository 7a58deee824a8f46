"""Readers on files that are cut into many ranges, odd records, and pieces of large files."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.functions import text as T
from sitelake.operators import joins as J
from sitelake.sources import readers as S
from sitelake.sources import writers as K
from sitelake.sources.lines import read_lines, with_running_counts


@pytest.fixture(params=["64m", "300"])
def ranges(spark, request):
    """Files whole, and cut into ranges of 300 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def atom(serial, name, chain, resseq, x, b, alt=" "):
    return f"ATOM  {serial:>5} {name:<4}{alt}ALA {chain}{resseq:>4}    {x:8.3f}{x + 1:8.3f}{x + 2:8.3f}  1.00{b:6.2f}"


def test_running_counts_follow_the_file(spark, tmp_path, ranges):
    for name in "ab":
        (tmp_path / name).write_text("\n".join(f"{name} {i} {'mark' if i % 7 == 0 else ''}" for i in range(500)) + "\r\n\r\n")
    lines = with_running_counts(read_lines(spark, str(tmp_path)).where("trim(value) <> ''"), n=F.lit(True), marks=F.col("value").contains("mark"))
    assert (lines.select("file", "block").distinct().count() > 10) == (ranges == "300")
    for r in lines.collect():
        i = int(r.value.split()[1])
        assert (r.n, r.marks) == (i + 1, i // 7 + 1)


def test_first_atoms_by_line_order(spark, tmp_path, ranges):
    """Serials of stars and falling coordinates do not decide, the order of the lines does."""
    rows, want = [], {}
    for res in range(1, 60):
        xs = [9.0 - k for k in range(4)]
        rows += [atom("*****", " CB ", "A", res, 50.0, 1.0)] + [atom("*****", " CA ", "A", res, x, 2.0 + k) for k, x in enumerate(xs)]
        want[res] = (9.0, 2.0, (1 + 2 + 3 + 4 + 5) / 5)
    rows += [atom(9, " N  ", "B", 1, 1.0, 10.0), atom(3, " C  ", "B", 1, 3.0, 20.0), "HETATM    1  CA  HOH A   1", atom(1, " CA ", "B", 1, 7.0, 5.0, alt="B")]
    (tmp_path / "x.pdb").write_text("\n".join(rows))
    got = {(r.chain, r.resseq): r for r in S.read_atoms(spark, str(tmp_path), "CA").collect()}
    assert {res: (r.x, r.b, r.mean_b) for (c, res), r in got.items() if c == "A"} == want
    b = got["B", 1]
    assert (b.atom, b.serial, b.x, b.b, b.mean_b) == ("N", 9, 2.0, 15.0, 15.0)


def header(title, k):
    return f"HEADER    KIND {k}\n{'TITLE     ' + title if title else 'REMARK'}\nCOMPND    MOL_ID: 1;\nCOMPND   2 MOLECULE: M{k}; CHAIN: A;\nREMARK   2 RESOLUTION.    2.{k % 10} ANGSTROMS.\nATOM      1\n"


def test_records_end_at_a_line_of_end(spark, tmp_path, ranges):
    """A title that ends in END is no end of a record; a file that does not end in one keeps its last record."""
    titles = ["A NEW TREND", "THE END", "", "ENDING", *[f"T{k}" for k in range(40)]]
    (tmp_path / "many").write_text("END  \n".join(header(t, k) for k, t in enumerate(titles)))
    heads, molecules = S.read_structure_headers(spark, str(tmp_path), many=True)
    got = {int(r.file.rsplit("#", 1)[1]): (r["head"], r.desc, r.rez) for r in heads.collect()}
    assert got == {k: (f"kind {k}", t.lower(), 2 + k % 10 / 10) for k, t in enumerate(titles)}
    assert {(int(r.file.rsplit("#", 1)[1]), r.chain, r.molecule) for r in molecules.collect()} == {(k, "A", f"m{k}") for k in range(len(titles))}


def test_file_records_keep_files_without_a_header(spark, tmp_path, ranges):
    (tmp_path / "a").write_text(header("ONE", 1) * 1 + "ATOM\n" * 200)
    (tmp_path / "b").write_text("ATOM\n" * 200)
    heads = {r.file[-1]: r for r in S.read_structure_headers(spark, str(tmp_path))[0].collect()}
    assert heads["a"].desc == "one" and (heads["b"].desc, heads["b"].rez) == ("", None)


def test_profile_blocks_and_vectors_over_ranges(spark, tmp_path, ranges):
    text, want = "before 1 2\n", []
    for k in range(1, 31):
        text += f"{S.PROFILE_MARK} s{k}\n   A C D\n"
        for pos in (1, 2):
            values = [(k * 3 + pos * j) % 9 - 4 for j in range(20)]
            text += f"{pos} A {' '.join(map(str, values))}\n"
            want.append((f"s{k}", pos, [round(1 / (1 + math.exp(-v)), 6) for v in values]))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x").write_text(text)
    ids = spark.createDataFrame([(f"s{k}", k) for k in range(1, 31)], "seq_id string, ordinal int")
    got = [(r.seq_id, r.position, r.profile) for r in S.read_profile_blocks(spark, f"{tmp_path}/p", ids).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(DataContractError):
        S.read_profile_blocks(spark, f"{tmp_path}/p", ids.where("ordinal <> 30"))
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x").write_text("\n\n".join(f"{'ACD'[i % 3]}: {i}.5 -{i} 3" for i in range(100)) + "\n")
    file = read_lines(spark, f"{tmp_path}/v").first().file
    seq = spark.createDataFrame([(file, "".join("ACD"[i % 3] for i in range(100)))], "file string, seq string")
    rows = S.read_vectors(spark, f"{tmp_path}/v", 3, seq).orderBy("pos").collect()
    assert [(r.pos, r.aa, r.vector) for r in rows] == [(i, "ACD"[i % 3], [i + 0.5, -float(i), 3.0]) for i in range(100)]
    with pytest.raises(DataContractError):
        S.read_vectors(spark, f"{tmp_path}/v", 3, seq.withColumn("seq", F.expr("reverse(seq)")))


def test_checksums_in_pieces(spark, tmp_path):
    """Sizes around the piece, an empty file, odd names, and a file of 3 GB that takes no room on the disk."""
    (tmp_path / "sub dir").mkdir()
    parts = {"a": b"", "b": b"x" * 1000, "c": bytes(range(256)) * 4, "sub dir/d é.gz": b"\x1f\x8bnot really"}
    for name, data in parts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.bytes, r.sha256) for r in S.file_checksums(spark, str(tmp_path), chunk=256).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in parts.items()}
    big, size = tmp_path / "big", 3 << 30
    big.mkdir()
    with (big / "sparse").open("wb") as f:
        f.truncate(size)
    total, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        total.update(zeros)
    assert [tuple(r) for r in S.file_checksums(spark, str(big)).collect()] == [("sparse", size, total.hexdigest())]
    (tmp_path / "none").mkdir()
    assert S.file_checksums(spark, f"{tmp_path}/none").count() == 0


def test_manifest_is_published_whole_or_not_at_all(spark, tmp_path):
    """A failing write leaves the older manifest; examples are those of rows with an error."""
    path = f"{tmp_path}/manifest"
    rows = [(i, "BAD" if i % 3 == 0 else "OK", f"e{i}" if i % 6 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, status string, error string")
    K.write_manifest(df.where("id < 10"), path, "id")
    failing = df.withColumn("id", F.when(F.col("id") == 150, F.raise_error("stop")).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        K.write_manifest(failing, path, "id")
    read = lambda: [r.id for r in spark.read.option("header", True).schema(df.schema).csv(path).collect()]
    assert sorted(read()) == list(range(10))
    got = {r.status: r for r in K.write_manifest(df, path, "id").collect()}
    assert read() == list(range(200)) and [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["manifest"]
    assert (got["BAD"].n, got["BAD"].n_errors, got["BAD"].examples, got["BAD"].errors) == (67, 34, list(range(0, 120, 6)), [f"e{i}" for i in range(0, 120, 6)])
    assert (got["OK"].n, got["OK"].n_errors, got["OK"].examples) == (133, 0, None)


def test_nearest_occurrence_is_that_of_all_occurrences(spark):
    rows = [("aa", "aaaa", w) for w in range(5)] + [("a.b", "xa.ba.b", w) for w in range(7)] + [("z", "abc", 1), ("ab", "ab" * 20_000, 20_001), (r"\E", r"x\Ey\E", 3)]
    df = spark.createDataFrame(rows, "q string, t string, w int")
    for r in df.withColumn("got", T.nearest_occurrence("t", "q", F.col("w"))).collect():
        starts = [i + 1 for i in range(len(r.t)) if r.t.startswith(r.q, i)]
        assert r.got == min(starts, key=lambda s: (abs(s - 1 - r.w), s), default=None), (r.q, r.w)


def test_aligned_scores_come_from_one_join(spark):
    a = spark.createDataFrame([("c", i, i % 2, i / 10) for i in range(10)], "chain string, position int, label int, score double")
    out = J.align_scores([a, a.withColumn("score", F.col("score") * 2), a])
    assert out.columns == ["chain", "position", "label", "score_0", "score_1", "score_2"]
    assert "Join" not in out._jdf.queryExecution().toString()
    assert sorted((r.position, r.score_0, r.score_1) for r in out.collect()) == [(i, i / 10, i / 5) for i in range(10)]
    for wrong in (a.where("position <> 3"), a.withColumn("label", F.when(F.col("position") == 2, 5).otherwise(F.col("label")))):
        with pytest.raises(DataContractError, match="not aligned"):
            J.align_scores([a, wrong])


def test_release_lists_are_bounded(spark):
    bridge = spark.createDataFrame([("c", "OK", True, f"P{i:03}") for i in range(300)] * 2 + [("d", "FAIL", False, "X")], "complex string, status string, strict boolean, accession string")
    keys = spark.createDataFrame([("c", "train"), ("d", "val")], "complex string, split string")
    labels = keys.select("complex", F.lit(3).alias("n_positive"))
    rows = {r.complex: r for r in J.release_table(keys, labels, keys.select("complex", F.lit("OK").alias("feature_status")), bridge, listed=5).collect()}
    assert (rows["c"].accessions, rows["c"].n_accessions, rows["c"].bridge_n_chains) == ("P000;P001;P002;P003;P004", 300, 600)
    assert rows["c"].accession_sum == sum(int(hashlib.md5(f"P{i:03}".encode()).hexdigest()[:8], 16) for i in range(300))
    assert (rows["d"].accessions, rows["d"].n_accessions, rows["d"].usable) == ("", 0, True)
    assert J.release_accessions(bridge).count() == 300
