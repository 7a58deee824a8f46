"""Source and sink queries.

The text, JSON and XML files are written by Spark from the given tables, in full,
and read back by the source under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelake.core import rounded as R
from sitelake.core import shared_dir
from sitelake.functions.residue import field
from sitelake.operators.metrics import status_summary
from sitelake.plans import fixtures as fx
from sitelake.plans.joins_q import QC_SQL, qc_table
from sitelake.plans.metrics_q import COVERAGE_SQL, complex_labels
from sitelake.plans.registry import query
from sitelake.plans.windows_q import TABLE_SQL
from sitelake.sources import readers as S
from sitelake.sources import writers as K


def folder(spark, name):
    return f"{shared_dir(spark)}/sitelake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def text_files(df, name):
    path = folder(df.sparkSession, name)
    df.write.text(path)
    return path


@query("s01_read_residues", f"WITH {fx.SCORED_SQL} SELECT CAST(chain AS VARCHAR) AS seq_id, count(*) AS n, sum(position)::BIGINT AS positions, round(sum(s2), 4) AS total FROM scored GROUP BY 1")
def _(spark, sf):
    path = folder(spark, "residues")
    rows = fx.scored(spark, sf).select(F.col("chain").alias("seq_id"), "position", F.lit("A").alias("residue"), F.col("s2").alias("score"), F.lit("m").alias("method"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    back = S.read_residues(spark, path)
    return back.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"), R(F.sum("score"), 4).alias("total"))


@query("s02_read_ids", "SELECT DISTINCT lower(c_mktsegment) AS id FROM customer")
def _(spark, sf):
    lines = fx.table(spark, sf, "customer").select(F.concat(F.lit("  "), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# "), "c_name")).otherwise(F.col("c_mktsegment")), F.lit(" ")).alias("value"))
    return S.read_ids(spark, text_files(lines.unionByName(lines.limit(1).select(F.lit("   ").alias("value"))), "ids"))


@query("s03_s04_fasta_round_trip", f"WITH {fx.CHAINS_SQL} SELECT concat('doc', chain) AS seq_id, length(seq) AS n, sha1(seq) AS seq_sha1 FROM chains")
def _(spark, sf):
    path = folder(spark, "fasta")
    K.write_fasta(fx.chains(spark, sf).select(F.concat(F.lit("doc"), "chain").alias("seq_id"), "seq"), path)
    return S.read_fasta(spark, path).select("seq_id", F.length("seq").alias("n"), F.sha1("seq").alias("seq_sha1"))


@query("s04_fasta_lines", f"WITH {fx.CHAINS_SQL} SELECT chain, greatest(1, ceil(length(seq) / 80.0::DOUBLE))::BIGINT AS n_lines, least(80, length(seq)) AS first_line FROM chains")
def _(spark, sf):
    rows = fx.chains(spark, sf)
    lines = K.fasta_lines(rows, seq_id="chain").select(F.split("value", "\n").alias("l"))
    return lines.select(F.substring(F.col("l")[0], 2, 20).cast("long").alias("chain"), (F.size("l") - 1).cast("long").alias("n_lines"), F.length(F.col("l")[1]).alias("first_line"))


def atom_line(alt, serial, shift=0.0, b=None):
    pad = lambda c, n: F.lpad(c.cast("string"), n, " ")
    num = lambda c: F.lpad(F.format_string("%.3f", c), 8, " ")
    return F.concat(
        F.lit("ATOM  "), pad(serial, 5), F.lit(" "), F.rpad("atom", 4, " "), alt, F.lit("ALA"), F.lit(" "), F.substring(F.lit("ABCDEFGHIJ"), F.col("chain") + 1, F.lit(1)),
        pad(F.col("pos"), 4), F.lit("    "), num(F.col("x") + shift), num(F.col("y")), num(F.col("z")), F.lit("  1.00"), F.lpad(F.format_string("%.2f", F.abs("x") if b is None else b), 6, " ")).alias("value")


def atom_files(spark, sf):
    """CA rows read from a file per complex; copies behind the first and at location B must be ignored."""
    atoms = fx.atoms(spark, sf)
    serial = F.col("ordinal") * 10
    row = lambda k, df: df.select("complex", "pos", "ordinal", F.lit(k).alias("k"), F.col("value"))
    ca = atoms.where("atom = 'CA'")
    # The order of the file decides: the copies behind the first CA have smaller serials, or none.
    b = F.col("pos") % 50 + F.col("ordinal") * 0.25
    lines = row(0, atoms.withColumn("value", atom_line(F.lit(" "), serial + 500, b=b))).unionByName(
        row(1, ca.withColumn("value", atom_line(F.lit("A"), F.lit("*****"), 100.0, b + 7)))).unionByName(
        row(2, ca.withColumn("value", atom_line(F.lit("B"), F.lit(1)))))
    path = folder(spark, "atoms")
    lines.repartition("complex").sortWithinPartitions("complex", "pos", "k", "ordinal").select("complex", "value").write.partitionBy("complex").text(path)
    return S.read_atoms(spark, f"{path}/complex=*", "CA")


@query("s05_first_atoms", f"""
WITH {fx.ATOMS_SQL}, a AS (SELECT complex, chain, pos, atom, ordinal, x, unnest(CASE WHEN atom = 'CA' THEN [0, 7] ELSE [0] END) AS shift FROM atoms),
r AS (SELECT complex, substr('ABCDEFGHIJ', CAST(chain + 1 AS INTEGER), 1) AS chain, pos, avg(pos % 50 + ordinal * 0.25::DOUBLE + shift) AS mean_b, any_value(round(x, 3)) FILTER (atom = 'CA' AND shift = 0) AS x FROM a GROUP BY ALL)
SELECT chain, CAST(pos AS INTEGER) AS resseq, count(*) AS n, round(sum(x), 2) + 0.0 AS x, round(sum(mean_b), 4) AS mean_b FROM r GROUP BY ALL""")
def _(spark, sf):
    return atom_files(spark, sf).groupBy("chain", "resseq").agg(F.count("*").alias("n"), R(F.sum("x"), 2).alias("x"), R(F.sum("mean_b"), 4).alias("mean_b"))


@query("s05_read_atoms", f"""
WITH {fx.ATOMS_SQL} SELECT substr('ABCDEFGHIJ', CAST(chain + 1 AS INTEGER), 1) AS chain, CAST(pos AS INTEGER) AS resseq, count(*) AS n, round(sum(round(x, 3)), 2) + 0.0 AS x FROM atoms WHERE atom = 'CA' GROUP BY ALL""")
def _(spark, sf):
    atoms = fx.atoms(spark, sf)
    serial = F.col("ordinal") * 10
    # per complex a folder: a second CA with a later serial and one at location B must both be ignored
    lines = atoms.select("complex", atom_line(F.lit(" "), serial)).unionByName(
        atoms.where("atom = 'CA'").select("complex", atom_line(F.lit("A"), serial + 500))).unionByName(
        atoms.where("atom = 'CA'").select("complex", atom_line(F.lit("B"), F.lit(1)))).unionByName(
        atoms.select("complex", F.lit("HETATM    1  CA  HOH A   1").alias("value")))
    path = folder(spark, "atoms")
    # one file per complex: the file is part of a residue's key
    lines.repartition("complex").write.partitionBy("complex").text(path)
    ca = S.read_atoms(spark, f"{path}/complex=*", "CA")
    return ca.groupBy("chain", "resseq").agg(F.count("*").alias("n"), R(F.sum("x"), 2).alias("x"))


def header_text():
    kind = F.when(F.col("c_nationkey") < 8, "X-RAY DIFFRACTION").when(F.col("c_nationkey") < 16, "").otherwise("SOLUTION NMR")
    title = F.when(F.col("c_nationkey") < 12, "CRYO-EM STUDY").otherwise("CRYSTAL   STUDY")
    return F.concat(
        F.rpad(F.concat(F.lit("HEADER    "), "c_mktsegment"), 50, " "), F.lit("01-JAN-00\n"), F.lit("TITLE     "), title, F.lit("\nTITLE    2 OF "), "c_name",
        F.lit("\nCOMPND    MOL_ID: 1;\nCOMPND   2 MOLECULE: KINASE;\nCOMPND   3 CHAIN: A, B;\nCOMPND   4 MOL_ID: 2;\nCOMPND   5 MOLECULE: PART "), F.col("c_nationkey").cast("string"),
        F.lit(";\nCOMPND   6 CHAIN: C\nEXPDTA    "), kind, F.lit("\nREMARK   2 RESOLUTION.    "), F.format_string("%.2f", F.col("c_nationkey") / 5 + 1), F.lit(" ANGSTROMS.\n"))


def header_files(spark, sf):
    c = fx.table(spark, sf, "customer")
    path = folder(spark, "headers")
    # one file per nation: headers of many structures, each file one record
    one = c.groupBy("c_nationkey").agg(F.min("c_mktsegment").alias("c_mktsegment"), F.min("c_name").alias("c_name"))
    one.select("c_nationkey", header_text().alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return S.read_structure_headers(spark, f"{path}/*")


@query("s06_structure_headers", """
WITH o AS (SELECT c_nationkey, min(c_mktsegment) AS seg, min(c_name) AS name FROM customer GROUP BY 1)
SELECT lower(seg) AS head, concat(CASE WHEN c_nationkey < 12 THEN 'cryo-em study' ELSE 'crystal study' END, ' of ', lower(name)) AS "desc",
  CASE WHEN c_nationkey < 8 THEN 'x-ray diffraction' WHEN c_nationkey >= 16 THEN 'solution nmr' WHEN c_nationkey < 12 THEN 'electron microscopy' ELSE '' END AS met, c_nationkey / 5 + 1 AS rez FROM o""")
def _(spark, sf):
    return header_files(spark, sf)[0].select("head", "desc", "met", R("rez", 2).alias("rez"))


@query("s06_structure_molecules", """
SELECT chain, CASE WHEN chain = 'C' THEN concat('part ', c_nationkey) ELSE 'kinase' END AS molecule, count(*) AS n
FROM (SELECT DISTINCT c_nationkey FROM customer), (VALUES ('A'), ('B'), ('C')) v(chain) GROUP BY ALL""")
def _(spark, sf):
    return header_files(spark, sf)[1].groupBy("chain", "molecule").agg(F.count("*").alias("n"))


def header_records(spark, sf):
    """A record for every customer, many to a file."""
    path = folder(spark, "records")
    fx.table(spark, sf, "customer").repartition("c_custkey").select(F.concat(header_text(), F.lit("END")).alias("value")).write.text(path)
    return S.read_structure_headers(spark, path, many=True)


@query("s06_all_headers", """
SELECT lower(c_mktsegment) AS head, concat(CASE WHEN c_nationkey < 12 THEN 'cryo-em study' ELSE 'crystal study' END, ' of ', lower(c_name)) AS "desc",
  CASE WHEN c_nationkey < 8 THEN 'x-ray diffraction' WHEN c_nationkey >= 16 THEN 'solution nmr' WHEN c_nationkey < 12 THEN 'electron microscopy' ELSE '' END AS met, c_nationkey / 5 + 1 AS rez FROM customer""")
def _(spark, sf):
    return header_records(spark, sf)[0].select("head", "desc", "met", R("rez", 2).alias("rez"))


@query("s06_all_molecules", """
SELECT chain, CASE WHEN chain = 'C' THEN concat('part ', c_nationkey) ELSE 'kinase' END AS molecule, count(*) AS n
FROM customer, (VALUES ('A'), ('B'), ('C')) v(chain) GROUP BY ALL""")
def _(spark, sf):
    return header_records(spark, sf)[1].groupBy("chain", "molecule").agg(F.count("*").alias("n"))


@query("s07_xml_chains", f"WITH {fx.CHAINS_SQL} SELECT concat('C', chain) AS chain, chain % 9 AS num_tm, complex AS type, length(seq) AS n, sha1(seq) AS seq_sha1 FROM chains")
def _(spark, sf):
    c = fx.chains(spark, sf)
    text = F.concat(F.lit('<p:CHAIN CHAINID="C'), F.col("chain").cast("string"), F.lit('" NUM_TM="'), (F.col("chain") % 9).cast("string"), F.lit('" TYPE="'), "complex",
                    F.lit('"><p:SEQ> '), F.regexp_replace("seq", "(.{60})", "$1 "), F.lit("</p:SEQ></p:CHAIN>"))
    part = F.pmod(F.hash("chain"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("part")
    body = c.select(part, F.lit(1).alias("o"), text.alias("value"))
    parts = body.select("part").distinct()
    lines = body.unionByName(parts.select("part", F.lit(0).alias("o"), F.lit('<p:SET xmlns:p="http://x.org">').alias("value"))).unionByName(
        parts.select("part", F.lit(2).alias("o"), F.lit("</p:SET>").alias("value")))
    path = folder(spark, "xml")
    lines.repartition("part").sortWithinPartitions("part", "o").select("part", "value").write.partitionBy("part").text(path)
    rows = S.read_xml_chains(spark, f"{path}/*")
    return rows.select("chain", F.col("num_tm").cast("long").alias("num_tm"), "type", F.length("seq").alias("n"), F.sha1("seq").alias("seq_sha1"))


def cluster_files(spark, sf):
    part = fx.table(spark, sf, "part")
    lines = part.where("p_size > 10").select(F.concat(F.col("p_brand"), F.lit(" \t"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("value"))
    known = part.where("p_size < 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("seq_id"))
    return S.read_clusters(spark, text_files(lines, "clusters"), known)


@query("s08_read_clusters", "SELECT concat('P', p_partkey) AS seq_id, CASE WHEN p_size > 10 THEN p_brand ELSE concat('P', p_partkey) END AS cluster FROM part WHERE p_size < 40")
def _(spark, sf):
    return cluster_files(spark, sf)[0]


@query("s08_unknown_members", "SELECT count(*) AS n_unknown FROM part WHERE p_size > 10 AND NOT p_size < 40")
def _(spark, sf):
    return cluster_files(spark, sf)[1]


@query("s09_read_pair_hits", """
SELECT CAST(l_partkey AS VARCHAR) AS query, CAST(l_suppkey AS VARCHAR) AS target, round(CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END, 6) AS pident, l_linenumber AS alnlen, count(*) AS n
FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'O' GROUP BY ALL""")
def _(spark, sf):
    line = fx.table(spark, sf, "lineitem")
    bad = F.when(F.col("l_linestatus") == "O", "n/a").otherwise("0.5")
    text = F.concat_ws("\t", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", F.lit("0.9"), bad)
    lines = line.select(F.when(F.col("l_returnflag") == "A", F.concat_ws("\t", "l_partkey", "l_suppkey")).otherwise(text).alias("value"))
    return S.read_pair_hits(spark, text_files(lines, "hits")).groupBy("query", "target", R("pident").alias("pident"), "alnlen").agg(F.count("*").alias("n"))


def profiles(spark, sf):
    vec = fx.table(spark, sf, "embeddings")
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("string"))
    line = lambda r: F.concat(F.lit(f"{r + 1} A "), F.array_join(F.slice(ints, r * 20 + 1, 20), " "))
    block = F.concat(F.lit(S.PROFILE_MARK + " x\n  A C D\n"), line(0), F.lit("\n"), line(1), F.lit("\n"), line(2), F.lit("\n"))
    # one file per hundred vectors; a file's blocks follow its ids
    grouped = vec.select(F.floor(F.col("vec_id") / 100).alias("g"), "vec_id", block.alias("value"))
    path = folder(spark, "profiles")
    grouped.repartition("g").sortWithinPartitions("g", "vec_id").select("g", "value").write.partitionBy("g").text(path)
    ids = grouped.select("g", F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("seq_id"), (F.col("vec_id") - F.col("g") * 100 + 1).cast("int").alias("ordinal"))
    return S.read_profile_blocks(spark, f"{path}/*", ids.join(file_names(spark, path, "g"), "g").drop("g"))


@query("s10_profile_blocks", """
WITH v AS (SELECT vec_id, unnest(range(0, 3)) AS r, embedding AS e FROM embeddings)
SELECT concat('V', vec_id) AS seq_id, CAST(r + 1 AS INTEGER) AS position, round(1 / (1 + exp(-CAST(floor(CAST(e[r * 20 + 1] AS DOUBLE) * 10) AS DOUBLE))), 6) AS first_value,
  round(1 / (1 + exp(-CAST(floor(CAST(e[r * 20 + 20] AS DOUBLE) * 10) AS DOUBLE))), 6) AS last_value FROM v""")
def _(spark, sf):
    return profiles(spark, sf).select("seq_id", "position", F.col("profile")[0].alias("first_value"), F.col("profile")[19].alias("last_value"))


@query("s10_profile_values", """
WITH v AS (SELECT vec_id, r, k, CAST(embedding[r * 20 + k + 1] AS DOUBLE) AS x FROM embeddings, range(0, 3) a(r), range(0, 20) b(k))
SELECT concat('V', vec_id) AS seq_id, CAST(r + 1 AS INTEGER) AS position, 'A' AS aa, CAST(k AS INTEGER) AS k, round(1 / (1 + exp(-floor(x * 10))), 6) AS value FROM v""")
def _(spark, sf):
    """All twenty values of every row."""
    return profiles(spark, sf).select("seq_id", "position", "aa", F.posexplode("profile").alias("k", "value"))


def file_names(spark, path, part):
    """The file of each partition folder."""
    files = spark.read.format("binaryFile").load(f"{path}/*").select(F.col("path").alias("file"))
    return files.withColumn(part, F.regexp_extract("file", rf"{part}=(\d+)", 1).cast("long"))


@query("s11_aliases", f"""
WITH {fx.RESIDUES_SQL}, {TABLE_SQL}, v AS (SELECT r.aa, greatest(0, least(1, pos / 1000.0::DOUBLE - 0.1)) * coalesce(max_area, 200) AS asa FROM residues r LEFT JOIN tab t ON t.aa = r.aa)
SELECT aa, count(*) AS n, round(avg(asa), 6) AS asa FROM v GROUP BY aa""")
def _(spark, sf):
    raw = fx.residues(spark, sf).select(F.col("aa").alias("Residue"), (F.col("pos") / 1000 - 0.1).alias("RSA"))
    df = S.read_with_aliases(raw, {"seq": ["aa", "residue"], "rsa": ["rel_acc", "rsa"]}, ignore_case=True)
    area = df.select(F.col("seq").alias("aa"), S.absolute_area("rsa", "seq", field("max_area")).alias("asa"))
    return area.groupBy("aa").agg(F.count("*").alias("n"), R(F.avg("asa")).alias("asa"))


def vectors(spark, sf):
    """``(complex, pos, aa, vector)`` read back from a file of lines per complex."""
    pts = fx.placed_points(spark, sf).select("pid", "complex", "pos", "aa")
    vec = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), F.array_join(F.transform("embedding", lambda v: F.format_string("%.6f", v.cast("double"))), " ").alias("v"))
    rows = pts.join(vec, "pid").select("complex", "pos", F.concat("aa", F.lit(": "), "v").alias("value"))
    path = folder(spark, "vectors")
    rows.repartition("complex").sortWithinPartitions("complex", "pos").select("complex", "value").write.partitionBy("complex").text(path)
    files = file_names(spark, path, "complex")
    seqs = pts.groupBy("complex").agg(F.sort_array(F.collect_list(F.struct("pos", "aa"))).alias("c")).select("complex", F.array_join(F.transform("c", lambda s: s["aa"]), "").alias("seq"))
    return S.read_vectors(spark, f"{path}/*", 64, files.join(seqs, "complex").select("file", "seq")).join(files, "file")


@query("s12_read_vectors", """
SELECT CAST(floor(vec_id / 100) AS BIGINT) AS complex, count(*) AS n, round(sum(round(CAST(embedding[1] AS DOUBLE), 6)), 4) + 0.0 AS first_sum, round(sum(round(CAST(embedding[64] AS DOUBLE), 6)), 4) + 0.0 AS last_sum FROM embeddings GROUP BY 1""")
def _(spark, sf):
    return vectors(spark, sf).groupBy("complex").agg(F.count("*").alias("n"), R(F.sum(F.col("vector")[0]), 4).alias("first_sum"), R(F.sum(F.col("vector")[63]), 4).alias("last_sum"))


@query("s12_vector_values", """
SELECT CAST(floor(vec_id / 100) AS BIGINT) AS complex, CAST(vec_id % 100 AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, round(CAST(embedding[k + 1] AS DOUBLE), 6) + 0.0 AS value FROM embeddings, range(0, 64) r(k)""")
def _(spark, sf):
    """All 64 values of every line, in the order of the file."""
    return vectors(spark, sf).select("complex", "pos", F.posexplode("vector").alias("k", "v")).select("complex", "pos", "k", R("v", 6).alias("value"))


def packed(spark, sf):
    return K.pack(fx.scored(spark, sf).select("chain", "position", "label", F.col("s2").alias("score")), block=256)


@query("s13_pack", f"""
WITH {fx.SCORED_SQL}, b AS (SELECT chain, CAST(floor((position - 1) / 256) AS BIGINT) AS block, count(*) AS length, sum(label)::BIGINT AS positives, round(sum(s2), 4) AS total FROM scored GROUP BY ALL)
SELECT *, coalesce(sum(length) OVER (ORDER BY chain, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b""")
def _(spark, sf):
    p = packed(spark, sf)
    total = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v)
    ones = F.aggregate("labels", F.lit(0).cast("long"), lambda a, v: a + v)
    return p.select("chain", "block", F.col("length").cast("long").alias("length"), ones.alias("positives"), R(total, 4).alias("total"), "offset")


@query("s13_unpack", f"WITH {fx.SCORED_SQL} SELECT chain, position, label, s2 AS score FROM scored")
def _(spark, sf):
    return K.unpack(packed(spark, sf), block=256)


@query("s14_read_run_log", "SELECT user_id AS run, count(*) AS n_epochs, round(max(value), 6) AS best FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "done").otherwise("epoch").alias("event"), F.col("user_id").alias("run"), F.struct(F.col("value").alias("ap")).alias("val"))
    path = folder(spark, "log")
    ev.write.json(path)
    epochs, _ = S.read_run_log(spark, path, "event string, run long, val struct<ap: double>")
    return epochs.groupBy("run").agg(F.count("*").alias("n_epochs"), R(F.max("val.ap")).alias("best"))


@query("s15_write_manifest", f"""
WITH {COVERAGE_SQL}, m AS (SELECT complex, CASE WHEN coverage = 0 THEN 'ERROR' WHEN coverage < 0.5 THEN 'SKIP' ELSE 'OK' END AS status FROM cov)
SELECT status, count(*) AS n, array_to_string(list_sort(list(complex) FILTER (rn <= 20)), ';') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY complex) AS rn FROM m) GROUP BY status""")
def _(spark, sf):
    status = F.when(F.col("coverage") == 0, "ERROR").when(F.col("coverage") < 0.5, "SKIP").otherwise("OK")
    path = folder(spark, "manifest")
    K.write_manifest(complex_labels(spark, sf).select("complex", status.alias("status")), path, "complex")
    back = spark.read.option("header", True).schema("complex long, status string").csv(path)
    return status_summary(back, "status", example="complex").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ";"))


@query("s15_manifest_errors", f"""
WITH {COVERAGE_SQL}, m AS (SELECT complex, CASE WHEN coverage = 0 THEN 'ERROR' WHEN coverage < 0.5 THEN 'SKIP' ELSE 'OK' END AS status,
  CASE WHEN coverage = 0 THEN concat('no residue of ', complex) WHEN coverage < 0.5 AND complex % 7 = 0 THEN 'low' END AS error FROM cov),
e AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY complex) AS rn FROM m WHERE error IS NOT NULL)
SELECT status, count(*) AS n, count(error) AS n_errors, any_value(examples) AS examples, any_value(errors) AS errors
FROM m LEFT JOIN (SELECT status, string_agg(complex, ';' ORDER BY complex) AS examples, string_agg(error, ';' ORDER BY complex) AS errors FROM e WHERE rn <= 20 GROUP BY status) USING (status) GROUP BY status""")
def _(spark, sf):
    status = F.when(F.col("coverage") == 0, "ERROR").when(F.col("coverage") < 0.5, "SKIP").otherwise("OK")
    error = F.when(F.col("coverage") == 0, F.concat(F.lit("no residue of "), "complex")).when((F.col("coverage") < 0.5) & (F.col("complex") % 7 == 0), "low")
    path = folder(spark, "manifest")
    rows = complex_labels(spark, sf).select("complex", status.alias("status"), error.alias("error"))
    K.write_manifest(rows.where("complex % 2 = 0"), path, "complex")
    out = K.write_manifest(rows, path, "complex")  # takes the place of the first
    return out.withColumns({"examples": F.array_join(F.col("examples").cast("array<string>"), ";"), "errors": F.array_join("errors", ";")})


@query("s16_metric_views", f"""WITH {QC_SQL}
SELECT prot, chain, concat(prot, '_', chain) AS prot_mark, nchain FROM qc""")
def _(spark, sf):
    df = qc_table(spark, sf).withColumn("prot_mark", F.concat_ws("_", "prot", "chain"))
    path = folder(spark, "metrics")
    K.write_metric_views(df, path)
    return K.read_metric_view(spark, path, "nchain", "prot long, chain long, prot_mark string, nchain long")


@query("s16_all_views", f"""WITH {QC_SQL}, v AS (SELECT *, concat(prot, '_', chain) AS prot_mark FROM qc)
SELECT 'nchain' AS view, prot_mark, CAST(nchain AS VARCHAR) AS value FROM v UNION ALL SELECT 'head', prot_mark, head FROM v
UNION ALL SELECT 'mthm', prot_mark, CAST(mthm AS VARCHAR) FROM v UNION ALL SELECT 'seq', prot_mark, concat(seq, '/', length(seq)) FROM v
UNION ALL SELECT 'desc', prot_mark, concat('d', chain) FROM v UNION ALL SELECT 'met', prot_mark, CASE WHEN chain % 2 = 0 THEN 'em' ELSE 'xray' END FROM v
UNION ALL SELECT 'bio_name', prot_mark, concat('b', prot) FROM v UNION ALL SELECT 'rez', prot_mark, CAST(round(rez * 1000) AS BIGINT)::VARCHAR FROM v""")
def _(spark, sf):
    """All eight tables read back."""
    df = qc_table(spark, sf).withColumns({
        "prot_mark": F.concat_ws("_", "prot", "chain"), "len_seq": F.length("seq"), "desc": F.concat(F.lit("d"), "chain"),
        "met": F.when(F.col("chain") % 2 == 0, "em").otherwise("xray"), "bio_name": F.concat(F.lit("b"), "prot")})
    path = folder(spark, "metrics")
    names = K.write_metric_views(df, path)
    out = None
    for name in names:
        values = K.METRIC_VIEWS[name][3:]
        kinds = {"rez": "double", "nchain": "long", "mthm": "long", "len_seq": "int"}
        back = K.read_metric_view(spark, path, name, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in ["prot", "chain", "prot_mark", *values]))
        value = F.round(F.col("rez") * 1000).cast("long").cast("string") if name == "rez" else F.col(values[0]).cast("string") if len(values) == 1 else F.concat_ws("/", *values)
        part = back.select(F.lit(name).alias("view"), "prot_mark", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s17_file_checksums")
def _(spark, sf):
    return S.file_checksums(spark, sf)


@query("s17_written_files", r"""
WITH f AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, string_agg(concat(o_orderkey, ' ', o_custkey, ' ', o_orderpriority), chr(10) ORDER BY o_orderkey) || chr(10) AS content FROM orders GROUP BY 1)
SELECT concat('part=', part) AS folder, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM f""")
def _(spark, sf):
    """A text file for every month of orders."""
    o = fx.table(spark, sf, "orders")
    lines = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("part"), "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_custkey", "o_orderpriority").alias("value"))
    path = folder(spark, "hashed")
    lines.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    sums = S.file_checksums(spark, path).where(F.col("path").startswith("part="))
    return sums.select(F.substring_index("path", "/", 1).alias("folder"), "bytes", "sha256")


RESOLVE_SQL = """
inv AS (SELECT DISTINCT concat('/a/', page_id, '.pt') AS path FROM pages WHERE contains(url, '/en/') UNION SELECT concat('/b/', page_id, '.pt') FROM pages WHERE contains(url, 'https')
  UNION SELECT '/shared.pt' FROM pages WHERE page_id = 0),
ids AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split FROM documents)"""


def resolved(spark, sf):
    pages = fx.table(spark, sf, "pages")
    at = lambda d: F.concat(F.lit(f"/{d}/"), F.col("page_id").cast("string"), F.lit(".pt")).alias("path")
    inv = pages.where(F.col("url").contains("/en/")).select(at("a")).unionByName(pages.where(F.col("url").contains("https")).select(at("b"))).unionByName(
        pages.where("page_id = 0").select(F.lit("/shared.pt").alias("path")))
    ids = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "train").otherwise("test").alias("split"))
    return S.resolve_resources(ids, inv, ["/a/{id}.pt", "/b/{id}.pt", "/shared.pt"])


@query("s18_resolve_resources", f"""
WITH {RESOLVE_SQL} SELECT id, split, CASE WHEN a.path IS NOT NULL THEN 0 WHEN b.path IS NOT NULL THEN 1 WHEN s.path IS NOT NULL THEN 2 END AS priority, coalesce(a.path, b.path, s.path) AS path
FROM ids LEFT JOIN inv a ON a.path = concat('/a/', id, '.pt') LEFT JOIN inv b ON b.path = concat('/b/', id, '.pt') LEFT JOIN inv s ON s.path = '/shared.pt'""")
def _(spark, sf):
    return resolved(spark, sf)


@query("s18_shared_paths", f"""
WITH {RESOLVE_SQL}, r AS (SELECT id, split FROM ids LEFT JOIN inv a ON a.path = concat('/a/', id, '.pt') LEFT JOIN inv b ON b.path = concat('/b/', id, '.pt') WHERE a.path IS NULL AND b.path IS NULL)
SELECT '/shared.pt' AS path, min(split) AS first_split, max(split) AS last_split, count(*) AS n FROM r HAVING min(split) <> max(split)""")
def _(spark, sf):
    return S.shared_paths(resolved(spark, sf))


