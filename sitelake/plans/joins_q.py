"""Join queries (J01-J09, J13-J22); the distance joins J10-J12 are in ``spatial_q``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.core import rounded as R
from sitelake.operators import joins as J
from sitelake.plans import fixtures as fx
from sitelake.plans.metrics_q import COVERAGE_SQL, complex_labels, round_all
from sitelake.plans.registry import query

LETTER = fx.LETTERS


def letter(col):
    return F.substring(F.lit(LETTER), (F.pmod(col, F.lit(20)) + 1).cast("int"), F.lit(1))


def labels_and_scores(spark, sf):
    """Labels of every chain; scores for chains shifted by three, with some letters disagreeing."""
    s = fx.scored(spark, sf)
    labels = s.select(F.col("chain").alias("seq_id"), "position", letter(F.col("position")).alias("residue"), "label")
    scores = s.select((F.col("chain") - 3).alias("seq_id"), "position",
                      letter(F.col("position") + (F.col("s2") > 0.75).cast("int")).alias("residue"), F.col("s2").alias("score"))
    return labels, scores


LABELS_SCORES_SQL = f"""{fx.SCORED_SQL},
labels_t AS (SELECT chain AS seq_id, position, substr('{LETTER}', position % 20 + 1, 1) AS residue, label FROM scored),
scores_t AS (SELECT chain - 3 AS seq_id, position, substr('{LETTER}', (position + (s2 > 0.75)::INT) % 20 + 1, 1) AS residue,
  s2 AS score FROM scored)"""


@query("j01_label_score_join", f"""
WITH {LABELS_SCORES_SQL}
SELECT seq_id, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(score), 6) AS mean_score
FROM labels_t JOIN scores_t USING (seq_id, position) WHERE labels_t.residue = scores_t.residue GROUP BY seq_id""")
def _(spark, sf):
    joined, _, _ = J.label_score_join(*labels_and_scores(spark, sf))
    return joined.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), R(F.avg("score")).alias("mean_score"))


@query("j01_residue_mismatches", f"""
WITH {LABELS_SCORES_SQL}
SELECT seq_id, position, labels_t.residue AS label_residue, scores_t.residue AS score_residue
FROM labels_t JOIN scores_t USING (seq_id, position) WHERE labels_t.residue <> scores_t.residue""")
def _(spark, sf):
    return J.label_score_join(*labels_and_scores(spark, sf))[1]


@query("j01_missing_chains", f"WITH {LABELS_SCORES_SQL} SELECT DISTINCT seq_id FROM labels_t WHERE seq_id NOT IN (SELECT seq_id FROM scores_t)")
def _(spark, sf):
    return J.label_score_join(*labels_and_scores(spark, sf))[2]


def qc_orders(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    allow = fx.table(spark, sf, "customer").where("c_acctbal > 0")
    return J.allowlist(orders, allow, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("j02_allowlist_kept", """
SELECT o_orderkey, c_custkey, o_orderstatus, c_mktsegment AS qc_c_mktsegment, c_nationkey AS qc_c_nationkey
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def _(spark, sf):
    return qc_orders(spark, sf)[0].select("o_orderkey", "c_custkey", "o_orderstatus", "qc_c_mktsegment", "qc_c_nationkey")


@query("j02_allowlist_dropped", """
SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, sf):
    return qc_orders(spark, sf)[1].select("o_orderkey", "c_custkey")


@query("j03_retain_chains", """
WITH qc AS (SELECT l_orderkey AS seq_id, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2),
sp AS (SELECT c_custkey AS complex, CASE WHEN c_mktsegment = 'BUILDING' THEN 'val' ELSE 'train' END AS split
       FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT o_orderkey AS seq_id, o_custkey AS complex, split, n_lines,
  CASE WHEN split IS NULL THEN 'complex_not_in_split' WHEN n_lines IS NULL THEN 'chain_not_in_qc' END AS reason
FROM orders LEFT JOIN sp ON o_custkey = sp.complex LEFT JOIN qc ON o_orderkey = qc.seq_id""")
def _(spark, sf):
    chains = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("complex"))
    qc = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq_id")).agg(F.count("*").alias("n_lines")).where("n_lines >= 2")
    split = fx.table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("complex"), F.when(F.col("c_mktsegment") == "BUILDING", "val").otherwise("train").alias("split"))
    return J.retain_chains(chains, split, qc)


def qc_table(spark, sf):
    chains = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("prot"), F.col("o_orderkey").alias("chain"), F.col("o_orderstatus").alias("seq"))
    headers = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("prot"), F.col("c_mktsegment").alias("head"), (F.col("c_acctbal") / 1000).alias("rez"))
    xml = (
        fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("prot"), F.col("o_orderkey").alias("chain"))
        .join(fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), "l_linestatus", "l_linenumber"), "chain")
        .groupBy("prot", "chain").agg(F.min("l_linestatus").alias("xml_seq"), F.max("l_linenumber").alias("mthm"))
    )
    return J.integrate_qc(chains, headers, xml)


QC_SQL = """
qc AS (SELECT o_custkey AS prot, o_orderkey AS chain, o_orderstatus AS seq, c_mktsegment AS head, c_acctbal / 1000 AS rez, xml_seq, mthm,
  count(*) OVER (PARTITION BY o_custkey) AS nchain, coalesce(o_orderstatus = xml_seq, false) AS seq_equal_xml
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS xml_seq, max(l_linenumber) AS mthm FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@query("j04_integrate_qc", f"WITH {QC_SQL} SELECT * FROM qc")
def _(spark, sf):
    return qc_table(spark, sf)


def hit_tables(spark, sf):
    """Line items as pair hits between part chains and supplier chains that share one id space."""
    hits = fx.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("target"),
        (1 - F.abs("l_discount") * 8).alias("pident"), F.col("l_quantity").cast("int").alias("alnlen"),
        (1 - F.abs("l_tax")).alias("qcov"), (F.col("l_extendedprice") / (F.col("l_extendedprice") + 5000)).alias("tcov"))
    membership = fx.table(spark, sf, "part").where("p_size > 5").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 40, "test").when(F.col("p_size") > 30, "val").otherwise("train").alias("split"))
    return hits, membership


HITS_SQL = """
hits AS (SELECT l_partkey AS query, l_suppkey AS target, 1 - abs(l_discount) * 8 AS pident, CAST(l_quantity AS INTEGER) AS alnlen,
  1 - abs(l_tax) AS qcov, l_extendedprice / (l_extendedprice + 5000) AS tcov FROM lineitem),
member AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'test' WHEN p_size > 30 THEN 'val' ELSE 'train' END AS split
  FROM part WHERE p_size > 5),
tagged AS (SELECT hits.*, q.split AS qs, t.split AS ts FROM hits LEFT JOIN member q ON query = q.id LEFT JOIN member t ON target = t.id
  WHERE pident >= 0.3 AND alnlen >= 10 AND qcov >= 0.5 AND tcov >= 0.5)"""


@query("j05_audit_hits", f"""
WITH {HITS_SQL}
SELECT CASE WHEN qs IS NULL OR ts IS NULL THEN 'missing' WHEN qs = ts THEN 'same'
  ELSE concat(least(qs, ts), '__', greatest(qs, ts)) END AS outcome, count(*) AS n_hits, round(max(pident), 6) AS max_pident
FROM tagged GROUP BY ALL""")
def _(spark, sf):
    return round_all(J.audit_hits(*hit_tables(spark, sf), min_id=0.3, coverage=0.5, min_len=10))


def identity_tables(spark, sf):
    """Customers as the dimension; orders name them exactly, by pair, with other case, or not at all."""
    third = F.floor(F.col("c_custkey") / 3).cast("string")
    side = F.when(F.col("c_custkey") % 3 == 0, "a").when(F.col("c_custkey") % 3 == 1, "A").otherwise("b")
    cust = fx.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("seq_id"),
        F.concat(F.lit("P"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("pdb_id"), F.concat(side, third).alias("chain_id"))
    named = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("c_custkey")).join(cust, "c_custkey")
    p = F.substring("o_orderpriority", 1, 1)
    none = F.lit("none")
    return named.select(
        "o_orderkey",
        F.when(p == "1", F.col("seq_id")).when(p == "3", F.upper("seq_id")).otherwise(none).alias("seq_id"),
        F.when(p.isin("2", "4"), F.col("pdb_id")).otherwise(none).alias("pdb_id"),
        F.when(p == "2", F.col("chain_id")).when(p == "4", F.upper("chain_id")).otherwise(none).alias("chain_id"),
    ), cust


IDENTITY_SQL = """
cust AS (SELECT c_custkey, c_name AS seq_id, concat('P', CAST(floor(c_custkey / 10) AS BIGINT)) AS pdb_id,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'A' ELSE 'b' END, CAST(floor(c_custkey / 3) AS BIGINT)) AS chain_id FROM customer),
named AS (SELECT o_orderkey, left(o_orderpriority, 1) AS p, cust.* FROM orders JOIN cust ON o_custkey = c_custkey),
asked AS (SELECT o_orderkey, CASE p WHEN '1' THEN seq_id WHEN '3' THEN upper(seq_id) ELSE 'none' END AS seq_id,
  CASE WHEN p IN ('2', '4') THEN pdb_id ELSE 'none' END AS pdb_id,
  CASE p WHEN '2' THEN chain_id WHEN '4' THEN upper(chain_id) ELSE 'none' END AS chain_id FROM named),
k1 AS (SELECT seq_id, min(c_custkey) AS v FROM cust GROUP BY 1),
k2 AS (SELECT lower(pdb_id) AS p, chain_id AS c, min(c_custkey) AS v FROM cust GROUP BY ALL),
k3 AS (SELECT lower(seq_id) AS s, min(c_custkey) AS v FROM cust GROUP BY 1 HAVING count(*) = 1),
k4 AS (SELECT lower(pdb_id) AS p, lower(chain_id) AS c, min(c_custkey) AS v FROM cust GROUP BY 1, 2 HAVING count(*) = 1)"""


@query("j06_resolve_ids", f"""
WITH {IDENTITY_SQL}
SELECT o_orderkey, a.seq_id, a.pdb_id, a.chain_id, coalesce(k1.v, k2.v, k3.v, k4.v) AS matched,
  CASE WHEN k1.v IS NOT NULL THEN 'exact_id' WHEN k2.v IS NOT NULL THEN 'exact_pair' WHEN k3.v IS NOT NULL THEN 'folded_id'
    WHEN k4.v IS NOT NULL THEN 'folded_pair' ELSE 'unmatched' END AS match_method
FROM asked a LEFT JOIN k1 ON a.seq_id = k1.seq_id LEFT JOIN k2 ON lower(a.pdb_id) = k2.p AND a.chain_id = k2.c
LEFT JOIN k3 ON lower(a.seq_id) = k3.s LEFT JOIN k4 ON lower(a.pdb_id) = k4.p AND lower(a.chain_id) = k4.c""")
def _(spark, sf):
    return J.resolve_ids(*identity_tables(spark, sf), value="c_custkey")


@query("j07_resolve_source", """
SELECT doc_id, coalesce(quality, length(benchmark.text), n) AS value,
  CASE WHEN quality IS NOT NULL THEN 'labels' WHEN benchmark.text IS NOT NULL THEN 'benchmark'
    WHEN n IS NOT NULL THEN 'talks' ELSE 'missing' END AS origin
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN benchmark ON item_id = doc_id
LEFT JOIN (SELECT conv_id, min(length(text)) AS n FROM conversations GROUP BY conv_id) ON conv_id = doc_id""")
def _(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    return J.resolve_source(
        t("documents").select("doc_id"),
        [
            ("labels", t("labels").select("doc_id", F.col("quality").cast("long").alias("v")), "v"),
            ("benchmark", t("benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("v")), "v"),
            ("talks", t("conversations").select(F.col("conv_id").alias("doc_id"), F.length("text").cast("long").alias("v")), "v"),
        ],
        "doc_id",
    )


@query("j08_best_candidate", """
SELECT o_orderkey, l_partkey AS accession, l_discount + 0.0 AS identity, l_tax + 0.0 AS coverage, coalesce(n, 0) AS n_candidates FROM orders
LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount + 0.0 DESC, l_tax + 0.0 DESC, l_quantity DESC, l_partkey, l_suppkey) = 1)
ON l_orderkey = o_orderkey""")
def _(spark, sf):
    cands = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("accession"), "l_suppkey", "l_quantity",
        (F.col("l_discount") + 0.0).alias("identity"), (F.col("l_tax") + 0.0).alias("coverage"))
    order = [F.col("identity"), F.col("coverage"), F.col("l_quantity"), -F.col("accession"), -F.col("l_suppkey")]
    return J.best_candidate(fx.table(spark, sf, "orders").select("o_orderkey"), cands, ["o_orderkey"], order, ["accession", "identity", "coverage"])


@query("j09_assign_intervals", f"""
WITH {fx.RESIDUES_SQL},
regions AS (
  SELECT doc_id AS chain, -3 AS beg, CAST(floor(n_chars / 3) AS INTEGER) AS stop, 'M' AS code, 1 AS ordinal FROM documents
  UNION ALL SELECT doc_id, CAST(floor(n_chars / 4) AS INTEGER), CAST(floor(n_chars / 2) AS INTEGER), 'I', 2 FROM documents
  UNION ALL SELECT doc_id, CAST(floor(n_chars * 0.8) AS INTEGER), CAST(n_chars + 50 AS INTEGER), 'O', 3 FROM documents)
SELECT chain, coalesce(code, '') AS code, count(*) AS n, sum(pos + 1)::BIGINT AS position_sum FROM
  (SELECT r.chain, r.pos, arg_max(g.code, g.ordinal) AS code FROM residues r
   LEFT JOIN regions g ON g.chain = r.chain AND r.pos + 1 BETWEEN g.beg AND g.stop GROUP BY r.chain, r.pos) GROUP BY ALL""")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    n = F.col("n_chars")
    region = lambda b, e, c, o: docs.select(
        F.col("doc_id").alias("chain"), b.cast("int").alias("beg"), e.cast("int").alias("end"), F.lit(c).alias("code"), F.lit(o).alias("ordinal"))
    regions = region(F.lit(-3), F.floor(n / 3), "M", 1).unionByName(region(F.floor(n / 4), F.floor(n / 2), "I", 2)).unionByName(
        region(F.floor(n * 0.8), n + 50, "O", 3))
    stamped = J.assign_intervals(fx.chains(spark, sf).select("chain", F.length("seq").alias("n")), regions)
    return stamped.groupBy("chain", F.coalesce("code", F.lit("")).alias("code")).agg(
        F.count("*").alias("n"), F.sum("position").alias("position_sum"))


def score_sets(spark, sf):
    s = fx.scored(spark, sf)
    return [s.select("chain", "position", "label", F.col(c).alias("score")) for c in ("s1", "s2")]


@query("j13_align_scores", f"""
WITH {fx.SCORED_SQL} SELECT chain, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(s1), 6) AS mean_0, round(avg(s2), 6) AS mean_1
FROM scored GROUP BY chain""")
def _(spark, sf):
    return J.align_scores(score_sets(spark, sf)).groupBy("chain").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), R(F.avg("score_0")).alias("mean_0"), R(F.avg("score_1")).alias("mean_1"))


@query("j13_alignment_violations", f"""
WITH {fx.SCORED_SQL}, other AS (SELECT chain + 2 AS chain, position, label FROM scored)
SELECT chain, position, CASE WHEN a.label IS NULL OR b.label IS NULL THEN 'missing' ELSE 'label' END AS violation
FROM scored a FULL JOIN other b USING (chain, position) WHERE a.label IS DISTINCT FROM b.label""")
def _(spark, sf):
    a, b = score_sets(spark, sf)
    return J.alignment_violations([a, b.withColumn("chain", F.col("chain") + 2)])


@query("j14_first_difference", f"""
WITH {fx.RESIDUES_SQL}, r AS (SELECT chain + 1 AS chain, pos, aa FROM residues),
d AS (SELECT chain, pos, CASE WHEN l.aa IS NULL THEN 'missing_left' WHEN r.aa IS NULL THEN 'missing_right' ELSE 'aa' END AS field
  FROM residues l FULL JOIN r USING (chain, pos) WHERE l.aa IS DISTINCT FROM r.aa)
SELECT chain, min(pos) AS pos, arg_min(field, pos) AS field, count(*) AS n_differences FROM d GROUP BY chain""")
def _(spark, sf):
    left = fx.chains(spark, sf).select("chain", F.col("seq").alias("aa"))
    return J.first_difference(left, left.withColumn("chain", F.col("chain") + 1), ["aa"], pos="pos")


@query("j15_fan_out", f"""
WITH {fx.DEDUP_SQL} SELECT id, seq_hash, n_copies, feature FROM dedup
JOIN (SELECT seq_hash, count(*) AS n_copies, min(n) * 2 AS feature FROM dedup GROUP BY seq_hash) USING (seq_hash)""")
def _(spark, sf):
    d = fx.dedup(spark, sf)
    features = d.groupBy("seq_hash").agg(F.count("*").alias("n_copies"), (F.min("n") * 2).alias("feature"))
    return J.fan_out(features, d.select("id", "seq_hash"), "seq_hash")


@query("j16_release_table", f"""
WITH {COVERAGE_SQL},
bridge AS (SELECT l_orderkey AS complex, CASE WHEN l_returnflag = 'N' THEN 'FAIL' ELSE 'OK' END AS status, l_discount >= 0.05 AS strict,
  CAST(l_suppkey AS VARCHAR) AS accession FROM lineitem),
b AS (SELECT complex, count(*) AS n, sum((status = 'OK')::INT)::BIGINT AS ok, sum(strict::INT)::BIGINT AS st,
  array_to_string(list_sort(list_distinct(list(accession) FILTER (status = 'OK'))), ';') AS accs FROM bridge GROUP BY complex),
s AS (SELECT complex, count(*) AS n_acc, sum(('0x' || substr(md5(accession), 1, 8))::BIGINT)::BIGINT AS acc_sum FROM (SELECT DISTINCT complex, accession FROM bridge WHERE status = 'OK') GROUP BY complex)
SELECT o_orderkey AS complex, o_orderstatus AS split, n_residues, n_positive::BIGINT AS n_positive,
  CASE WHEN o_totalprice > 100000 THEN 'OK' ELSE 'SKIP' END AS feature_status, coalesce(n, 0) AS bridge_n_chains, coalesce(ok, 0) AS bridge_n_ok,
  coalesce(st, 0) AS bridge_n_strict, coalesce(accs, '') AS accessions, coalesce(n_acc, 0) AS n_accessions, coalesce(acc_sum, 0) AS accession_sum, o_totalprice > 100000 AND n_positive IS NOT NULL AS usable
FROM orders LEFT JOIN cov ON cov.complex = o_orderkey LEFT JOIN b ON b.complex = o_orderkey LEFT JOIN s ON s.complex = o_orderkey""")
def _(spark, sf):
    orders = fx.table(spark, sf, "orders")
    split = orders.select(F.col("o_orderkey").alias("complex"), F.col("o_orderstatus").alias("split"))
    features = orders.select(F.col("o_orderkey").alias("complex"), F.when(F.col("o_totalprice") > 100000, "OK").otherwise("SKIP").alias("feature_status"))
    bridge = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("complex"), F.when(F.col("l_returnflag") == "N", "FAIL").otherwise("OK").alias("status"),
        (F.col("l_discount") >= 0.05).alias("strict"), F.col("l_suppkey").cast("string").alias("accession"))
    return J.release_table(split, complex_labels(spark, sf).select("complex", "n_residues", "n_positive"), features, bridge)


STITCH_SQL = f"""{fx.RESIDUES_SQL},
feat AS (SELECT doc_id AS chain, CAST(quality AS DOUBLE) + 0.5 AS f1, CAST(toxic AS DOUBLE) + 0.25 AS f2 FROM labels)"""


@query("j17_stitch", f"""
WITH {STITCH_SQL}
SELECT complex, count(*) AS n_residues, count(f1) AS n_available, round(count(f1)::DOUBLE / count(*), 6) AS coverage_residue,
  round(sum(coalesce(f1, 0)), 6) AS f1, round(sum(coalesce(f2, 0)), 6) AS f2 FROM residues LEFT JOIN feat USING (chain) GROUP BY complex""")
def _(spark, sf):
    feats = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("chain"), (F.col("quality") + 0.5).cast("double").alias("f1"), (F.col("toxic") + 0.25).cast("double").alias("f2"))
    rows = J.stitch(fx.residues(spark, sf), feats, ["chain"], ["f1", "f2"], missing="zero")
    sums = rows.groupBy("complex").agg(F.sum("f1").alias("f1"), F.sum("f2").alias("f2"))
    return round_all(J.stitch_coverage(rows, "complex").join(sums, "complex"))


@query("j18_restrict_split", """
SELECT doc_id AS id, lang AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, sf):
    split = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"))
    return J.restrict_split(split, fx.table(spark, sf, "labels").where("quality = 1").withColumnRenamed("doc_id", "id"))


def seed_tables(spark, sf):
    """Per run (seed): the mean of its click events as control, of its view events as candidate."""
    m = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("seed")).agg(
        *[F.coalesce(F.avg(F.when(F.col("event_type") == e, F.col("value"))), F.lit(0.0)).alias(e) for e in ("click", "view")])
    return m.select("seed", F.col("click").alias("ap")), m.select("seed", F.col("view").alias("ap"))


SEED_SQL = """
seeds AS (SELECT user_id AS seed, coalesce(avg(value) FILTER (event_type = 'click'), 0) AS c,
  coalesce(avg(value) FILTER (event_type = 'view'), 0) AS d FROM events GROUP BY user_id)"""


@query("j19_paired_delta", f"""
WITH {SEED_SQL} SELECT seed, round(c, 6) AS control_ap, round(d, 6) AS candidate_ap, round(d - c, 6) + 0.0 AS delta_ap FROM seeds""")
def _(spark, sf):
    return round_all(J.paired_delta(*seed_tables(spark, sf), metrics=["ap"]))


@query("j20_validated_join", """
SELECT o_orderkey, o_totalprice, l.n_lines FROM orders
JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    right = lines.join(orders, "o_orderkey").select("o_orderkey", "n_lines", (F.col("o_totalprice") + 1e-13).alias("o_totalprice"))
    return J.validated_join(orders, right, ["o_orderkey"], same=["o_totalprice"])


@query("j20_join_report", """
WITH r AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN l.o_custkey IS NULL THEN 'only_right' WHEN r.n IS NULL THEN 'only_left' WHEN n > 1 THEN 'duplicate' END AS problem
FROM orders l FULL JOIN r USING (o_orderkey) WHERE l.o_custkey IS NULL OR r.n IS NULL OR n > 1""")
def _(spark, sf):
    return J.join_report(fx.table(spark, sf, "orders"), fx.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("j21_explode_join", """
WITH w AS (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS word FROM part),
dim AS (SELECT word, count(*) AS n_parts FROM w GROUP BY word)
SELECT p_partkey, word, n_parts FROM w JOIN dim USING (word) WHERE word <> ''""")
def _(spark, sf):
    part = fx.table(spark, sf, "part").select("p_partkey", "p_name")
    dim = part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n_parts"))
    return J.explode_join(part, "p_name", dim, "word", sep=" ").select("p_partkey", "word", "n_parts")


@query("j22_experiment_table", """
SELECT CAST(user_id AS VARCHAR) AS model, n, round(macro, 6) AS macro FROM
 (SELECT user_id, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT user_id, avg(value) AS macro FROM events WHERE event_type <> 'error' GROUP BY 1) USING (user_id)
UNION ALL SELECT 'ensemble', count(*), round(avg(value), 6) FROM events""")
def _(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("model", F.col("user_id").cast("string"))
    formal = ev.groupBy("model").agg(F.count("*").alias("n"))
    macro = ev.where("event_type <> 'error'").groupBy("model").agg(F.avg("value").alias("macro"))
    extra = ev.agg(F.lit("ensemble").alias("model"), F.count("*").alias("n"), F.avg("value").alias("macro"))
    return round_all(J.experiment_table(formal, macro, extra))
