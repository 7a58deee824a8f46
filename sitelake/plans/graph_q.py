"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.core import rounded as R
from sitelake.operators import graph as G
from sitelake.operators import metrics as M
from sitelake.operators import select as S
from sitelake.plans import fixtures as fx
from sitelake.plans.metrics_q import COVERAGE_SQL, complex_labels, round_all
from sitelake.plans.registry import query
from sitelake.plans.spatial_q import KNN_SQL, near


def components(spark, sf):
    """Components of all complexes, written once per application."""

    def build():
        e = fx.edges(spark, sf)
        return G.connected_components(e, G.shared_cluster_links(e))

    return fx.kept(spark, sf, "components", build)


CC = f"WITH RECURSIVE {fx.COMPONENTS_SQL}"


@query("g01_connected_components", f"{CC} SELECT complex, component FROM cc")
def _(spark, sf):
    return components(spark, sf)


@query("g02_number_components", f"""
{CC}, s AS (SELECT component, count(*) AS n, min(complex) AS first FROM cc GROUP BY component)
SELECT component, n, row_number() OVER (ORDER BY n DESC, first DESC) - 1 AS component_id FROM s""")
def _(spark, sf):
    return G.number_components(components(spark, sf))


@query("a23_component_metrics", f"""
{CC}, {COVERAGE_SQL}, k AS (SELECT component, count(DISTINCT cluster) AS n_clusters FROM cc JOIN edges USING (complex) GROUP BY component)
SELECT component, count(*) AS n_complexes, sum(n_residues)::BIGINT AS n_residues, sum(n_positive)::BIGINT AS n_positive, sum(n_negative)::BIGINT AS n_negative,
  round(avg(coverage), 6) AS coverage_mean, min(complex) AS first_complex, any_value(n_clusters) AS n_clusters,
  round(sum(n_positive)::DOUBLE / greatest(1, sum(n_positive) + sum(n_negative)), 6) AS positive_fraction
FROM cc JOIN cov USING (complex) JOIN k USING (component) GROUP BY component""")
def _(spark, sf):
    return round_all(component_table(spark, sf))


def component_table(spark, sf):
    return M.component_metrics(components(spark, sf), fx.edges(spark, sf), complex_labels(spark, sf))


@query("a24_size_stats", f"""
{CC}, s AS (SELECT component, count(*) AS n FROM cc GROUP BY component)
SELECT count(*) AS n, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, median(n) AS median FROM s""")
def _(spark, sf):
    sizes = components(spark, sf).groupBy("component").agg(F.count("*").alias("size"))
    return round_all(M.size_stats(sizes, "size"))


@query("k06_largest_components", f"{CC} SELECT component, count(*) AS size FROM cc GROUP BY component ORDER BY size DESC, component LIMIT 10")
def _(spark, sf):
    return S.largest(components(spark, sf), ["component"], 10, ["-size", "component"])


def contact_edges(spark, sf):
    """Contacts of every complex in residue numbers, scored 1/(1+d)."""
    at = F.col("complex") * 100
    return near(spark, sf).select(F.col("complex").alias("graph"), (F.col("pid") - at).alias("src"), (F.col("neighbor") - at).alias("dst"),
                                  R(1 / (1 + F.col("d")), 9).alias("score"), "d", "rank")


EDGE_SQL = KNN_SQL + """,
ce AS (SELECT complex AS graph, pid - complex * 100 AS src, bpid - complex * 100 AS dst, round(1 / (1 + d), 9) AS score, d, rk AS rank FROM kn WHERE rk <= 10),
sizes AS (SELECT complex AS graph, count(*) AS n FROM points GROUP BY complex)"""


def graph_sizes(spark, sf):
    return fx.points(spark, sf).groupBy(F.col("complex").alias("graph")).agg(F.count("*").alias("n"))


@query("g04_prune_contacts", f"""
WITH {EDGE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY graph, src ORDER BY score DESC, dst) AS rn FROM ce WHERE abs(src - dst) >= 6 AND score >= 0.04),
b AS (SELECT graph, src, dst, score FROM t WHERE rn <= 3 UNION ALL SELECT graph, dst, src, score FROM t WHERE rn <= 3)
SELECT graph, src, dst, max(score) AS score FROM b GROUP BY ALL""")
def _(spark, sf):
    return G.prune_contacts(contact_edges(spark, sf), 3, 0.04, 6)


@query("g04_merge_tile_edges", f"WITH {EDGE_SQL} SELECT graph, src % 50 AS src, dst % 50 AS dst, arg_max(score, rank * 1000 + src + dst / 1000) AS score FROM ce GROUP BY ALL")
def _(spark, sf):
    tiled = contact_edges(spark, sf).withColumn("tile", F.col("rank") * 1000 + F.col("src") + F.col("dst") / 1000)
    return G.merge_tile_edges(tiled.withColumns({c: F.col(c) % 50 for c in ("src", "dst")}), "last")


def chain_tables(spark, sf):
    """Segments of four chains per complex; predictions differ or are absent where the chain lies far to one side."""
    pts = fx.placed_points(spark, sf).withColumn("quarter", F.floor(F.col("pos") / 25))
    seqs = pts.groupBy(F.col("complex").alias("graph"), F.col("quarter").alias("chain")).agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.max("aa").alias("seq"), F.sum("x").alias("sx"))
    predicted = seqs.where("sx > -150").select("graph", "chain", F.when(F.col("sx") > 150, F.concat("seq", F.lit("Q"))).otherwise(F.col("seq")).alias("pred_seq"))
    local = contact_edges(spark, sf).select("graph", F.floor(F.col("src") / 25).alias("chain"), (F.col("src") % 25).alias("src"),
                                            (F.col("dst") - F.floor(F.col("src") / 25) * 25).alias("dst"), F.col("d").alias("dist"))
    return seqs.drop("sx"), predicted, local


STATUS_SQL = EDGE_SQL + """,
seqs AS (SELECT complex AS graph, CAST(floor((pid - complex * 100) / 25) AS BIGINT) AS chain, min(pid - complex * 100) AS start, max(pid - complex * 100) + 1 AS stop,
  max(aa) AS seq, sum(x) AS sx FROM points GROUP BY 1, 2),
st AS (SELECT graph, chain, start, stop, seq, CASE WHEN NOT sx > -150 THEN 'MISSING' WHEN sx > 150 THEN 'MISMATCH' ELSE 'OK' END AS status FROM seqs)"""


@query("g05_chain_status", f"WITH {STATUS_SQL} SELECT graph, chain, start, stop, seq, status FROM st")
def _(spark, sf):
    seqs, predicted, _ = chain_tables(spark, sf)
    return G.chain_status(seqs, predicted)


@query("g05_stitch_graph", f"""
WITH {STATUS_SQL}, l AS (SELECT graph, CAST(floor(src / 25) AS BIGINT) AS chain, src % 25 AS src, dst - CAST(floor(src / 25) AS BIGINT) * 25 AS dst, d FROM ce)
SELECT graph, chain, src + start AS src, dst + start AS dst, round(d, 6) AS dist FROM l JOIN st USING (graph, chain)
WHERE status = 'OK' AND dst >= 0 AND dst < stop - start AND src < stop - start AND src <> dst""")
def _(spark, sf):
    seqs, predicted, local = chain_tables(spark, sf)
    return round_all(G.stitch_graph(G.chain_status(seqs, predicted), local))


@query("g05_graph_status", f"""
WITH {STATUS_SQL}, g AS (SELECT graph, count(*) AS n_chains, count(*) FILTER (status = 'OK') AS n_ok FROM st GROUP BY graph)
SELECT graph, n_chains, n_ok, n_ok::DOUBLE / n_chains AS coverage, CASE WHEN n_ok = n_chains THEN 'OK' WHEN n_ok::DOUBLE / n_chains >= 0.5 AND n_ok > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM g""")
def _(spark, sf):
    seqs, predicted, _ = chain_tables(spark, sf)
    return G.graph_status(G.chain_status(seqs, predicted))


@query("g06_slice_graph", f"""
WITH {EDGE_SQL} SELECT graph, src - 20 AS src, dst - 20 AS dst, score FROM ce JOIN sizes USING (graph) WHERE src >= 20 AND dst >= 20 AND src < n - 10 AND dst < n - 10""")
def _(spark, sf):
    ranges = graph_sizes(spark, sf).select("graph", F.lit(20).alias("start"), (F.col("n") - 10).alias("stop"))
    return G.slice_graph(contact_edges(spark, sf).select("graph", "src", "dst", "score"), ranges)


@query("g07_clean_edges", f"""
WITH {EDGE_SQL} SELECT graph, src - 5 AS src, dst * 2 - 30 AS dst, score FROM ce JOIN sizes USING (graph)
WHERE rank <> 3 AND rank <> 4 AND src - 5 >= 0 AND dst * 2 - 30 >= 0 AND src - 5 < n AND dst * 2 - 30 < n AND src - 5 <> dst * 2 - 30""")
def _(spark, sf):
    score = F.when(F.col("rank") == 3, float("nan")).when(F.col("rank") == 4, float("inf")).otherwise(F.col("score"))
    raw = contact_edges(spark, sf).select("graph", (F.col("src") - 5).alias("src"), (F.col("dst") * 2 - 30).alias("dst"), score.alias("score"))
    return G.clean_edges(raw, graph_sizes(spark, sf))


@query("g08_node_stats", f"""
WITH {EDGE_SQL}, c AS (SELECT graph, src, dst, least(0.08, 1 / (1 + d)) AS score FROM ce),
o AS (SELECT graph, src AS node, sum(score) AS s, avg(score) AS m, max(score) AS x, count(*) AS k FROM c GROUP BY ALL),
i AS (SELECT graph, dst AS node, sum(score) AS s, avg(score) AS m, max(score) AS x, count(*) AS k FROM c GROUP BY ALL)
SELECT graph, node, round(coalesce(o.s, 0), 6) AS out_sum, round(coalesce(o.m, 0), 6) AS out_mean, round(coalesce(o.x, 0), 6) AS out_max, round(coalesce(o.k, 0) / sqrt(n), 6) AS out_n,
  round(coalesce(i.s, 0), 6) AS in_sum, round(coalesce(i.m, 0), 6) AS in_mean, round(coalesce(i.x, 0), 6) AS in_max, round(coalesce(i.k, 0) / sqrt(n), 6) AS in_n
FROM o FULL JOIN i USING (graph, node) JOIN sizes USING (graph)""")
def _(spark, sf):
    e = contact_edges(spark, sf).select("graph", "src", "dst", (1 / (1 + F.col("d"))).alias("score"))
    return round_all(G.node_stats(e, graph_sizes(spark, sf), clip=0.08))


TYPES_SQL = ", ".join(f"(edge_type = {i})::DOUBLE AS type_{t}" for t, i in G.EDGE_TYPES.items())


@query("g09_build_edges", f"""
WITH {EDGE_SQL}, nodes AS (SELECT complex AS graph, pid - complex * 100 AS node, chain FROM points),
base AS (SELECT graph, src, dst, score, 0 AS edge_type FROM ce WHERE rank <= 2 UNION ALL SELECT graph, src, dst, score, 4 FROM ce WHERE rank = 3
  UNION ALL SELECT a.graph, a.node, b.node, 0, 1 FROM nodes a JOIN nodes b ON a.graph = b.graph AND a.chain = b.chain AND b.node - a.node BETWEEN 1 AND 4),
e AS (SELECT * FROM base UNION ALL SELECT graph, dst, src, score, edge_type FROM base
  UNION ALL SELECT graph, n, node, 1, 2 FROM nodes JOIN sizes USING (graph) UNION ALL SELECT graph, node, n, 1, 3 FROM nodes JOIN sizes USING (graph)),
f AS (SELECT e.*, n, s.chain AS sc, d.chain AS dc FROM e JOIN sizes USING (graph) LEFT JOIN nodes s ON s.graph = e.graph AND s.node = e.src LEFT JOIN nodes d ON d.graph = e.graph AND d.node = e.dst)
SELECT graph, src, dst, edge_type, round(least(1, score), 6) AS score, round(CASE WHEN sc IS NULL OR dc IS NULL THEN 0 ELSE (dst - src) / greatest(1, n - 1)::DOUBLE END, 6) + 0.0 AS rel,
  round(CASE WHEN sc IS NULL OR dc IS NULL THEN 0 ELSE abs(dst - src) / greatest(1, n - 1)::DOUBLE END, 6) AS abs_rel,
  CASE WHEN sc IS NULL OR dc IS NULL THEN 0 ELSE (sc = dc)::DOUBLE END AS same_chain, CASE WHEN sc IS NULL OR dc IS NULL THEN 0 ELSE (sc <> dc)::DOUBLE END AS other_chain, {TYPES_SQL} FROM f""")
def _(spark, sf):
    nodes = fx.placed_points(spark, sf).select(F.col("complex").alias("graph"), F.col("pos").alias("node"), "chain")
    e = contact_edges(spark, sf)
    return round_all(G.build_edges(nodes, e.where("rank <= 2"), e.where("rank = 3"), neighbors=4))


@query("g10_edge_softmax", f"""
WITH {EDGE_SQL}, l AS (SELECT graph, src, dst, score * 100 AS logit FROM ce),
m AS (SELECT *, exp(greatest(-60, logit - max(logit) OVER (PARTITION BY graph, dst))) AS ex FROM l)
SELECT graph, src, dst, logit, round(ex / sum(ex) OVER (PARTITION BY graph, dst), 6) AS attention FROM m""")
def _(spark, sf):
    e = contact_edges(spark, sf).select("graph", "src", "dst", (F.col("score") * 100).alias("logit"))
    return G.edge_softmax(e).select("graph", "src", "dst", "logit", R("attention").alias("attention"))


