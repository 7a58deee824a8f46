"""Graph operators (G01, G02, G04-G10); G03 is in ``spatial``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, discard, durable, ratio, running_totals


def shared_cluster_links(members: DataFrame, item: str = "complex", cluster: str = "cluster") -> DataFrame:
    """Links from every item of a cluster to the cluster's smallest item: n links for n members, never all pairs."""
    hubs = members.groupBy(cluster).agg(F.min(item).alias("v"))
    return members.join(hubs, cluster).where(F.col(item) != F.col("v")).select(F.col(item).alias("u"), "v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(nodes: DataFrame, links: DataFrame, node: str = "complex", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest node of each component as its name.

    Alternates large-star and small-star contraction, which needs a logarithmic
    number of rounds whatever the diameter. Each round is written to the shared
    folder, so plans stay short and a lost executor costs one round at most; the
    round before is deleted then, so two tables are there at a time.
    Minima are combined map-side; AQE splits the joins on hot nodes.
    """
    e = durable(links.select(F.col("u"), F.col("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        before, e = e, durable(_small_star(_large_star(e)), "links")
        discard(before)
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise DataContractError(f"components did not settle in {max_rounds} rounds; the last one left {seen[0]} links")
    roots = e.select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.select(node).distinct().join(roots, node, "left").withColumn("component", F.coalesce("component", node))


def number_components(members: DataFrame, node: str = "complex") -> DataFrame:
    """Number components from 0 by size, then first member, both descending."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.min(node).alias("first"))
    ranked = running_totals(sizes, order=["-n", "-first"], rank="__rn")
    return ranked.select("component", "n", (F.col("__rn") - 1).alias("component_id"))


def clean_score(c: Column, clip: float = 1.0) -> Column:
    """NaN and infinities below become 0, infinity above becomes ``clip``; the rest is clipped to [0, clip]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(clip), F.nanvl(c, F.lit(0.0))))


def clean_edges(edges: DataFrame, sizes: DataFrame, by: str = "graph") -> DataFrame:
    """Drop self, out-of-range and non-finite edges; ``sizes(graph, n)`` gives the node counts."""
    s = F.col("score")
    ok = (~F.isnan(s)) & (F.abs(s) != float("inf")) & (F.col("src") >= 0) & (F.col("dst") >= 0) & (F.col("src") < F.col("n")) & (F.col("dst") < F.col("n")) & (F.col("src") != F.col("dst"))
    return edges.join(sizes, by).where(ok).drop("n")


def prune_contacts(edges: DataFrame, k: int, min_score: float, min_sep: int, bidirectional: bool = True, by: Sequence[str] = ("graph",)) -> DataFrame:
    """Best ``k`` contacts per source at least ``min_sep`` apart; reversed edges added, the larger score kept."""
    score = F.when(F.isnan("score"), -1.0).when(F.col("score") == float("inf"), 1.0).when(F.col("score") == float("-inf"), -1.0).otherwise(F.col("score"))
    kept = edges.withColumn("score", score).where((F.abs(F.col("src") - F.col("dst")) >= min_sep) & (F.col("score") >= min_score) & (F.col("src") != F.col("dst")))
    w = Window.partitionBy(*by, "src").orderBy(F.desc("score"), "dst")
    top = kept.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).select(*by, "src", "dst", "score")
    if bidirectional:
        top = top.unionByName(top.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return top.groupBy(*by, "src", "dst").agg(F.max("score").alias("score"))


def merge_tile_edges(edges: DataFrame, merge: str = "max", tile: str = "tile", by: Sequence[str] = ("graph",)) -> DataFrame:
    """One score per edge over overlapping tiles: the largest, or the last tile's."""
    pick = {"max": F.max("score"), "last": F.max_by("score", tile)}
    if merge not in pick:
        raise DataContractError(f"unknown merge rule {merge}")
    return edges.groupBy(*by, "src", "dst").agg(pick[merge].alias("score"))


def chain_status(segments: DataFrame, predicted: DataFrame, on: Sequence[str] = ("graph", "chain")) -> DataFrame:
    """OK, MISSING or MISMATCH per chain; ``segments(..., start, stop, seq)``, ``predicted(..., pred_seq)``."""
    status = F.when(F.col("pred_seq").isNull(), "MISSING").when(F.col("pred_seq") != F.col("seq"), "MISMATCH").otherwise("OK")
    return segments.join(predicted, list(on), "left").withColumn("status", status).drop("pred_seq")


def stitch_graph(status: DataFrame, edges: DataFrame, on: Sequence[str] = ("graph", "chain")) -> DataFrame:
    """Move edges of OK chains into complex numbering, without self, out-of-range and non-finite ones."""
    ok = status.where("status = 'OK'").select(*on, "start", (F.col("stop") - F.col("start")).alias("__len"))
    n = F.col("__len")
    valid = (F.col("src") >= 0) & (F.col("dst") >= 0) & (F.col("src") < n) & (F.col("dst") < n) & (F.col("src") != F.col("dst")) & ~F.isnan("dist") & (F.abs("dist") != float("inf"))
    return edges.join(ok, list(on)).where(valid).select(
        *on, (F.col("src") + F.col("start")).alias("src"), (F.col("dst") + F.col("start")).alias("dst"), "dist")


def graph_status(status: DataFrame, by: str = "graph", min_coverage: float = 0.5) -> DataFrame:
    ok = F.sum((F.col("status") == "OK").cast("long"))
    g = status.groupBy(by).agg(F.count("*").alias("n_chains"), ok.alias("n_ok"))
    cov = F.col("n_ok") / F.greatest(F.lit(1), F.col("n_chains"))
    state = F.when(F.col("n_ok") == F.col("n_chains"), "OK").when((cov >= min_coverage) & (F.col("n_ok") > 0), "PARTIAL").otherwise("FAIL")
    return g.withColumns({"coverage": cov, "status": state})


def slice_graph(edges: DataFrame, ranges: DataFrame, by: str = "graph") -> DataFrame:
    """Edges inside ``[start, stop)`` of their graph, renumbered from 0."""
    inside = reduce(lambda a, b: a & b, [(F.col(c) >= F.col("start")) & (F.col(c) < F.col("stop")) for c in ("src", "dst")])
    return edges.join(ranges, by).where(inside).withColumns({c: F.col(c) - F.col("start") for c in ("src", "dst")}).drop("start", "stop")


def node_stats(edges: DataFrame, sizes: DataFrame, by: str = "graph", clip: float = 1.0) -> DataFrame:
    """Sum, mean, maximum and ``count / sqrt(n)`` of clipped scores, outgoing and incoming, per node with an edge."""
    scored = edges.withColumn("score", clean_score(F.col("score"), clip))

    def side(col: str, tag: str) -> DataFrame:
        return scored.groupBy(by, F.col(col).alias("node")).agg(
            F.sum("score").alias(f"{tag}_sum"), F.avg("score").alias(f"{tag}_mean"), F.max("score").alias(f"{tag}_max"), F.count("*").alias(f"{tag}_n"))

    both = side("src", "out").join(side("dst", "in"), [by, "node"], "full_outer").join(sizes, by)
    norm = F.sqrt(F.greatest(F.lit(1), F.col("n")).cast("double"))
    cols = [f"{t}_{m}" for t in ("out", "in") for m in ("sum", "mean", "max", "n")]
    return both.na.fill(0, cols).withColumns({f"{t}_n": F.col(f"{t}_n") / norm for t in ("out", "in")}).drop("n")


EDGE_TYPES = {"contact": 0, "sequence": 1, "from_global": 2, "to_global": 3, "aux": 4}


def build_edges(nodes: DataFrame, contacts: DataFrame, aux: DataFrame | None = None, neighbors: int = 2, by: str = "graph",
                use_global: bool = True, clip: float = 1.0) -> DataFrame:
    """Typed edge list with features: contact both ways, chain neighbours ±1..K both ways, global node both ways, auxiliary.

    ``nodes(graph, node, chain)`` numbers nodes from 0 in sequence order; the
    global node of a graph of n nodes is n. Chain neighbours come from an
    equi-join on the node number plus an offset.
    """
    sizes = nodes.groupBy(by).agg(F.count("*").alias("n"))

    def two_way(e: DataFrame, kind: str) -> DataFrame:
        e = e.select(by, "src", "dst", F.nanvl("score", F.lit(0.0)).alias("score"), F.lit(EDGE_TYPES[kind]).alias("edge_type"))
        return e.unionByName(e.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"), "score", "edge_type"))

    parts = [two_way(contacts, "contact")]
    if aux is not None:
        parts.append(two_way(aux, "aux"))
    ahead = nodes.select(by, F.col("node").alias("src"), "chain", F.explode(F.sequence(F.lit(1), F.lit(neighbors))).alias("k")).withColumn("dst", F.col("src") + F.col("k"))
    steps = ahead.join(nodes.select(by, F.col("node").alias("dst"), "chain"), [by, "dst", "chain"]).select(by, "src", "dst", F.lit(0.0).alias("score"))
    parts.append(two_way(steps, "sequence"))
    if use_global:
        g = nodes.join(sizes, by)
        for kind, s, d in (("from_global", "n", "node"), ("to_global", "node", "n")):
            parts.append(g.select(by, F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(1.0).alias("score"), F.lit(EDGE_TYPES[kind]).alias("edge_type")))
    edges = reduce(DataFrame.unionByName, parts).join(sizes, by)
    chain_of = lambda end: nodes.select(by, F.col("node").alias(end), F.col("chain").alias(f"{end}_chain"))
    tagged = edges.join(chain_of("src"), [by, "src"], "left").join(chain_of("dst"), [by, "dst"], "left")
    inner = F.col("src_chain").isNotNull() & F.col("dst_chain").isNotNull()
    rel = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("dst") - F.col("src")) / F.greatest(F.lit(1), F.col("n") - 1)))
    same = F.col("src_chain") == F.col("dst_chain")
    flag = lambda c: F.when(inner, c.cast("double")).otherwise(0.0)
    return tagged.select(
        by, "src", "dst", "edge_type", clean_score(F.col("score"), clip).alias("score"),
        F.when(inner, rel).otherwise(0.0).alias("rel"), F.when(inner, F.abs(rel)).otherwise(0.0).alias("abs_rel"),
        flag(same).alias("same_chain"), flag(~same).alias("other_chain"),
        *[(F.col("edge_type") == i).cast("double").alias(f"type_{t}") for t, i in EDGE_TYPES.items()])


def edge_softmax(edges: DataFrame, logit: str = "logit", by: Sequence[str] = ("graph",)) -> DataFrame:
    """Softmax over the incoming edges of each node: shifted by the maximum, exponent clamped to ±60.

    Maximum and sum are aggregations joined back, so a node with very many
    incoming edges is never one window group.
    """
    key = [*by, "dst"]
    peak = edges.groupBy(*key).agg(F.max(logit).alias("__m"))
    e = edges.join(peak, key).withColumn("__e", F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(logit) - F.col("__m")))))
    total = e.groupBy(*key).agg(F.sum("__e").alias("__t"))
    return e.join(total, key).withColumn("attention", ratio(F.col("__e"), F.greatest(F.col("__t"), F.lit(1e-12)))).drop("__m", "__e", "__t")
