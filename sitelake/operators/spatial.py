"""Distance joins (J10-J12) and the neighbourhood features built on them.

A radius join is an equi-join on grid cells: one side stays in its cell, the
other is copied to the 27 cells around it, and the exact distance decides. Points
that share coordinates are merged into one *site* with counts and property sums
first, so copies never pair up with each other, and the sums per site are
finished in the join's own tasks before anything is shuffled again. No complex
is paired with itself as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import durable, ratio, spread
from sitelake.functions import residue as P
from sitelake.operators.windows import v_named, v_scale, v_sub, v_unit, vec

XYZ = ["x", "y", "z"]
Weight = Callable[[Column], Column]


def _cells(size: Column | float, prefix: str = "__c") -> dict[str, Column]:
    return {f"{prefix}{c}": F.floor(F.col(c) / size) for c in XYZ}


def _spread_27(df: DataFrame, size: Column | float, prefix: str = "__c") -> DataFrame:
    near = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col(c) / size) + s))
    for c in XYZ:
        df = df.withColumn(f"{prefix}{c}", near(c))
    return df


def _distance() -> Column:
    return F.sqrt(sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in XYZ), F.lit(0.0)))


def site_pairs(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str], strict: bool) -> DataFrame:
    """Pairs of sites of one group with distance ``d``; strict means ``0 < d < radius``, else ``d <= radius``.

    The right side's coordinates come back as ``__x, __y, __z``.
    """
    keys = [*by, *_cells(1.0)]
    r = _spread_27(right, radius).withColumnsRenamed({c: f"__{c}" for c in XYZ})
    pairs = left.withColumns(_cells(radius)).join(r, keys).withColumn("d", _distance())
    d = F.col("d")
    return pairs.where((d > 0) & (d < radius) if strict else d <= radius)


def neighbor_sums(points: DataFrame, radius: float, terms: dict[str, tuple[Weight, str | None]], by: Sequence[str] = ("complex",),
                  strict: bool = True, include_self: bool = False) -> DataFrame:
    """Add ``sum over neighbours of weight(d) * property`` per term (property ``None`` counts neighbours).

    Weights may also read the offset of the neighbour, ``__x - x`` and so on.
    A point's own contribution is taken off again unless ``include_self``.
    """
    by = list(by)
    props = sorted({p for _, p in terms.values() if p})
    totals = points.groupBy(*by, *XYZ).agg(F.count("*").alias("__n"), *[F.sum(F.col(p).cast("double")).alias(f"__s_{p}") for p in props])
    left = totals.select(*by, *XYZ)
    mass = {p: F.col(f"__s_{p}") for p in props} | {None: F.col("__n")}
    pairs = site_pairs(left, totals, radius, by, strict)
    sums = pairs.groupBy(*by, *XYZ).agg(*[F.sum(w(F.col("d")) * mass[p]).alias(name) for name, (w, p) in terms.items()])
    out = points.join(sums, [*by, *XYZ], "left").na.fill(0, list(terms))
    if strict or include_self:
        return out
    own = {p: F.col(p) for p in props} | {None: F.lit(1)}
    here = out.withColumns({f"__{c}": F.col(c) for c in XYZ})
    return here.withColumns({n: F.col(n) - w(F.lit(0.0)) * own[p] for n, (w, p) in terms.items()}).drop("__x", "__y", "__z")


def within(r: float, strict: bool = True) -> Weight:
    return lambda d: F.when(d < r if strict else d <= r, 1.0).otherwise(0.0)


def _flag(df: DataFrame, name: str, letters: str, letter: str = "aa") -> DataFrame:
    return df.withColumn(name, P.is_in(letter, letters).cast("double"))


# ---------------------------------------------------------------- J10-J12, G03


def contact_labels(atoms: DataFrame, cutoff: float, residue: Sequence[str], by: str = "complex", unlike: str = "chain") -> DataFrame:
    """Label 1 for residues with an atom at most ``cutoff`` from an atom of another chain of the complex.

    Only existence matters, so this is a semi-join on cells: no pair is emitted.
    """
    sites = atoms.select(by, unlike, *XYZ).distinct()
    near = _spread_27(sites, cutoff).withColumnsRenamed({c: f"__{c}" for c in XYZ} | {unlike: "__unlike", by: "__by"} | {f"__c{c}": f"__n{c}" for c in XYZ})
    mine = sites.withColumns(_cells(cutoff))
    same_cell = (F.col(by) == F.col("__by"))
    for c in XYZ:
        same_cell = same_cell & (F.col(f"__c{c}") == F.col(f"__n{c}"))
    touching = mine.join(near, same_cell & (F.col(unlike) != F.col("__unlike")) & (_distance() <= cutoff), "left_semi").select(by, unlike, *XYZ)
    hit = atoms.join(touching, [by, unlike, *XYZ], "left_semi").select(*residue).distinct().withColumn("label", F.lit(1))
    return atoms.select(*residue).distinct().join(hit, list(residue), "left").na.fill(0, ["label"])


def radius_neighbors(points: DataFrame, radii: Sequence[float], by: Sequence[str] = ("complex",)) -> DataFrame:
    """Neighbour counts ``0 < d < r`` for several radii in one pass, as ``n_{r}``."""
    return neighbor_sums(points, max(radii), {f"n_{r:g}": (within(r), None) for r in radii}, by)


def _lists(pairs: DataFrame, site: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` candidates per site by (d, pid); cut to k per task before the shuffle."""
    w = Window.partitionBy(*site).orderBy("d", "__pid")
    top = pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return top.groupBy(*site).agg(F.sort_array(F.collect_list(F.struct("d", F.col("__pid").alias("pid")))).alias("near"))


def _candidates(points: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """At most ``k + 1`` members per site, lowest ids first: further copies cannot enter a list of k."""
    w = Window.partitionBy(*by, *XYZ).orderBy("pid")
    return points.select(*by, *XYZ, "pid").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k + 1).drop("__rn").withColumnRenamed("pid", "__pid")


def _per_point(points: DataFrame, lists: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    joined = points.select(*by, *XYZ, "pid").join(lists, [*by, *XYZ])
    others = F.slice(F.filter("near", lambda n: n["pid"] != F.col("pid")), 1, k)
    return joined.select(*by, "pid", F.posexplode(others).alias("r", "n")).select(
        *by, "pid", F.col("n.pid").alias("neighbor"), F.col("n.d").alias("d"), (F.col("r") + 1).alias("rank"))


def contact_graph(points: DataFrame, cutoff: float, m: int, by: Sequence[str] = ("complex",)) -> DataFrame:
    """Edges to the ``m`` nearest points at most ``cutoff`` away (ties by id)."""
    sites = points.select(*by, *XYZ).distinct()
    pairs = site_pairs(sites, _candidates(points, m, by), cutoff, by, strict=False)
    return _per_point(points, _lists(pairs, [*by, *XYZ], m + 1), m, by)


#: Cell widths that kNN chooses from: the extent of the group halved up to this many times.
LEVELS = 20


def _levels(cands: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Per site the finest level whose own cell holds ``k + 1`` candidates, 0 if none does."""
    cells = [f"__c{c}" for c in XYZ]
    every = cands.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns(_cells(_width()))
    full = every.groupBy(*by, "__level", *cells).agg(F.count("*").alias("__n")).where(F.col("__n") > k).drop("__n")
    held = every.select(*by, *XYZ, "__extent", "__level", *cells).distinct().join(full, [*by, "__level", *cells])
    sites = cands.select(*by, *XYZ, "__extent").distinct()
    best = held.groupBy(*by, *XYZ, "__extent").agg(F.max("__level").alias("__level"))
    return sites.join(best, [*by, *XYZ, "__extent"], "left").na.fill(0, ["__level"])


def _width() -> Column:
    return F.col("__extent") / F.pow(F.lit(2.0), F.col("__level"))


def knn(points: DataFrame, k: int, by: Sequence[str] = ("complex",)) -> DataFrame:
    """Exact ``k`` nearest neighbours within a group, the point itself excluded, ties by id.

    Cells follow the local density: a site starts with the finest dyadic cell that
    holds ``k + 1`` candidates, so one far point does not widen the cells of the
    others. A site is done when ``k + 1`` candidates lie within one cell width,
    since nothing nearer can be outside the 27 cells; the others try again with
    cells twice as wide, until a cell covers the group. Copies of rows at levels and
    cells are counted and sorted in shuffled parts: a small file of rows is one task.
    """
    by = list(by)
    site = [*by, *XYZ]
    span = [F.max(c) - F.min(c) for c in XYZ]
    cands = durable(_candidates(points, k, by), "knn-candidates")
    boxes = cands.groupBy(*by).agg(F.greatest(F.lit(1e-9), *span).alias("__extent"))
    todo = durable(_levels(spread(cands, *site).join(boxes, by), k, by), "knn-sites")
    cands = cands.join(boxes, by)
    cells = [f"__c{c}" for c in XYZ]
    found = []
    while used := [r[0] for r in todo.select("__level").distinct().collect()]:  # at most LEVELS + 1 numbers
        # A site asks the 27 cells around it at its level; candidates lie in one cell per level in use.
        near = cands.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in used]))).withColumns(_cells(_width())).select(
            *by, "__level", *cells, *[F.col(c).alias(f"__{c}") for c in XYZ], "__pid")
        # Spark takes the 27 copies for as small as their table and would broadcast them to one task per file.
        asked = _spread_27(todo, _width()).hint("merge").join(near, [*by, "__level", *cells])
        pairs = asked.withColumn("d", _distance()).where(F.col("d") <= _width())
        lists = _lists(pairs, [*site, "__extent", "__level"], k + 1)
        done = (F.size("near") > k) | (F.col("__level") <= -1)
        step = durable(todo.join(lists, [*site, "__extent", "__level"], "left").withColumn("__done", F.coalesce(done, F.lit(False))), "knn-round")
        found.append(step.where("__done").select(*site, "near"))
        # Level -1 is twice the extent, which covers the diagonal of the group.
        todo = step.where("not __done").select(*site, "__extent", (F.col("__level") - 1).alias("__level"))
    if not found:
        return _per_point(points, _lists(site_pairs(todo.select(*site), cands.select(*by, *XYZ, "__pid"), 1.0, by, strict=False), site, k + 1), k, by)
    lists = found[0]
    for f in found[1:]:
        lists = lists.unionByName(f)
    return _per_point(points, lists, k, by)


def knn_values(points: DataFrame, neighbors: DataFrame, cols: Sequence[str], k: int, by: Sequence[str] = ("complex",)) -> DataFrame:
    """Neighbour rows up to rank ``k`` with the neighbour's columns."""
    side = points.select(*by, F.col("pid").alias("neighbor"), *[F.col(c).alias(f"nb_{c}") for c in cols])
    return neighbors.where(F.col("rank") <= k).join(side, [*by, "neighbor"])


# ---------------------------------------------------------------- features

_ONE: Weight = lambda d: F.lit(1.0)


def _sphere(r: float) -> float:
    return 4.0 / 3.0 * math.pi * r**3


def density(points: DataFrame, radii: Sequence[float] = (5.0, 10.0, 15.0), by=("complex",)) -> DataFrame:
    out = radius_neighbors(points, radii, by)
    dens = {f"density_{r:g}": F.col(f"n_{r:g}") / _sphere(r) for r in radii}
    return out.withColumns(dens).withColumn("density_step", F.col(f"density_{radii[1]:g}") - F.col(f"density_{radii[0]:g}")).drop(*[f"n_{r:g}" for r in radii])


def class_density(points: DataFrame, radii: Sequence[float] = (5.0, 10.0), by=("complex",)) -> DataFrame:
    flagged = _flag(_flag(points, "__pos", "KRH"), "__neg", "DE")
    terms = {f"{s}_{r:g}": (within(r), f"__{s}") for s in ("pos", "neg") for r in radii}
    out = neighbor_sums(flagged, max(radii), terms, by)
    return out.withColumns({f"{s}_{r:g}": F.col(f"{s}_{r:g}") / _sphere(r) for s in ("pos", "neg") for r in radii}).drop("__pos", "__neg")


def class_shares(points: DataFrame, classes: dict[str, str], radii: Sequence[float], by=("complex",)) -> DataFrame:
    """Share of each class among neighbours ``0 < d < r``; 0 without neighbours. Serves X03, X04 and X05."""
    flagged = points
    for name, letters in classes.items():
        flagged = _flag(flagged, f"__f_{name}", letters)
    terms = {f"__n_{r:g}": (within(r), None) for r in radii} | {f"{c}_{r:g}": (within(r), f"__f_{c}") for c in classes for r in radii}
    out = neighbor_sums(flagged, max(radii), terms, by)
    shares = {f"{c}_{r:g}": ratio(F.col(f"{c}_{r:g}"), F.col(f"__n_{r:g}")) for c in classes for r in radii}
    return out.withColumns(shares).drop(*[f"__n_{r:g}" for r in radii], *[f"__f_{c}" for c in classes])


def hydro_shares(points, radii=(5.0, 10.0), by=("complex",)):
    return class_shares(points, {"nonpolar": P.NONPOLAR, "polar": P.POLAR + P.CHARGED}, radii, by)


def environment(points, radius=8.0, by=("complex",)):
    return class_shares(points, {"aromatic": P.AROMATIC, "donor": P.DONORS, "acceptor": P.ACCEPTORS, "glypro": "GP"}, (radius,), by)


def metal_potential(points, radii=(6.0, 10.0), by=("complex",)):
    return _flag(class_shares(points, {"metal": P.METAL_BINDERS}, radii, by), "intrinsic", P.METAL_BINDERS)


def centroid_distance(points: DataFrame, by=("complex",)) -> DataFrame:
    centre = points.groupBy(*by).agg(*[F.avg(c).alias(f"__{c}") for c in XYZ])
    return points.join(centre, list(by)).withColumn("center_dist", _distance()).drop("__x", "__y", "__z")


def cavity_vectors(points: DataFrame, radii: Sequence[float] = (6.0, 10.0, 14.0), by=("complex",)) -> DataFrame:
    """Unit vector from the mean of the neighbours to the point, per radius; zero without neighbours."""
    def off(r, c):
        return lambda d: F.when(d < r, F.col(f"__{c}") - F.col(c)).otherwise(0.0)

    terms = {f"__n_{r:g}": (within(r), None) for r in radii} | {f"__o{c}_{r:g}": (off(r, c), None) for r in radii for c in XYZ}
    out = neighbor_sums(points, max(radii), terms, by)
    cols: dict[str, Column] = {}
    for r in radii:
        v = tuple(-ratio(F.col(f"__o{c}_{r:g}"), F.col(f"__n_{r:g}")) for c in XYZ)
        cols |= {f"cavity_{r:g}_{c}": u for c, u in zip(XYZ, v_unit(v))}
    return out.withColumns(cols).drop(*terms)


def sidechain_centroids(atoms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the side-chain atoms of a residue, its CA where there are none."""
    side = ~F.col("atom").isin("N", "CA", "C", "O")
    mean = lambda c: F.coalesce(F.avg(F.when(side, F.col(c))), F.max(F.when(F.col("atom") == "CA", F.col(c))))
    return atoms.groupBy(*by).agg(*[mean(c).alias(c) for c in XYZ])


def packing(points: DataFrame, by=("complex",), radii: tuple[float, float] = (6.0, 10.0)) -> DataFrame:
    """Nearest other centroid, close count / 20 and ``1 - close / (near + 1e-6)``."""
    counted = radius_neighbors(points, radii, by)
    sites = points.groupBy(*by, *XYZ).agg(F.min("pid").alias("pid"))
    nearest = knn(sites, 1, by).join(sites, [*by, "pid"]).select(*by, *XYZ, F.col("d").alias("nearest"))
    c6, c10 = F.col(f"n_{radii[0]:g}"), F.col(f"n_{radii[1]:g}")
    return counted.join(nearest, [*by, *XYZ], "left").na.fill(0.0, ["nearest"]).withColumns(
        {"packing": c6 / 20.0, "void_ratio": 1.0 - c6 / (c10 + 1e-6)}).drop(f"n_{radii[0]:g}", f"n_{radii[1]:g}")


def _per_complex_max(df: DataFrame, cols: Sequence[str], by: Sequence[str], absolute: bool = False) -> DataFrame:
    """Join the largest value of each column in the group as ``__max_{c}``; the maximum is combined map-side."""
    top = df.groupBy(*by).agg(*[F.max(F.abs(F.col(c)) if absolute else F.col(c)).alias(f"__max_{c}") for c in cols])
    return df.join(top, list(by))


def depth(points: DataFrame, neighbors: DataFrame, by=("complex",), k: int = 10) -> DataFrame:
    mean = neighbors.where(F.col("rank") <= k).groupBy(*by, "pid").agg(F.avg("d").alias("depth"))
    out = _per_complex_max(points.join(mean, [*by, "pid"], "left").na.fill(0.0, ["depth"]), ["depth"], by)
    return out.withColumn("depth", F.when(F.col("__max_depth") > 0, F.col("depth") / F.col("__max_depth")).otherwise(F.col("depth"))).drop("__max_depth")


def convexity(points: DataFrame, neighbors: DataFrame, by=("complex",), k: int = 8) -> DataFrame:
    """Distance to the centroid of the ``k`` nearest (at least 3), scaled to [-1, 1] by the largest of the complex."""
    mean = knn_values(points, neighbors, XYZ, k, by).groupBy(*by, "pid").agg(*[F.avg(f"nb_{c}").alias(f"__{c}") for c in XYZ], F.count("*").alias("__k"))
    raw = points.join(mean, [*by, "pid"], "left").withColumn("convexity", F.when(F.col("__k") >= 3, _distance()).otherwise(0.0)).drop("__x", "__y", "__z", "__k")
    out = _per_complex_max(raw, ["convexity"], by)
    top = F.col("__max_convexity")
    return out.withColumn("convexity", F.when(top > 0, 2 * (F.col("convexity") / top) - 1).otherwise(F.col("convexity"))).drop("__max_convexity")


def electrostatics(points: DataFrame, charge: str, radius: float = 10.0, by=("complex",)) -> DataFrame:
    """Potential ``sum q/d`` over neighbours with d >= 0.1 and mean absolute charge including the point itself."""
    q = points.withColumn("__q", F.col(charge)).withColumn("__aq", F.abs(F.col(charge)))
    inv = lambda d: F.when(d >= 0.1, F.lit(1.0) / F.greatest(d, F.lit(0.1))).otherwise(0.0)
    out = neighbor_sums(q, radius, {"__n": (_ONE, None), "potential": (inv, "__q"), "__abs": (_ONE, "__aq")}, by, strict=False, include_self=True)
    alone = F.col("__n") <= 1
    raw = out.withColumns({"potential": F.when(alone, 0.0).otherwise(F.col("potential")), "charge_density": F.when(alone, 0.0).otherwise(F.col("__abs") / F.col("__n"))})
    top = _per_complex_max(raw, ["potential", "charge_density"], by, absolute=True)
    p, c = F.col("__max_potential"), F.col("__max_charge_density")
    return top.withColumns({
        "potential": F.when(p > 0, F.col("potential") / (p + 1e-6)).otherwise(F.col("potential")),
        "charge_density": F.when(c > 0, F.col("charge_density") / c).otherwise(F.col("charge_density")),
    }).drop("__q", "__aq", "__n", "__abs", "__max_potential", "__max_charge_density")


def polar_share(points: DataFrame, radius: float = 8.0, by=("complex",)) -> DataFrame:
    out = neighbor_sums(_flag(points, "__p", P.POLAR_SHARE), radius, {"__n": (_ONE, None), "polar_share": (_ONE, "__p")}, by, strict=False, include_self=True)
    return out.withColumn("polar_share", F.col("polar_share") / F.col("__n")).drop("__p", "__n")


def hydrophobicity(points: DataFrame, radius: float = 8.0, by=("complex",)) -> DataFrame:
    """Scaled index, share of hydrophobic points nearby, and the 1/(d+1)-weighted mean scaled per complex."""
    h = points.withColumn("__h", P.lookup("aa", P.field("hydropathy"), 0.0))
    h = h.withColumn("__hp", (F.col("__h") > 0).cast("double"))
    inv = lambda d: F.lit(1.0) / (d + 1.0)
    out = neighbor_sums(h, radius, {"__n": (_ONE, None), "hydro_share": (_ONE, "__hp"), "surface_hydro": (inv, "__h")}, by, strict=False, include_self=True)
    raw = out.withColumns({
        "hydro_index": (F.col("__h") + 4.5) / (9.0 + 1e-6),
        "hydro_share": F.col("hydro_share") / F.col("__n"),
        "surface_hydro": F.col("surface_hydro") / F.col("__n"),
    })
    span = raw.groupBy(*by).agg(F.min("surface_hydro").alias("__lo"), F.max("surface_hydro").alias("__hi"))
    scaled = (F.col("surface_hydro") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-6)
    some = (F.col("__lo") != 0) | (F.col("__hi") != 0)
    return raw.join(span, list(by)).withColumn("surface_hydro", F.when(some, scaled).otherwise(F.col("surface_hydro"))).drop("__h", "__hp", "__n", "__lo", "__hi")


def map_property(points: DataFrame, neighbors: DataFrame, prop: Column, by=("complex",), k: int = 5, radius: float = 10.0) -> DataFrame:
    """A property three ways: own value, mean of the ``k`` nearest, 1/(d+1)-weighted mean within ``radius``."""
    p = points.withColumn("map_self", prop.cast("double"))
    near = knn_values(p, neighbors, ["map_self"], k, by).groupBy(*by, "pid").agg(F.avg("nb_map_self").alias("map_knn"))
    inv = lambda d: F.lit(1.0) / (d + 1.0)
    out = neighbor_sums(p, radius, {"__n": (_ONE, None), "__w": (inv, None), "__v": (inv, "map_self")}, by, strict=False)
    return out.join(near, [*by, "pid"], "left").withColumns({
        "map_knn": F.coalesce("map_knn", "map_self"),
        "map_weighted": F.when(F.col("__n") > 0, ratio(F.col("__v"), F.col("__w"))).otherwise(F.col("map_self")),
    }).drop("__n", "__w", "__v")


def pocketness(points: DataFrame, by=("complex",)) -> DataFrame:
    out = neighbor_sums(points, 12.0, {f"__n{r}": (within(r, strict=False), None) for r in (6, 10, 12)}, by, strict=False)
    expected = 4.0 / 3.0 * math.pi * 10.0**3 / 100.0
    return out.withColumns({
        "convexity_index": F.least(F.col("__n10") / expected, F.lit(1.0)),
        "packing_density": F.least(F.col("__n6") / 15.0, F.lit(1.0)),
        "shell_ratio": F.col("__n6") / (F.col("__n12") + 1e-6),
    }).drop("__n6", "__n10", "__n12")


def smooth_environment(points: DataFrame, prop: str, radius: float = 8.0, sigma: float = 6.0, by=("complex",)) -> DataFrame:
    """Gaussian-weighted mean property, its contrast to the point, and class means around it."""
    classes = {"env_pos": "KRH", "env_neg": "DE", "env_donor": P.ENV_DONORS, "env_acceptor": P.ENV_ACCEPTORS}
    flagged = points
    for name, letters in classes.items():
        flagged = _flag(flagged, f"__f_{name}", letters)
    gauss = lambda d: F.exp(-(d * d) / (sigma * sigma))
    terms = {"__n": (_ONE, None), "__w": (gauss, None), "env_prop": (gauss, prop)} | {c: (gauss, f"__f_{c}") for c in classes}
    out = neighbor_sums(flagged, radius, terms, by, strict=False)
    some = F.col("__n") > 0
    mean = {c: F.when(some, ratio(F.col(c), F.col("__w"))).otherwise(0.0) for c in ["env_prop", *classes]}
    return out.withColumns(mean).withColumn("env_contrast", F.when(some, F.col("env_prop") - F.col(prop)).otherwise(0.0)).drop("__n", "__w", *[f"__f_{c}" for c in classes])


def flexibility(points: DataFrame, neighbors: DataFrame, b: str, area: str, by=("complex",), k: int = 8) -> DataFrame:
    """Scaled flexibility, its spread over the ``k`` nearest, and exposure times flexibility.

    Values that all lie in 0..100 are read as confidence and inverted.
    """
    span = points.groupBy(*by).agg(F.min(b).alias("__lo"), F.max(b).alias("__hi"), F.max(area).alias("__area"))
    inverted = (F.col("__lo") >= 0) & (F.col("__hi") <= 100)
    width = F.col("__hi") - F.col("__lo")
    norm = F.when(width > 0, F.when(inverted, F.col("__hi") - F.col(b)).otherwise(F.col(b) - F.col("__lo")) / width).otherwise(0.0)
    top = F.when(F.col("__area") > 0, F.col("__area")).otherwise(1.0)
    out = points.join(span, list(by)).withColumn("b_norm", norm).withColumn("exposure", F.col(area) / top * F.col("b_norm")).drop("__lo", "__hi", "__area")
    spread = knn_values(out, neighbors, ["b_norm"], k, by).groupBy(*by, "pid").agg(F.stddev_pop("nb_b_norm").alias("b_local_std"))
    return out.join(spread, [*by, "pid"], "left").na.fill(0.0, ["b_local_std"])


# Side-chain atoms that donate or accept a hydrogen bond; the
# backbone N donates and the backbone O accepts in every residue.
BOND_DONORS = {"R": ("NE", "NH1", "NH2"), "N": ("ND2",), "Q": ("NE2",), "H": ("ND1", "NE2"), "K": ("NZ",), "S": ("OG",),
               "T": ("OG1",), "W": ("NE1",), "Y": ("OH",), "C": ("SG",)}
BOND_ACCEPTORS = {"D": ("OD1", "OD2"), "E": ("OE1", "OE2"), "N": ("OD1",), "Q": ("OE1",), "H": ("ND1", "NE2"), "S": ("OG",),
                  "T": ("OG1",), "Y": ("OH",), "C": ("SG",)}


def bond_role(table: dict[str, Sequence[str]], backbone: str, letter: str = "aa", atom: str = "atom") -> Column:
    cond = F.col(atom) == backbone
    for a, names in table.items():
        cond = cond | ((F.col(letter) == a) & F.col(atom).isin(*names))
    return cond


def bond_features(atoms: DataFrame, residue: Sequence[str], by=("complex",), low: float = 2.5, high: float = 4.0, exclude_self: bool = False) -> DataFrame:
    """Donor and acceptor bond counts, donor distance statistics and flags per residue.

    Pairs inside a residue count as in the reference rule; ``exclude_self``
    takes them off by an equi-join inside the residue.
    """
    roles = atoms.withColumns({"__don": bond_role(BOND_DONORS, "N").cast("double"), "__acc": bond_role(BOND_ACCEPTORS, "O").cast("double")})
    span = lambda lo, hi: (lambda d: F.when((d > lo) & (d < hi), 1.0).otherwise(0.0))
    ranged = lambda f: (lambda d: F.when((d > low) & (d < high), f(d)).otherwise(0.0))
    terms = {
        "__a_n": (span(low, high), "__acc"), "__a_d": (ranged(lambda d: d), "__acc"), "__a_q": (ranged(lambda d: d * d), "__acc"),
        "__a_strong": (span(low, 3.0), "__acc"), "__a_weak": (span(3.5, high), "__acc"), "__d_n": (span(low, high), "__don"),
    }
    out = neighbor_sums(roles, high, terms, by, strict=True)
    if exclude_self:
        key = [*by, *[c for c in residue if c not in by]]
        other = roles.select(*key, *[F.col(c).alias(f"__{c}") for c in XYZ], F.col("__acc").alias("o_acc"), F.col("__don").alias("o_don"))
        inside = roles.select(*key, "atom", *XYZ).join(other, key).withColumn("d", _distance())
        mass = {"__acc": F.col("o_acc"), "__don": F.col("o_don")}
        own = inside.groupBy(*key, "atom").agg(*[F.sum(w(F.col("d")) * mass[p]).alias(f"s{n}") for n, (w, p) in terms.items()])
        out = out.join(own, [*key, "atom"]).withColumns({n: F.col(n) - F.col(f"s{n}") for n in terms})
    don, acc = F.col("__don"), F.col("__acc")
    g = out.groupBy(*residue).agg(
        F.sum(don * F.col("__a_n")).alias("n_donor"), F.sum(acc * F.col("__d_n")).alias("n_acceptor"),
        F.sum(don * F.col("__a_d")).alias("__d"), F.sum(don * F.col("__a_q")).alias("__q"),
        F.sum(don * F.col("__a_strong")).alias("__s"), F.sum(don * F.col("__a_weak")).alias("__w"))
    n = F.col("n_donor")
    mean = ratio(F.col("__d"), n)
    var = F.greatest(F.lit(0.0), ratio(F.col("__q"), n) - mean * mean)
    cap = lambda c: F.least(c, F.lit(1.0))
    return g.select(
        *residue, cap(n / 4.0).alias("donors"), cap(F.col("n_acceptor") / 4.0).alias("acceptors"), (mean / 4.0).alias("mean_dist"),
        (F.sqrt(var) / 4.0).alias("std_dist"), (F.col("__s") > 0).cast("double").alias("strong"), (F.col("__w") > 0).cast("double").alias("weak"),
        cap(n / 4.0).alias("partners"), cap((n + F.col("n_acceptor")) / 8.0).alias("connectivity"))


def sym3_eigenvalues(a: dict[str, Column]) -> tuple[Column, Column]:
    """Largest and smallest eigenvalue of a symmetric 3x3 matrix in closed form."""
    mean = (a["xx"] + a["yy"] + a["zz"]) / 3.0
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    dx, dy, dz = a["xx"] - mean, a["yy"] - mean, a["zz"] - mean
    p = F.sqrt((dx * dx + dy * dy + dz * dz + 2.0 * off) / 6.0)
    det = dx * (dy * dz - a["yz"] * a["yz"]) - a["xy"] * (a["xy"] * dz - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dy * a["xz"])
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), ratio(det, 2.0 * p * p * p)))
    phi = F.acos(r) / 3.0
    return mean + 2.0 * p * F.cos(phi), mean + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)


_PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def anisotropy(points: DataFrame, radius: float = 10.0, by=("complex",)) -> DataFrame:
    """``(l1 - l3)/l1`` around the neighbour mean and ``1 - lmin/lmax`` around the point; 0 below three neighbours."""
    off = lambda c: F.col(f"__{c}") - F.col(c)
    terms = {"__k": (_ONE, None)} | {f"__m{c}": ((lambda c: lambda d: off(c))(c), None) for c in XYZ}
    terms |= {f"__v{p}": ((lambda p: lambda d: off(p[0]) * off(p[1]))(p), None) for p in _PAIRS}
    out = neighbor_sums(points, radius, terms, by)
    k = F.greatest(F.col("__k"), F.lit(1.0))
    named = out.withColumns({f"__e{p}": F.col(f"__v{p}") - F.col(f"__m{p[0]}") * F.col(f"__m{p[1]}") / k for p in _PAIRS})
    l1, l3 = sym3_eigenvalues({p: F.col(f"__e{p}") for p in _PAIRS})
    s1, s3 = sym3_eigenvalues({p: F.col(f"__v{p}") for p in _PAIRS})
    stage = named.withColumns({"__l1": l1, "__l3": l3, "__s1": s1, "__s3": s3})
    enough = F.col("__k") >= 3
    return stage.withColumns({
        "anisotropy": F.when(enough & (F.col("__l1") > 1e-8), (F.col("__l1") - F.col("__l3")) / (F.col("__l1") + 1e-8)).otherwise(0.0),
        "normal_magnitude": F.when(enough & (F.col("__s1") > 1e-8), 1.0 - ratio(F.col("__s3"), F.col("__s1"))).otherwise(0.0),
    }).drop(*terms, *[f"__e{p}" for p in _PAIRS], "__l1", "__l3", "__s1", "__s3")


def frame_vectors(atoms: DataFrame, by: Sequence[str], letter: str = "aa") -> DataFrame:
    """Unit vectors per residue: side-chain base (CB or virtual CB), side-chain centre, donor and acceptor direction."""
    pick = lambda a, c: F.max(F.when(F.col("atom") == a, F.col(c)))
    side = ~F.col("atom").isin("N", "CA", "C", "O") & ~F.col("atom").startswith("H")
    g = atoms.groupBy(*by, letter).agg(
        *[pick(a, c).alias(f"{a}_{c}") for a in ("N", "CA", "C", "O", "CB") for c in XYZ],
        *[F.avg(F.when(side, F.col(c))).alias(f"S_{c}") for c in XYZ])
    ca, n, c, o, cb, s = (vec(f"{a}_") for a in ("CA", "N", "C", "O", "CB", "S"))
    # One normalisation per projection: nesting them would repeat the inner norms in every component.
    g = g.withColumns(v_named(v_unit(v_sub(ca, n)), "__a") | v_named(v_unit(v_sub(ca, c)), "__b"))
    g = g.withColumns(v_named(tuple(p + q for p, q in zip(vec("__a"), vec("__b"))), "__w"))
    g = g.withColumns(v_named(v_unit(vec("__w")), "__u"))
    s1 = g.withColumns(v_named(v_unit(v_sub(cb, ca)), "__r") | v_named(v_unit(v_scale(vec("__u"), F.lit(-1.5))), "__v"))
    real = (F.col(letter) != "G") & F.col("CB_x").isNotNull()
    virtual = F.col("N_x").isNotNull() & F.col("C_x").isNotNull()
    base = {f"base_{c}": F.when(real, F.col(f"__r{c}")).when(virtual, F.col(f"__v{c}")).otherwise(0.0) for c in XYZ}
    centre = v_unit(v_sub(s, ca))
    s2 = s1.withColumns(base).withColumns({f"center_{c}": F.when(F.col("S_x").isNotNull(), u).otherwise(F.col(f"base_{c}")) for c, u in zip(XYZ, centre)})
    carbonyl = v_unit(v_sub(o, c))
    has_co = F.col("C_x").isNotNull() & F.col("O_x").isNotNull()
    s3 = s2.withColumns(
        {f"donor_{c}": F.when(P.is_in(letter, P.DONORS), F.col(f"center_{c}")).otherwise(0.0) for c in XYZ}
        | {f"acceptor_{c}": F.when(P.is_in(letter, P.ACCEPTORS), -F.col(f"center_{c}")).when(has_co, u).otherwise(0.0) for c, u in zip(XYZ, carbonyl)})
    return s3.select(*by, letter, *[f"{v}_{c}" for v in ("base", "center", "donor", "acceptor") for c in XYZ])


def backbone_vectors(atoms: DataFrame, by: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Mean atom minus CA and the first three atoms minus CA; zero where an atom is missing."""
    ca = {c: F.max(F.when(F.col("atom") == "CA", F.col(c))) for c in XYZ}
    nth = lambda i, c: F.max(F.when(F.col(ordinal) == i, F.col(c)))
    zero = F.lit(0.0)
    return atoms.groupBy(*by).agg(
        *[F.coalesce(F.avg(c) - ca[c], zero).alias(f"mean_{c}") for c in XYZ],
        *[F.coalesce(nth(i, c) - ca[c], zero).alias(f"atom{i}_{c}") for i in range(3) for c in XYZ])


def area_shares(df: DataFrame, area: str, letter: str = "aa") -> DataFrame:
    """Total, relative, polar and apolar surface shares with exposed and buried flags."""
    a = F.col(area)
    rel = a / P.lookup(letter, P.field("max_area"), 200.0)
    polar = F.when(P.is_in(letter, P.POLAR_AREA), 0.7).otherwise(0.3)
    return df.withColumns({
        "area_total": a / 300.0, "area_rel": F.least(rel, F.lit(1.0)), "area_polar": a * polar / 200.0, "area_apolar": a * (1 - polar) / 200.0,
        "exposed": (rel > 0.5).cast("double"), "buried": (rel < 0.2).cast("double")})


def slab_flags(points: DataFrame, thickness: DataFrame, by: str = "complex", default: float = 15.0) -> DataFrame:
    """``|z|`` and whether it lies within the half thickness of the membrane slab."""
    return points.join(thickness, by, "left").withColumns({
        "abs_z": F.abs("z"), "in_slab": F.abs("z") <= F.coalesce("half_thickness", F.lit(default))})
