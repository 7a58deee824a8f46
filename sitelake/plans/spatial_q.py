"""Distance-join, contact-graph and neighbourhood queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sitelake.core import rounded as R
from sitelake.functions import residue as P
from sitelake.operators import spatial as X
from sitelake.plans import fixtures as fx
from sitelake.plans.metrics_q import round_all
from sitelake.plans.registry import query
from sitelake.plans.windows_q import TABLE_SQL, in_sql

PAIRS_SQL = fx.POINTS_SQL + """,
pr AS (SELECT a.complex, a.pid, a.chain, a.aa, a.x, a.y, a.z, a.extra, b.pid AS bpid, b.chain AS bchain, b.aa AS baa,
  b.x AS bx, b.y AS b_y, b.z AS bz, b.extra AS bextra,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM points a JOIN points b ON a.complex = b.complex AND a.pid <> b.pid)"""
KNN_SQL = PAIRS_SQL + """,
kn AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, bpid) AS rk FROM pr)"""


def sph(r):
    return 4.0 / 3.0 * math.pi * r**3


def per_point(spark, sf, df, cols, digits=6):
    return df.select("complex", "pid", *[R(c, digits).alias(c) for c in cols])


def near(spark, sf):
    """Ten nearest neighbours of every point, written once and shared by the features that need them."""
    return fx.kept(spark, sf, "knn10", lambda: X.knn(fx.points(spark, sf), 10))


def agg_sql(exprs: dict[str, str], where: str, src: str = "pr", digits: int = 6, extra: str = "", sql: str = PAIRS_SQL) -> str:
    """Per-point aggregates over pairs, zero for points without any."""
    inner = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    outer = ", ".join(f"round(coalesce(g.{n}, 0), {digits}) + 0.0 AS {n}" for n in exprs)
    return f"""WITH {sql}{extra}, g AS (SELECT pid, {inner} FROM {src} WHERE {where} GROUP BY pid)
SELECT p.complex, p.pid, {outer} FROM points p LEFT JOIN g USING (pid)"""


@query("j10_contact_labels", f"""
WITH {PAIRS_SQL} SELECT p.complex, p.chain, p.pid, CAST(EXISTS (SELECT 1 FROM pr WHERE pr.pid = p.pid AND chain <> bchain AND d <= 5.5) AS INTEGER) AS label FROM points p""")
def _(spark, sf):
    return X.contact_labels(fx.points(spark, sf), 5.5, ["complex", "chain", "pid"])


@query("j11_radius_neighbors", agg_sql({f"n_{r}": f"sum((d > 0 AND d < {r})::DOUBLE)" for r in (5, 10, 15)}, "d < 15"))
def _(spark, sf):
    return per_point(spark, sf, X.radius_neighbors(fx.points(spark, sf), [5.0, 10.0, 15.0]), ["n_5", "n_10", "n_15"])


@query("j12_knn", f"WITH {KNN_SQL} SELECT complex, pid, bpid AS neighbor, round(d, 6) AS d, CAST(rk AS INTEGER) AS rank FROM kn WHERE rk <= 10")
def _(spark, sf):
    return round_all(near(spark, sf))


@query("j12_knn_large", f"""
WITH {fx.POINTS_SQL},
pr AS (SELECT a.pid, b.pid AS bpid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM points a JOIN points b ON a.pid <> b.pid),
kn AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, bpid) AS rk FROM pr)
SELECT pid, bpid AS neighbor, round(d, 6) AS d, CAST(rk AS INTEGER) AS rank FROM kn WHERE rk <= 10""")
def _(spark, sf):
    """All points as one complex."""
    one = fx.points(spark, sf).withColumn("complex", F.lit(0))
    return round_all(X.knn(one, 10)).drop("complex")


@query("g03_contact_graph", f"WITH {KNN_SQL} SELECT complex, pid, bpid AS neighbor, round(d, 6) AS d, CAST(rk AS INTEGER) AS rank FROM kn WHERE rk <= 4 AND d <= 12")
def _(spark, sf):
    return round_all(X.contact_graph(fx.points(spark, sf), 12.0, 4))


@query("x01_density", agg_sql({
    **{f"density_{r}": f"sum((d < {r})::INT) / {sph(r)!r}::DOUBLE" for r in (5, 10, 15)},
    "density_step": f"sum((d < 10)::INT) / {sph(10)!r}::DOUBLE - sum((d < 5)::INT) / {sph(5)!r}::DOUBLE"}, "d < 15", digits=9))
def _(spark, sf):
    return per_point(spark, sf, X.density(fx.points(spark, sf)), ["density_5", "density_10", "density_15", "density_step"], 9)


@query("x02_class_density", agg_sql({
    f"{s}_{r}": f"sum((d < {r} AND {in_sql('baa', letters)})::INT) / {sph(r)!r}::DOUBLE" for s, letters in (("pos", "KRH"), ("neg", "DE")) for r in (5, 10)}, "d < 10", digits=9))
def _(spark, sf):
    return per_point(spark, sf, X.class_density(fx.points(spark, sf)), ["pos_5", "pos_10", "neg_5", "neg_10"], 9)


def share_exprs(classes, radii):
    return {f"{c}_{r}": f"coalesce(sum((d < {r} AND {in_sql('baa', m)})::INT)::DOUBLE / nullif(sum((d < {r})::INT), 0), 0)" for c, m in classes.items() for r in radii}


@query("x03_hydro_shares", agg_sql(share_exprs({"nonpolar": P.NONPOLAR, "polar": P.POLAR + P.CHARGED}, (5, 10)), "d < 10"))
def _(spark, sf):
    return per_point(spark, sf, X.hydro_shares(fx.points(spark, sf)), ["nonpolar_5", "nonpolar_10", "polar_5", "polar_10"])


@query("x04_environment", agg_sql(share_exprs({"aromatic": P.AROMATIC, "donor": P.DONORS, "acceptor": P.ACCEPTORS, "glypro": "GP"}, (8,)), "d < 8"))
def _(spark, sf):
    return per_point(spark, sf, X.environment(fx.points(spark, sf)), ["aromatic_8", "donor_8", "acceptor_8", "glypro_8"])


@query("x05_metal_potential", f"""
WITH m AS ({agg_sql(share_exprs({"metal": P.METAL_BINDERS}, (6, 10)), "d < 10")}), {fx.POINTS_SQL}
SELECT m.*, ({in_sql('aa', P.METAL_BINDERS)})::DOUBLE AS intrinsic FROM m JOIN points USING (complex, pid)""")
def _(spark, sf):
    return per_point(spark, sf, X.metal_potential(fx.points(spark, sf)), ["metal_6", "metal_10", "intrinsic"])


@query("x06_centroid_distance", f"""
WITH {fx.POINTS_SQL}, c AS (SELECT complex, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY complex)
SELECT complex, pid, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 6) AS center_dist FROM points JOIN c USING (complex)""")
def _(spark, sf):
    return per_point(spark, sf, X.centroid_distance(fx.points(spark, sf)), ["center_dist"])


CAV = [f"cavity_{r}_{c}" for r in (6, 10, 14) for c in "xyz"]


def cavity_sql():
    b = {"x": "bx", "y": "b_y", "z": "bz"}
    means = ", ".join(f"any_value({c}) - avg({b[c]}) FILTER (d < {r}) AS v{r}{c}" for r in (6, 10, 14) for c in "xyz")
    norm = lambda r: f"sqrt(v{r}x * v{r}x + v{r}y * v{r}y + v{r}z * v{r}z)"
    out = ", ".join(f"round(coalesce(CASE WHEN {norm(r)} > 1e-8 THEN v{r}{c} / ({norm(r)} + 1e-8) ELSE 0 END, 0), 5) + 0.0 AS cavity_{r}_{c}" for r in (6, 10, 14) for c in "xyz")
    return f"WITH {PAIRS_SQL}, g AS (SELECT pid, {means} FROM pr WHERE d < 14 GROUP BY pid) SELECT p.complex, p.pid, {out} FROM points p LEFT JOIN g USING (pid)"


@query("x07_cavity_vectors", cavity_sql())
def _(spark, sf):
    return per_point(spark, sf, X.cavity_vectors(fx.points(spark, sf)), CAV, 5)


CENTROID_SQL = fx.ATOMS_SQL + """,
cen AS (SELECT complex, pid, """ + ", ".join(
    f"coalesce(avg({c}) FILTER (atom NOT IN ('N', 'CA', 'C', 'O')), max({c}) FILTER (atom = 'CA')) AS {c}" for c in "xyz") + """ FROM atoms GROUP BY complex, pid),
cp AS (SELECT a.complex, a.pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM cen a JOIN cen b ON a.complex = b.complex AND a.pid <> b.pid)"""


@query("x08_packing", f"""
WITH {CENTROID_SQL}
SELECT complex, pid, round(min(d) FILTER (d > 0), 6) AS nearest, round(sum((d < 6)::INT) / 20.0::DOUBLE, 6) AS packing,
  round(1 - sum((d < 6)::INT) / (sum((d < 10)::INT) + 1e-6::DOUBLE), 6) AS void_ratio FROM cp GROUP BY complex, pid""")
def _(spark, sf):
    cen = X.sidechain_centroids(fx.atoms(spark, sf), ["complex", "pid"])
    return per_point(spark, sf, X.packing(cen), ["nearest", "packing", "void_ratio"])


@query("x09_depth", f"""
WITH {KNN_SQL}, m AS (SELECT complex, pid, avg(d) AS v FROM kn WHERE rk <= 10 GROUP BY complex, pid)
SELECT complex, pid, round(v / max(v) OVER (PARTITION BY complex), 6) AS depth FROM m""")
def _(spark, sf):
    return per_point(spark, sf, X.depth(fx.points(spark, sf), near(spark, sf)), ["depth"])


@query("x10_convexity", f"""
WITH {KNN_SQL}, m AS (SELECT complex, pid, sqrt(power(avg(bx) - any_value(x), 2) + power(avg(b_y) - any_value(y), 2) + power(avg(bz) - any_value(z), 2)) AS v
  FROM kn WHERE rk <= 8 GROUP BY complex, pid)
SELECT complex, pid, round(2 * (v / max(v) OVER (PARTITION BY complex)) - 1, 6) + 0.0 AS convexity FROM m""")
def _(spark, sf):
    return per_point(spark, sf, X.convexity(fx.points(spark, sf), near(spark, sf)), ["convexity"])


# Residue charges used by the electrostatic feature.
CHARGES = {"D": -1.0, "E": -1.0, "H": 0.5, "K": 1.0, "R": 1.0}
CHARGE_SQL = "CASE {c} " + " ".join(f"WHEN '{a}' THEN {v}::DOUBLE" for a, v in CHARGES.items()) + " ELSE 0::DOUBLE END"


@query("x11_electrostatics", f"""
WITH {PAIRS_SQL}, n AS (SELECT pid, count(*) AS k, sum(CASE WHEN d >= 0.1 THEN {CHARGE_SQL.format(c='baa')} / d ELSE 0 END) AS pot,
  sum(abs({CHARGE_SQL.format(c='baa')})) AS s FROM pr WHERE d <= 10 GROUP BY pid),
v AS (SELECT p.complex, p.pid, coalesce(pot, 0) AS pot, CASE WHEN k IS NULL THEN 0 ELSE (s + abs({CHARGE_SQL.format(c='p.aa')})) / (k + 1) END AS den FROM points p LEFT JOIN n USING (pid))
SELECT complex, pid, round(CASE WHEN max(abs(pot)) OVER w > 0 THEN pot / (max(abs(pot)) OVER w + 1e-6) ELSE pot END, 6) + 0.0 AS potential,
  round(CASE WHEN max(den) OVER w > 0 THEN den / max(den) OVER w ELSE den END, 6) AS charge_density FROM v WINDOW w AS (PARTITION BY complex)""")
def _(spark, sf):
    pts = fx.points(spark, sf).withColumn("q", P.lookup("aa", CHARGES, 0.0))
    return per_point(spark, sf, X.electrostatics(pts, "q"), ["potential", "charge_density"])


@query("x12_polar_share", f"""
WITH {PAIRS_SQL}, n AS (SELECT pid, count(*) AS k, sum(({in_sql('baa', P.POLAR_SHARE)})::INT) AS s FROM pr WHERE d <= 8 GROUP BY pid)
SELECT p.complex, p.pid, round((coalesce(s, 0) + ({in_sql('p.aa', P.POLAR_SHARE)})::INT)::DOUBLE / (coalesce(k, 0) + 1), 6) AS polar_share FROM points p LEFT JOIN n USING (pid)""")
def _(spark, sf):
    return per_point(spark, sf, X.polar_share(fx.points(spark, sf)), ["polar_share"])


@query("x13_hydrophobicity", f"""
WITH {PAIRS_SQL}, {TABLE_SQL}, h AS (SELECT pr.pid, d, t.hydropathy AS bh FROM pr JOIN tab t ON t.aa = pr.baa WHERE d <= 8),
n AS (SELECT pid, count(*) AS k, sum((bh > 0)::INT) AS s, sum(bh / (d + 1)) AS w FROM h GROUP BY pid),
v AS (SELECT p.complex, p.pid, (hydropathy + 4.5) / (9 + 1e-6) AS hydro_index, (coalesce(s, 0) + (hydropathy > 0)::INT)::DOUBLE / (coalesce(k, 0) + 1) AS hydro_share,
  (coalesce(w, 0) + hydropathy) / (coalesce(k, 0) + 1) AS u FROM points p JOIN tab t ON t.aa = p.aa LEFT JOIN n USING (pid))
SELECT complex, pid, round(hydro_index, 6) AS hydro_index, round(hydro_share, 6) AS hydro_share,
  round((u - min(u) OVER w) / (max(u) OVER w - min(u) OVER w + 1e-6), 6) AS surface_hydro FROM v WINDOW w AS (PARTITION BY complex)""")
def _(spark, sf):
    return per_point(spark, sf, X.hydrophobicity(fx.points(spark, sf)), ["hydro_index", "hydro_share", "surface_hydro"])


@query("x14_map_property", f"""
WITH {KNN_SQL}, {TABLE_SQL}, k5 AS (SELECT pid, avg(t.volume) AS m FROM kn JOIN tab t ON t.aa = baa WHERE rk <= 5 GROUP BY pid),
r AS (SELECT pid, sum(t.volume / (d + 1)) / sum(1 / (d + 1)) AS w FROM pr JOIN tab t ON t.aa = baa WHERE d <= 10 GROUP BY pid)
SELECT p.complex, p.pid, t.volume AS map_self, round(coalesce(m, t.volume), 6) AS map_knn, round(coalesce(w, t.volume), 6) AS map_weighted
FROM points p JOIN tab t ON t.aa = p.aa LEFT JOIN k5 USING (pid) LEFT JOIN r USING (pid)""")
def _(spark, sf):
    out = X.map_property(fx.points(spark, sf), near(spark, sf), P.lookup("aa", P.field("volume"), 0.0))
    return per_point(spark, sf, out, ["map_self", "map_knn", "map_weighted"])


@query("x15_pocketness", agg_sql({
    "convexity_index": f"least(1, sum((d <= 10)::INT) / {4.0 / 3.0 * math.pi * 10.0**3 / 100.0!r}::DOUBLE)",
    "packing_density": "least(1, sum((d <= 6)::INT) / 15.0::DOUBLE)",
    "shell_ratio": "sum((d <= 6)::INT) / (sum((d <= 12)::INT) + 1e-6::DOUBLE)"}, "d <= 12"))
def _(spark, sf):
    return per_point(spark, sf, X.pocketness(fx.points(spark, sf)), ["convexity_index", "packing_density", "shell_ratio"])


def env_sql():
    g = "exp(-(d * d) / 36.0::DOUBLE)"
    cls = {"env_pos": "KRH", "env_neg": "DE", "env_donor": P.ENV_DONORS, "env_acceptor": P.ENV_ACCEPTORS}
    return agg_sql({
        "env_prop": f"sum({g} * bextra) / sum({g})", "env_contrast": f"sum({g} * bextra) / sum({g}) - any_value(extra)",
        **{c: f"sum({g} * ({in_sql('baa', m)})::INT) / sum({g})" for c, m in cls.items()}}, "d <= 8")


@query("x16_smooth_environment", env_sql())
def _(spark, sf):
    out = X.smooth_environment(fx.points(spark, sf), "extra")
    return per_point(spark, sf, out, ["env_prop", "env_contrast", "env_pos", "env_neg", "env_donor", "env_acceptor"])


@query("x17_flexibility", f"""
WITH {KNN_SQL}, s AS (SELECT *, abs(extra) AS b, abs(x) AS area FROM points),
v AS (SELECT complex, pid, area / max(area) OVER w AS e, CASE WHEN min(b) OVER w >= 0 AND max(b) OVER w <= 100 THEN (max(b) OVER w - b) / (max(b) OVER w - min(b) OVER w)
  ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END AS nb FROM s WINDOW w AS (PARTITION BY complex)),
k AS (SELECT kn.pid, stddev_pop(v.nb) AS sd FROM kn JOIN v ON v.pid = kn.bpid WHERE rk <= 8 GROUP BY kn.pid)
SELECT complex, pid, round(nb, 6) AS b_norm, round(coalesce(sd, 0), 6) AS b_local_std, round(e * nb, 6) AS exposure FROM v LEFT JOIN k USING (pid)""")
def _(spark, sf):
    pts = fx.points(spark, sf).withColumns({"b": F.abs("extra"), "area": F.abs("x")})
    return per_point(spark, sf, X.flexibility(pts, near(spark, sf), "b", "area"), ["b_norm", "b_local_std", "exposure"])


def role_sql(table, backbone, p):
    return f"({p}atom = '{backbone}' OR " + " OR ".join(f"({p}aa = '{a}' AND {in_sql(p + 'atom', n)})" for a, n in table.items()) + ")"


BONDS = ["donors", "acceptors", "mean_dist", "std_dist", "strong", "weak", "partners", "connectivity"]


def bond_sql(pairs):
    return f"""
WITH {fx.ATOMS_SQL}, s AS (SELECT complex, pid, atom, aa, x / 4 AS x, y / 4 AS y, z / 4 AS z FROM atoms),
q AS (SELECT a.pid, b.pid AS other, {role_sql(X.BOND_DONORS, 'N', 'a.')} AS adon, {role_sql(X.BOND_ACCEPTORS, 'O', 'a.')} AS aacc,
  {role_sql(X.BOND_DONORS, 'N', 'b.')} AS bdon, {role_sql(X.BOND_ACCEPTORS, 'O', 'b.')} AS bacc,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM s a JOIN s b ON a.complex = b.complex),
g AS (SELECT pid, count(*) FILTER (adon AND bacc) AS nd, count(*) FILTER (aacc AND bdon) AS na, avg(d) FILTER (adon AND bacc) AS m,
  stddev_pop(d) FILTER (adon AND bacc) AS sd, count(*) FILTER (adon AND bacc AND d < 3) AS st, count(*) FILTER (adon AND bacc AND d > 3.5) AS wk
  FROM q WHERE d > 2.5 AND d < 4 AND {pairs} GROUP BY pid)
SELECT p.complex, p.pid, least(1, coalesce(nd, 0) / 4.0::DOUBLE) AS donors, least(1, coalesce(na, 0) / 4.0::DOUBLE) AS acceptors, round(coalesce(m, 0) / 4, 6) AS mean_dist,
  round(coalesce(sd, 0) / 4, 6) AS std_dist, (coalesce(st, 0) > 0)::DOUBLE AS strong, (coalesce(wk, 0) > 0)::DOUBLE AS weak, least(1, coalesce(nd, 0) / 4.0::DOUBLE) AS partners,
  least(1, (coalesce(nd, 0) + coalesce(na, 0)) / 8.0::DOUBLE) AS connectivity FROM (SELECT DISTINCT complex, pid FROM atoms) p LEFT JOIN g USING (pid)"""


def bonds(spark, sf, exclude_self):
    atoms = fx.atoms(spark, sf).withColumns({c: F.col(c) / 4 for c in "xyz"})
    return per_point(spark, sf, X.bond_features(atoms, ["complex", "pid"], exclude_self=exclude_self), BONDS)


@query("x18_bond_features", bond_sql("true"))
def _(spark, sf):
    return bonds(spark, sf, False)


@query("x18_without_self", bond_sql("pid <> other"))
def _(spark, sf):
    """Pairs inside a residue taken off."""
    return bonds(spark, sf, True)


@query("x19_anisotropy")
def _(spark, sf):
    return per_point(spark, sf, X.anisotropy(fx.points(spark, sf)), ["anisotropy", "normal_magnitude"])


FRAMES = [f"{v}_{c}" for v in ("base", "center", "donor", "acceptor") for c in "xyz"]


def frame_sql():
    def unit(p):
        n = f"sqrt({p}x * {p}x + {p}y * {p}y + {p}z * {p}z)"
        return lambda c: f"CASE WHEN {n} > 1e-8 THEN {p}{c} / ({n} + 1e-8) ELSE 0 END"

    names = ("N", "CA", "C", "O", "CB")
    g = ", ".join(f"max({c}) FILTER (atom = '{a}') AS {a}_{c}" for a in names for c in "xyz") + ", " + ", ".join(
        f"avg({c}) FILTER (atom NOT IN ('N', 'CA', 'C', 'O')) AS s_{c}" for c in "xyz")
    d = ", ".join(f"CA_{c} - N_{c} AS a{c}, CA_{c} - C_{c} AS b{c}, CB_{c} - CA_{c} AS r{c}, s_{c} - CA_{c} AS m{c}, O_{c} - C_{c} AS k{c}" for c in "xyz").replace("AS by", "AS b_y")
    fix = lambda t: t.replace("by", "b_y")
    bis = ", ".join(fix(f"({unit('a')(c)}) + ({unit('b')(c)}) AS w{c}") for c in "xyz")
    neg = ", ".join(f"-1.5 * ({unit('w')(c)}) AS v{c}" for c in "xyz")
    base = ", ".join(f"CASE WHEN aa <> 'G' AND rx IS NOT NULL THEN {unit('r')(c)} ELSE {unit('v')(c)} END AS base_{c}" for c in "xyz")
    cen = ", ".join(f"CASE WHEN mx IS NOT NULL THEN {unit('m')(c)} ELSE base_{c} END AS center_{c}" for c in "xyz")
    out = ", ".join(f"round(base_{c}, 5) + 0.0 AS base_{c}, round(center_{c}, 5) + 0.0 AS center_{c}, round(CASE WHEN {in_sql('aa', P.DONORS)} THEN center_{c} ELSE 0 END, 5) + 0.0 AS donor_{c}, "
                    f"round(CASE WHEN {in_sql('aa', P.ACCEPTORS)} THEN -center_{c} ELSE {unit('k')(c)} END, 5) + 0.0 AS acceptor_{c}" for c in "xyz")
    return f"""WITH {fx.ATOMS_SQL}, g AS (SELECT complex, pid, aa, {g} FROM atoms GROUP BY ALL), d AS (SELECT *, {d} FROM g), w AS (SELECT *, {bis} FROM d),
    v AS (SELECT *, {neg} FROM w), b AS (SELECT *, {base} FROM v), c AS (SELECT *, {cen} FROM b) SELECT complex, pid, {out} FROM c"""


@query("x20_frame_vectors", frame_sql())
def _(spark, sf):
    return per_point(spark, sf, X.frame_vectors(fx.atoms(spark, sf), ["complex", "pid"]), FRAMES, 5)


BACK = [f"{n}_{c}" for n in ("mean", "atom0", "atom1", "atom2") for c in "xyz"]


@query("x21_backbone_vectors", f"""
WITH {fx.ATOMS_SQL}, g AS (SELECT complex, pid, {', '.join(f"avg({c}) AS m{c}, max({c}) FILTER (atom = 'CA') AS a{c}, " + ', '.join(f"max({c}) FILTER (ordinal = {i}) AS o{i}{c}" for i in range(3)) for c in 'xyz')} FROM atoms GROUP BY complex, pid)
SELECT complex, pid, {', '.join(f"round(coalesce(m{c} - a{c}, 0), 6) + 0.0 AS mean_{c}, " + ', '.join(f"round(coalesce(o{i}{c} - a{c}, 0), 6) + 0.0 AS atom{i}_{c}" for i in range(3)) for c in 'xyz')} FROM g""")
def _(spark, sf):
    return per_point(spark, sf, X.backbone_vectors(fx.atoms(spark, sf), ["complex", "pid"]), BACK)


AREAS = ["area_total", "area_rel", "area_polar", "area_apolar", "exposed", "buried"]


@query("x22_area_shares", f"""
WITH {fx.POINTS_SQL}, {TABLE_SQL}, s AS (SELECT complex, pid, p.aa, abs(extra) * 4 AS a, abs(extra) * 4 / max_area AS rel,
  CASE WHEN {in_sql('p.aa', P.POLAR_AREA)} THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS q FROM points p JOIN tab t ON t.aa = p.aa)
SELECT complex, pid, round(a / 300, 6) AS area_total, round(least(1, rel), 6) AS area_rel, round(a * q / 200, 6) AS area_polar, round(a * (1 - q) / 200, 6) AS area_apolar,
  (rel > 0.5)::DOUBLE AS exposed, (rel < 0.2)::DOUBLE AS buried FROM s""")
def _(spark, sf):
    pts = fx.points(spark, sf).withColumn("area", F.abs("extra") * 4)
    return per_point(spark, sf, X.area_shares(pts, "area"), AREAS)


@query("x23_slab_flags", f"""
WITH {fx.POINTS_SQL}, t AS (SELECT complex, max(abs(z)) / 2 AS h FROM points GROUP BY complex HAVING avg(x) > 0)
SELECT complex, pid, round(abs(z), 6) AS abs_z, abs(z) <= coalesce(h, 15) AS in_slab FROM points LEFT JOIN t USING (complex)""")
def _(spark, sf):
    pts = fx.points(spark, sf)
    t = pts.groupBy("complex").agg((F.max(F.abs("z")) / 2).alias("half_thickness"), F.avg("x").alias("m")).where("m > 0").drop("m")
    return X.slab_flags(pts, t).select("complex", "pid", R("abs_z").alias("abs_z"), "in_slab")
