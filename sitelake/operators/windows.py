"""Ordered windows over residues (W01-W16) and position features.

Frames of a few residues run in blocks with a halo (``with_halo``), so neither a
long chain nor a large complex needs one task. Frame sums come from running sums
inside a block: the cost per row does not grow with the window size. Sums that
feed a result exactly are kept in integers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, frame_sum, halo_rows, ratio, require_empty, running_totals, with_halo
from sitelake.functions.residue import GROUPS, LETTERS, field, is_in, lookup

_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
_SO_FAR = (Window.unboundedPreceding, 0)


def relative(pos: Column, n: Column) -> Column:
    """``pos / max(1, n - 1)``."""
    return pos / F.greatest(F.lit(1), n - 1)


def local_position(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based position in the chain, chain length and relative position, from any sortable order."""
    ranked = running_totals(df, by=by, order=order, rank="__rn")
    sizes = df.groupBy(*by).agg(F.count("*").alias("chain_len"))
    local = F.col("__rn") - 1
    return ranked.join(sizes, list(by)).select(
        *df.columns, local.alias("local_pos"), "chain_len", relative(local, F.col("chain_len")).alias("rel_pos"))


def ordinal_encode(df: DataFrame, col: str, by: Sequence[str], order: str) -> DataFrame:
    """Ordinal of each value by first appearance (0,1,2,...) and its rank divided by ``max(1, n - 1)``."""
    first = df.groupBy(*by, col).agg(F.min(order).alias("first_row"))
    ranked = running_totals(first, by=by, order=["first_row"], rank="__rn")
    sizes = first.groupBy(*by).agg(F.count("*").alias("n_values"))
    code = F.col("__rn") - 1
    return ranked.join(sizes, list(by)).select(
        *by, col, "first_row", "n_values", code.alias("ordinal"), relative(code, F.col("n_values")).alias("ordinal_norm"))


def rolling_moments(df: DataFrame, cols: Sequence[str], sizes: Sequence[int], by: Sequence[str], pos: str) -> DataFrame:
    """Truncated centred mean and population deviation of **integer** columns, exact.

    Adds ``win{w}_{col}_mean`` and ``win{w}_{col}_std`` in the units of the column.
    """

    def build(spread: DataFrame, w) -> DataFrame:
        so_far, whole = w.rowsBetween(*_SO_FAR), w.rowsBetween(*_WHOLE)
        sums: dict[str, Column] = {"__pn": F.count("*").over(so_far), "__tn": F.count("*").over(whole)}
        for c in cols:
            v = F.col(c).cast("long")
            sums |= {f"__p_{c}": F.sum(v).over(so_far), f"__t_{c}": F.sum(v).over(whole),
                     f"__q_{c}": F.sum(v * v).over(so_far), f"__u_{c}": F.sum(v * v).over(whole)}
        run = spread.withColumns(sums)
        frames: dict[str, Column] = {}
        for size in sizes:
            r = size // 2
            frames[f"__n{size}"] = frame_sum("__pn", "__tn", r, w)
            for c in cols:
                frames[f"__s{size}_{c}"] = frame_sum(f"__p_{c}", f"__t_{c}", r, w)
                frames[f"__z{size}_{c}"] = frame_sum(f"__q_{c}", f"__u_{c}", r, w)
        framed = run.withColumns(frames)
        out: dict[str, Column] = {}
        for size in sizes:
            n = F.col(f"__n{size}")
            for c in cols:
                s, z = F.col(f"__s{size}_{c}"), F.col(f"__z{size}_{c}")
                out[f"win{size}_{c}_mean"] = s / n
                out[f"win{size}_{c}_std"] = F.sqrt((n * z - s * s).cast("double")) / n
        return framed.select(*spread.columns, *[v.alias(k) for k, v in out.items()])

    return with_halo(df, by, pos, max(sizes) // 2, build)


# Decimal property tables as integers: value * factor.
_PROPERTY_UNITS = {"hydropathy": 10, "charge": 10, "mass": 100, "volume": 10}


def _layout(largest: dict[str, int], rows: int) -> dict[str, tuple[int, int, int]]:
    """Column, first bit and bits of each field, so that sums over ``rows`` rows fit next to each other in BIGINTs."""
    used: list[int] = []
    out = {}
    for name, most in sorted(largest.items(), key=lambda x: -x[1]):
        bits = max(1, (most * rows).bit_length())
        if bits > 63:
            raise DataContractError(f"windows over {rows} rows are too wide for packed sums")
        k = next((i for i, u in enumerate(used) if u + bits <= 63), len(used))
        if k == len(used):
            used.append(0)
        out[name] = (k, used[k], bits)
        used[k] += bits
    return out


def rolling_stats(df: DataFrame, sizes: Sequence[int] = (7, 15, 31), by: Sequence[str] = ("complex",), pos: str = "ord",
                  letter: str = "aa") -> DataFrame:
    """Scaled window mean and deviation of hydropathy, charge, mass and volume.

    The frame runs over the whole complex by default and so crosses chains; pass
    the chain in ``by`` to stop at its ends. Unknown letters count as 0. A letter
    stands for a few BIGINTs that hold all its values and squares; only those are
    summed and looked up, and the frame's size follows from the positions.
    """
    tables, low = {}, {}
    for p, f in _PROPERTY_UNITS.items():
        ints = {a: round(v * f) for a, v in field(p).items()}
        low[p] = min(0, *ints.values())
        tables[f"{p}_s"] = ({a: v - low[p] for a, v in ints.items()}, -low[p])  # from 0 up: fields must not borrow
        tables[f"{p}_q"] = ({a: v * v for a, v in ints.items()}, 0)
    layout = _layout({n: max(*t.values(), d) for n, (t, d) in tables.items()}, halo_rows(max(sizes) // 2))
    longs = range(1 + max(k for k, _, _ in layout.values()))
    at = lambda k, value: sum(value(*tables[n]) << first for n, (c, first, _) in layout.items() if c == k)
    packed = {f"__k{k}": lookup(letter, {a: at(k, lambda t, d, a=a: t.get(a, d)) for a in LETTERS}, at(k, lambda t, d: d)).cast("long") for k in longs}
    shift_scale = {"hydropathy": (4.5, 9.0), "charge": (1.0, 2.0), "mass": (-75.0, 130.0), "volume": (-60.0, 168.0)}

    def build(spread: DataFrame, w) -> DataFrame:
        so_far, whole = w.rowsBetween(*_SO_FAR), w.rowsBetween(*_WHOLE)
        run = spread.withColumns(packed).withColumns(
            {f"{k}_p": F.sum(k).over(so_far) for k in packed} | {f"{k}_t": F.sum(k).over(whole) for k in packed}
            | {"__from": F.min(pos).over(whole), "__to": F.max(pos).over(whole)})
        framed = run.withColumns({f"{k}_{size}": frame_sum(f"{k}_p", f"{k}_t", size // 2, w) for size in sizes for k in packed})
        out = []
        for size in sizes:
            r = size // 2
            n = F.least(F.col(pos) + r, F.col("__to")) - F.greatest(F.col(pos) - r, F.col("__from")) + 1

            def total(name: str) -> Column:
                k, first, bits = layout[name]
                return F.shiftright(F.col(f"__k{k}_{size}"), first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

            for p, unit in _PROPERTY_UNITS.items():
                shift, scale = shift_scale[p]
                s, z = total(f"{p}_s") + n * low[p], total(f"{p}_q")
                out.append(((s / n / unit + shift) / scale).alias(f"win{size}_{p}_mean"))
                out.append((F.sqrt((n * z - s * s).cast("double")) / n / unit / scale).alias(f"win{size}_{p}_std"))
        return framed.select(*spread.columns, *out)

    return with_halo(df, by, pos, max(sizes) // 2, build)


def rolling_mean_strict(df: DataFrame, cols: Sequence[str], sizes: Sequence[int] = (3, 5, 7, 9), sentinel: float = 0.11111111,
                        by: Sequence[str] = ("chain",), pos: str = "pos") -> DataFrame:
    """Centred mean over complete frames only; an incomplete frame gives ``sentinel``."""

    def build(spread: DataFrame, w) -> DataFrame:
        out = {}
        for size in sizes:
            frame = w.rowsBetween(-(size // 2), size // 2)
            for c in cols:
                whole = F.count(c).over(frame) == size
                out[f"{size}_wm_{c}"] = F.when(whole, F.avg(c).over(frame)).otherwise(F.lit(sentinel))
        return spread.withColumns(out)

    return with_halo(df, by, pos, max(sizes) // 2, build)


def _field_bits(rows: int) -> int:
    """Bits of a packed letter count: four counts to a BIGINT while a window group stays below 2^14 rows, else two."""
    if rows >= 1 << 31:
        raise DataContractError(f"windows over {rows} rows are too wide for packed counts")
    return 14 if rows < 1 << 14 else 31


def _packed(letter: str, bits: int) -> dict[str, Column]:
    out, per = {}, 62 // bits
    for g in range(0, len(LETTERS), per):
        out[f"__k{g // per}"] = lookup(letter, {a: 1 << (bits * i) for i, a in enumerate(LETTERS[g:g + per])}, 0).cast("long")
    return out


def _window_letter_counts(df: DataFrame, sizes: Sequence[int], by: Sequence[str], pos: str, letter: str, finish) -> DataFrame:
    bits = _field_bits(halo_rows(max(sizes) // 2))
    per = 62 // bits

    def build(spread: DataFrame, w) -> DataFrame:
        packed = _packed(letter, bits)
        so_far, whole = w.rowsBetween(*_SO_FAR), w.rowsBetween(*_WHOLE)
        run = spread.withColumns(packed).withColumns(
            {f"{k}_p": F.sum(k).over(so_far) for k in packed} | {f"{k}_t": F.sum(k).over(whole) for k in packed})
        framed = run.withColumns({f"{k}_{size}": frame_sum(f"{k}_p", f"{k}_t", size // 2, w) for size in sizes for k in packed})
        counts = {}
        for size in sizes:
            for i, a in enumerate(LETTERS):
                counts[f"__c{size}_{a}"] = F.shiftright(F.col(f"__k{i // per}_{size}"), bits * (i % per)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        counted = framed.select(*spread.columns, *[v.alias(k) for k, v in counts.items()])
        return counted.select(*spread.columns, *[c for size in sizes for c in finish(size, {a: F.col(f"__c{size}_{a}") for a in LETTERS})])

    return with_halo(df, by, pos, max(sizes) // 2, build)


def _entropy(counts: dict[str, Column], size: int) -> Column:
    """Sum of ``p ln(p + 1e-12)``; counts of a small frame take their term from a table of all of them."""
    if size > 64:
        n = F.greatest(F.lit(1), sum(counts.values(), F.lit(0)))
        each = (F.when(c > 0, c / n * F.log(c / n + F.lit(1e-12))).otherwise(F.lit(0.0)) for c in counts.values())
        return -sum(each, F.lit(0.0)) / math.log(20.0)
    terms = [0.0] * (size + 1)
    for n in range(1, size + 1):
        terms += [c / n * math.log(c / n + 1e-12) if 0 < c <= n else 0.0 for c in range(size + 1)]
    table = F.lit(terms)
    row = sum(counts.values(), F.lit(0)) * (size + 1)
    return -sum((F.get(table, (row + c).cast("int")) for c in counts.values()), F.lit(0.0)) / math.log(20.0)


def rolling_entropy(df: DataFrame, sizes: Sequence[int] = (7, 15, 31), by: Sequence[str] = ("complex",), pos: str = "ord", letter: str = "aa") -> DataFrame:
    """Shannon entropy of the valid letters in a centred frame, divided by ln 20; 0 without any."""
    return _window_letter_counts(df, sizes, by, pos, letter, lambda size, c: [_entropy(c, size).alias(f"win{size}_entropy")])


def rolling_class_share(df: DataFrame, sizes: Sequence[int] = (5, 9, 17, 33), by: Sequence[str] = ("complex",), pos: str = "ord",
                        letter: str = "aa", entropy: bool = False) -> DataFrame:
    """Share of each residue class and of the most frequent letter among valid letters of a frame."""

    def finish(size, counts):
        n = F.greatest(F.lit(1), sum(counts.values(), F.lit(0)))
        shares = [(sum((counts[a] for a in m), F.lit(0)) / n).alias(f"win{size}_frac_{g}") for g, m in GROUPS.items()]
        extra = [_entropy(counts, size).alias(f"win{size}_aa_entropy")] if entropy else []
        return [*shares, *extra, (F.greatest(*counts.values()) / n).alias(f"win{size}_max_aa_frac")]

    return _window_letter_counts(df, sizes, by, pos, letter, finish)


def rolling_moment(df: DataFrame, degrees: Sequence[int] = (100, 160), sizes: Sequence[int] = (9, 17, 33),
                   by: Sequence[str] = ("complex",), pos: str = "ord", letter: str = "aa") -> DataFrame:
    """Hydrophobic moment of a centred frame, at most 1.

    Restarting the angle at each frame start only turns the vector sum, so its
    length can be taken from angles counted along the whole sequence.
    """
    h = lookup(letter, field("hydropathy"), 0.0)
    valid = is_in(letter, LETTERS).cast("long")

    def build(spread: DataFrame, w) -> DataFrame:
        cols = {"__v": valid}
        for d in degrees:
            angle = F.radians((F.pmod(F.col(pos), F.lit(360)) * d).cast("double"))
            cols |= {f"__x{d}": h * F.cos(angle), f"__y{d}": h * F.sin(angle)}
        spread2 = spread.withColumns(cols)
        out = {}
        for size in sizes:
            frame = w.rowsBetween(-(size // 2), size // 2)
            n = F.sum("__v").over(frame)
            for d in degrees:
                x, y = F.sum(f"__x{d}").over(frame), F.sum(f"__y{d}").over(frame)
                out[f"win{size}_moment_{d}"] = F.least(F.lit(1.0), ratio(F.sqrt(x * x + y * y), n * 4.5))
        return spread2.withColumns(out).drop(*cols)

    return with_halo(df, by, pos, max(sizes) // 2, build)


def neighbor_letters(df: DataFrame, by: Sequence[str] = ("complex",), pos: str = "ord", letter: str = "aa") -> DataFrame:
    """Previous and next letter, X beyond the ends; the frame crosses chains unless ``by`` names the chain."""

    def build(spread, w):
        return spread.withColumns({"prev_aa": F.coalesce(F.lag(letter).over(w), F.lit("X")), "next_aa": F.coalesce(F.lead(letter).over(w), F.lit("X"))})

    return with_halo(df, by, pos, 1, build)


def segments(df: DataFrame, col: str, by: Sequence[str], pos: str) -> DataFrame:
    """Runs of equal values: ``[start, stop)`` per segment, numbered from 0 in each group."""

    def build(spread, w):
        return spread.withColumn("__new", F.coalesce(~F.col(col).eqNullSafe(F.lag(col).over(w)) | (F.col(pos) == 0), F.lit(True)))

    starts = with_halo(df.select(*by, pos, col), by, pos, 1, build).where("__new").select(*by, col, F.col(pos).alias("start"))
    numbered = running_totals(starts, by=by, order=["start"], rank="__rn")
    following = numbered.select(*by, (F.col("__rn") - 1).alias("__rn"), F.col("start").alias("__next"))
    ends = df.groupBy(*by).agg((F.max(pos) + 1).alias("__end"))
    return numbered.join(following, [*by, "__rn"], "left").join(ends, list(by)).select(
        *by, (F.col("__rn") - 1).alias("segment"), col, "start", F.coalesce("__next", "__end").alias("stop"))


def split_values(segs: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Values that occur in more than one segment of a group."""
    return segs.groupBy(*by, col).agg(F.count("*").alias("n_segments")).where("n_segments > 1")


def require_contiguous_values(segs: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    require_empty(split_values(segs, col, by), f"{col} is not contiguous")
    return segs


def check_contiguous(df: DataFrame, by: Sequence[str], pos: str = "position") -> DataFrame:
    """Groups whose positions are not exactly 1..n, with what is wrong."""
    per_pos = df.groupBy(*by, pos).agg(F.count("*").alias("__n"))
    stats = per_pos.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.count("*").alias("n_distinct"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    problem = F.when(F.col("n") != F.col("n_distinct"), "duplicate").when(F.col("first") != 1, "start").when(F.col("last") != F.col("n"), "gap")
    return stats.withColumn("problem", problem).where("problem is not null")


def offsets(df: DataFrame, length: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running offset before each row: 0, l0, l0+l1, ..."""
    return running_totals(df, by=by, order=order, sums={"__end": length}).select(
        *df.columns, (F.col("__end") - F.col(length)).alias("offset"))


def best_epoch(df: DataFrame, metric: str, by: str = "run", epoch: str = "epoch", event: str | None = None) -> DataFrame:
    """Best epoch (earliest among equals), its value, the last epoch, and whether a ``done`` event was logged."""
    done = F.max((F.col(event) == "done").cast("int")) == 1 if event else F.lit(False)
    best = df.groupBy(by).agg(
        F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e"))).alias("b"), F.max(epoch).alias("last_epoch"), done.alias("done"))
    return best.select(by, (-F.col("b.e")).alias("best_epoch"), F.col("b.m").alias("best_value"), "last_epoch", "done")


def pos_encoding(df: DataFrame, rel: dict[str, Column], freqs: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Sine and cosine of ``2*pi*f*position`` for each relative position."""
    out = {}
    for scope, r in rel.items():
        for f in freqs:
            out[f"{scope}_pos_sin{f}"] = F.sin(2.0 * math.pi * f * r)
            out[f"{scope}_pos_cos{f}"] = F.cos(2.0 * math.pi * f * r)
    return df.withColumns(out)


def pos_features(df: DataFrame, pos: str = "pos", n: str = "chain_len") -> DataFrame:
    """Distances to both chain ends, terminal flags and log length."""
    p, length = F.col(pos), F.col(n)
    d_n, d_c = p / F.greatest(F.lit(1), length), (length - 1 - p) / F.greatest(F.lit(1), length)
    return df.withColumns({
        "dist_n": d_n,
        "dist_c": d_c,
        "dist_end": F.least(d_n, d_c),
        "is_n_term10": (p < 10).cast("double"),
        "is_c_term10": (p >= length - 10).cast("double"),
        "is_n_term20": (p < 20).cast("double"),
        "is_c_term20": (p >= length - 20).cast("double"),
        "chain_len_log": F.log1p(length) / math.log1p(4096.0),
    })


# ---------------------------------------------------------------- chain geometry

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def v_sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def v_scale(a: Vec, s: Column) -> Vec:
    return tuple(x * s for x in a)


def v_dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def v_cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def v_norm(a: Vec) -> Column:
    return F.sqrt(v_dot(a, a))


def v_named(a: Vec, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{c}": x for c, x in zip("xyz", a)}


def v_unit(a: Vec, eps: float = 1e-8) -> Vec:
    """``a / (|a| + eps)``, zero where ``|a| <= eps``."""
    n = v_norm(a)
    return tuple(F.when(n > eps, x / (n + eps)).otherwise(0.0) for x in a)


def _over(a: Vec, fn, w) -> Vec:
    return tuple(fn(x).over(w) for x in a)


def frenet(df: DataFrame, by: Sequence[str] = ("complex", "chain"), pos: str = "pos") -> DataFrame:
    """Tangent, normal, binormal, curvature and torsion along a chain; chains shorter than 4 are left out."""
    sized = df.join(df.groupBy(*by).agg(F.count("*").alias("__n")), list(by)).where("__n >= 4")
    at_start, at_end = F.col(pos) == 0, F.col(pos) == F.col("__n") - 1
    inner = ~at_start & ~at_end

    def build(spread: DataFrame, w) -> DataFrame:
        here = vec("")
        ahead, behind = _over(here, F.lead, w), _over(here, F.lag, w)
        step = tuple(F.when(at_start, a - h).when(at_end, h - b).otherwise(a - b) for a, h, b in zip(ahead, here, behind))
        s1 = spread.withColumns(v_named(step, "d"))
        n = v_norm(vec("d"))
        unit = tuple(F.when(n > 1e-6, x / n).otherwise(e) for x, e in zip(vec("d"), (1.0, 0.0, 0.0)))
        s2 = s1.withColumns(v_named(unit, "t"))
        bend = v_sub(_over(vec("t"), F.lead, w), _over(vec("t"), F.lag, w))
        s3 = s2.withColumns(v_named(bend, "b"))
        k = v_norm(vec("b"))
        t = vec("t")
        axis = (F.when(F.abs(t[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(t[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0))
        side = v_sub(axis, v_scale(t, v_dot(axis, t)))
        side_n = v_norm(side)
        normal = tuple(F.when(inner, F.when(k > 1e-6, b / k).otherwise(s / side_n)).otherwise(0.0) for b, s in zip(vec("b"), side))
        s4 = s3.withColumns({"curvature": F.when(inner & (k > 1e-6), k).otherwise(0.0), **v_named(normal, "n")})
        s5 = s4.withColumns(v_named(v_cross(vec("t"), vec("n")), "c"))
        turn = v_sub(_over(vec("c"), F.lead, w), _over(vec("c"), F.lag, w))
        return s5.withColumn("torsion", F.when(inner, -v_dot(turn, vec("n"))).otherwise(0.0))

    out = with_halo(sized, by, pos, 4, build)
    return out.select(*df.columns, "tx", "ty", "tz", "nx", "ny", "nz", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("cz").alias("bz"), "curvature", "torsion")


def backbone(atoms: DataFrame, by: Sequence[str], names: Sequence[str] = ("N", "CA", "C")) -> DataFrame:
    """One row per residue with the coordinates of the named atoms (``N_x`` ...), NULL where absent."""
    return atoms.groupBy(*by).agg(*[
        F.first(F.when(F.col("atom") == a, F.col(c)), ignorenulls=True).alias(f"{a}_{c}") for a in names for c in "xyz"])


def dihedral(p0: Vec, p1: Vec, p2: Vec, p3: Vec) -> Column:
    b0, b1, b2 = v_sub(p1, p0), v_sub(p2, p1), v_sub(p3, p2)
    u = v_scale(b1, 1.0 / (v_norm(b1) + 1e-8))
    v = v_sub(b0, v_scale(u, v_dot(b0, u)))
    w = v_sub(b2, v_scale(u, v_dot(b2, u)))
    return F.atan2(v_dot(v_cross(u, v), w), v_dot(v, w))


def torsions(residues: DataFrame, by: Sequence[str] = ("complex", "chain"), pos: str = "pos") -> DataFrame:
    """Sine and cosine of phi, psi and omega between neighbours of one chain; 0 where an atom is missing.

    ``residues`` comes from ``backbone``; ``pos`` counts residues of the chain from 0.
    """

    def build(spread: DataFrame, w) -> DataFrame:
        n, ca, c = vec("N_"), vec("CA_"), vec("C_")
        prev_ca, prev_c, next_n = _over(ca, F.lag, w), _over(c, F.lag, w), _over(n, F.lead, w)
        s = spread.withColumns(v_named(prev_ca, "pca_") | v_named(prev_c, "pc_") | v_named(next_n, "nn_"))
        pca, pc, nn = vec("pca_"), vec("pc_"), vec("nn_")
        return s.withColumns({"phi": dihedral(pc, n, ca, c), "psi": dihedral(n, ca, c, nn), "omega": dihedral(pca, pc, n, ca)})

    out = with_halo(residues, by, pos, 1, build)
    zero = F.lit(0.0)
    return out.select(*by, pos, *[F.coalesce(fn(a), zero).alias(f"{a}_{nm}") for a in ("phi", "psi", "omega") for nm, fn in (("sin", F.sin), ("cos", F.cos))])


def curvature_roughness(df: DataFrame, by: Sequence[str] = ("complex",), pos: str = "pos", window: int = 7) -> DataFrame:
    """Local curvature and coordinate spread in a frame, each divided by the largest of the complex."""

    def build(spread: DataFrame, w) -> DataFrame:
        here = vec("")
        v1 = v_sub(here, _over(here, F.lag, w))
        v2 = v_sub(_over(here, F.lead, w), here)
        s = spread.withColumns(v_named(v1, "__a") | v_named(v2, "__b"))
        a, b = vec("__a"), vec("__b")
        bend = ratio(v_norm(v_sub(b, a)), v_norm(a) + 1e-6)
        frame = w.rowsBetween(-(window // 2), window // 2)
        total = F.sum(F.col("x") + F.col("y") + F.col("z")).over(frame)
        square = F.sum(v_dot(vec(""), vec(""))).over(frame)
        k = F.count("*").over(frame) * 3
        spread_ = F.when(k > 3, F.sqrt(F.greatest(F.lit(0.0), square / k - (total / k) * (total / k)))).otherwise(0.0)
        return s.withColumns({"curvature": F.coalesce(bend, F.lit(0.0)), "roughness": spread_})

    raw = with_halo(df, by, pos, max(1, window // 2), build)
    top = raw.groupBy(*by).agg(F.max("curvature").alias("__c"), F.max("roughness").alias("__r"))
    return raw.join(top, list(by)).select(
        *df.columns,
        F.when(F.col("__c") > 0, F.col("curvature") / (F.col("__c") + 1e-6)).otherwise(0.0).alias("curvature"),
        F.when(F.col("__r") > 0, F.col("roughness") / F.col("__r")).otherwise(0.0).alias("roughness"),
    )


def helix_flag(df: DataFrame, by: Sequence[str] = ("complex",), pos: str = "pos") -> DataFrame:
    """True where 4.5 < d(i, i+3) < 6.5 holds at this row or the one before; the first and last rows never start a turn."""

    def build(spread: DataFrame, w) -> DataFrame:
        here = vec("")
        d = v_norm(v_sub(tuple(F.lead(c, 3).over(w) for c in here), here))
        s = spread.withColumn("__turn", F.coalesce((F.col(pos) >= 1) & (d > 4.5) & (d < 6.5), F.lit(False)))
        return s.withColumn("helix", F.col("__turn") | F.coalesce(F.lag("__turn").over(w), F.lit(False))).drop("__turn")

    return with_halo(df, by, pos, 4, build)
