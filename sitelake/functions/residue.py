"""Residue tables and the per-residue static features built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.core import require_columns

LETTERS = "ACDEFGHIKLMNPQRSTVWY"

# Residue letter, three-letter code, mass, hydropathy, volume,
# charge at pH 7, isoelectric point, side-chain pKa (None where not ionisable),
# rounded weight, polarity class, donor count, acceptor count, aromatic flag,
# maximal surface area.
RESIDUES = [
    ("A", "ALA", 89.09, 1.8, 88.6, 0.0, 6.00, None, 89.1, 0, 0, 0, 0, 129.0),
    ("C", "CYS", 121.16, 2.5, 108.5, 0.0, 5.07, 8.18, 121.2, 1, 1, 0, 0, 167.0),
    ("D", "ASP", 133.10, -3.5, 111.1, -1.0, 2.77, 3.65, 133.1, 3, 0, 2, 0, 193.0),
    ("E", "GLU", 147.13, -3.5, 138.4, -1.0, 3.22, 4.25, 147.1, 3, 0, 2, 0, 223.0),
    ("F", "PHE", 165.19, 2.8, 189.9, 0.0, 5.48, None, 165.2, 0, 0, 0, 1, 240.0),
    ("G", "GLY", 75.07, -0.4, 60.1, 0.0, 5.97, None, 75.1, 0, 0, 0, 0, 104.0),
    ("H", "HIS", 155.16, -3.2, 153.2, 0.1, 7.59, 6.00, 155.2, 2, 1, 1, 1, 224.0),
    ("I", "ILE", 131.17, 4.5, 166.7, 0.0, 6.02, None, 131.2, 0, 0, 0, 0, 197.0),
    ("K", "LYS", 146.19, -3.9, 168.6, 1.0, 9.74, 10.53, 146.2, 2, 1, 0, 0, 236.0),
    ("L", "LEU", 131.17, 3.8, 166.7, 0.0, 5.98, None, 131.2, 0, 0, 0, 0, 201.0),
    ("M", "MET", 149.21, 1.9, 162.9, 0.0, 5.74, None, 149.2, 0, 0, 0, 0, 224.0),
    ("N", "ASN", 132.12, -3.5, 114.1, 0.0, 5.41, None, 132.1, 1, 1, 2, 0, 195.0),
    ("P", "PRO", 115.13, -1.6, 112.7, 0.0, 6.30, None, 115.1, 0, 0, 0, 0, 159.0),
    ("Q", "GLN", 146.15, -3.5, 143.8, 0.0, 5.65, None, 146.2, 1, 1, 2, 0, 225.0),
    ("R", "ARG", 174.20, -4.5, 173.4, 1.0, 10.76, 12.48, 174.2, 2, 4, 0, 0, 274.0),
    ("S", "SER", 105.09, -0.8, 89.0, 0.0, 5.68, None, 105.1, 1, 1, 1, 0, 155.0),
    ("T", "THR", 119.12, -0.7, 116.1, 0.0, 5.60, None, 119.1, 1, 1, 1, 0, 172.0),
    ("V", "VAL", 117.15, 4.2, 140.0, 0.0, 5.96, None, 117.1, 0, 0, 0, 0, 174.0),
    ("W", "TRP", 204.23, -0.9, 227.8, 0.0, 5.89, None, 204.2, 0, 1, 0, 1, 285.0),
    ("Y", "TYR", 181.19, -1.3, 193.6, 0.0, 5.66, 10.07, 181.2, 1, 1, 1, 1, 263.0),
]
FIELDS = ("aa", "code", "mass", "hydropathy", "volume", "charge", "pi", "pka",
          "weight", "polarity", "donors", "acceptors", "aromatic", "max_area")
TYPES = ("string", "string", *["double"] * 7, *["int"] * 4, "double")

# Residue classes of the sequence features.
GROUPS = {
    "positive": "KRH",
    "negative": "DE",
    "polar": "STNQCY",
    "hydrophobic": "AILMFWV",
    "aromatic": "FWYH",
    "small": "AGSTCV",
}

# Residue classes of the neighbourhood features.
NONPOLAR = "AVLIMFWPG"
POLAR = "STCYNQ"
CHARGED = "KRHDE"
AROMATIC = "FYWH"
DONORS = "STYCNQRKHW"
ACCEPTORS = "DESTYNQH"
METAL_BINDERS = "HDECMYSTNQ"
POLAR_SHARE = "CDEHKNQRSTY"
ENV_DONORS = "STYNQRKHW"
ENV_ACCEPTORS = "DENQSTY"
POLAR_AREA = "STNQYC"

# Non-standard codes; the tables of the tools differ in them.
EXTRA_CODES = {
    "sequence": {"SEC": "U", "PYL": "O"},
    "structure": {"MSE": "M", "SEC": "C", "PYL": "K"},
}

# Five factor scores per residue letter.
FACTORS = {
    "A": (-0.591, -1.302, -0.733, 1.570, -0.146),
    "C": (-1.343, 0.465, -0.862, -1.020, -0.255),
    "D": (1.050, 0.302, -3.656, -0.259, -3.242),
    "E": (1.357, -1.453, 1.477, 0.113, -0.837),
    "F": (-1.006, -0.590, 1.891, -0.397, 0.412),
    "G": (-0.384, 1.652, 1.330, 1.045, 2.064),
    "H": (0.336, -0.417, -1.673, -1.474, -0.078),
    "I": (-1.239, -0.547, 2.131, 0.393, 0.816),
    "K": (1.831, -0.561, 0.533, -0.277, 1.648),
    "L": (-1.019, -0.987, -1.505, 1.266, -0.912),
    "M": (-0.663, -1.524, 2.219, -1.005, 1.212),
    "N": (0.945, 0.828, 1.299, -0.169, 0.933),
    "P": (0.189, 2.081, -1.628, 0.421, -1.392),
    "Q": (0.931, -0.179, -3.005, -0.503, -1.853),
    "R": (1.538, -0.055, 1.502, 0.440, 2.897),
    "S": (-0.228, 1.399, -4.760, 0.670, -2.647),
    "T": (-0.032, 0.326, 2.213, 0.908, 1.313),
    "V": (-1.337, -0.279, -0.544, 1.242, -1.262),
    "W": (-0.595, 0.009, 0.672, -2.128, -0.184),
    "Y": (0.260, 0.830, 3.097, -0.838, 1.512),
}


def field(name: str) -> dict[str, object]:
    i = FIELDS.index(name)
    return {r[0]: r[i] for r in RESIDUES}


def residue_table(spark: SparkSession) -> DataFrame:
    """The twenty-row lookup table."""
    schema = ", ".join(f"{n} {t}" for n, t in zip(FIELDS, TYPES))
    return spark.createDataFrame(RESIDUES, schema)


def with_residue_columns(df: DataFrame, names: Sequence[str], letter: str = "aa") -> DataFrame:
    """Left join of table columns; the table has twenty rows, so it is always broadcast."""
    side = residue_table(df.sparkSession).select(F.col("aa").alias("__aa"), *names)
    return df.join(F.broadcast(side), F.col(letter) == F.col("__aa"), "left").drop("__aa")


def lookup(letter: str | Column, values: dict[str, object], default) -> Column:
    """Value of a small letter table as one ``CASE``: stays in generated code, no join."""
    c = F.col(letter) if isinstance(letter, str) else letter
    by_value: dict[object, list[str]] = {}
    for k, v in values.items():
        if v is not None and v != default:
            by_value.setdefault(v, []).append(k)
    out = None
    for v, keys in by_value.items():
        cond = c.isin(*keys)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def is_in(letter: str | Column, letters: str) -> Column:
    c = F.col(letter) if isinstance(letter, str) else letter
    return c.isin(*letters)


def class_onehot(letter: str | Column) -> Column:
    """Nonpolar, polar and charged as a one-hot array; all zero for other letters."""
    return F.array(*[is_in(letter, m).cast("double") for m in (NONPOLAR, POLAR, CHARGED)])


def map_code(code: str | Column, extra: dict[str, str] | None = None, default: str = "X") -> Column:
    """Three-letter code to letter; unknown codes give ``default``."""
    table = {r[1]: r[0] for r in RESIDUES} | (extra or {})
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    c = F.upper(F.trim(F.col(code) if isinstance(code, str) else code))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def onehot(letter: str | Column) -> Column:
    c = F.col(letter) if isinstance(letter, str) else letter
    return F.array(*[(F.coalesce(c == a, F.lit(False))).cast("double") for a in LETTERS])


def residue_static(df: DataFrame, letter: str = "aa") -> DataFrame:
    """One-hot letter, six class flags and seven scaled properties with their defaults."""
    t = with_residue_columns(df, ["mass", "hydropathy", "volume", "charge", "pi", "pka"], letter)
    return t.withColumns({
        "onehot": onehot(letter),
        **{f"group_{g}": is_in(letter, m).cast("double") for g, m in GROUPS.items()},
        "mass": (F.coalesce("mass", F.lit(75.0)) - 75.0) / 130.0,
        "hydropathy": (F.coalesce("hydropathy", F.lit(0.0)) + 4.5) / 9.0,
        "volume": (F.coalesce("volume", F.lit(60.0)) - 60.0) / 168.0,
        "charge": (F.coalesce("charge", F.lit(0.0)) + 1.0) / 2.0,
        "pi": F.coalesce("pi", F.lit(6.0)) / 14.0,
        "has_pka": F.col("pka").isNotNull().cast("double"),
        "pka": F.coalesce("pka", F.lit(0.0)) / 14.0,
    })


def physchem20(df: DataFrame, letter: str = "aa") -> DataFrame:
    """Twenty static physico-chemical features as ``ARRAY<DOUBLE>``; zeros for unknown letters."""
    t = with_residue_columns(df, ["hydropathy", "weight", "volume", "polarity", "donors", "acceptors", "aromatic", "charge", "pka"], letter)
    h, p, k = F.col("hydropathy"), F.col("polarity"), F.col("pka")

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("double")

    feats = [
        h / 4.5, F.col("weight") / 204.2, F.col("volume") / 227.8, p / 3.0, F.col("donors") / 4.0, F.col("acceptors") / 2.0,
        F.col("aromatic").cast("double"), F.col("charge"),
        *[flag(p == i) for i in range(4)],
        flag(k.isNotNull()), k / 14.0, flag(k < 7.0), flag(k > 7.0),
        flag(h > 2.0), flag((h > 0) & (h <= 2.0)), flag((h >= -2.0) & (h <= 0)), flag(h < -2.0),
    ]
    return t.select(*df.columns, F.array(*[F.coalesce(f, F.lit(0.0)) for f in feats]).alias("physchem"))


def subst_features(df: DataFrame, matrix: DataFrame, letter: str = "aa") -> DataFrame:
    """Substitution row / 11 and factor row / 5; zeros for unknown letters.

    ``matrix(aa, row ARRAY<DOUBLE>)`` is input data, read with
    ``read_substitution_matrix``; one row per letter is kept, so at most twenty
    rows are broadcast.
    """
    require_columns(matrix, ["aa", "row"], "substitution matrix")
    side = matrix.where(F.col("aa").isin(*LETTERS)).dropDuplicates(["aa"]).select(F.col("aa").alias("__aa"), F.col("row").alias("__row"))
    zeros = F.array(*[F.lit(0.0)] * len(LETTERS))
    pairs = [x for a, v in FACTORS.items() for x in (F.lit(a), F.array(*[F.lit(f / 5.0) for f in v]))]
    none = F.array(*[F.lit(0.0)] * 5)
    return df.join(F.broadcast(side), F.col(letter) == F.col("__aa"), "left").select(
        *df.columns,
        F.transform(F.coalesce("__row", zeros), lambda v: v / 11.0).alias("substitution"),
        F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(letter)), none).alias("factors"),
    )
