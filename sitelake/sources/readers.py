"""Text, XML and JSON sources (S01-S03, S05-S12, S14) and file tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, require_columns, require_empty
from sitelake.functions.residue import LETTERS
from sitelake.functions.text import infer_method, norm_text
from sitelake.sources.lines import PLACE, read_lines, with_running_counts


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited text with a header; every column is a string until it is cast on purpose."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_residues(spark: SparkSession, path: str, value_col: str = "score", sep: str = "\t") -> DataFrame:
    """Residue table with a score or a label; missing columns and bad numbers fail."""
    raw = require_columns(read_delimited(spark, path, sep), ["seq_id", "position", "residue", value_col], path)
    kind = "int" if value_col == "label" else "double"
    extra = ["method"] if "method" in raw.columns else []
    return raw.select("seq_id", F.col("position").cast("int").alias("position"), "residue", F.col(value_col).cast(kind).alias(value_col), *extra)


def read_ids(spark: SparkSession, path: str, lower: bool = True, unique: bool = True) -> DataFrame:
    """Ids, one per line, without blanks and ``#`` comments."""
    v = F.trim("value")
    ids = spark.read.text(path).select((F.lower(v) if lower else v).alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))
    return ids.distinct() if unique else ids


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, seq)``: the id is the first word of the header, the sequence its lines joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("r")).where(F.trim("r") != "")
    return records.select(
        F.regexp_extract("r", r"^(\S*)", 1).alias("seq_id"),
        F.regexp_replace(F.regexp_replace("r", r"^[^\n]*(\n|$)", ""), r"\s+", "").alias("seq"))


def _field(line: str, start: int, stop: int) -> Column:
    """Columns ``start..stop`` of a fixed-width record, 1-based and inclusive, trimmed."""
    return F.trim(F.substring(line, start, stop - start + 1))


def read_atoms(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """ATOM records of structure files; alternate locations other than blank and A are dropped.

    A blank chain is ``A``. ``name`` keeps one row per residue: the first record of
    that atom name in the order of the file's lines, whatever its serial says, or
    else the mean of the residue's atoms with the fields of its first record.
    ``mean_b`` is then the mean confidence over all atoms of the residue.
    """
    alt = _field("value", 17, 17)
    num = lambda a, b, t: _field("value", a, b).try_cast(t)
    atoms = read_lines(spark, path).where(F.substring("value", 1, 6) == "ATOM  ").where(alt.isin("", "A")).select(
        *PLACE, num(7, 11, "int").alias("serial"), _field("value", 13, 16).alias("atom"), _field("value", 18, 20).alias("resname"),
        F.when(F.trim(F.substring("value", 22, 1)) == "", "A").otherwise(F.substring("value", 22, 1)).alias("chain"), num(23, 26, "int").alias("resseq"), _field("value", 27, 27).alias("icode"),
        num(31, 38, "double").alias("x"), num(39, 46, "double").alias("y"), num(47, 54, "double").alias("z"), num(61, 66, "double").alias("b"))
    if name is None:
        return atoms.drop("block", "line")
    key = ["file", "chain", "resseq", "icode"]
    rest = [c for c in atoms.columns if c not in (*key, "block", "line")]
    place, named = F.struct("block", "line"), F.col("atom") == name
    one = atoms.groupBy(*key).agg(
        F.min_by(F.when(named, F.struct(*rest)), F.when(named, place)).alias("r"), F.min_by(F.struct(*rest), place).alias("any"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("x", "y", "z", "b")])
    mean = lambda c: F.col(f"mean_{c}") if c in ("x", "y", "z", "b") else F.col(f"any.{c}")
    return one.select(*key, *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(mean(c)).alias(c) for c in rest], "mean_b")


#: Lines of a structure file that describe it, and the one that ends a record.
HEADER_LINE = r"^(HEADER|TITLE|COMPND|EXPDTA|REMARK   2 RESOLUTION\.)"
END_LINE = r"^END\s*$"


def read_structure_headers(spark: SparkSession, path: str, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(file, head, desc, met, rez)`` and ``(file, chain, molecule)``; one file is one record.

    With ``many`` a file holds many records, each closed by a line that is ``END``
    and nothing else but blanks; ``file`` then has the record's number, from 0, behind a
    ``#``. Only the describing lines of a record are brought together, in the order
    of the file; a record without any has empty fields. An empty file gives no row.
    """
    lines = read_lines(spark, path)
    wanted = F.col("value").rlike(HEADER_LINE)
    if many:
        ends = F.col("value").rlike(END_LINE)
        counted = with_running_counts(lines.where(wanted | ends), record=ends)
        own = F.col("record") - ends.cast("long")  # the closing line belongs to the record before
        lines = counted.select(F.concat("file", F.lit("#"), own).alias("file"), "block", "line", "value")
    ordered = F.sort_array(F.collect_list(F.when(wanted, F.struct("block", "line", "value"))))
    whole = lines.groupBy("file").agg(F.transform(ordered, lambda s: s["value"]).alias("lines"))

    def joined(tag: str, start: int, stop: int) -> Column:
        mine = F.filter("lines", lambda s: s.startswith(tag))
        return F.trim(F.regexp_replace(F.array_join(F.transform(mine, lambda s: F.trim(F.substring(s, start, stop - start + 1))), " "), r"\s+", " "))

    found = F.try_element_at(F.filter("lines", lambda s: s.startswith("REMARK   2 RESOLUTION.")), F.lit(1))
    resolution = F.regexp_extract(F.coalesce(found, F.lit("")), r"(\d+\.?\d*)\s+ANGSTROM", 1).try_cast("double")
    named = whole.select(
        "file", F.lower(joined("HEADER", 11, 50)).alias("head"), F.lower(joined("TITLE", 11, 80)).alias("desc"), F.lower(joined("EXPDTA", 11, 80)).alias("stated"),
        resolution.alias("rez"),
        joined("COMPND", 11, 80).alias("compnd"))
    heads = named.select("file", "head", "desc", infer_method("stated", "head", "desc").alias("met"), "rez")
    parts = named.select("file", F.explode(F.split("compnd", r"MOL_ID:")).alias("m"))
    mol = F.lower(F.trim(F.regexp_extract("m", r"MOLECULE:\s*([^;]*)", 1)))
    listed = F.split(F.regexp_replace(F.regexp_extract("m", r"CHAIN:\s*([^;]*)", 1), r"\s", ""), ",")
    rows = parts.select("file", mol.alias("molecule"), F.explode(listed).alias("chain")).where("molecule <> '' and chain <> ''")
    return heads, rows.groupBy("file", "chain").agg(F.min("molecule").alias("molecule"))


def read_xml_chains(spark: SparkSession, path: str) -> DataFrame:
    """CHAIN elements: id, number of membrane segments, type, sequence without blanks. Namespaces are ignored."""
    schema = "_CHAINID string, _NUM_TM string, _TYPE string, SEQ string"
    raw = spark.read.format("xml").option("rowTag", "CHAIN").option("ignoreNamespace", True).schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    return raw.select("file", norm_text("_CHAINID").alias("chain"), F.trim("_NUM_TM").try_cast("int").alias("num_tm"), norm_text("_TYPE").alias("type"),
                      F.upper(F.regexp_replace(F.coalesce("SEQ", F.lit("")), r"\s+", "")).alias("seq"))


def read_clusters(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(seq_id, cluster)`` for every known sequence, and member counts of unknown ones; an unlisted sequence is its own cluster."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("cluster"), parts[1].alias("seq_id"))
    one = rows.groupBy("seq_id").agg(F.min("cluster").alias("cluster"))
    placed = known.select("seq_id").distinct().join(one, "seq_id", "left").withColumn("cluster", F.coalesce("cluster", "seq_id"))
    unknown = one.join(known.select("seq_id"), "seq_id", "left_anti").agg(F.count("*").alias("n_unknown"))
    return placed, unknown


def read_pair_hits(spark: SparkSession, path: str) -> DataFrame:
    """Six leading fields of a hit table; rows with too few or bad fields are skipped, percent identities become shares."""
    p = F.split("value", "\t")
    num = lambda i, t: F.get(p, F.lit(i)).try_cast(t)
    hits = spark.read.text(path).where(F.size(p) >= 6).select(
        F.get(p, F.lit(0)).alias("query"), F.get(p, F.lit(1)).alias("target"), num(2, "double").alias("pident"), num(3, "double").cast("int").alias("alnlen"),
        num(4, "double").alias("qcov"), num(5, "double").alias("tcov"))
    share = F.when(F.col("pident") > 1, F.col("pident") / 100).otherwise(F.col("pident"))
    return hits.withColumn("pident", share).where("pident is not null and alnlen is not null and qcov is not null and tcov is not null")


PROFILE_MARK = "Query profile of sequence"


def read_profile_blocks(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Profile rows per block, values squashed by a sigmoid and rounded to six digits.

    A line with the mark opens a block. Block i of a file belongs to its i-th id:
    ``ids(seq_id, ordinal[, file])`` counts from 1 and must match the blocks; lines
    before the first mark count for none. Numbered lines must hold twenty numbers,
    of which the whole part counts. A file is read by as many tasks as it has ranges.
    """
    marked = F.col("value").contains(PROFILE_MARK)
    numbered = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).try_cast("int").isNotNull()
    rows = durable(with_running_counts(read_lines(spark, path).where(marked | numbered), ordinal=marked).where("ordinal > 0"), "profile-rows")
    key = ["file", "ordinal"] if "file" in ids.columns else ["ordinal"]
    blocks = rows.where(marked).select(*key).distinct().withColumn("found", F.lit(True))
    require_empty(ids.join(blocks, key, "full_outer").where("seq_id is null or found is null").select("ordinal"), "profile blocks and ids differ")
    good = rows.where(~marked).join(ids, key).select("seq_id", F.col("value").alias("line"))
    p = F.split(F.trim("line"), r"\s+")
    cells = F.transform(F.slice(p, 3, 20), lambda v: v.try_cast("double"))
    require_empty(good.where((F.size(p) < 22) | F.exists(cells, lambda v: v.isNull())).select("seq_id", "line"), "profile rows without twenty values")
    # Whole parts only, cut towards zero, as profiles are integers.
    values = F.transform(cells, lambda v: F.round(1.0 / (1.0 + F.exp(-F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))), 6))
    return good.select("seq_id", F.get(p, F.lit(0)).cast("int").alias("position"), F.get(p, F.lit(1)).alias("aa"), values.alias("profile"))


def read_with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], ignore_case: bool = False) -> DataFrame:
    """Canonical columns from the first alias present; a column without any alias fails."""
    have = {(c.lower() if ignore_case else c): c for c in reversed(df.columns)}
    out = []
    for canonical, names in aliases.items():
        hit = next((have[n.lower() if ignore_case else n] for n in names if (n.lower() if ignore_case else n) in have), None)
        if hit is None:
            raise DataContractError(f"none of {list(names)} found for {canonical}; the table has {df.columns}")
        out.append(F.col(f"`{hit}`").alias(canonical))
    return df.select(*out)


def absolute_area(rsa: Column | str, letter: Column | str, table: dict[str, float], default: float = 200.0) -> Column:
    """Relative area clipped to [0, 1] times the residue's maximum."""
    from sitelake.functions.residue import lookup

    r = F.col(rsa) if isinstance(rsa, str) else rsa
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)) * lookup(letter, table, default)


def read_vectors(spark: SparkSession, path: str, dim: int, expected: DataFrame | None = None) -> DataFrame:
    """Lines ``aa: f1 ... fD`` of files named after their sequence; every line must hold ``dim`` numbers.

    ``pos`` counts the lines of a file from 0, blank ones left out. ``expected(file,
    seq)`` must equal the letters of the file in order. A file is read by as many
    tasks as it has ranges.
    """
    filled = F.trim("value") != ""
    lines = with_running_counts(read_lines(spark, path).where(filled), n=filled).withColumnRenamed("value", "text")
    p = F.split(F.trim(F.substring_index("text", ":", -1)), r"[,\s]+")
    rows = lines.select(
        "file", (F.col("n") - 1).cast("int").alias("pos"), F.trim(F.substring_index("text", ":", 1)).alias("aa"), F.transform(p, lambda v: v.cast("double")).alias("vector"))
    rows = durable(rows, "vectors")
    require_empty(rows.where(F.size("vector") != dim).select("file", "pos"), f"vectors without {dim} numbers")
    if expected is not None:
        letters = expected.select("file", F.posexplode(F.split("seq", "")).alias("pos", "want"))
        bad = rows.join(letters, ["file", "pos"], "full_outer").where(~F.col("aa").eqNullSafe(F.col("want")))
        require_empty(bad.select("file", "pos"), "vector letters differ from the sequence")
    return rows


def read_run_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Epoch events of JSON-lines logs, and a ``done`` flag per file."""
    raw = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    return raw.where("event = 'epoch'"), raw.groupBy("file").agg((F.max((F.col("event") == "done").cast("int")) == 1).alias("done"))


def read_substitution_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The usual text form: comment lines, a header of letters, one row per letter; columns are put in letter order."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    cells = lambda s: F.split(F.trim(s), r"\s+")
    rows = whole.select(lines.alias("l")).select(cells(F.element_at("l", 1)).alias("head"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("row")).select("head", cells(F.col("row")).alias("c"))
    value = lambda a: F.element_at("c", (F.array_position("head", a) + 1).cast("int")).cast("double")
    return rows.where(F.col("c")[0].isin(*LETTERS)).select(F.col("c")[0].alias("aa"), F.array(*[value(a) for a in LETTERS]).alias("row"))


#: Stores whose files are read piece by piece; files of all others are hashed by Spark's own reader, up to 2 GB each.
STREAMED = ("file", "hdfs", "s3", "gs")


def file_checksums(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """Relative path, size and SHA-256 of every file below a folder.

    Sizes come from the listing alone. The files are dealt over the executors, and
    each is hashed there from one piece of ``chunk`` bytes after the other, so its
    size does not matter. Empty files, which no scan returns, are added from the
    names of the listing. An empty folder gives an empty table.
    """
    from urllib.parse import unquote

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").split(":")[-1].lstrip("/")
    relative = F.regexp_replace(F.col("path"), F.lit(f"^.*?{base}/"), F.lit(""))
    names = files.inputFiles()
    named = spark.createDataFrame([(unquote(n),) for n in names], "path string").select(relative.alias("path"))
    empty = named.join(files.select(relative.alias("path")), "path", "left_anti").select(
        "path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    if not names or names[0].split(":")[0] not in STREAMED:
        return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).unionByName(empty)

    def hashed(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sums = []
            for uri in batch.column(0).to_pylist():
                if uri.startswith("file:"):  # this one writes a path as it is, without escapes
                    store, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
                else:
                    store, name = fs.FileSystem.from_uri(uri)
                total = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as stream:
                    while piece := stream.read(chunk):
                        total.update(piece)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    listed = files.select("path", F.col("length").alias("bytes"))
    # Listing puts many files into one task; hashing should not.
    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(hashed, "path string, bytes long, sha256 string").withColumn("path", relative).unionByName(empty)


def resolve_resources(ids: DataFrame, inventory: DataFrame, templates: Sequence[str], key: str = "id") -> DataFrame:
    """First existing path per id from ordered templates with ``{id}``; ids without one keep NULL.

    Candidates are a handful of rows per id, joined to the inventory on the path.
    """
    options = F.array(*[F.struct(F.lit(i).alias("priority"), F.replace(F.lit(t), F.lit("{id}"), F.col(key).cast("string")).alias("path")) for i, t in enumerate(templates)])
    cands = ids.select(key, F.inline(options))
    hit = cands.join(inventory.select("path").distinct(), "path").groupBy(key).agg(F.min(F.struct("priority", "path")).alias("h"))
    return ids.join(hit, key, "left").select(*ids.columns, F.col("h.priority").alias("priority"), F.col("h.path").alias("path"))


def shared_paths(resolved: DataFrame, split: str = "split") -> DataFrame:
    """Paths used by more than one split."""
    g = resolved.where("path is not null").groupBy("path").agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("n"))
    return g.where("first_split <> last_split")
