"""SimHash fingerprints of whole texts and the search for close ones. Built-in columns only.

Terms are pairs of neighbouring words, each as often as it occurs. Every term
hash votes on all bits; a bit is set if more than half of the votes are for it.
Votes are counted four bits to a long, in blocks of terms short enough that no
counter runs over, so a text of any length is counted in full.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import durable, spread

#: Two hashes of 64 bits.
HALVES = 2
BITS = 64 * HALVES
#: Terms counted together: few enough for a counter of 16 bits, of which the uppermost also carries the sign.
BLOCK = 16_384
#: Bits in which near copies (five-word Jaccard of 0.8) may differ.
RADIUS = 17
#: Rows of buckets in a partition of the join.
CACHED = 32_768
LANES = 0x0001000100010001
SPLIT = r"[ \t\n\x0B\f\r]+"
#: Stands before the first word, so that a text without words has a term too.
START = "\u0002"


def term_hashes(text: Column) -> Column:
    """One 64-bit hash per pair of neighbouring words, the start and the end of the text included."""
    words = F.concat(F.array(F.lit(START)), F.filter(F.split(text, SPLIT), lambda w: w != ""))
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def vote_columns(term: Column) -> list[Column]:
    """Packed votes of a term: column ``16 * half + k`` counts the bits ``k, k + 16, k + 32, k + 48`` of that half."""
    halves = [F.xxhash64(term, F.lit(h)) for h in range(HALVES)]
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{16 * i + k}") for i, h in enumerate(halves) for k in range(16)]


def bits_from_votes(blocks: Column) -> list[Column]:
    """The halves of the fingerprint from a list of ``struct(votes array<long>, n long)``, one per block of terms."""
    total = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + b["n"])

    def half(h: int) -> Column:
        def bit(i: Column) -> Column:
            lane = (F.floor(i / 16) * 16).cast("int")
            count = F.aggregate(
                blocks, F.lit(0).cast("long"),
                lambda acc, b: acc + F.call_function("shiftrightunsigned", F.get(b["votes"], (i % 16).cast("int") + 16 * h), lane).bitwiseAND(F.lit(0xFFFF)),
            )
            return F.when(count * 2 > total, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))

    return [half(h) for h in range(HALVES)]


def as_text(halves: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    return F.lit(1.0) - differ / F.lit(float(BITS))


def with_fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` plus columns ``f<text number>_<half>`` for each of ``texts``.

    ``keys`` are fixed-width and name a row. If ``rows`` are dealt by one of them
    already, nothing is moved: the terms are counted where their text is.
    """

    def tagged_terms(n: int, name: str) -> Column:
        return F.transform(term_hashes(F.col(name)), lambda h, i: F.struct(h.alias("h"), F.lit(n).alias("t"), F.floor(i / BLOCK).cast("int").alias("b")))

    tagged = F.flatten(F.array(*[tagged_terms(n, t) for n, t in enumerate(texts)]))
    terms = rows.select(*keys, F.explode(tagged).alias("x")).select(*keys, F.col("x.h").alias("__h"), F.col("x.t").alias("__t"), F.col("x.b").alias("__b"))
    counted = terms.groupBy(*keys, "__t", "__b").agg(*vote_columns(F.col("__h")), F.count("*").alias("__n"))
    votes = F.struct(F.array(*[f"v{i}" for i in range(16 * HALVES)]).alias("votes"), F.col("__n").alias("n"))
    # One entry for every block of a text.
    listed = counted.groupBy(*keys).agg(*[
        F.collect_list(F.when(F.col("__t") == n, votes)).alias(f"__l{n}") for n in range(len(texts))
    ])
    halves = [bits_from_votes(F.col(f"__l{n}")) for n in range(len(texts))]
    return listed.select(*keys, *[c.alias(f"f{n}_{h}") for n, hs in enumerate(halves) for h, c in enumerate(hs)])


def in_order(docs: DataFrame, spread: int = 8) -> DataFrame:
    """``(bucket, place, doc_id, text, next_text)``: rows by ascending id, each with the text of the next row.

    After the last row comes the first. Rows are dealt to ranges of ids whose
    borders are quantiles of all ids (``spread`` ranges per shuffle partition), so
    no window spans the table; the first row of the next range closes the gap.
    Rows with equal ids are ordered by text, null ids come first.
    """
    spark = docs.sparkSession
    n = spread * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("k"))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    firsts = durable(rows.groupBy("bucket").agg(F.min("k").alias("k")), "firsts")
    # As many rows as there are ranges; repeated ids are settled by text.
    opening = rows.join(F.broadcast(firsts), ["bucket", "k"], "left_semi").groupBy("bucket").agg(F.min("text").alias("opening"))
    opening = durable(opening, "opening")
    ring = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("bucket", F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(whole)).alias("next_bucket"))
    after = durable(following.join(opening.select(F.col("bucket").alias("next_bucket"), F.col("opening").alias("next_opening")), "next_bucket"), "following")
    w = Window.partitionBy("bucket").orderBy("k", "text")
    inside = rows.withColumn("place", F.row_number().over(w)).withColumn("inner", F.lead("text").over(w))
    return inside.join(F.broadcast(after), "bucket").select(
        "bucket", "place", "next_bucket", "doc_id", "text", F.coalesce("inner", "next_opening").alias("next_text")
    )


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """All pairs ``(a0, a1, b0, b1)`` of different fingerprints at most ``radius`` bits apart.

    ``prints(f0, f1)`` holds distinct fingerprints. They are cut into ``blocks``
    blocks of bits; two fingerprints within the radius agree on at least ``blocks
    - radius`` whole blocks, so a table for every choice of that many blocks,
    moved to the front as its key, finds them all. A pair is reported by the first
    table in which it agrees.
    """
    keep, width = blocks - radius, BITS // blocks
    if keep < 1 or BITS % blocks or 64 % width:
        raise ValueError("blocks must exceed the radius and divide the halves")

    def block(prefix: str, i: int) -> Column:
        half, at = divmod(i * width, 64)
        return F.shiftrightunsigned(F.col(f"{prefix}{half}"), at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    tables = list(combinations(range(blocks), keep))

    def keyed(prefix: str) -> DataFrame:
        own = prints.select(F.col("f0").alias(f"{prefix}0"), F.col("f1").alias(f"{prefix}1"))
        keys = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[block(prefix, i) for i in c]).alias("key")) for t, c in enumerate(tables)])
        return own.select("*", F.explode(keys).alias("x")).select(f"{prefix}0", f"{prefix}1", "x.table", "x.key")

    first = F.lit(True)
    for t, c in enumerate(tables[:-1]):
        agree = F.lit(True)
        for i in c:
            agree = agree & (block("a", i) == block("b", i))
        first = first & ~((F.lit(t) < F.col("table")) & agree)
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    ordered = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    left, right = keyed("a"), keyed("b").withColumnsRenamed({"table": "bt", "key": "bk"})
    on = (F.col("table") == F.col("bt")) & (F.col("key") == F.col("bk")) & ordered & (apart <= radius) & first
    return left.join(right, on).select("a0", "a1", "b0", "b1")


def close_fingerprints(prints: DataFrame, radius: int) -> DataFrame:
    """The same pairs as ``near_fingerprints`` for a radius of many bits.

    With ``radius // 2 + 1`` blocks two fingerprints within the radius differ in at
    most one bit of some block. Every block is a table; a fingerprint is looked up
    there by its own block and by the block with each of its zero bits set. All
    pairs are found, each reported by the first table in which it meets.
    """
    spark, blocks = prints.sparkSession, radius // 2 + 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    cuts = [BITS * t // blocks for t in range(blocks + 1)]
    masks = [halves((1 << cuts[t + 1]) - (1 << cuts[t])) for t in range(blocks)]
    tables = [(t, *m, 0, 0) for t, m in enumerate(masks)]
    probes = [(t, *m, *halves(1 << i if i >= 0 else 0)) for t, m in enumerate(masks) for i in [-1, *range(cuts[t], cuts[t + 1])]]

    def keyed(prefix: str, lookups: list) -> DataFrame:
        own = prints.select(F.col("f0").alias(f"{prefix}0"), F.col("f1").alias(f"{prefix}1"))
        fields = ["t", "m0", "m1", "s0", "s1"]
        listed = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(row, fields)]) for row in lookups])
        # At most a few hundred rows, which depend on the radius alone.
        fixed = F.broadcast(spark.range(1).select(F.inline(listed)))
        zero = (F.col(f"{prefix}0").bitwiseAND(F.col("s0")) == 0) & (F.col(f"{prefix}1").bitwiseAND(F.col("s1")) == 0)
        value = [F.col(f"{prefix}{h}").bitwiseOR(F.col(f"s{h}")).bitwiseAND(F.col(f"m{h}")) for h in range(HALVES)]
        same = (F.col("s0") == 0) & (F.col("s1") == 0)
        return own.join(fixed, zero).select(f"{prefix}0", f"{prefix}1", F.xxhash64("t", *value).alias(f"{prefix}k"), F.col("t").cast("byte").alias("t"), same.alias("same"))

    left, right = keyed("a", probes), keyed("b", tables).drop("t", "same")
    x = [F.col(f"a{h}").bitwiseXOR(F.col(f"b{h}")) for h in range(HALVES)]
    apart = F.bit_count(x[0]) + F.bit_count(x[1])
    first = F.lit(True)
    for t, m in enumerate(masks[:-1]):
        differ = F.bit_count(x[0].bitwiseAND(F.lit(m[0]))) + F.bit_count(x[1].bitwiseAND(F.lit(m[1])))
        first = first & ~((F.lit(t) < F.col("t")) & (differ <= 1))
    ordered = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    # The tables have a row per block, the lookups one per bit: the short side is hashed.
    on = (F.col("ak") == F.col("bk")) & (apart <= radius) & (~F.col("same") | ordered) & first
    return left.join(right.hint("shuffle_hash"), on).select("a0", "a1", "b0", "b1")


def near_counts(prints: DataFrame, radius: int, members: int = 512) -> DataFrame:
    """``(f0, f1, n_near)``: for each of ``prints(f0, f1)``, all distinct, how many others are at most ``radius`` bits apart.

    Fingerprints are cut into blocks of bits, at least ``radius // 2 + 1`` of them, so
    two within the radius differ in at most one bit of some block. Every block is a
    two within the radius differ in at most one bit of some block. Every block is a
    table of buckets; a fingerprint looks up its own bucket and those one bit away,
    and a pair counts in the first table in which it meets. Buckets of up to four times
    the members that evenly spread fingerprints would have are joined by row, where the
    comparison is compiled and a row is a close pair; of two buckets one bit apart only
    one is looked up then, and its pairs count on both sides. A fuller bucket holds many
    near copies: among these each is a list of ``members`` fingerprints or several such
    lists, and a lookup gives a number per list, so a large group of near copies has no
    row per pair.
    """
    blocks = max(9, radius // 2 + 1)
    cuts = [BITS * t // blocks for t in range(blocks + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [tuple(signed(((1 << b) - (1 << a)) >> (64 * h) & (1 << 64) - 1) for h in range(HALVES)) for a, b in zip(cuts, cuts[1:])]

    def bucket(t: int) -> Column:
        """Number of the table and the bits of the block, in one."""
        low, width = cuts[t], widths[t]
        if low >= 64 or low + width <= 64:
            bits = F.shiftrightunsigned(F.col(f"f{low // 64}"), low % 64)
        else:
            bits = F.shiftrightunsigned(F.col("f0"), low).bitwiseOR(F.shiftleft(F.col("f1"), 64 - low))
        return bits.bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(t << 32))

    own = spread(prints, "f0", "f1").select("f0", "f1", F.explode(F.array(*[bucket(t) for t in range(blocks)])).alias("k"))
    # At most as many rows as there are values of a block: 2 ** 15 for each of nine tables.
    sizes = durable(own.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    held_rows = sizes.agg(F.sum("n")).first()[0] or 0
    even = held_rows / blocks / 2 ** min(widths)
    # The rows of a bucket are read again for every lookup: a hash map of so many stays in a processor's cache.
    parts = min(4096, 1 + held_rows // CACHED)
    full = F.col("n") > max(16.0, 4 * even)
    small = F.broadcast(sizes.where(~full).select(F.col("k").alias("key")))
    large = F.broadcast(sizes.where(full).select(F.col("k").alias("key"), F.ceil(F.col("n") / members).cast("int").alias("lists")))
    of_table = lambda values, k: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.shiftrightunsigned(k, 32).cast("int"))
    marked = own.join(large.withColumnRenamed("key", "k"), "k", "left").select("f0", "f1", "k", F.col("lists").isNotNull().alias("full"))
    changes = F.array(*[F.lit(c).cast("long") for c in (0, *[1 << i for i in range(max(widths))])])
    asked = marked.select("*", F.explode(changes).alias("change")).where(F.col("change") < of_table([1 << w for w in widths], F.col("k")))
    asked = asked.select("f0", "f1", "full", F.col("k").bitwiseXOR(F.col("change")).alias("key"), (F.col("k").bitwiseAND(F.col("change")) == 0).alias("up"))

    def meets(other: list[Column]) -> Column:
        x = [F.col(f"f{h}").bitwiseXOR(other[h]) for h in range(HALVES)]
        apart = F.bit_count(x[0]) + F.bit_count(x[1])
        found = (apart <= radius) & (apart > 0)
        for t, m in enumerate(masks[:-1]):
            differ = sum((F.bit_count(x[h].bitwiseAND(F.lit(m[h]))) for h in range(HALVES) if m[h]), F.lit(0))
            found = found & ((F.lit(t) >= F.shiftrightunsigned("key", 32)) | (differ > 1))
        return found

    # Upwards into small buckets, and downwards into them from full ones.
    upward = asked.where("up or full").join(small, "key").select("f0", "f1", "key").repartition(parts, "key")
    held = own.select(F.col("k").alias("bucket"), F.col("f0").alias("g0"), F.col("f1").alias("g1")).join(small, F.col("bucket") == F.col("key")).drop("key").repartition(parts, "bucket")
    pairs = upward.join(held.hint("shuffle_hash"), (F.col("key") == F.col("bucket")) & meets([F.col("g0"), F.col("g1")]))
    one, other = F.struct("f0", "f1"), F.struct(F.col("g0").alias("f0"), F.col("g1").alias("f1"))
    blocks_differ = [F.col(f"f{h}").bitwiseXOR(F.col(f"g{h}")).bitwiseAND(of_table([m[h] for m in masks], F.col("key"))) != 0 for h in range(HALVES)]
    ends = pairs.select(F.inline(F.when(blocks_differ[0] | blocks_differ[1], F.array(one, other)).otherwise(F.array(one))))
    listed = own.withColumnRenamed("k", "key").join(large, "key").select("key", F.pmod(F.xxhash64("f0", "f1"), F.col("lists")).cast("int").alias("part"), "f0", "f1")
    listed = listed.groupBy("key", "part").agg(F.collect_list(F.struct("f0", "f1")).alias("members"))
    dense = asked.where("full").join(large, "key").select("f0", "f1", "key", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("part"))
    hits = dense.join(listed.hint("shuffle_hash"), ["key", "part"]).select("f0", "f1", F.size(F.filter("members", lambda y: meets([y["f0"], y["f1"]]))).alias("n"))
    counted = ends.groupBy("f0", "f1").agg(F.count("*").alias("n")).unionByName(hits.where("n > 0").groupBy("f0", "f1").agg(F.sum("n").alias("n")))
    return counted.groupBy("f0", "f1").agg(F.sum("n").alias("n_near"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, one row per row of ``docs``.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next`` and ``n_near``, the number of other fingerprints in
    the table at most ``radius`` bits away. The edited form replaces the last
    ``floor(n_chars / 2)`` code points by the first as many of the next document.
    Null text counts as empty; empty texts share a fingerprint; a table with one
    row is its own next document; an empty table gives no rows.
    """
    base = in_order(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = base.select("bucket", "place", "next_bucket", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    # The digest travels as four longs: fixed-width keys stay in the fast aggregate.
    words = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    rows = rows.select("*", *words)
    keys = ["bucket", "place", "next_bucket", "doc_id", "n_chars", "s0", "s1", "s2", "s3"]
    marked = durable(with_fingerprints(rows, keys, ["text", "edited"]), "fingerprints")
    w = Window.partitionBy("bucket").orderBy("place")
    opening = marked.where("place = 1").select(F.col("bucket").alias("next_bucket"), F.col("f0_0").alias("o0"), F.col("f0_1").alias("o1"))
    prints = durable(marked.select(F.col("f0_0").alias("f0"), F.col("f0_1").alias("f1")).distinct(), "prints")
    near = near_counts(prints, radius).withColumnsRenamed({"f0": "f0_0", "f1": "f0_1"})
    own, changed = [F.col("f0_0"), F.col("f0_1")], [F.col("f1_0"), F.col("f1_1")]
    following = [F.coalesce("n0", "o0"), F.coalesce("n1", "o1")]
    return (
        marked.withColumn("n0", F.lead("f0_0").over(w)).withColumn("n1", F.lead("f0_1").over(w))
        # One row per range of ids.
        .join(F.broadcast(opening), "next_bucket", "left")
        .join(near, ["f0_0", "f0_1"], "left")
        .select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), as_text([F.col(f"s{i}") for i in range(4)]).alias("edited_sha256"),
            as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
            likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"),
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
        )
    )
