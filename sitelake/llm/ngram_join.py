"""Similarity join of documents on word n-grams, with Bayesian pruning of candidates.

1. Every text gives the set of its word 5-grams, a digest of the set and a MinHash
   signature. Documents with one set are one class and go on as one row.
2. Rows that agree on a band of the signature are candidates. A bucket is cut into
   blocks; a pair of blocks is one unit of work, so no bucket is one task's and no
   pairs are written out.
3. Within a unit the signatures are compared some values at a time. Agreement
   counts are binomial, so with a uniform prior the similarity has a beta
   posterior; a pair is dropped as soon as the chance that it reaches the
   threshold falls below the tolerance.
4. Survivors are verified exactly on their n-gram sets, each pair in the unit of the
   first band that it agrees in. A unit returns link counts and a spanning forest of
   its links, which is all that the components need.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm.components import components
from sitelake.llm.frames import add_from_text, mix64
from sitelake.llm.words import groups, shingles, words_of

N = 5
THRESHOLD = 0.8
#: MinHash values, and values per band: a pair at the threshold is missed by all 32 bands with probability 5e-8.
VALUES, ROWS = 128, 4
#: Values compared between two looks at the posterior.
STEP = 16
TOLERANCE = 1e-5
#: Members of a block; a unit of work has two blocks at most.
BLOCK = 512
_SEEDS = np.random.default_rng(97).integers(0, 2**63, (2, VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_sets(texts, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words than ``n`` make one n-gram, no words none."""
    out: list[np.ndarray] = []
    for _, part in groups(texts):
        w = words_of(part)
        grams, of = shingles(w.hash, w.text, n)
        cut = np.searchsorted(of, np.arange(w.n_texts + 1))
        out += [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signature(grams: np.ndarray) -> bytes:
    """MinHash values of a set as little-endian 32-bit numbers; all ones for the empty set."""
    low = np.full(VALUES, np.uint64(2**64 - 1))
    for i in range(0, len(grams), 512):
        part = grams[i : i + 512]
        low = np.minimum(low, (part[None, :] * _SEEDS[0][:, None] + _SEEDS[1][:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


@lru_cache
def least_matches(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> tuple[int, ...]:
    """For each look (after ``step``, ``2 * step``, ... values) the fewest matches a pair needs to go on.

    With a uniform prior and ``m`` of ``n`` matches the posterior is Beta(m + 1, n -
    m + 1); its mass above the threshold is the chance that a binomial of ``n + 1``
    trials at the threshold has at most ``m`` successes.
    """
    out = []
    for n in range(step, values + 1, step):
        term, total = (1.0 - threshold) ** (n + 1), 0.0
        for m in range(n + 1):
            total += term
            if total >= tolerance:
                break
            term *= (n + 1 - m) / (m + 1) * threshold / (1.0 - threshold)
        out.append(m)
    return tuple(out)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys: one row per signature, one column per band."""
    bands = VALUES // ROWS
    parts = signatures.reshape(len(signatures), bands, ROWS).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix64(key ^ parts[:, :, r])
    return key


def prune(sigs: np.ndarray, block: np.ndarray, band: int, needs: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` of a unit that may be similar and first agree in ``band``."""
    keys = bands_of(sigs)
    found_i, found_j = [], []
    cross = block.min() != block.max()
    for i in range(len(sigs) - 1):
        j = np.arange(i + 1, len(sigs))
        if cross:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        if band:  # all members agree in ``band``; pairs that agree earlier are another unit's
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        matches = np.zeros(len(j), np.int64)
        for k, need in enumerate(needs):
            if not len(j):
                break
            s = slice(k * STEP, (k + 1) * STEP)
            matches += (sigs[j, s] == sigs[i, s]).sum(axis=1)
            go = matches >= need
            j, matches = j[go], matches[go]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect what ``pairs`` connect, without circles."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def with_set_digest(docs: DataFrame, text: str = "text", out: str = "digest", n: int = N) -> DataFrame:
    """``docs`` with the digest of every row's n-gram set."""
    return add_from_text(docs, text, {out: "binary"}, lambda texts: [[set_digest(s) for s in gram_sets(texts, n)]])


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    def sketch(batches):
        for pdf in batches:
            sets = gram_sets(pdf["text"].tolist(), n)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "digest": [set_digest(s) for s in sets], "grams": [len(s) for s in sets],
                "signature": [signature(s) for s in sets],
            })

    return docs.mapInPandas(sketch, "doc_id long, digest binary, grams int, signature binary")


def _units(reps: DataFrame) -> DataFrame:
    """Units of work ``(unit, band, members array<struct<block, rep>>)``; buckets with the same members count once."""
    def keys(batches):
        bands = VALUES // ROWS
        for pdf in batches:
            if len(pdf):
                k = bands_of(np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(-1, VALUES))
                yield pd.DataFrame({"key": k.ravel().view(np.int64), "band": np.tile(np.arange(bands), len(pdf)), "rep": np.repeat(pdf["rep"].to_numpy(), bands)})

    rows = reps.where("grams > 0").select("rep", "signature").mapInPandas(keys, "key long, band int, rep long")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = (
        rows.join(shared, "key").withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.struct(F.col("own").alias("block"), "rep").alias("member"))
    )
    units = dealt.groupBy("key", "band", "low", "high").agg(F.array_sort(F.collect_list("member")).alias("members")).where(F.size("members") > 1)
    return units.groupBy("members").agg(F.min("band").alias("band")).select(F.monotonically_increasing_id().alias("unit"), "band", "members")


def _candidates(units: DataFrame, reps: DataFrame, needs: tuple[int, ...]) -> DataFrame:
    """``(unit, rep, partners)``: survivors of the pruning, one row per member of a surviving pair.

    ``partners`` are those of its pairs in which it comes first; a row per member and
    unit, however many pairs there are.
    """
    members = units.select("unit", "band", F.explode("members").alias("m")).select("unit", "band", "m.block", "m.rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        sigs = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(-1, VALUES)
        i, j = prune(sigs, pdf["block"].to_numpy(), int(pdf["band"].iloc[0]), needs)
        reps_ = pdf["rep"].to_numpy()
        involved = np.union1d(i, j)
        # Pairs come in the order of their first members.
        low, high = np.searchsorted(i, involved), np.searchsorted(i, involved, side="right")
        return pd.DataFrame({
            "unit": np.full(len(involved), pdf["unit"].iloc[0]), "rep": reps_[involved],
            "partners": pd.Series([reps_[j[x:y]] for x, y in zip(low, high)], dtype=object),
        })

    return members.join(reps.select("rep", "signature"), "rep").groupBy("unit").applyInPandas(compare, "unit long, rep long, partners array<long>")


def _verify(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(rep, links, other)``: link counts (``other`` null) and forest links (``links`` null) of every unit."""
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        sets_ = {r: np.frombuffer(g, "<u8") for r, g in zip(pdf["rep"], pdf["grams"])}
        links = [
            (int(a), int(b))
            for a, partners in zip(pdf["rep"], pdf["partners"])
            for b in partners if jaccard(sets_[a], sets_[b]) >= threshold
        ]
        ends = pd.Series([x for p in links for x in p], dtype="int64").value_counts()
        forest = _forest(links)
        return pd.concat([
            pd.DataFrame({"rep": ends.index.astype("int64"), "links": ends.to_numpy(), "other": None}),
            pd.DataFrame({"rep": [a for a, _ in forest], "links": None, "other": [b for _, b in forest]}),
        ], ignore_index=True).astype({"rep": "int64", "links": "Int64", "other": "Int64"})

    return candidates.join(sets, "rep").groupBy("unit").applyInPandas(check, "rep long, links long, other long")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, copy_of, n_copies, kept, digest``.

    Two different n-gram sets are linked if their Jaccard similarity is at least
    ``threshold``. ``n_links`` counts the different sets linked to that of the
    document, ``copy_of`` is the smallest id with the same set and ``n_copies`` the
    number of such rows, ``class_id`` the smallest id in the connected component.
    ``kept`` marks one row of each component, that of the smallest id. Null and
    empty texts, and texts of spaces, have the empty set: copies of each other,
    linked to nothing. Texts of fewer than ``n`` words have a single n-gram. Null
    ids come after all others. A pair is lost only with the probability of the
    bands (5e-8 at the threshold) or by the pruning (``tolerance``).
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = durable(_sketches(base, n).withColumn("row", F.monotonically_increasing_id()), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "grams", "signature")
    reps = rows.groupBy("digest").agg(F.min(order).alias("m"), F.count("*").alias("n_copies"))
    reps = durable(reps.select("digest", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("copy_of"), "m.grams", "m.signature", "n_copies"), "classes")
    units = durable(_units(reps), "units")
    candidates = durable(_candidates(units, reps, least_matches(threshold, tolerance)), "candidates")
    wanted = candidates.select("rep").distinct()
    wanted = durable(wanted.join(reps.select("rep", "copy_of", "digest"), "rep"), "wanted")
    texts = base.join(wanted.select(F.col("copy_of").alias("id")).distinct().hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def as_sets(batches):
        for pdf in batches:
            sets = gram_sets(pdf["text"].tolist(), n)
            yield pd.DataFrame({"digest": [set_digest(s) for s in sets], "grams": [s.tobytes() for s in sets]})

    sets = texts.mapInPandas(as_sets, "digest binary, grams binary").join(wanted.select("rep", "digest"), "digest").select("rep", "grams").dropDuplicates(["rep"])
    found = durable(_verify(candidates, sets, threshold), "links")
    degree = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    named = (
        reps.select("digest", "rep", "copy_of", "n_copies").join(degree, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    best = F.min(F.struct(F.col("copy_of").isNull().alias("z"), "copy_of", "rep")).alias("best")
    heads = named.groupBy("component").agg(best).select("component", F.col("best.copy_of").alias("class_id"), F.col("best.rep").alias("head"))
    classes = durable(named.join(heads, "component"), "heads")
    return rows.select("doc_id", "row", "digest").join(classes, "digest").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copy_of", "n_copies", (F.col("row") == F.col("head")).alias("kept"), "digest"
    )
