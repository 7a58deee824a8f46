"""Language identification with language-bitmask n-gram filters.

All languages share one Bloom filter whose every position holds a bit per
language (a bit-sliced filter: slice ``l`` is the filter of language ``l``). The
AND of the positions of an n-gram gives all languages that contain it in one
lookup. A text counts the hits of each language; hits that chance alone would
give at the fill of its slice are taken off, and the largest count decides.

An n-gram belongs to a language if it is there in enough documents and about as
frequent as in the language where it is most frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.core import durable, exact_quantile
from sitelake.llm.frames import add_from_text, mix64

SIZES = (2, 3, 4)
HASHES = 3
#: Positions of the filter; a power of two. The model is this many longs.
POSITIONS = 1 << 19
#: Expected number of training documents per language.
PER_LANGUAGE = 2000
#: Characters handled at once.
SEGMENT = 1 << 20
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters than letters is one space, and so are both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = letter_table()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[keep]


def gram_hashes(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie in one text, and the owner of each."""
    wide, hashes, owners = codes.astype(np.uint64), [], []
    for n in SIZES:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + wide[i : i + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        hashes.append(mix64(h[inside] * np.uint64(0x9E3779B97F4A7C15)))
        owners.append(owner[:m][inside])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def places(hashes: np.ndarray, positions: int) -> list[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return [((low + np.uint64(j) * high) & np.uint64(positions - 1)).astype(np.int64) for j in range(HASHES)]


def segments(texts):
    """``(codes, owner)`` of texts, many short ones or a part of a long one at a time; n-grams are in one segment each."""
    reach = max(SIZES) - 1
    held, owners, size = [], [], 0
    for i, t in enumerate(texts):
        codes = letter_codes(t or "")
        for s in range(0, max(1, len(codes) - reach), SEGMENT):
            part = codes[s : s + SEGMENT + reach]
            held.append(part)
            owners.append(np.full(len(part), i))
            size += len(part)
            if size >= SEGMENT:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


@dataclass
class Filters:
    """The learned filter: languages by bit number, the masks, and the chance of a false hit per language."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, share of the text's n-grams that are the language's (less chance hits), and number of n-grams."""
        n, langs = len(texts), len(self.languages)
        hits, total = np.zeros((n, langs)), np.zeros(n)
        for codes, owner in segments(texts):
            hashes, of = gram_hashes(codes, owner)
            at = places(hashes, len(self.masks))
            mask = self.masks[at[0]]
            for p in at[1:]:
                mask = mask & self.masks[p]
            total += np.bincount(of, minlength=n)
            for l in range(langs):
                hits[:, l] += np.bincount(of[(mask >> l) & 1 == 1], minlength=n)
        real = np.maximum(0.0, (hits - total[:, None] * self.chance) / (1.0 - self.chance)) if langs else hits
        names, scores, shares = [], np.zeros(n), np.zeros(n)
        for i, t in enumerate(texts):
            if not langs or t is None or not any(map(str.isalpha, t)):
                names.append(UNDETERMINED)
                continue
            best = int(real[i].argmax())
            rest = float(np.delete(real[i], best).max()) if langs > 1 else 0.0
            names.append(self.languages[best])
            scores[i] = real[i, best] / (real[i, best] + rest) if real[i, best] > 0 else 0.0
            shares[i] = real[i, best] / total[i] if total[i] else 0.0
        return names, scores, shares, total


def learn(docs: DataFrame, positions: int = POSITIONS, per_language: int = PER_LANGUAGE, min_docs: int = 2, share: float = 0.4, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters from labelled ``docs``: about ``per_language`` documents of each language, drawn by a hash of ``key``.

    ``share``: how frequent an n-gram must be in a language, against the language
    where it is most frequent. Counting and setting the bits are Spark jobs; the
    driver gets at most ``positions`` rows. At most 63 languages.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h")).where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(64).collect()}
    if len(sizes) > 63:
        raise ValueError("more languages than bits of a mask")
    languages = sorted(sizes)
    rate = F.lit(0)
    for i, name in enumerate(languages):
        rate = F.when(F.col("lang") == name, F.lit(int(min(1.0, per_language / sizes[name]) * 1_000_000))).otherwise(rate)
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < rate).select("text", "lang")

    def count(batches):
        bit = {name: i for i, name in enumerate(languages)}
        for pdf in batches:
            for l, group in pdf.groupby("lang"):
                texts = group["text"].tolist()
                for codes, owner in segments(texts):
                    hashes, of = gram_hashes(codes, owner)
                    if not len(hashes):
                        continue
                    # Equal n-grams have one size and so lie in the order of their texts; the sort keeps it.
                    order = hashes.argsort(kind="stable")
                    h, o = hashes[order], of[order]
                    new = np.ones(len(h), bool)
                    new[1:] = h[1:] != h[:-1]
                    new_doc = new.copy()
                    new_doc[1:] |= o[1:] != o[:-1]
                    at = np.flatnonzero(new)
                    yield pd.DataFrame({
                        "gram": h[at].view(np.int64), "l": bit[l], "n": np.diff(np.append(at, len(h))), "d": np.add.reduceat(new_doc.astype(np.int64), at),
                    })

    counts = sample.mapInPandas(count, "gram long, l int, n long, d long").groupBy("gram", "l").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    totals = {r[0]: r[1] for r in counts.groupBy("l").agg(F.sum("n")).collect()}
    per = F.lit(1.0)
    for l, n in totals.items():
        per = F.when(F.col("l") == l, F.lit(float(n))).otherwise(per)
    weighed = counts.withColumn("f", F.col("n") / per)
    member = F.transform(F.filter("a", lambda x: (x["f"] >= share * F.array_max("a.f")) & (x["d"] >= min_docs)), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["l"]))
    masks = weighed.groupBy("gram").agg(F.collect_list(F.struct("f", "d", "l")).alias("a")).select(
        "gram", F.aggregate(member, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(m)).alias("mask")
    ).where("mask <> 0")

    def spread(batches):
        for pdf in batches:
            for p in places(pdf["gram"].to_numpy().view(np.uint64), positions):
                yield pd.DataFrame({"place": p, "mask": pdf["mask"]})

    bits = masks.mapInPandas(spread, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(positions, np.int64)
    table[bits["place"].to_numpy()] = bits["mask"].to_numpy()
    fill = np.array([((table >> l) & 1).mean() for l in range(len(languages))])
    return Filters(languages, table, fill**HASHES)


def identify(docs: DataFrame, filters: Filters, text: str = "text", names: tuple[str, ...] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score; the text alone decides.

    Null texts and texts without a letter are ``und`` with score 0. The score is
    the best language's share of the two best counts. A third and a fourth name add
    the share of the text's n-grams that are of the language and the number of all.
    The filters have a fixed size and are sent to every executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(texts: list) -> list:
        return list(shared.value.predict(texts)[: len(names)])

    return add_from_text(docs, text, dict(zip(names, ("string", "double", "double", "double"))), predict)


def floors(docs: DataFrame, filters: Filters, part: float = 0.5, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Per language the least share that a text of it should have: ``part`` of the exact median over all labelled texts."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").where(F.col("lang").isin(filters.languages))
    judged = identify(rows, filters, names=("__pred", "__score", "__share", "__grams")).where("__grams > 0").select("lang", "__share")
    # Judged once: the counts and the sizes below read the written shares.
    shares = durable(judged, "shares")
    return {r["lang"]: part * r["m"] for r in exact_quantile(shares, "__share", 0.5, by=["lang"], out="m").collect()}


def covered(floor: dict[str, float], lang: str, share: str, grams: str) -> Column:
    """Whether a text's share reaches the floor of its language, less two standard errors of as many n-grams; one hit at least."""
    least = F.lit(0.0)
    for name, f in sorted(floor.items()):
        least = F.when(F.col(lang) == name, F.lit(f)).otherwise(least)
    return (F.col(share) > 0) & (F.col(share) >= least - 2 * F.sqrt(least * (1 - least) / F.col(grams)))
