"""Exact duplicates through a minimal perfect hash over the digests seen before.

The history's distinct digests are split by their leading bits into parts of a
few thousand. In every part a minimal perfect hash (bit arrays by level: a
digest takes its place on the first level where no other digest falls on the
same bit; its slot is the rank of that bit) numbers the digests from 0 without
gaps. Slot ``i`` holds the full digest, the locator of the row that wins and the
number of rows. A lookup computes one slot and compares all 32 bytes, so a
digest that the history lacks is never taken for a member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm.frames import LOWER_TABLE, add_from_text, mix64, parts_for, utf8

#: Digests in one part of the index; a part is a single row of about a megabyte.
PART = 8192
GAMMA = 2.0
#: Locator and row count of a slot; its digest lies in a byte table beside it.
SLOT = np.dtype([("doc", "<i8"), ("known", "?"), ("row", "<i8"), ("n", "<i8")])


def text_digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256(utf8(text).translate(LOWER_TABLE)).digest()


def with_digest(docs: DataFrame, text: str = "text", out: str = "digest") -> DataFrame:
    """``docs`` with the digest of every row's whole text as a binary column."""
    return add_from_text(docs, text, {out: "binary"}, lambda texts: [[text_digest(t) for t in texts]])


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def _keys(digests: list[bytes] | np.ndarray) -> np.ndarray:
    """Eight middle bytes of each digest; the part number comes from the leading ones."""
    raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    return raw[:, 8:16].copy().view("<u8").ravel()


class PerfectHash:
    """Levels of bits over distinct 64-bit keys; ``slots`` numbers members from 0 to n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(b.sum()) for b in levels]])
        self.ranks = [np.cumsum(b) - 1 for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(8, int(len(left) * GAMMA))
            at = _places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 64:
                raise ValueError("two different digests share their key bytes")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; keys that never met the index get any slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = _places(keys[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(b).to_bytes(4, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, levels) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=4))[: int.from_bytes(x[:4], "little")].astype(bool) for x in levels])


def _part(parts: int):
    """Part of a digest from its first seven bytes, so parts are even whatever the texts are."""
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return (lead % F.lit(parts)).cast("int").alias("part")


def winners(rows: DataFrame) -> DataFrame:
    """``(digest, best, n)`` of ``rows(doc_id, row, digest)``: one row per distinct digest, combined before the shuffle."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col("row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).select("digest", "best.known", "best.doc", "best.row", "n")


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """Index rows ``(part, levels, slots, digests)`` over ``history(digest, known, doc, row, n)`` with distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(pdf["digest"])
        mph = PerfectHash.build(keys)
        slots = np.zeros(len(pdf), SLOT)
        at = mph.slots(keys)
        for name in ("doc", "known", "row", "n"):
            slots[name][at] = pdf[name].to_numpy()
        table = np.empty((len(pdf), 32), np.uint8)
        table[at] = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "levels": [mph.dump()], "slots": [slots.tobytes()], "digests": [table.tobytes()]})

    return history.select("*", _part(parts)).groupBy("part").applyInPandas(build, "part int, levels array<binary>, slots binary, digests binary")


def lookup(index: DataFrame, fresh: DataFrame, parts: int) -> DataFrame:
    """Merge ``fresh(digest, known, doc, row, n)`` into the index, one part at a time.

    Returns one row per distinct digest of either side: the winner's locator, the
    number of rows and whether the history holds it. Nonmembers come back as they
    are, grouped among themselves.
    """

    def merge(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = left.empty
        slots = np.zeros(0, SLOT) if empty else np.frombuffer(left["slots"].iloc[0], SLOT).copy()
        held = np.zeros((0, 32), np.uint8) if empty else np.frombuffer(left["digests"].iloc[0], np.uint8).reshape(-1, 32)
        asked = np.frombuffer(b"".join(right["digest"]), np.uint8).reshape(-1, 32)
        at = np.full(len(right), -1, np.int64)
        if not empty and len(right):
            at = PerfectHash.load(left["levels"].iloc[0]).slots(_keys(right["digest"]))
        same = at >= 0
        same[same] = (held[at[same]] == asked[same]).all(axis=1)
        for i in np.flatnonzero(same):
            s, r = slots[at[i]], right.iloc[i]
            if (bool(r["known"]), r["doc"], r["row"]) > (bool(s["known"]), s["doc"], s["row"]):
                s["known"], s["doc"], s["row"] = r["known"], r["doc"], r["row"]
            s["n"] += r["n"]
        old = pd.DataFrame({"digest": [x.tobytes() for x in held], **{c: slots[c] for c in ("known", "doc", "row", "n")}, "member": True})
        new = right.loc[~same, ["digest", "known", "doc", "row", "n"]].assign(member=False)
        return pd.concat([old, new], ignore_index=True)

    return index.groupBy("part").cogroup(fresh.select("*", _part(parts)).groupBy("part")).applyInPandas(
        merge, "digest binary, known boolean, doc long, row long, n long, member boolean"
    )


def exact_dedup(docs: DataFrame, is_history, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest, member)``, one row per row of ``docs``.

    ``is_history`` is a condition on ``doc_id`` that tells the rows seen before;
    their distinct digests make the index and the other rows are looked up in it.
    Of equal texts the row with the largest ``doc_id`` stays; rows without id only
    win among themselves, and of repeated rows with one id a single one stays.
    Null text counts as empty; empty texts equal each other.

    Rows are combined by digest before every shuffle but the last join, whose hot
    digests AQE splits.
    """
    tagged = with_digest(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).drop("text")
    rows = durable(tagged.withColumn("row", F.monotonically_increasing_id()), "digests")
    old = F.coalesce(is_history, F.lit(False))
    history = winners(rows.where(old))
    fresh = winners(rows.where(~old))
    parts = parts_for(rows.count(), PART)
    index = durable(build_index(history, parts), "index")
    groups = durable(lookup(index, fresh, parts), "groups")
    return rows.join(groups.withColumnsRenamed({"row": "best_row"}), "digest").select(
        "doc_id",
        F.when(F.col("known"), F.col("doc")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"),
        "digest",
        "member",
    )
