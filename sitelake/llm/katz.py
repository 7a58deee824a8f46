"""Katz backoff language model over word bigrams, counted and evaluated where the texts are.

``P(w | h) = d(c(h, w)) c(h, w) / c(h)`` for bigrams seen in training, otherwise
``alpha(h) P(w)``; ``P(w)`` is the discounted unigram, and all unknown words
together get what the discounts leave. ``d`` are Good-Turing discounts of counts up
to ``CUT``. ``alpha(h)`` makes the probabilities of all words after ``h``, the
unknown word included, sum to exactly one.

Texts never move. A scan turns them into blocks: token numbers over the block's own
word list. A block asks for the counts of its distinct words, then of its distinct
bigrams; questions are dealt by word and by context to parts that add up the counts
of all blocks, keep them as the n-gram tables, and answer each block. Common
contexts are split over several parts by their second word and their sums are added
up afterwards, so no part holds one context whole.

N-grams are known by hashes: 64 bits for words, 64 + 48 for bigrams.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm.frames import mix64, parts_for, release
from sitelake.llm.words import groups, words_of

#: Good-Turing applies to counts up to this.
CUT = 5
#: Text bytes of a block, questions of a part, and the training count from which a context is split.
BLOCK_BYTES = 32 << 20
PART = 600_000
HOT = 1_000_000
#: Tokens of a block that are looked up at a time.
SLICE = 1 << 18
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

BLOCKS = "block long, n_tokens long, n_train long, doc_ids binary, nulls binary, train binary, lengths binary, words binary, tokens binary"
ANSWERS = "kind string, part int, block long, data binary, context long, sums array<double>, keys array<long>, seconds array<long>, counts array<int>"


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, most of them small, as quickly compressed byte planes."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def join(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def discounts(n_r: np.ndarray) -> np.ndarray:
    """Factors ``d[0..CUT]`` from ``n_r[r]``, the number of n-grams that occur ``r`` times, for ``r <= CUT + 1``.

    Where Good-Turing gives nothing between 0 and 1, as in very small tables,
    that count is discounted by a constant instead.
    """
    d = np.ones(CUT + 1)
    ones, twos = float(n_r[1]), float(n_r[2])
    flat = ones / (ones + 2 * twos) if ones > 0 else 0.5
    tail = (CUT + 1) * n_r[CUT + 1] / ones if ones > 0 else 1.0
    for r in range(1, CUT + 1):
        good = (r + 1) * n_r[r + 1] / (r * n_r[r]) if n_r[r] > 0 else 0.0
        value = (good - tail) / (1.0 - tail) if tail < 1.0 else 0.0
        d[r] = value if 0.0 < value < 1.0 else (r - flat) / r if flat < 1.0 else (r - 0.5) / r
    return d


@dataclass
class Unigrams:
    """Totals of the unigram table and what follows from them."""

    tokens: float
    types: float
    d: np.ndarray
    unknown: float

    @classmethod
    def of(cls, tokens: float, types: float, n_r: np.ndarray) -> Unigrams:
        d = discounts(n_r)
        left = sum(r * n_r[r] * (1 - d[r]) for r in range(1, CUT + 1)) / tokens if tokens else 1.0
        if left <= 0:  # nothing was discounted: every count is large
            left = types / (tokens + types) if tokens else 1.0
            d = d * (1 - left)
            return cls(tokens, types, np.append(d, 1 - left), left)
        return cls(tokens, types, np.append(d, 1.0), left)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, CUT + 1)] * c / max(self.tokens, 1.0), self.unknown)


def to_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of token numbers from ``docs(doc_id, text, train)``."""

    def build(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids, nulls, train, lengths, hashes, size = [], [], [], [], [], 0

        def block():
            n = np.concatenate(lengths)
            words, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = counts.argsort()[::-1]
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            flags = np.concatenate(train)
            return pd.DataFrame({
                "block": [base + made], "n_tokens": [int(n.sum())], "n_train": [int(flags.sum())], "doc_ids": [np.concatenate(ids).tobytes()],
                "nulls": [np.concatenate(nulls).tobytes()], "train": [flags.tobytes()], "lengths": [pack(n)],
                "words": [words[order].tobytes()], "tokens": [pack(number[tokens])],
            })

        for pdf in batches:
            known = pdf["doc_id"].notna().to_numpy()
            numbers = pdf["doc_id"].fillna(0).to_numpy(np.int64)
            flags = pdf["train"].to_numpy(bool)
            for first, part in groups(pdf["text"].tolist()):
                w = words_of(part)
                n, here = w.counts(), slice(first, first + len(part))
                hashes.append(np.insert(w.hash, np.cumsum(n), END))
                lengths.append(n + 1)
                ids.append(numbers[here])
                nulls.append(~known[here])
                train.append(flags[here])
                size += sum(map(len, part))
                if size >= BLOCK_BYTES:
                    yield block()
                    made += 1
                    ids, nulls, train, lengths, hashes, size = [], [], [], [], [], 0
        if ids:
            yield block()

    return docs.mapInPandas(build, BLOCKS)


def _by_part(of: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each value that occurs, in order: the work is that of the block, however many parts there are."""
    order = of.argsort(kind="stable")
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    return dict(zip(of[order[first]].tolist(), np.split(order, first[1:])))


class Block:
    """A block's arrays; ``count`` are the training counts of its words once they are known."""

    def __init__(self, row):
        self.words = np.frombuffer(row.words, "<u8")
        self.tokens = unpack(row.tokens).astype(np.int32)
        self.lengths = unpack(row.lengths)
        self.train = np.frombuffer(row.train, bool)
        self.doc_ids, self.nulls = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.nulls, bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.in_train = np.repeat(self.train, self.lengths)

    def word_parts(self, parts: int) -> dict[int, np.ndarray]:
        """Word numbers that go to each part that has any, in the order in which they are asked and answered."""
        return _by_part((mix64(self.words) % np.uint64(parts)).astype(np.int64))

    def take_counts(self, answers, parts: int) -> None:
        self.count = np.zeros(len(self.words), np.int64)
        at = self.word_parts(parts)
        for p, data in answers:
            self.count[at[p]] = unpack(data)

    def bigrams(self, parts: int, begin_count: int, hot: int) -> None:
        """Distinct bigrams, sorted by context, and the part of each."""
        n = len(self.words) + 1
        # One number per token's bigram, sorted; few arrays of the block's length are there at a time.
        keys = np.empty(len(self.tokens), np.int64)
        keys[1:] = self.tokens[:-1]
        keys[self.starts] = n - 1
        keys *= n
        keys += self.tokens
        ranked = np.sort(keys)
        new = np.ones(len(keys), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        pairs = ranked[new]
        del ranked, new
        self.pair_of = np.empty(len(keys), np.int32)
        for at in range(0, len(keys), SLICE):
            self.pair_of[at : at + SLICE] = np.searchsorted(pairs, keys[at : at + SLICE])
        del keys
        self.left, self.right = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs
        names = np.append(self.words, BEGIN)
        self.left_count = np.append(self.count, begin_count)
        self.splits = 1 + self.left_count // hot
        self.context = names[self.left]
        self.second = names[self.right] >> np.uint64(16)
        of = self.second % self.splits[self.left].astype(np.uint64)
        of *= np.uint64(0xD1342543DE82EF95)
        of += self.context
        of = (mix64(of) % np.uint64(parts)).astype(np.int32)
        self.by_part = _by_part(of)

    def heads(self, sel: np.ndarray) -> np.ndarray:
        """Where a new context begins among the bigrams ``sel``."""
        return np.flatnonzero(np.diff(self.left[sel], prepend=-1))


def ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                b = Block(row)
                seen = np.bincount(b.tokens[b.in_train], minlength=len(b.words))
                rows = [(p, row.block, join([b.words[s].tobytes(), pack(seen[s])])) for p, s in b.word_parts(parts).items()]
                yield pd.DataFrame(rows, columns=["part", "block", "data"])

    return blocks.mapInPandas(ask, "part int, block long, data binary")


def _rows(records: list[dict]) -> pd.DataFrame:
    """Records as ``ANSWERS`` columns; whole numbers keep all their bits where others are missing."""
    whole = {"part": "Int32", "block": "Int64", "context": "Int64"}
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    return pd.DataFrame({
        n: pd.array([r.get(n) for r in records], dtype=whole[n]) if n in whole else pd.Series([r.get(n) for r in records], dtype=object) for n in names
    })


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up a part's words: one table row, and one answer per block."""
    asked = [split(d) for d in pdf["data"]]
    keys = [np.frombuffer(a[0], "<u8") for a in asked]
    words, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpack(a[1]) for a in asked]), minlength=len(words)).astype(np.int64)
    part, cuts = int(pdf["part"].iloc[0]), np.cumsum([len(k) for k in keys])[:-1]
    seen = total > 0
    sums = [float(total.sum()), float(seen.sum()), *[float((total == r).sum()) for r in range(1, CUT + 2)]]
    out = [{"kind": "table", "part": part, "sums": sums, "keys": words[seen].view(np.int64), "counts": total[seen]}]
    out += [{"kind": "words", "part": part, "block": b, "data": pack(total[i])} for b, i in zip(pdf["block"], np.split(at, cuts))]
    return _rows(out)


def ask_bigrams(parts: int, begin_count: int, hot_count: int):
    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == "block"]
        row = next(own.itertuples())
        b = Block(row)
        answers = pdf[pdf["kind"] == "words"]
        b.take_counts(zip(answers["part"].astype(int), answers["data"]), parts)
        b.bigrams(parts, begin_count, hot_count)
        seen = np.bincount(b.pair_of[b.in_train], minlength=len(b.left))
        rows = []
        for p, sel in b.by_part.items():
            at = b.heads(sel)
            split_ = b.splits[b.left[sel[at]]] > 1
            rows.append((p, row.block, join([
                b.context[sel[at]].tobytes(), pack(np.diff(np.append(at, len(sel)))), split_.tobytes(),
                pack48(b.second[sel]), pack(seen[sel]), pack(b.count[b.right[sel]]),
            ])))
        return pd.DataFrame(rows, columns=["part", "block", "data"])

    return ask


def count_bigrams(unigrams: Unigrams):
    """Add up a part's bigrams: table row, answers, and partial sums of split contexts."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        heads, sizes, flags, seconds, seen, right = ([] for _ in range(6))
        for d in pdf["data"]:
            a = split(d)
            heads.append(np.frombuffer(a[0], "<u8"))
            sizes.append(unpack(a[1]))
            flags.append(np.frombuffer(a[2], bool))
            seconds.append(unpack48(a[3]))
            seen.append(unpack(a[4]))
            right.append(unpack(a[5]))
        contexts, at_context = np.unique(np.concatenate(heads), return_inverse=True)
        is_split = np.zeros(len(contexts), bool)
        is_split[at_context] = np.concatenate(flags)
        # One number per bigram: its context's number and its second word.
        context = np.repeat(at_context, np.concatenate(sizes))
        second = np.concatenate(seconds)
        order = np.lexsort((second, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (second[order][1:] != second[order][:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        total = np.bincount(at, weights=np.concatenate(seen), minlength=len(first)).astype(np.int64)
        known, owner = total > 0, context[first]
        lower = unigrams.probability(np.concatenate(right)[first])
        n, slots = len(contexts), CUT + 2
        by_count = np.bincount(owner[known] * slots + np.minimum(total[known], CUT + 1), minlength=n * slots).reshape(n, slots)[:, 1:]
        taken = np.bincount(owner[known], weights=lower[known], minlength=n)
        sums = [float((total == r).sum()) for r in range(1, CUT + 2)]
        out = [{"kind": "table", "part": part, "sums": sums, "keys": contexts[owner[known]].view(np.int64), "seconds": second[first][known].astype(np.int64), "counts": total[known]}]
        i = j = 0
        for b, h, s in zip(pdf["block"], heads, seconds):
            c = at_context[i : i + len(h)]
            out.append({"kind": "bigrams", "part": part, "block": b, "data": join([pack(total[at[j : j + len(s)]]), pack(by_count[c].ravel()), taken[c].tobytes()])})
            out += [{"kind": "uses", "block": b, "context": int(contexts[k].view(np.int64))} for k in c[is_split[c]]]
            i, j = i + len(h), j + len(s)
        out += [{"kind": "partial", "context": int(contexts[k].view(np.int64)), "sums": [*map(float, by_count[k]), float(taken[k])]} for k in np.flatnonzero(is_split)]
        return _rows(out)

    return count


def context_weights(by_count: np.ndarray, taken: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(alpha, scale)`` of contexts: ``by_count`` bigram types per count (the last: above the cut), ``taken`` their lower-order mass.

    Contexts that training lacks have alpha 1. Where no count is low enough to be
    discounted, seen bigrams are scaled down to leave room for as many tokens as
    there are types.
    """
    safe = np.maximum(count, 1).astype(float)
    left = (by_count[:, :CUT] * np.arange(1, CUT + 1) * (1.0 - d[1:])).sum(axis=1) / safe
    types = by_count.sum(axis=1)
    scale = np.where(left > 0, 1.0, safe / (safe + types))
    left = np.where(left > 0, left, types / (safe + types))
    return np.where(count > 0, left / np.maximum(1.0 - taken, 1e-300), 1.0), np.where(count > 0, scale, 1.0)


def score_block(parts: int, begin_count: int, hot_count: int, unigrams: Unigrams, d: np.ndarray):
    factor = np.append(d, 1.0)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Block(next(pdf[pdf["kind"] == "block"].itertuples()))
        words, pairs, hot = (pdf[pdf["kind"] == k] for k in ("words", "bigrams", "hot"))
        b.take_counts(zip(words["part"].astype(int), words["data"]), parts)
        b.bigrams(parts, begin_count, hot_count)
        del b.context, b.second, b.in_train  # only questions need them
        n, m = len(b.left_count), len(b.left)
        count, by_count, taken = np.zeros(m, np.int64), np.zeros((n, CUT + 1)), np.zeros(n)
        for p, data in zip(pairs["part"].astype(int), pairs["data"]):
            total, kinds, mass = split(data)
            sel = b.by_part[p]
            at = b.left[sel[b.heads(sel)]]
            count[sel] = unpack(total)
            by_count[at], taken[at] = unpack(kinds).reshape(-1, CUT + 1), np.frombuffer(mass, "<f8")
        if len(hot):
            names = np.append(b.words, BEGIN)
            order = names.argsort()
            for c, s in zip(hot["data"], hot["sums"]):
                at = order[np.searchsorted(names[order], np.uint64(int.from_bytes(c, "big")))]
                by_count[at], taken[at] = s[:-1], s[-1]
        del b.by_part
        alpha, scale = context_weights(by_count, taken, b.left_count, d)
        lower = unigrams.probability(b.count)
        logs = lower[b.right]
        logs *= alpha[b.left]
        seen = np.flatnonzero(count)
        at, c = b.left[seen], count[seen]
        logs[seen] = scale[at] * factor[np.minimum(c, CUT + 1)] * c / np.maximum(b.left_count[at], 1)
        del at, c, seen, count, b.left, b.right
        np.log10(logs, out=logs)
        base = np.log10((b.count + 1.0) / (unigrams.tokens + unigrams.types + 1.0))
        add = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731  every text has its end
        ids = pd.array(b.doc_ids, dtype="Int64")
        ids[b.nulls] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "held_out": ~b.train, "n_tokens": b.lengths, "n_known": np.add.reduceat((b.count > 0)[b.tokens], b.starts, dtype=np.int64),
            "train_tokens": int(unigrams.tokens), "base_score": add(base[b.tokens]), "score": add(logs[b.pair_of]),
        })

    return score


def _with_kind(df: DataFrame, kind: str | None = None) -> DataFrame:
    """``df`` in the columns of a block's working table."""
    names = [c.split() for c in ("kind string, part int, sums array<double>, data binary, " + BLOCKS).split(", ")]
    have = df.columns
    return df.select(*[
        (F.lit(kind) if n == "kind" and kind else F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in names
    ])


def score_documents(docs: DataFrame, is_train: Column, part_size: int = PART, hot_count: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Katz scores of all rows of ``docs``, learned from those where ``is_train`` holds.

    Columns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, one row per row. Null and empty texts are one end token. Repeated rows
    count as often as they are there. Without training rows everything is unknown
    and scores 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train"))
    blocks = durable(to_blocks(rows), "blocks")
    n_tokens, begin_count = (int(x or 0) for x in blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first())
    parts = parts_for(n_tokens, part_size)
    words = durable(ask_words(blocks, parts).groupBy("part").applyInPandas(count_words, ANSWERS), "unigrams")

    def totals(table: DataFrame, size: int) -> np.ndarray:
        got = table.where("kind = 'table'").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).first()
        return np.array([float(x or 0) for x in got])

    t = totals(words, CUT + 3)
    unigrams = Unigrams.of(t[0], t[1], np.append(0.0, t[2:]))
    mine = _with_kind(blocks, "block").unionByName(_with_kind(words.where("kind = 'words'")))
    asked = mine.groupBy("block").applyInPandas(ask_bigrams(parts, begin_count, hot_count), "part int, block long, data binary")
    bigrams = durable(asked.groupBy("part").applyInPandas(count_bigrams(unigrams), ANSWERS), "bigrams")
    d = discounts(np.append(0.0, totals(bigrams, CUT + 1)))
    del asked
    release(spark)
    partial = bigrams.where("kind = 'partial'")
    sums = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(CUT + 2)])
    hot = partial.groupBy("context").agg(sums.alias("sums"))
    uses = bigrams.where("kind = 'uses'").select("block", "context").distinct()
    # Names travel as bytes: as a nullable number pandas would round them.
    replies = uses.join(hot, "context").select("block", "sums", F.unhex(F.lpad(F.hex("context"), 16, "0")).alias("data"))
    work = mine.unionByName(_with_kind(bigrams.where("kind = 'bigrams'"))).unionByName(_with_kind(replies, "hot"))
    return work.groupBy("block").applyInPandas(
        score_block(parts, begin_count, hot_count, unigrams, d),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
