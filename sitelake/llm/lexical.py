"""Ranked lexical search: short lists summed first, long lists skipped over.

Documents are cut into blocks, and each block holds its own inverted lists of the
terms that the queries ask for. Within a block a query runs in two modes. Its short
lists are taken term at a time: their contributions are added up into accumulators.
The accumulators then act as one more list, with the largest sum as its bound, in a
document-at-a-time pass over the long lists. That pass goes window by window through
the documents in ascending order: it leaves out windows whose bounds cannot reach the
lowest score of the current best, makes candidates only from the lists without which
no document could reach it, and looks the candidates up in the others. The best of
all blocks are merged per query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import durable
from sitelake.llm.frames import LOWER_TABLE, utf8

#: ASCII other than digits and letters ends a term; A-Z are lower-cased.
_TERM_TABLE = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
TABLE = LOWER_TABLE.translate(_TERM_TABLE)
#: A block of documents ends at so many bytes of text or so many documents.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 14
#: Documents of a window of the pass over long lists.
WINDOW = 2048
#: Queries are taken in groups of about so many bytes of text; each group has its own lists.
QUERY_BYTES = 4 << 20
#: About so many blocks at most are searched beforehand for lower bounds of the best scores.
SEED_BLOCKS = 64

BLOCK = "ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, docs binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text, in UTF-8."""
    return utf8(text).translate(TABLE).split()


@dataclass
class Query:
    """Numbers of a query's distinct terms and how often it repeats each."""

    number: int
    terms: np.ndarray
    times: np.ndarray


def number_terms(texts: Sequence[tuple[int, str | None]]) -> tuple[dict[bytes, int], list[Query]]:
    known: dict[bytes, int] = {}
    queries = []
    for number, text in texts:
        counts = Counter(known.setdefault(t, len(known)) for t in terms_of(text))
        queries.append(Query(number, np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
    return known, queries


def index_blocks(docs: DataFrame, known: dict[bytes, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of ``docs(doc_id, text)``: ids, terms per document, and the lists of the ``known`` terms.

    Documents of a block are numbered by ascending id (nulls last); a list holds
    ascending document numbers and how often the term occurs.
    """
    import pyarrow as pa

    def block(ids: list, sizes: list, held: list[Counter]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        term = np.fromiter((t for i in order for t in held[i]), np.int64)
        tf = np.fromiter((c for i in order for c in held[i].values()), np.int64, len(term))
        doc = np.repeat(np.arange(len(ids)), [len(held[i]) for i in order])
        by = np.argsort(term, kind="stable")
        terms, lengths = np.unique(term, return_counts=True)
        values = [
            pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[sizes[i] for i in order]], pa.list_(pa.int64())),
            pa.array([terms.astype(np.int32)], pa.list_(pa.int32())), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([doc[by].astype(np.uint32).tobytes()]), pa.array([tf[by].astype(np.uint32).tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(values, names=["ids", "sizes", "terms", "lengths", "docs", "tfs"])

    def run(batches: Iterator) -> Iterator:
        ids, sizes, held, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text := text.as_py())
                found = Counter(map(known.get, words))
                found.pop(None, None)
                ids.append(i), sizes.append(len(words)), held.append(found)
                size += len(text or "")
                if size >= BLOCK_BYTES or len(ids) >= block_docs:
                    yield block(ids, sizes, held)
                    ids, sizes, held, size = [], [], [], 0
        if ids:
            yield block(ids, sizes, held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK)


@dataclass
class Statistics:
    """Documents with a term, all terms with repeats, and the weight of each known term."""

    documents: int
    total: int
    weights: np.ndarray


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def statistics(blocks: DataFrame, n_terms: int) -> Statistics:
    """Sums over all blocks; a number for each term of the queries reaches the driver."""
    sizes = blocks.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count("*"), F.sum("n")).first()
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "lengths")).alias("p")).select("p.*")
    df = np.zeros(n_terms, np.int64)
    for term, n in pairs.groupBy("terms").agg(F.sum("lengths")).collect():
        df[term] = n
    return Statistics(sizes[0], sizes[1] or 0, np.array([weight(sizes[0], int(n)) for n in df], np.int64))


class Lists:
    """The inverted lists of one block with the contribution of each entry and the largest of each window."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, lengths: np.ndarray, docs: np.ndarray, tfs: np.ndarray, stats: Statistics, window: int = WINDOW):
        top = int(sizes.max(initial=0))
        if 25 * top * stats.documents < 2**63:
            norm = 75 + (25 * sizes * stats.documents) // max(1, stats.total)
        else:  # beyond 64 bits: the same in Python's integers
            norm = np.array([75 + 25 * int(n) * stats.documents // stats.total for n in sizes], np.int64)
        term = np.repeat(np.arange(len(terms)), lengths)
        tfs = tfs.astype(np.int64)
        self.docs, self.n = docs.astype(np.int64), len(sizes)
        self.values = stats.weights[terms][term] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * norm[self.docs]))
        self.place = {int(t): k for k, t in enumerate(terms)}
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.window, self.windows = window, -(-self.n // window)
        cell = term * self.windows + self.docs // window
        self.cuts = np.searchsorted(cell, np.arange(len(terms) * self.windows + 1))
        self.tops = np.zeros((len(terms), self.windows), np.int64)
        if len(cell):
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            self.tops.ravel()[cell[first]] = np.maximum.reduceat(self.values, first)

    def search(self, query: Query, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents (numbers, scores) with a score of at least ``floor`` and above 0; equal scores by ascending number."""
        own = [(self.place[t], m) for t, m in zip(query.terms.tolist(), query.times.tolist()) if t in self.place]
        own.sort(key=lambda x: self.starts[x[0] + 1] - self.starts[x[0]])
        # Term at a time: the shortest lists, together no longer than an eighth of the documents.
        room, short = self.n // 8, 0
        while short < len(own) and (size := self.starts[own[short][0] + 1] - self.starts[own[short][0]]) <= room:
            room -= size
            short += 1
        summed_docs, summed, summed_cuts, summed_tops = self._summed(own[:short])
        long = own[short:]
        tops = np.array([self.tops[p] * m for p, m in long] + [summed_tops])
        reach = tops.sum(axis=0)
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(1, floor)
        for w in np.flatnonzero(reach >= floor).tolist():
            if reach[w] < floor:  # the floor has risen
                continue
            start = w * self.window
            lists = []
            for row, (p, m) in enumerate(long):
                a, b = self.cuts[p * self.windows + w], self.cuts[p * self.windows + w + 1]
                if a < b:
                    lists.append((int(tops[row, w]), self.docs[a:b], self.values[a:b], m))
            a, b = summed_cuts[w], summed_cuts[w + 1]
            if a < b:
                lists.append((int(summed_tops[w]), summed_docs[a:b], summed[a:b], 1))
            lists.sort(key=lambda x: x[0])
            # Lists whose bounds together stay below the floor make no candidates.
            left, optional = 0, 0
            while optional < len(lists) and left + lists[optional][0] < floor:
                left += lists[optional][0]
                optional += 1
            dense = np.zeros(self.window, np.int64)
            for _, docs, values, m in lists[optional:]:
                dense[docs - start] += values * m
            found = np.flatnonzero(dense >= max(1, floor - left))
            score = dense[found]
            found = found + start
            for top, docs, values, m in reversed(lists[:optional]):
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score = score + np.where(docs[at] == found, values[at] * m, 0)
                left -= top
                keep = score + left >= floor
                found, score = found[keep], score[keep]
            if not len(found):
                continue
            best_docs, best = np.concatenate([best_docs, found]), np.concatenate([best, score])
            if len(best) > k:
                order = np.lexsort((best_docs, -best))[:k]
                best_docs, best = best_docs[order], best[order]
            if len(best) == k:
                floor = max(floor, int(best.min()))
        order = np.lexsort((best_docs, -best))
        order = order[best[order] >= floor]
        return best_docs[order], best[order]

    def _summed(self, short: list[tuple[int, int]]):
        """Accumulators of the short lists: documents, sums, and per window their range and largest sum."""
        spans = [(slice(self.starts[p], self.starts[p + 1]), m) for p, m in short]
        tops = np.zeros(self.windows, np.int64)
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.windows + 1, np.int64), tops
        docs = np.concatenate([self.docs[s] for s, _ in spans])
        values = np.concatenate([self.values[s] * m for s, m in spans])
        by = np.argsort(docs, kind="stable")
        docs, values = docs[by], values[by]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        docs, sums = docs[first], np.add.reduceat(values, first)
        cuts = np.searchsorted(docs, np.arange(self.windows + 1) * self.window)
        np.maximum.at(tops, docs // self.window, sums)
        return docs, sums, cuts, tops


def search_blocks(blocks: DataFrame, queries: list[Query], stats: Statistics, k: int, floors: dict[int, int], window: int = WINDOW) -> DataFrame:
    """``(query, doc_id, score)``: what of each block may belong to a query's ``k`` best.

    ``floors`` are known lower bounds of the k-th best score; a task raises its own
    copy with each block that it has searched.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        floor = dict(floors)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, terms, lengths, docs, tfs = (batch.column(c)[i] for c in range(6))
                array = lambda c: c.values.to_numpy(zero_copy_only=False)
                number = lambda c: np.frombuffer(c.as_buffer(), np.uint32)
                lists = Lists(array(sizes), array(terms), array(lengths), number(docs), number(tfs), stats, window)
                who, which, scores = [], [], []
                for q in queries:
                    found, score = lists.search(q, k, floor.get(q.number, 0))
                    if len(found) == k:
                        floor[q.number] = max(floor.get(q.number, 0), int(score[-1]))
                    who.append(np.full(len(found), q.number))
                    which.append(found), scores.append(score)
                if who:
                    values = [pa.array(np.concatenate(who), pa.int64()), ids.values.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(scores))]
                    yield pa.RecordBatch.from_arrays(values, names=["query", "doc_id", "score"])

    return blocks.mapInArrow(run, "query long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query; the sort keeps ``k`` rows per query and task before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, block_docs: int = BLOCK_DOCS, window: int = WINDOW, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """The ``k`` highest-scoring documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Returns ``item_id, rank, doc_id, score``. All documents are searched for all
    items. Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, only A-Z lower-cased; null and empty texts have none, and a document
    without terms counts in no statistic and is never found. Every row is a document,
    so repeated rows and ids are ranked apart (equal scores by ascending id, null ids
    last). Repeated rows of ``items`` are one item; rows that share only an id are
    ranked each on its own under that id, null ids as well. Items without terms,
    or whose terms no document has, give no rows, as do empty tables. Other columns
    are not read. Items are taken in groups of about ``query_bytes`` of text,
    one at a time on the driver; the number of groups is the number of passes.
    """
    spark = docs.sparkSession
    items = durable(items.select(F.col("item_id").cast("long"), "text").where(F.length("text") > 0).distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // query_bytes))
    parts = []
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        known, queries = number_terms([(n, r.text) for n, r in enumerate(rows)])
        blocks = durable(index_blocks(docs, known, block_docs), "lists")
        stats = statistics(blocks, len(known))
        queries = [q for q in queries if len(q.terms)]
        # Any blocks give valid lower bounds; some of them, searched first, spare most rows of the others.
        seeds = blocks.where(F.pmod(F.xxhash64("ids"), F.lit(max(16, blocks.count() // SEED_BLOCKS))) == 0)
        lows = _best(search_blocks(seeds, queries, stats, k, {}, window), k).where(F.col("rank") == k)
        floors = {r.query: r.score for r in lows.collect()}
        best = _best(search_blocks(blocks, queries, stats, k, floors, window), k)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], "query long, item_id long")
        parts.append(durable(best.join(names, "query").select("item_id", "rank", "doc_id", "score"), "ranked"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
