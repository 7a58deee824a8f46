"""Hard negatives over an inverted multi-index.

Vectors are cut into two halves, and each half has a codebook of its own; a cell is
a pair of codewords. For an anchor, a codeword bounds the inner product of its half:
product with the codeword plus the anchor half's length times the radius of the
codeword. Cells are visited by the sum of the two bounds, largest first, with the
multi-sequence heap over both sorted lists; the next cell's bound tells what scores
are still possible, so a visit ends when the wanted window of scores is certain.

The codebooks come from a bounded sample. All rows are indexed, in blocks with radii
of their own, and every anchor is searched in every block; the blocks' results are
merged per anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.core import DataContractError, durable, running_totals

#: Codewords of a half, rows that they are fitted on, rounds of the fit.
CODEWORDS = 24
SAMPLE = 4096
ROUNDS = 8
#: Rows of a block, and anchors that are searched in one pass over the blocks.
BLOCK_ROWS = 1 << 14
ANCHORS = 1 << 12
#: Rows whose scores are computed at once.
VISIT = 512
#: Bounds are floating-point numbers and scores are integers; this covers the rounding.
SLACK = 0.25

BLOCK = "rows array<long>, ids array<long>, labels array<int>, vectors binary"


@dataclass
class Codebooks:
    """One codebook per half; the vectors are cut after ``cut`` of ``dim`` components and kept as ``kind``."""

    dim: int
    kind: str
    cut: int
    first: np.ndarray
    second: np.ndarray


def _fit(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Codewords by Lloyd's rounds from evenly spread points of the sample."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points if len(points) else np.zeros((1, points.shape[1]))
    words = points[np.linspace(0, len(points) - 1, k).astype(int)]
    for _ in range(rounds):
        at = _nearest(points, words)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, at, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1)[None] - 2 * points @ words.T, axis=1)


def taking_part(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(row, vec_id, label, x)`` of the rows with a label and a finite vector, ``x`` as integers.

    ``row`` tells rows of one id apart. A component becomes ``floor(256 * x)``.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    values = F.transform(F.col(vec), lambda x: x.cast("double"))
    usable = vectors.where(F.col("label").isNotNull() & F.col(vec).isNotNull() & ~F.exists(values, odd))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"),
        F.transform(values, lambda x: F.floor(x * 256)).alias("x"))


def fit_codebooks(rows: DataFrame, codewords: int = CODEWORDS, sample: int = SAMPLE) -> Codebooks:
    """Codebooks from at most ``sample`` rows, those with the smallest hash of their content."""
    dim, top = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    dim = dim or 0
    if dim * (top or 0) ** 2 >= 2**53:
        raise DataContractError(f"scores of {dim} components up to {top} are beyond exact arithmetic")
    taken = rows.select("x").orderBy(F.xxhash64("x", "row")).limit(sample).collect()
    points, cut = _padded([r.x for r in taken], dim), (dim + 1) // 2
    kind = "i2" if (top or 0) < 2**15 else "i4" if top < 2**31 else "i8"
    return Codebooks(dim, kind, cut, _fit(points[:, :cut], codewords, ROUNDS), _fit(points[:, cut:], codewords, ROUNDS))


def _padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def index_blocks(rows: DataFrame, books: Codebooks, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All ``rows`` as blocks of ``block_rows`` at most: row numbers, ids, labels and vectors, shorter vectors with zeros behind."""
    import pyarrow as pa

    def block(held: list) -> pa.RecordBatch:
        rows, ids, labels, vectors = zip(*held)
        values = [
            pa.array([list(rows)], pa.list_(pa.int64())), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(labels)], pa.list_(pa.int32())),
            pa.array([_padded(list(vectors), books.dim).astype(books.kind).tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(values, names=["rows", "ids", "labels", "vectors"])

    def run(batches: Iterator) -> Iterator:
        held: list = []
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append(item)
                if len(held) == block_rows:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return rows.select("row", "vec_id", "label", "x").mapInArrow(run, BLOCK)


class MultiIndex:
    """The cells of one block: rows sorted by cell, and the radius of each codeword that occurs."""

    def __init__(self, vectors: np.ndarray, books: Codebooks):
        self.books = books
        first, second = vectors[:, : books.cut], vectors[:, books.cut :]
        a, b = _nearest(first, books.first), _nearest(second, books.second)
        width = len(books.second)
        self.order = np.argsort(a * width + b, kind="stable")
        self.vectors = vectors[self.order]
        self.starts = np.searchsorted((a * width + b)[self.order], np.arange(len(books.first) * width + 1))
        self.halves = [self._half(first, a, books.first), self._half(second, b, books.second)]

    @staticmethod
    def _half(points: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codewords that occur, their numbers and radii."""
        far = np.zeros(len(words))
        np.maximum.at(far, at, np.sqrt(((points - words[at]) ** 2).sum(axis=1)))
        used = np.unique(at)
        return used, words[used], far[used]

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Batches of places with their scores, cells by falling bound; with each batch the bound of all that is left."""
        books, width = self.books, len(self.books.second)
        lists = []
        for half, (used, words, radii) in zip((anchor[: books.cut], anchor[books.cut :]), self.halves):
            bound = words @ half + np.sqrt(half @ half) * radii
            by = np.argsort(-bound, kind="stable")
            lists.append((bound[by], used[by]))
        (b1, c1), (b2, c2) = lists
        heap = [(-(b1[0] + b2[0]), 0, 0)] if len(b1) and len(b2) else []
        cells: list[int] = []
        size = 0
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = int(c1[i] * width + c2[j])
            if (n := self.starts[cell + 1] - self.starts[cell]) > 0:
                cells.append(cell)
                size += n
            # Each pair is pushed once: along the second list, and down the first from its head.
            if j + 1 < len(b2):
                heapq.heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(b1):
                heapq.heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))
            if size >= VISIT or (cells and not heap):
                at = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in cells])
                rest = -heap[0][0] + SLACK if heap else -np.inf
                yield rest, self.order[at], (self.vectors[at] @ anchor).astype(np.int64)
                cells, size = [], 0


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then smallest id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def nearest(index: MultiIndex, anchor: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of the ``wanted`` rows with a score of at least ``floor``: places and scores."""
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rest, at, s in index.visit(anchor):
        keep = wanted[at] & (s >= floor)
        if keep.any():
            places, scores = np.concatenate([places, at[keep]]), np.concatenate([scores, s[keep]])
            best = _top(scores, ids[places], k)
            places, scores = places[best], scores[best]
            if len(places) == k:
                floor = max(floor, int(scores[-1]))
        if rest < floor:
            break
    return places, scores


def in_windows(
    index: MultiIndex, anchor: np.ndarray, wanted: np.ndarray, ids: np.ndarray, k: int, windows: list[tuple[int, int]], floors: list[float]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window ``(low, high)`` of scores the ``k`` best of the ``wanted`` rows: places and scores.

    A window is certain once the bound of the rest is below its lower end, or below
    its k-th best score; rows of equal score are all seen, so ties fall by id. A row
    below its window's floor is left out.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
    need = [max(low, f) for (low, _), f in zip(windows, floors)]
    for rest, at, s in index.visit(anchor):
        keep = wanted[at] & (s >= min(need))
        at, s = at[keep], s[keep]
        for w, (_, high) in enumerate(windows):
            inside = (s >= need[w]) & (s <= high)
            if inside.any():
                places, scores = np.concatenate([found[w][0], at[inside]]), np.concatenate([found[w][1], s[inside]])
                best = _top(scores, ids[places], k)
                found[w] = places[best], scores[best]
                if len(best) == k:
                    need[w] = max(need[w], int(found[w][1][-1]))
        if rest < min(need):
            break
    return found


@dataclass
class Anchor:
    """An anchor row; ``windows`` are the distinct ranges of scores that its positives allow."""

    row: int
    label: int
    vector: np.ndarray
    windows: list[tuple[int, int]]


def search_blocks(blocks: DataFrame, books: Codebooks, anchors: list[Anchor], k: int) -> DataFrame:
    """Best rows of each block per anchor (``high`` null: same label) or per anchor and window (other labels).

    Returns ``anchor, high, row, vec_id, score``; ``high`` is the upper end of the
    window. A task raises its lower bounds with each block that it has searched.
    """
    import pyarrow as pa

    last = np.iinfo(np.int64).max

    def run(batches: Iterator) -> Iterator:
        floors = [[-np.inf] * max(1, len(a.windows)) for a in anchors]
        for batch in batches:
            for i in range(batch.num_rows):
                rows, labels = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 2))
                ids = batch.column(1)[i].values
                # Null ids come last among equal scores.
                order_ids = ids.fill_null(last).to_numpy(zero_copy_only=False)
                vectors = np.frombuffer(batch.column(3)[i].as_buffer(), books.kind).reshape(len(rows), books.dim).astype(np.float64)
                index = MultiIndex(vectors, books)
                out: list[list[np.ndarray]] = []
                for a, low in zip(anchors, floors):
                    same = labels == a.label
                    if a.windows:
                        parts = in_windows(index, a.vector, ~same, order_ids, k, a.windows, low)
                    else:
                        parts = [nearest(index, a.vector, same & (rows != a.row), order_ids, k, low[0])]
                    for w, (places, scores) in enumerate(parts):
                        if len(places) == k:
                            low[w] = max(low[w], int(scores[-1]))
                        out.append([np.full(len(places), a.row), np.full(len(places), a.windows[w][1] if a.windows else 0), places, scores])
                if out:
                    who, high, places, scores = (np.concatenate(c) for c in zip(*out))
                    at = pa.array(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who), pa.array(high), pa.array(rows).take(at), ids.take(at), pa.array(scores)],
                        names=["anchor", "high", "row", "vec_id", "score"])

    return blocks.mapInArrow(run, "anchor long, high long, row long, vec_id long, score long")


def _best(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, low: int = 80,
    codewords: int = CODEWORDS, block_rows: int = BLOCK_ROWS, anchors_a_pass: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of ``vectors(vec_id, embedding, label)``: of another label, and nearly as close as a positive.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. Anchors are the rows whose id is divisible by ``every``; a
    positive's negatives score from ``low`` percent of its score up to all of it, so
    a positive below 0 has none. Exact: all rows are indexed and only cells that
    cannot matter are left out. Rows with a null label or vector, or a null or
    non-finite component, take no part. A null id is no anchor and comes last among
    equal scores. Rows of one id are rows of their own: an anchor's copy can be its
    positive, and repeated anchors give their rows again. Shorter vectors count as
    filled with zeros; empty vectors score 0. Components so large that scores pass
    2^53 raise. An empty table gives an empty result; other columns are not read.

    ``anchors_a_pass`` anchors go through the driver at a time and are searched in
    one pass over the blocks.
    """
    spark = vectors.sparkSession
    rows = durable(taking_part(vectors), "vectors")
    books = fit_codebooks(rows, codewords)
    blocks = durable(index_blocks(rows, books, block_rows), "blocks")
    chosen = running_totals(rows.where(F.col("vec_id") % every == 0), ["row"], rank="number")
    chosen = durable(chosen.withColumn("part", F.floor((F.col("number") - 1) / anchors_a_pass)), "anchors")
    last = chosen.agg(F.max("part")).first()[0]
    parts = []
    for p in range(0 if last is None else last + 1):
        held = chosen.where(F.col("part") == p).select("row", "vec_id", "label", "x").collect()
        anchors = [Anchor(r.row, r.label, _padded([r.x], books.dim)[0], []) for r in held]
        near = durable(_best(search_blocks(blocks, books, anchors, positives), positives, ["anchor"]), "positives")
        windows: dict[int, set[tuple[int, int]]] = {}
        for r in near.where("score >= 0").select("anchor", "score").distinct().collect():
            windows.setdefault(r.anchor, set()).add((-(-low * r.score // 100), r.score))
        narrowed = [Anchor(a.row, a.label, a.vector, sorted(windows[a.row])) for a in anchors if a.row in windows]
        far = _best(search_blocks(blocks, books, narrowed, negatives), negatives, ["anchor", "high"])
        names = spark.createDataFrame([(r.row, r.vec_id) for r in held], "anchor long, anchor_id long")
        pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        far = far.select("anchor", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = pairs.join(far, ["anchor", "positive_score"]).join(names, "anchor")
        parts.append(durable(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
