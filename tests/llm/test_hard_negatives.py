"""Hard negatives against a full comparison, bounds of every visited cell, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.llm import hard_negatives as hn
from sitelake.llm.queries import prepare

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    held = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        held.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for n, i, label, v in held:
        if i is None or i % every:
            continue
        positives = sorted(((score(v, w), j) for m, j, other, w in held if other == label and m != n), key=by)[:5]
        others = sorted(((score(v, w), j) for _, j, other, w in held if other != label), key=by)
        for ps, pid in positives:
            for rank, (s, j) in enumerate([x for x in others if 80 * ps <= 100 * x[0] <= 100 * ps][:5], 1):
                out[i, pid, rank, j, ps, s] += 1
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * 0.6
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_visits_cover_every_row_under_their_bounds():
    x = np.floor(clustered(900, 10, 1).astype(float) * 256)
    books = hn.Codebooks(10, "i2", 5, hn._fit(x[:400, :5], 6, 5), hn._fit(x[:400, 5:], 6, 5))
    index = hn.MultiIndex(x, books)
    for anchor in x[:20]:
        seen, bound = [], np.inf
        for rest, at, scores in index.visit(anchor):
            assert (scores == (x[at] @ anchor).astype(int)).all() and scores.max() <= bound
            seen += at.tolist()
            bound = rest
        assert sorted(seen) == list(range(900))


def test_visits_end_early():
    """On separated clusters most cells are left out, with the same result."""
    x = np.floor(clustered(6000, 4, 2).astype(float) * 256)
    books = hn.Codebooks(4, "i2", 2, hn._fit(x[:2000, :2], 24, 8), hn._fit(x[:2000, 2:], 24, 8))
    index, ids = hn.MultiIndex(x, books), np.arange(6000)
    seen = 0
    for a in range(20):
        counted = type("Counted", (), {"visit": lambda self, v: (seen_rows.append(len(at)) or (rest, at, s) for rest, at, s in index.visit(v))})()
        seen_rows = []
        places, scores = hn.nearest(counted, x[a], ids != a, ids, 5, -np.inf)
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[a]) if i != a)[:5]
        assert [(-s, p) for p, s in zip(places.tolist(), scores.tolist())] == want
        seen += sum(seen_rows)
    assert seen < 0.5 * 20 * 6000


@pytest.mark.parametrize("codewords, block, a_pass", [(3, 40, 2), (24, 1 << 14, 4096)])
def test_mine(spark, codewords, block, a_pass):
    prepare(spark)
    x = clustered(400, 6, 3)
    rows = [(i, x[i].tolist(), int(i * 7919 % 10 % 4)) for i in range(380)]
    # Ties and copies, repeated ids, odd vectors, nulls in every column.
    rows += [(1000 + i, x[0].tolist(), 1) for i in range(12)] + [(200, x[380].tolist(), 2), (200, x[381].tolist(), 2), (100, x[0].tolist(), 0)]
    rows += [(None, x[0].tolist(), 0), (None, x[1].tolist(), 2), (300, None, 1), (400, x[2].tolist(), None), (500, [1.0, None], 1), (600, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 2)]
    rows += [(800, [], 3), (900, [0.5], 3), (7, [-1.0, 0.0, 0.25, 0.0, 0.0, 0.0], 9)]
    df = spark.createDataFrame(rows, ROWS).repartition(3).withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("x", F.lit(2))
    got = hn.mine(df, codewords=codewords, block_rows=block, anchors_a_pass=a_pass).collect()
    assert Counter(tuple(r) for r in got) == plain(rows) and len(got) > 20
    assert hn.mine(df.limit(0)).count() == 0
    assert hn.mine(df.where("vec_id = 1")).count() == 0
    assert hn.mine(spark.createDataFrame([(100, None, 1), (200, [1.0], None)], ROWS)).count() == 0
    with pytest.raises(DataContractError):
        hn.mine(spark.createDataFrame([(100, [3e9], 1)], ROWS))
