"""Ranked lexical search against a plain scorer, with small blocks and windows so that every branch runs."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.llm import lexical
from sitelake.llm.queries import prepare

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = defaultdict(list)
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out[item] += [(rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return {i: sorted(v, key=str) for i, v in out.items() if v}


def found_ranks(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v, key=str) for i, v in out.items()}


def test_terms():
    for t in ("", None, "A-b_c9 É é\x7fZ", "ÀB\tc\x00d e", "x" * 100_000 + " y"):
        assert [b.decode() for b in lexical.terms_of(t)] == plain_terms(t)


def test_search_of_a_block():
    """Skipping gives what adding up everything gives, ties included, for any floor."""
    rng = np.random.default_rng(5)
    skipped = 0
    for trial in range(60):
        n, n_terms = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        held = [np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.05, 0.3, 0.9])) for _ in range(n_terms)]
        held = [(t, d) for t, d in enumerate(held) if len(d)]
        if not held:
            continue
        stats = lexical.Statistics(n, n * 10, np.array([lexical.weight(n, 1 + int(rng.integers(n))) for _ in range(n_terms)]))
        tfs = [rng.integers(1, 3, len(d)) for _, d in held]
        sizes = rng.integers(1, 20, n)
        lists = lexical.Lists(sizes, np.array([t for t, _ in held]), np.array([len(d) for _, d in held]), np.concatenate([d for _, d in held]), np.concatenate(tfs), stats, window=16)
        times = rng.integers(1, 3, n_terms)
        full = np.zeros(n, np.int64)
        for (t, d), tf in zip(held, tfs):
            full[d] += times[t] * stats.weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + 25 * sizes[d] * n // (n * 10))))
        for floor in (0, int(np.median(full)), int(full.max())):
            docs, scores = lists.search(lexical.Query(0, np.arange(n_terms), times), 5, floor)
            want = sorted((-s, i) for i, s in enumerate(full.tolist()) if s > 0 and s >= floor)[:5]
            assert list(zip((-scores).tolist(), docs.tolist())) == want
            skipped += len(want) == 5
    assert skipped > 20


@pytest.mark.parametrize("block, window, query_bytes", [(7, 4, 60), (1 << 14, 2048, 4 << 20)])
def test_rank_documents(spark, docs_of, empty_docs, block, window, query_bytes):
    prepare(spark)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Aa", "the", "the", "the"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 25)))) for i in range(120)]
    rows += [(200 + i, "the same text, É w1") for i in range(30)] + [(7, "W1 again"), (7, "W1 again"), (None, "w2-w3"), (None, None), (300, ""), (301, "!?"), (302, "w4 " * 20_000)]
    docs = docs_of(rows).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    texts = [(1, "w1 w2 w2 É"), (2, "The same text"), (3, "nowhere"), (4, ""), (5, None), (6, "w3, w3; w4! aA"), (6, "w3, w3; w4! aA"), (None, "w5")]
    items = spark.createDataFrame(texts, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert found_ranks(lexical.rank_documents(docs, items, 20, block, window, query_bytes)) == plain_ranks(rows, list(dict.fromkeys(texts)), 20)
    assert lexical.rank_documents(empty_docs, items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs_of([(1, None), (2, "?")]), items).count() == 0
