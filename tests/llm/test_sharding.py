"""Jump consistent hashing against its one-key definition, slots and copies on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.core import DataContractError
from sitelake.llm import sharding
from sitelake.llm.queries import prepare


def one(key, shards):
    """The walk of one key in plain integers."""
    place, step = -1, 0
    while step < shards:
        place = step
        key = (key * 2862933555777941757 + 1) % 2**64
        step = int((place + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return place


def test_walk():
    keys = np.random.default_rng(3).integers(0, 2**64, 2000, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [one(int(k), n) for k in keys]
    # Fixed values of the published algorithm.
    assert sharding.jump_hash(np.array([1, 0xDEADBEEF, 256], np.uint64), 1024).tolist() == [549, 285, 520]
    assert not len(sharding.jump_hash(keys[:0], 5))
    with pytest.raises(DataContractError):
        sharding.jump_hash(keys, 0)


def test_growth_moves_the_necessary_fraction():
    keys = np.random.default_rng(4).integers(0, 2**64, 40000, dtype=np.uint64)
    before, after = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(after[before != after]) == {16}
    assert abs((before != after).mean() - 1 / 17) < 0.006
    assert max(Counter(before.tolist()).values()) < 1.06 * len(keys) / 16


def test_shard_documents(spark, docs_of, empty_docs):
    prepare(spark)
    rows = [(i, f"text {i}") for i in range(200)] + [(None, "x"), (None, None), (5, "text 5"), (5, "other"), (-7, ""), (2**62, "é" * 50_000)]
    docs = docs_of(rows).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(None)).withColumn("size", F.lit(1))
    got = sharding.shard_documents(docs, 16).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    places, slots = defaultdict(set), defaultdict(list)
    for r in got:
        places[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else -(2**63)))
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 16)
    assert all(len(p) == 1 for p in places.values())
    for s in slots.values():
        s.sort()
        assert [k for k, _ in s] == list(range(len(s))) and [i for _, i in s] == sorted(i for _, i in s)
    assert sharding.shard_documents(empty_docs).count() == 0


def test_other_keys_moves_and_files(spark, docs_of, tmp_path):
    prepare(spark)
    docs = docs_of([(i, f"t{i % 10}") for i in range(100)])
    by_text = sharding.with_shard(docs, 8, key="text")
    assert by_text.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n <> 1").count() == 0
    assert sharding.moved(docs, 8, 9).where("to_shard <> 8").count() == 0
    sharding.write_shards(docs, f"{tmp_path}/out", 8, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {(r.doc_id, r.shard) for r in sharding.with_shard(docs, 8).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want and back.count() == 100
    with pytest.raises(DataContractError):
        sharding.with_shard(by_text, 8)
